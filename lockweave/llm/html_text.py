"""Main text of web pages by deducing each host's template from its pages.

A page is a sequence of tokens: elements, told apart by their path of open elements
(tag and first class), and texts, told apart by path and content.  Copies of a page are
one page, however many rows there are.  Over the pages of one host every token has an occurrence vector: how often each page holds it.  Tokens
with the same vector form an equivalence class; Spark finds classes by a hash of the
vector, a sum over pages, so that no host's pages ever meet in one task.

A class is valid if it occurs on enough of the host's pages, and nests into the
template below the class that holds its topmost tokens' parent path.  A text is fixed
if elements of some pages are of its class: wherever these are, it is, as often -- also
on a host with page types that share little.  What lies between is slots.  The element of the template
under which the most text varies, outside of menus and other such regions, is the
host's main element; its slots are the page's main text.  A page of a host with too
few pages, or one that lacks its host's main element, is judged by its own tokens;
one with fixed texts only keeps them, since nothing tells them from a text of its own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockweave.llm.common import need, table

#: A template, and a class with fixed texts, needs so many pages; a class is valid on this share of the host's.
PAGES, VALID = 4, 0.5
#: Templates of up to so many bytes in all are broadcast; larger ones are joined by host.
BROADCAST = 8 << 20

# HTML's own element kinds, and words that name regions other than the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
OUTSIDE = frozenset("nav footer aside form button dialog menu head input fieldset noscript template svg math object select".split())
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
REGIONS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended "
    "share sharing social notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments reply replies respond disqus pagination pager skip toolbar".split()
)
#: Words that stand beside a region's own in names such as main-nav or sidebar_left (fixed values of this library).
BESIDE = frozenset("left right top bottom main site page global primary secondary first last box bar list block wrapper wrap container section inner outer item items area unit slot link links content body text title form button icon icons row col column columns mobile desktop sticky fixed".split())
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_END = re.compile(r"""(?:[^>"']|"[^"<]*"|'[^'<]*')*+>""")
_WORD = re.compile(r"[a-z]+")
_SELF = re.compile(r"""[\s"']/$""")
#: Where a raw element without an end tag is taken to end.
_STOP = re.compile(rf"</?(?:{'|'.join(sorted(CLOSES_P | {'body', 'html', 'head'}))})(?=[\s/>])", re.I)


def parts(page: str) -> Iterator[tuple[str, str, str]]:
    """('open' | 'close' | 'text', name, attributes or text), leniently; raw elements' contents are left out."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", "", page[at:lt]
        if lt == n:
            return
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2 if page.startswith("<!-->", lt) else lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = nxt == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            if closing:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "", "<"
                at = lt + 1
            continue
        tag = name.group().lower()
        end = _END.match(page, name.end())
        stop = end.end() if end else page.find(">", name.end()) + 1 or n
        if closing:
            yield "close", tag, ""
        else:
            yield "open", tag, page[name.end() : stop - 1]
            if tag in RAW and not _SELF.search(page, name.end(), stop - 1):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, stop)
                if not close:
                    close = _STOP.search(page, stop)
                    yield "close", tag, ""
                stop = close.start() if close else n
        at = stop


def _names(value: str, words: frozenset[str]) -> bool:
    """Whether a class, id or role names one of the ``words``: by itself, or beside words of place and shape only."""
    for token in value.split():
        found = _WORD.findall(token)
        of = [w in words or w.rstrip("s") in words for w in found]
        if any(of) and all(o or w in BESIDE for o, w in zip(of, found, strict=True)):
            return True
    return False


def _region(tag: str, attrs: str, within: bool) -> tuple[str, bool]:
    """The element's name within a path, and whether it is a region other than the article.

    An article or main element is none, unless it is a reader's comment or lies ``within`` another one.
    """
    out = tag in OUTSIDE or tag in RAW
    if not attrs or ("class" not in attrs.lower() and "id" not in attrs.lower() and "role" not in attrs.lower()):
        return tag, out
    first, words = "", COMMENTS if tag in ("article", "main") and not within else REGIONS
    for k, a, b, c in _ATTR.findall(attrs):
        key, value = k.lower(), (a or b or c).lower()
        if key == "class":
            first = first or (value.split() or [""])[0].replace("/", "_")
        if key in ("class", "id", "role") and tag not in ("html", "body"):
            out = out or _names(value, words)
        if key == "hidden" or key == "aria-hidden" and value == "true":
            out = out or tag not in ("html", "body")
    return f"{tag}.{first}" if first else tag, out


def blocks(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(path, outside, text, kind): kind 'open' for an element's start, 'text' for a block of text, decoded, white space as one space."""
    stack: list[tuple[str, str, bool]] = []  # tag, path, outside
    held: list[str] = []

    def path() -> tuple[str, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else ("", False)

    def flush():
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        return text

    for kind, tag, rest in parts(page):
        if kind == "text":
            held.append(rest)
            continue
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
            continue
        if text := flush():
            yield *path(), text, "text"
        if kind == "open":
            if tag in CLOSES_P and any(s[0] in FOREIGN for s in stack):  # what an unclosed drawing can't hold ends it
                del stack[next(i for i, s in enumerate(stack) if s[0] in FOREIGN) :]
            if tag in CLOSES_P and stack and stack[-1][0] == "p":
                stack.pop()
            if stack and (tag == "li" and stack[-1][0] == "li" or tag in ("td", "th") and stack[-1][0] in ("td", "th") or tag in ("dt", "dd") and stack[-1][0] in ("dt", "dd") or tag in ("tr",) and stack[-1][0] in ("tr", "td", "th")):
                stack.pop()
            within = any(s[0] in ("article", "main") for s in stack)
            name, out = _region(tag, rest, within)
            up, above = path()
            # a header is a region of the page, or of an article an introduction
            out = out or above or tag == "header" and not within
            here = f"{up}/{name}"
            yield here, out, "", "open"
            if tag not in VOID and not rest.endswith("/"):
                stack.append((tag, here, out))
        else:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
    if text := flush():
        yield *path(), text, "text"


def main_of(mass: dict[str, tuple[int, bool]]) -> str:
    """The path of the main element, given each path's characters of (varying) text in its own blocks and whether it is outside.

    article and main are preferred; else from the body down, as long as one child holds most of the text.
    """
    total: dict[str, int] = {}
    for path, (n, out) in mass.items():
        if not out:
            steps = path.split("/")
            for i in range(2, len(steps) + 1):
                p = "/".join(steps[:i])
                total[p] = total.get(p, 0) + n
    for tag in ("article", "main"):
        own = [p for p in total if p.rsplit("/", 1)[1].split(".")[0] == tag and total[p]]
        if own:
            return max(own, key=lambda p: (total[p], -len(p), p))
    at = next((p for p in sorted(total, key=len) if p.rsplit("/", 1)[1].split(".")[0] == "body"), "")
    while at:
        below = [p for p in total if p.startswith(at + "/") and "/" not in p[len(at) + 1 :] and p.rsplit("/", 1)[1].split(".")[0] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "tr", "table", "ul", "ol")]
        best = max(below, key=lambda p: (total[p], p), default=None)
        if best is None or not total[best] or total[best] < 0.6 * total[at]:
            break
        at = best
    return at


def _key(path: str, text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{path}\0{text}") - (1 << 63)


def host_of(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def contents(pages: DataFrame, url_col: str, text_col: str) -> DataFrame:
    """host, page (a digest), html: each host's pages, copies once."""
    html = F.coalesce(F.col(text_col), F.lit(""))
    return pages.select(host_of(url_col).alias("host"), F.md5(html).alias("page"), html.alias("html")).dropDuplicates(["host", "page"])


def occurrences(src: DataFrame) -> DataFrame:
    """Per host and token of ``contents``: the hash of its occurrence vector, its pages, and its characters; summed over a batch already."""
    import pyarrow as pa

    names = ["host", "token", "path", "outside", "fixed", "vector", "pages", "n_chars"]
    types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            seen: dict[tuple, list] = {}
            for host, page, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own: dict[tuple, list[int]] = {}
                for path, out, text, kind in blocks(body or ""):
                    token = own.setdefault((_key(path, text), path, out, kind == "text"), [0, 0])
                    token[0] += 1
                    token[1] += len(text)
                for token, (n, chars) in own.items():
                    x = seen.setdefault((host, *token), [0, 0, 0])
                    x[0] += xxhash.xxh64_intdigest(f"{page}:{n}") >> 16
                    x[1] += 1
                    x[2] += chars
            rows = [(*k, v[0] & ((1 << 62) - 1), v[1], v[2]) for k, v in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)

    found = src.mapInArrow(run, "host string, token bigint, path string, outside boolean, fixed boolean, vector bigint, pages bigint, n_chars bigint")
    total = F.sum(F.col("vector").cast("decimal(38,0)")) % F.lit(1 << 62).cast("decimal(38,0)")
    return found.groupBy("host", "token", "path", "outside", "fixed").agg(total.cast("bigint").alias("vector"), F.sum("pages").alias("pages"), F.sum("n_chars").alias("n_chars"))


#: A path whose last element is an article or main.
_SEMANTIC = r"/(article|main)(\.[^/]*)?$"


def templates(pages: DataFrame, url_col: str, text_col: str) -> DataFrame:
    """One row per host that has a template: its main element's path and the keys of the fixed texts in it."""
    import pyarrow as pa

    src = contents(pages, url_col, text_col)
    tokens = table(occurrences(src), "tokens")
    sizes = src.select("host", "page").groupBy("host").agg(F.count("*").alias("n")).where(f"n >= {PAGES}")
    hosts = table(sizes, "hosts")
    shape = tokens.where("not fixed").join(hosts, "host")
    # a text is fixed if its class holds an element; what varies is all other text
    bound = shape.where(f"pages >= {PAGES}").select("host", "vector", "pages", F.lit(True).alias("whole")).distinct()
    text = table(tokens.where("fixed").join(hosts, "host").join(bound, ["host", "vector", "pages"], "left").select("host", "token", "path", "outside", "n_chars", F.coalesce("whole", F.lit(False)).alias("whole")), "texts")
    # half a host's pages hold each of these paths, so that no more of them go into a row than two pages have
    classes = shape.where(F.col("pages") >= VALID * F.col("n")).groupBy("host", "vector").agg(F.collect_set("path").alias("paths"))
    tree = classes.groupBy("host").agg(F.collect_list("paths").alias("tree"))

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth = lambda p: p.count("/")
        for batch in batches:
            hosts, paths = [], []
            for host, tree in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                valid: set[str] = set()
                for own in sorted(map(sorted, tree or []), key=lambda c: (min(map(depth, c)), c)):  # parents first: nesting
                    top = min(map(depth, own))
                    ups = {p.rsplit("/", 1)[0] for p in own if depth(p) == top}
                    if all(not up or up in valid for up in ups):
                        valid.update(own)
                hosts += [host] * len(valid)
                paths += sorted(valid)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], ["host", "up"])

    valid = table(tree.mapInArrow(nest, "host string, up string"), "valid")
    # a text under no element of the template counts for the nearest that is
    mass = text.groupBy("host", "path", "outside").agg(F.sum(F.when(F.col("whole") | F.col("outside"), 0).otherwise(F.col("n_chars"))).alias("n_chars"))
    steps = F.split("path", "/")
    above = mass.withColumn("up", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(steps))), lambda i: F.array_join(F.slice(steps, 1, i), "/"))))
    near = above.join(valid, ["host", "up"]).groupBy("host", "path", "outside").agg(F.max_by("up", F.length("up")).alias("up"), F.first("n_chars").alias("n_chars"))
    held = near.groupBy("host", "up").agg(F.sum("n_chars").alias("n_chars"), F.every("outside").alias("outside"))
    by_host = held.groupBy("host").agg(F.collect_list(F.struct("up", "n_chars", "outside")).alias("mass"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mains = [main_of({m["up"]: (m["n_chars"], m["outside"]) for m in mass}) for mass in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mains, pa.string())], ["host", "main"])

    mains = table(by_host.mapInArrow(choose, "host string, main string"), "mains")
    # within article and main all text counts, so only other hosts need the fixed texts, and of these those in the main element
    plain = mains.where(~F.col("main").rlike(_SEMANTIC) & (F.col("main") != ""))
    inside = (F.col("path") == F.col("main")) | F.startswith("path", F.concat("main", F.lit("/")))
    keys = text.where("whole and not outside").join(plain, "host").where(inside).groupBy("host").agg(F.collect_set("token").alias("keys"))
    return table(mains.join(keys, "host", "left").select("host", "main", F.coalesce("keys", F.array().cast("array<bigint>")).alias("keys")), "templates")


def extract_page(page: str, main: str | None, fixed: frozenset[int] | set[int]) -> str:
    """The main text of one page, given its host's template (main None: there is none)."""
    found = [(path, out, text) for path, out, text, kind in blocks(page) if kind == "text"]
    inside = lambda path, top: path == top or path.startswith(top + "/")
    if not main or not any(inside(p, main) and not out for p, out, _ in found):
        mass: dict[str, tuple[int, bool]] = {}
        for path, out, text in found:
            mass[path] = (mass.get(path, (0, out))[0] + len(text), out)
        main = main_of(mass)
    semantic = main.rsplit("/", 1)[-1].split(".")[0] in ("article", "main")
    own = [(path, text) for path, out, text in found if not out and (not main or inside(path, main))]
    varying = [text for path, text in own if semantic or not fixed or _key(path, text) not in fixed]
    return "\n".join(varying or [text for _, text in own])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """The main text of every whole page.

    Columns: ``id_col``, ``url_col``, text, n_chars.  Blocks come in page order, one a
    line, character references decoded.  Fixed texts of a template are left out
    except within an article or main element, whose text is the page's own even if
    other pages copy it, and of a page whose main element holds nothing else.  Of several
    article elements of unlike paths the one with the most text is the article.  Defined cases: a null or empty page has an empty text; a
    null url is of the host without a name; rows with a null or repeated id give a row
    each; an empty table gives none; further columns are not read.
    """
    import pyarrow as pa

    src = need(pages, id_col, url_col, text_col)
    known = templates(src, url_col, text_col)
    weight = known.agg(F.coalesce(F.sum(F.length("host") + F.length("main") + 8 * F.size("keys") + 64), F.lit(0)).alias("b")).first()["b"]
    side = F.broadcast(known) if weight <= BROADCAST else known
    rows = src.withColumn("_host", host_of(url_col)).join(side, F.col("_host") == F.col("host"), "left").select(id_col, url_col, text_col, "main", "keys")
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for body, main, keys in zip(*[batch.column(i) for i in (2, 3, 4)], strict=True):
                texts.append(extract_page(body.as_py() or "", main.as_py(), set(keys.as_py() or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint")
