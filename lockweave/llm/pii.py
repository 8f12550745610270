"""Personal data: fixed shapes, and identifiers that only their context gives away.

One pass over the texts finds the spans of four fixed shapes (the base) and, for
every base span and every other identifier-like run of signs, its lexical patterns:
the words around it, with neighbouring base spans as classes.  Spark then scores the
graph between patterns and values in rounds.  A pattern's confidence is the share
of its distinct values that are known to be of its kind; a value is known if it is a
base span somewhere, or as probably as its confident patterns together say.  Values
that are no base span but get known this way are the discovered spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockweave.llm.common import bounded, need, renamed, table, tidy

KINDS = ("email", "ip", "card", "phone")
#: A pattern counts if it has so many distinct known values and at least this confidence.
SUPPORT, CONFIDENCE = 5, 0.8
#: Rounds over the graph go on until no value is new and no score moves by more than STILL; past LIMIT rounds that is an error.
STILL, LIMIT = 1e-9, 200
#: Lists of spans of up to so many bytes are broadcast, so that texts aren't shuffled; larger ones are joined.
BROADCAST = 64 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Identifier-like runs that are no base span, with the kind that their signs suggest.
_LIKE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]{1,64}(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]{1,64}){0,4}")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){4,7}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9A-Za-z.])[0-9](?:[ -]?[0-9]){11,19}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+])(?:\([0-9]{2,4}\) ?)?[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,4}(?![0-9A-Za-z])")),
)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @ so that long runs of signs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), by start and then by the kinds' order."""
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(*m.span()[:1], 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and _luhn(d)]
    found += [(s, 3, e) for s, e in phones(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def mentions(text: str, base: list[tuple[int, str, int]]) -> list[dict]:
    """Base spans and other identifier-like runs, each with its value and patterns."""
    like: list[tuple[int, int, int]] = []
    if "@" in text or "(at)" in text or "[at]" in text or any(c in text for c in "0123456789"):
        for rank, (kind, shape) in enumerate(_LIKE):
            like += [(m.start(), rank, m.end()) for m in _around(text, kind)(shape)]
    spans = sorted([(s, -1, e, k) for s, k, e in base] + [(s, rank, e, _LIKE[rank][0]) for s, rank, e in like])
    free_from, base_at, out = 0, 0, list(base)
    starts = [s for s, _, _ in base]
    for s, rank, e, kind in spans:  # from left to right, none over another or over a base span
        if rank < 0:
            free_from = max(free_from, e)
            continue
        while base_at < len(starts) and starts[base_at] < s:
            base_at += 1
        if s >= free_from and not (base_at < len(starts) and starts[base_at] < e):
            out.append((s, kind, e))
            free_from = e
    by_end = {e: (s, k) for s, k, e in base}
    known = set(base)
    got = []
    for s, k, e in out:
        left: list[str] = []
        at = s
        while len(left) < 2 and at > 0:
            gap = at
            while gap > 0 and text[gap - 1] in " \t":
                gap -= 1
            if gap in by_end:  # a neighbouring base span stands for its class
                at, near = by_end[gap]
                left.append(f"<{near}>")
                continue
            begin = gap
            while begin > max(0, gap - 24) and not text[begin - 1].isspace():
                begin -= 1
            left.append(text[begin:gap].lower() or "\\n")
            at = begin
        right = (text[e : e + 24].split(None, 1) or [""])[0].lower()
        one, two = left[0] if left else "^", " ".join(reversed(left)) if left else "^"
        got.append({"kind": k, "start": s, "end": e, "base": (s, k, e) in known, "value": text[s:e].lower(), "patterns": [f"{two} _", f"{one} _ {right}"]})
    return got


def _around(text: str, kind: str):
    """Search only near the signs that a kind needs: a text without them costs one look."""
    if kind == "email":
        places = [m.start() for m in re.finditer(r"@|[\[(]at[\])]", text)]
        return lambda shape: (m for p in places if (m := next((x for x in shape.finditer(text, max(0, p - 66), p + 340) if x.start() < p < x.end()), None)))
    return lambda shape: shape.finditer(text)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: the base, and what the graph is made of."""
    import pyarrow as pa

    src = need(df, id_col, text_col).withColumn("text_key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    mention = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows: list[list] = [[] for _ in range(7)]
                for t in part.column(1):
                    text = t.as_py() or ""
                    base = base_spans(text)
                    n = [sum(k == kind for _, k, _ in base) for kind in KINDS]
                    line = written(base)
                    for col, x in zip(rows, [*n, hashlib.sha256(line.encode()).hexdigest(), line, mentions(text, base)], strict=True):
                        col.append(x)
                types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(mention)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *[pa.array(c, t) for c, t in zip(rows, types, strict=True)]], [id_col, "text_key", *[f"n_{k}" for k in KINDS], "base_sha256", "base_spans", "mentions"])
        tidy()

    return src.mapInArrow(
        run,
        f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, text_key bigint, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, base_spans string, "
        "mentions array<struct<kind:string,start:bigint,end:bigint,base:boolean,value:string,patterns:array<string>>>",
    )


def discover(graph: DataFrame) -> DataFrame:
    """``graph``: distinct kind, pattern, value, base.  Returns kind and value of what gets known without being base."""
    known = graph.where("base").select("kind", "value").distinct().withColumn("sure", F.lit(1.0))
    edges = table(graph.select("kind", "pattern", "value").distinct(), "edges")
    values = known = table(known, "known")
    before = known.limit(0)
    for _ in range(LIMIT):
        weighed = edges.join(values, ["kind", "value"], "left").withColumn("sure", F.coalesce("sure", F.lit(0.0)))
        patterns = weighed.groupBy("kind", "pattern").agg(F.avg("sure").alias("confidence"), F.count(F.when(F.col("sure") >= CONFIDENCE, 1)).alias("support"))
        good = table(patterns.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("kind", "pattern", "confidence"), "patterns")
        # independent patterns each fail with probability 1 - confidence
        doubt = edges.join(good, ["kind", "pattern"]).groupBy("kind", "value").agg(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))).alias("d"))
        news = doubt.join(known.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", (1 - F.exp("d")).alias("sure"))
        found = table(news, "found")
        both = found.join(before.withColumnRenamed("sure", "was"), ["kind", "value"], "full")
        moved = both.where(F.col("sure").isNull() | F.col("was").isNull() | (F.abs(F.col("sure") - F.col("was")) > STILL))
        if moved.isEmpty():
            return found.select("kind", "value")
        before, values = found, known.union(found)
    raise RuntimeError(f"discover: {LIMIT} rounds were not enough")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """All spans of every whole text.

    Columns: ``id_col``, n_email, n_ip, n_card, n_phone, base_sha256, base_spans and
    spans (all spans, kind:start:end by start and kind; code points, end exclusive).
    A discovered span that overlaps a base span isn't added.  Discovery looks at runs of
    signs in four shapes (``_LIKE``): addresses written out in parts of up to 64 signs,
    groups of hexadecimal digits, and 12 to 20 or grouped digits; other identifiers
    aren't candidates.  A pattern is one or two neighbouring words of up to 24 signs.  With ``keyed`` also
    text_hash, the built-in xxhash64 of the text.  Defined cases: a null
    or empty text has no spans; rows with a null or repeated id each give a row; an
    empty table gives none; further columns are not read.
    """
    found = table(scan(df, id_col, text_col).withColumnRenamed(id_col, "id"), "scanned")
    each = found.select("id", "text_key", F.explode("mentions").alias("m")).select("id", "text_key", "m.*")
    graph = each.select("kind", "value", "base", F.explode("patterns").alias("pattern"))
    news = discover(graph)
    spans = each.where("not base").join(news, ["kind", "value"]).select("id", "text_key", "kind", "start", "end")
    extra = spans.groupBy(F.col("id").alias("extra_id"), F.col("text_key").alias("extra_key")).agg(F.collect_set(F.struct("start", "kind", "end")).alias("extra"))
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    parts = F.transform(F.filter(F.split("base_spans", ","), lambda x: x != ""), lambda x: F.split(x, ":"))
    old = F.transform(parts, lambda x: F.struct(x[1].cast("long").alias("start"), rank[x[0]].alias("k"), x[2].cast("long").alias("end")))
    more = F.transform(F.coalesce("extra", F.array().cast("array<struct<start:bigint,kind:string,end:bigint>>")), lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("k"), x["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    every = F.transform(F.array_sort(F.concat(old, more)), lambda x: F.concat_ws(":", names[x["k"]], x["start"].cast("string"), x["end"].cast("string")))
    both = found.drop("mentions").join(extra, F.col("id").eqNullSafe(F.col("extra_id")) & (F.col("text_key") == F.col("extra_key")), "left")
    key = [F.col("text_key").alias("text_hash")] if keyed else []
    return both.select(F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS], "base_sha256", "base_spans", F.array_join(every, ",").alias("spans"), *key)


def replaced(text: str, spans: str) -> str:
    """``text`` with the spans' kinds in their place, in one pass from left to right."""
    out, done = [], 0
    for span in spans.split(","):
        kind, start, end = span.split(":")
        if int(start) >= done:
            out += [text[done : int(start)], f"<{kind}>"]
            done = int(end)
    return "".join([*out, text[done:]])


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every span of its texts replaced by its kind in angle brackets; all its columns stay.

    Spans are looked up by id and by the text's own hash, so repeated ids don't mix.
    Of overlapping spans the first is replaced, and the next one that starts after it.
    Texts without a span keep their value, null included.
    """
    import pyarrow as pa

    columns, (df, new) = df.columns, renamed(bounded(df))
    id_col, text_col = new[id_col], new[text_col]
    here = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    marked = df.withColumn("_text_key", here)
    found = find(marked.select(F.col(id_col), F.col(text_col)), id_col, text_col, keyed=True)
    spans = found.where("spans <> ''").groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).agg(F.min("spans").alias("_spans"))

    spans = table(spans, "spans")
    weight = spans.agg(F.coalesce(F.sum(F.length("_spans") + 64), F.lit(0)).alias("b")).first()["b"]
    side = F.broadcast(spans) if weight <= BROADCAST else spans
    both = marked.join(side, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_hash")), "left")
    at_text = list(new.values()).index(text_col)
    kept = [F.col(new[c]) for c in columns]
    schema = both.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, lists = list(batch.columns[:-1]), batch.column(batch.num_columns - 1)
            if lists.null_count < len(lists):
                texts = columns[at_text]
                columns[at_text] = pa.array([t.as_py() if not s.is_valid or not t.is_valid else replaced(t.as_py(), s.as_py()) for t, s in zip(texts, lists, strict=True)], texts.type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))
        tidy()

    return both.select(*kept, "_spans").mapInArrow(run, schema).select(*[F.col(new[c]).alias(c) for c in columns])
