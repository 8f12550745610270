"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lockweave.llm import byte_bpe, embedding_graph, html_text, line_dedup, packing, pii, quality, simhash, toxicity, warc
from lockweave.llm.common import table

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "word and another one\n" * 6000 + "x" * 50_000 + " end"
TEXTS = [(1, "The quick brown fox jumps over the lazy dog and runs away."), (2, None), (3, ""), (4, LONG), (5, "The quick brown fox jumps over the lazy dog and runs away."), (None, "no id here, a@b.co")]
#: Names that the operators use inside, as further columns of a table.
CLASH = ["n_tokens", "start", "fp", "component_id", "id", "score", "kept", "spans", "place", "stratum", "base", "_number", "_kept", "n", "text_key", "mentions", "host"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", *["clash"] * len(CLASH)) for i, t in [*TEXTS, TEXTS[0]]]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, {', '.join(f'`{c}` string' for c in CLASH)}").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")


def tokens(text):
    tok = packing.load(WORD).tok
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def test_packing(docs, none):
    rows = packing.pack(docs, WORD, keep=True).collect()
    assert packing.pack(none, WORD).collect() == []
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for doc, text in TEXTS:
        pieces = sorted(by_doc[doc], key=lambda r: r["start"])
        want = tokens(text)
        copies = 2 if doc == 1 else 1
        assert sum(p["length"] for p in pieces) == copies * len(want)
        if copies == 1:
            assert b"".join(bytes(p["ids"]) for p in pieces) == np.array(want, "<u4").tobytes()
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 2048 or at & (at - 1) == 0


def test_sum_of_squares_against_brute_force():
    """The chosen level is the one whose sum of squared counts is least, the fullest on ties."""
    rng = random.Random(3)
    p = packing.SumOfSquares(16)
    for i in range(400):
        s = rng.randint(1, 15)
        counts = p.count.copy()

        def total(at):
            c = counts.copy()
            if at:
                c[at] -= 1
            if at + s < 16:
                c[at + s] += 1
            return int((c[1:16] ** 2).sum())

        choices = [0, *[h for h in range(1, 17 - s) if counts[h]]]
        least = min(map(total, choices))
        assert p.level_for(s) == max(h for h in choices if total(h) == least)
        list(p.add(i, bytes(4 * s)))


def test_line_dedup(docs, none, spark):
    got = {r["doc_id"]: r for r in line_dedup.dedup(docs, report=True).collect()}
    assert line_dedup.dedup(none).collect() == []
    assert got[1]["text"] == TEXTS[0][1] and got[5]["text"] == "" and got[2]["text"] is None and got[3]["text"] == ""
    assert got[4]["text"].count("word and another") == 1 and got[4]["n_lines"] == 6001 and got[4]["n_kept"] == 2
    assert got[None]["text"] == TEXTS[-1][1] and got[1]["place"] == "clash"


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(1)
    lines = []
    for _ in range(120):
        base = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 40))]
        for _ in range(rng.randint(1, 4)):
            some = [w if rng.random() > 0.06 else f"v{rng.randint(0, 900)}" for w in base]
            rng.shuffle(some)
            lines.append(" ".join(some))
    lines += ["a b c d", "a b c d e", "d c b a", "", " \t"] + [" ".join([f"k{j}" for j in range(30)] + [f"z{i}"]) for i in range(80)]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 7]) for i in range(0, len(lines), 7)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, want = [], {}
    for i, t in enumerate(texts):
        kept = []
        for line in t.split("\n"):
            s = frozenset(line.split())
            if not s or not any(jaccard(s, o) >= 0.8 for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        want[i] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(df).collect()} == want
    # ids that leave no room for line numbers are ranked
    far = spark.createDataFrame([(i + (1 << 60), t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] - (1 << 60): r["text"] for r in line_dedup.dedup(far).collect()} == want


def test_line_dedup_large_group(spark, monkeypatch):
    """Near copies whose likeness to each other is near the bound: pairs stay a few a line, not a group a line."""
    verify, made, rng = line_dedup.verify, [], random.Random(1500)
    monkeypatch.setattr(line_dedup, "verify", lambda pairs, *more: made.append(pairs.count()) or verify(pairs, *more))
    lines = [" ".join(f"b{j}" if rng.random() > 0.09 else f"v{rng.randint(0, 99999)}" for j in range(27)) for _ in range(1500)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    sets = [frozenset(x.split()) for x in lines]
    assert got == {i: "" if any(jaccard(s, o) >= 0.8 for o in sets[:i]) else lines[i] for i, s in enumerate(sets)}
    assert sum(made) < 4 * len(lines), made


def components(n, linked):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_masks_cover_all_pairs_of_bits():
    ms = simhash.masks((1 << 64) - 1)
    for i in range(64):
        for j in range(i):
            assert any(not m >> i & 1 and not m >> j & 1 for m in ms)


def test_simhash_against_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        base = [f"t{rng.randint(0, 300)}" for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(w if rng.random() > 0.01 else "new" for w in base))
    texts += ["", None, "A b C", "a B c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import xxhash

    prints = []
    for t in texts:
        ws = (t or "").encode().lower().split()
        sh = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0)
    comp = components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == comp


def test_simhash_large_buckets(spark):
    """Buckets over the bound are dealt anew and lose no link."""
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(20)}
    start = rng.getrandbits(64)
    for _ in range(400):
        x = start
        for _ in range(rng.randint(1, 8)):
            x ^= 1 << rng.randint(0, 20)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    got = simhash.components(simhash.links(df, bucket=16)).collect()
    label = {r["node"] & ((1 << 64) - 1): r["component"] for r in got}
    comp = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    groups, mine = {}, {}
    for x, c in zip(fps, comp, strict=True):
        groups.setdefault(c, set()).add(x)
        mine.setdefault(label.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_simhash_cases(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 7 and simhash.near_duplicates(none).collect() == []
    by = {r["doc_id"]: r for r in got}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16 and by[3]["component_id"] == 2 and by[5]["component_id"] == 1
    kept = simhash.keep_first(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept if r["doc_id"]) == [(False, 1), (False, 2), (False, 4)]


PAGE = '<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One<br>two</p><p>Three {}<script>var x="</p>";</script></article><footer>Foot</footer></body></html>'


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a.org/1", PAGE.format(1)), (2, None, None), (3, "http://a.org/3", ""), (4, "http://a.org/4", PAGE.format("x" * 3000)), (5, "http://b.org/", PAGE.format("x" * 3000)), (6, "http://c.org", PAGE.format("x" * 3000)), (None, "http://d.org", "<p>loose &lt;text"), (4, "http://a.org/4", PAGE.format("x" * 3000))]
    return spark.createDataFrame([(*r, "c", "c", "c") for r in rows], "page_id long, url string, html string, digest string, id string, main string").repartition(3)


def test_warc(pages, spark):
    got = sorted(warc.round_trip(pages).collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))
    assert warc.round_trip(pages.where("page_id < 0")).collect() == []
    want = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert [r["page_id"] for r in got] == [1, 2, 3, 4, 4, 5, 6, None]
    for r in got:
        assert r["payload_bytes"] == len(want[r["page_id"]]) and r["payload_digest"] == hashlib.sha1(want[r["page_id"]]).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 6) if r["page_id"] in (4, 5) else ("response", None))


def test_warc_chunks_carry_digests(pages, spark):
    from lockweave.llm.common import new_path

    folder = new_path(spark, "w")
    found = warc.write(pages, folder)
    body = {str(r["page_id"]): (r["html"] or "").encode() for r in pages.collect()}
    rows = [r for r in warc.chunks(spark, folder, found, keep=True, size=100).collect() if r["record_type"] == "response" and r["record_id"]]
    for key in {r["record_id"] for r in rows}:
        own = sorted((r for r in rows if r["record_id"] == key), key=lambda r: r["chunk"])
        assert [r["chunk"] for r in own] == list(range(len(own))) and all(r["n_bytes"] <= 100 for r in own)
        so_far = b""
        for r in own:
            so_far += bytes(r["data"])
            assert r["digest"] == hashlib.sha1(so_far).hexdigest() and r["upto"] == len(so_far)
        assert so_far == body[key] and own[-1]["last"] and own[-1]["said"] == own[-1]["digest"]


def test_warc_ids_and_payloads_over_many_chunks(spark):
    """An empty id isn't a null one; payloads over several chunks come back whole; a revisit must match its response."""
    big = "é<p>" * 60_000
    rows = [("", "u", big), (None, "u", big), ("a:b", "u", big), ("z", "u", big + "x"), ("c", "u", "")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    n, d = len(big.encode()), hashlib.sha1(big.encode()).hexdigest()
    assert set(got) == {"", None, "a:b", "z", "c"}
    assert all((got[k]["payload_bytes"], got[k]["payload_digest"], got[k]["record_type"], got[k]["refers_to"]) == (n, d, "revisit", "a:b") for k in ("", None))
    assert (got["a:b"]["record_type"], got["a:b"]["payload_digest"], got["z"]["payload_bytes"], got["c"]["payload_bytes"]) == ("response", d, n + 1, 0)


def test_warc_checks_revisits(pages, monkeypatch):
    right = warc._record

    def wrong(page, url, body, digest, length, refers):
        return right(page, url, body, digest, length + (refers is not None), refers)

    monkeypatch.setattr(warc, "_record", wrong)
    with pytest.raises(ValueError, match="revisits"):
        warc.round_trip(pages).collect()


def test_html_long_page(spark):
    body = "\n".join(f"<p>para {i} of it</p>" for i in range(40_000))
    got = html_text.extract(spark.createDataFrame([(1, "http://x.org/a", f"<body><article>{body}</article></body>")], "page_id long, url string, html string")).first()
    assert got["text"] == "\n".join(f"para {i} of it" for i in range(40_000)) and got["n_chars"] == len(got["text"])


def test_html(pages):
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert html_text.extract(pages.where("page_id < 0")).collect() == []
    assert got[1]["text"] == "A & B\nOne two\nThree 1" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[None]["text"] == "loose <text"


def test_html_template_without_article(spark):
    """The main element is found by what varies; fixed texts and other regions go."""
    page = "<html><body><div class='top'>Site name</div><div class='box'><div class='inner'><p>Read more</p><p>{}</p></div></div><div id='comments'><p>{}</p></div><aside>{}</aside></body></html>"
    rows = [(i, f"http://x.org/{i}", page.format(" ".join(f"story{i}n{j}" for j in range(30)), f"me too {i}", f"side {i}")) for i in range(8)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == " ".join(f"story{r['page_id']}n{j}" for j in range(30)) for r in got)


def test_html_fixed_texts_of_page_types(spark):
    """A text that goes with the elements of one page type is fixed, however few of the host's pages are of that type."""
    page = "<html><body><div class='box'><div class='{}'><p>{}</p><p>{}</p></div></div></body></html>"
    story = lambda i: " ".join(f"story{i}n{j}" for j in range(30))
    rows = [(i, f"http://x.org/{i}", page.format(*(("report", "Read more") if i < 7 else ("talk", "Write a reply")), story(i))) for i in range(12)]
    # an article that most pages quote goes with no element
    rows += [(20 + i, f"http://y.org/{i}", page.format("report", "Read more", story(20 + i) + ("</p><p>quoted line" if i < 7 else "</p><p>another" + str(i)))) for i in range(10)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == story(i) for i in range(12))
    assert all(got[20 + i] == story(20 + i) + ("\nquoted line" if i < 7 else f"\nanother{i}") for i in range(10))


def test_html_keeps_copied_articles(spark):
    """Copies of an article are one page, and pages that share all of their main element's text keep it."""
    page = "<html><body><div class='box'><p>Read more</p><p>{}</p></div><aside>{}</aside></body></html>"
    story = lambda i: " ".join(f"story{i}n{j}" for j in range(30))
    rows = [(i, f"http://x.org/{i}", page.format(story(max(0, i - 30)), "")) for i in range(36)]  # 31 copies of one article
    rows += [(40 + i, f"http://y.org/{i}", page.format(story(40), f"side {i}")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == story(max(0, i - 30)) for i in range(36))
    assert all(got[40 + i] == f"Read more\n{story(40)}" for i in range(6))


def test_html_regions_are_named_by_whole_words():
    """Attributes are read one by one, region words count with words of place only, and nothing unclosed swallows the page."""
    cases = {
        '<div style="overflow:hidden"><p>Body</div>': "Body",
        '<div data-id="nav" data-state="hidden-print"><p>Body</div>': "Body",
        "<p>one<svg width=1 /><p>two": "one\ntwo",
        "<p>one<svg width=1><path d=1><p>two": "one\ntwo",
        "<p>one<script>var a<p>two</p>": "one\ntwo",
        "<p>one<script src=x /><p>two</p><script>b</script>": "one\ntwo",
        '<section class="social-science"><p>Body</section><p class="article-notice-free">too': "Body\ntoo",
        '<div class="main-nav left"><p>gone</div><div class="sidebar_2 box"><p>gone</div><p>Body': "Body",
        '<article>Text<article class="comment">gone</article></article>': "Text",
        '<article>Text<div id="comment-list"><p>gone</div></article>': "Text",
        '<article class="post sidebar-left">Text</article>': "Text",
        "<noscript><p>gone</noscript><select><option>gone</select><p>Body": "Body",
    }
    for page, want in cases.items():
        assert html_text.extract_page(f"<html><body>{page}</body></html>", None, set()) == want, page


def plain_templates(pages):
    """main and fixed (path, text) pairs of one host's pages, in plain dictionaries."""
    pages = sorted(set(pages))
    vectors, outside, mass = {}, {}, {}
    for i, page in enumerate(pages):
        for path, out, text, kind in html_text.blocks(page):
            own = vectors.setdefault((kind, path, text), [0] * len(pages))
            own[i] += 1
            outside[path] = out
    held = lambda v: sum(n > 0 for n in v)
    shapes = {tuple(v) for (kind, _, _), v in vectors.items() if kind == "open" and held(v) >= 4}
    fixed = {(path, text) for (kind, path, text), v in vectors.items() if kind == "text" and tuple(v) in shapes}
    classes = {}
    for (kind, path, _), v in vectors.items():
        if kind == "open" and held(v) >= len(pages) / 2:
            classes.setdefault(tuple(v), set()).add(path)
    valid = set()
    for own in sorted(map(sorted, classes.values()), key=lambda c: (min(p.count("/") for p in c), c)):
        top = min(p.count("/") for p in own)
        if all(p.rpartition("/")[0] in {"", *valid} for p in own if p.count("/") == top):
            valid |= set(own)
    for (kind, path, text), v in vectors.items():
        near = max((p for p in valid if path == p or path.startswith(p + "/")), key=len, default=None)
        if kind == "text" and near:
            n, out = mass.get(near, (0, True))
            more = 0 if (path, text) in fixed or outside[path] else len(text) * sum(v)
            mass[near] = (n + more, out and outside[path])
    return html_text.main_of(mass), fixed


def test_html_against_brute_force(spark):
    """Generated hosts of several page types, most without an article element; templates change what is found."""
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    rows = []
    for h in range(8):
        fixed = [words(rng.randint(2, 9)) for _ in range(8)]
        kinds = [(f"k{h}a", rng.sample(fixed, 3)), (f"k{h}b", rng.sample(fixed, 2))]
        for i in range(rng.randint(3, 16)):
            kind, lines = rng.choice(kinds[: 1 + h % 2])
            body = [f"<p>{words(rng.randint(20, 40))}</p>" for _ in range(rng.randint(1, 4))]
            body += [f"<div class='s{j}'>{x}</div>" for j, x in enumerate(lines)]
            rng.shuffle(body)
            tag = "article" if h == 5 else "div"
            page = f"<html><body><div class='top'>{fixed[0]}</div><{tag} class='{kind}'>{''.join(body)}</{tag}><div class='x'>{fixed[1]}<p>{words(2)}</p></div></body></html>"
            rows += [(len(rows) + j, f"http://h{h}.org/{i}", page) for j in range(rng.choice((1, 1, 3)))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    changed = 0
    by_host = {}
    for _, url, page in rows:
        by_host.setdefault(url.split("/")[2], []).append(page)
    plain = {h: plain_templates(p) if len(set(p)) >= 4 else (None, set()) for h, p in by_host.items()}
    for i, url, page in rows:
        main, fixed = plain[url.split("/")[2]]
        want = html_text.extract_page(page, main, {html_text._key(*k) for k in fixed})
        assert got[i] == want
        changed += want != html_text.extract_page(page, None, set())
    assert changed > len(rows) / 4


def test_malformed_html():
    for text in ["<", "<<p>a", "<p", "a<!-- b", "<script>x", "</", "<a href='x>y", "&#xZZ; &amp", "<p>a<p>b</div></p>"]:
        list(html_text.blocks(text))


def test_pii_cases(docs, none):
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert pii.find(none).collect() == [] and got[None]["n_email"] == 1 and got[None]["spans"] == "email:12:18"
    assert got[2]["base_sha256"] == got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    cut = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert cut[None]["text"] == "no id here, <email>" and cut[2]["text"] is None and cut[1]["spans"] == "clash"


def test_pii_discovers_by_context(spark):
    rows = [(i, f"words here, mobile no: +1 (264) 555-{1000 + i} and more of it {i}") for i in range(40)] + [(100, "mobile no: 555-123-9876 and more"), (101, "in all 555-123-4444 of them")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "phone:11:23" and got[101] == ""


def test_pii_discovers_by_long_chains(spark):
    """Each level's values are found by a pattern that counts only once the level before is known."""
    rows = []
    for level in range(1, 9):
        new = [f"v{i}_{j}" for i in (level - 1, level) for j in range(5) if i]
        rows += [("email", f"p{level}", f"base{j}", True) for j in range(30)] + [("email", f"p{level}", v, False) for v in new]
    found = pii.discover(spark.createDataFrame(rows, "kind string, pattern string, value string, base boolean").distinct()).collect()
    assert {r["value"] for r in found} == {f"v{i}_{j}" for i in range(1, 9) for j in range(5)}


def test_pii_discovers_planted_identifiers_of_each_kind(spark):
    """Identifiers without a fixed shape are found where known ones stand too, and nowhere else."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    def luhn(ok):
        while True:
            d = "".join(rng.choice("0123456789") for _ in range(16))
            if pii._luhn(d) == ok:
                return d
    known = {"email": lambda: f"{word()}@{word()}.org", "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "card": lambda: luhn(True), "phone": lambda: f"+1 (264) 555-{rng.randint(1000, 9999)}"}
    other = {"email": lambda: f"{word()} [at] {word()} [dot] org", "ip": lambda: ":".join(f"{rng.randint(4096, 65535):x}" for _ in range(8)), "card": lambda: luhn(False), "phone": lambda: f"555-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}"}
    lead = {"email": "write to", "ip": "logged from", "card": "paid with", "phone": "mobile no:"}
    rows, planted = [], set()
    for kind in pii.KINDS:
        for i in range(60):
            rows.append(f"{word()} {lead[kind]} {known[kind]()} {word()}")
        for i in range(12):
            rows += [f"{word()} {lead[kind]} {(x := other[kind]())} {word()}", f"{word()} {word()} {other[kind]()} {word()}"]
            at = len(word()) + 2 + len(lead[kind])
            planted.add((len(rows) - 2, f"{kind}:{at}:{at + len(x)}"))
    got = pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    found = {(r["doc_id"], s) for r in got for s in set(filter(None, r["spans"].split(","))) - set(filter(None, r["base_spans"].split(",")))}
    assert found == planted


def test_pii_scores_against_brute_force(spark):
    """Random graphs: rounds over plain dictionaries give the same values."""
    rng = random.Random(6)
    for _ in range(3):
        values = {f"v{i}": rng.random() < 0.85 for i in range(120)}
        graph = {(f"p{rng.randint(0, 30)}", v) for v in values for _ in range(rng.randint(1, 3))}
        base = {v for v, b in values.items() if b}
        sure, before = dict.fromkeys(base, 1.0), None
        while before != sure:
            before, by = sure, {}
            for p, v in graph:
                by.setdefault(p, []).append(sure.get(v, 0.0))
            good = {p: sum(s) / len(s) for p, s in by.items() if sum(x >= 0.8 for x in s) >= 5 and sum(s) / len(s) >= 0.8}
            sure = dict.fromkeys(base, 1.0)
            for v in set(values) - base:
                doubt = [max(1e-9, 1 - good[p]) for p, w in sorted(graph) if w == v and p in good]
                if doubt:
                    sure[v] = round(1 - float(np.prod(doubt)), 12)
        rows = [("email", p, v, v in base) for p, v in graph]
        got = {r["value"] for r in pii.discover(spark.createDataFrame(rows, "kind string, pattern string, value string, base boolean")).collect()}
        assert got == set(sure) - base and got


def test_pii_replaces_many_spans():
    text = "a@b.co " * 5000
    spans = pii.written(pii.base_spans(text))
    assert pii.replaced(text, spans) == "<email> " * 5000
    assert pii.replaced("abcdef", "email:1:4,phone:2:3,card:4:5") == "a<email><card>f"


def test_string_kernel_against_brute_force():
    """Common gapped subsequences of three characters, counted one by one."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 14))) for _ in range(40)]

    def parts(w):
        w = "\2" + w
        return [(w[i] + w[j] + w[k], toxicity.GAP ** (k - i - 2)) for i in range(len(w)) for j in range(i + 1, len(w)) for k in range(j + 1, min(len(w), i + 5))]

    def kernel(a, b):
        x, y = parts(a), parts(b)
        size = lambda z: (sum(w * w for _, w in z) + 1e-9) ** 0.5
        return min(1, sum(v * w for s, v in x for t, w in y if s == t) / (size(x) * size(y))) ** toxicity.POWER

    got = toxicity.Landmarks(words[:15]).kernel(words)
    assert np.allclose(got, [[kernel(a, b) for b in words[:15]] for a in words], atol=1e-4)


def test_greatest_values_of_each_document():
    rng = np.random.default_rng(3)
    docs, values = np.sort(rng.integers(0, 30, 300)), rng.normal(size=300)
    got = toxicity.greatest(values, docs, 31)
    for d in range(31):
        want = sorted((v for v in values[docs == d] if v > toxicity.LITTLE), reverse=True)[: toxicity.WORST]
        assert got[d].tolist() == [*want, *[0.0] * (toxicity.WORST - len(want))]


def test_toxicity(docs, none, labels, spark):
    flat = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(flat) == 7 and all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for r in flat)
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choice(["ing", "the", "thand", "er", "onest", "tion", "heati", "ofre"]) + rng.choice(["", "er", "ly"]) for _ in range(60))
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = plain().split()
        if bad:
            words[rng.randint(0, 59)] = rng.choice(["grobian", "flegeley", "schurke"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(df, known)
    out = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [i for i in out if out[i]["held_out"]]
    right = sum(out[i]["predicted"] == int(i % 4 == 0) for i in held) / len(held)
    assert len(held) > 150 and right > 0.97
    one = model.scorer()
    assert one(["the s.c.h.u.r.k.e of them"])[0] > 0.7 > one(["the sunlight of them"])[0]
    assert toxicity.score(none, model).collect() == []
    assert {r["doc_id"] for r in toxicity.reject(df, model).collect()} == {i for i in out if out[i]["predicted"] == 0}


def test_quality_cases(docs, none, labels):
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert quality.judge(none, labels).collect() == []
    assert got[2]["base_failed"] and got[3]["n_words"] == 0 and got[1]["kept"] and not got[4]["kept"]
    assert got[4]["n_dup_lines"] == 5999


def test_quality_counts_against_brute_force(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "#", "D ", "!! ", "\t", "é", "\x0b"]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    got = {r["doc_id"]: r for r in quality.counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        ws = [w.decode() for w in t.encode().split()]
        wins = [tuple(ws[j : j + 5]) for j in range(len(ws) - 4)]
        again = {j + k for j, w in enumerate(wins) if wins.count(w) > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(ws), sum(map(len, ws)), len(again), len(lines) - len(set(lines)))


def test_quality_bound_holds(spark):
    """A rule is admitted only where the exact binomial test allows it."""
    from math import comb

    from pyspark.sql import functions as F

    p = quality.RISK / len(quality.RULES)
    rows = [(n, k) for n in (5, 60, 900, 4000) for k in (0, 1, 5)]
    got = spark.createDataFrame(rows, "n long, k long").select("n", "k", quality.binomial_cdf(F.col("n"), F.col("k"), p).alias("c")).collect()
    for r in got:
        assert r["c"] == pytest.approx(sum(comb(r["n"], i) * p**i * (1 - p) ** (r["n"] - i) for i in range(r["k"] + 1)), rel=1e-9)


def test_quality_cutoffs_against_brute_force(spark):
    """Planted rates: the admitted cutoffs, per stratum and rule, are those of the exact tests walked one by one."""
    from math import comb

    rng = random.Random(9)
    rows, marks = [], []
    for i in range(3000):
        lang = ("aa", "bb", None)[0 if i < 1500 else 1 if i < 2900 else 2]
        good = rng.random() < 0.8
        bad = rng.random() < (0.001 if good else 0.7)
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 99999)}" for _ in range(40)] + (["#!!"] * rng.randint(1, 60) if bad and lang == "aa" else [])
        rows.append((i, " ".join(words), lang))
        marks.append((i, int(good) if i % 7 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    counted = table(quality.counts(df), "counts")
    known = [r.asDict() for r in counted.collect()]
    good = {i for i, q in marks if q == 1}
    held = [r for r in known if r["doc_id"] in good and r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"]]
    strata = {r["lang"] or "" for r in held}
    p, want = quality.RISK / len(quality.RULES), set()
    for s in strata:
        own = [r for r in held if (r["lang"] or "") == s]
        for rule, (a, b, cuts) in quality.RULES.items():
            last = None
            for c in cuts:  # from mild to harsh
                k = sum(r[a] * 1000 > r[b] * c for r in own)
                if sum(comb(len(own), i) * p**i * (1 - p) ** (len(own) - i) for i in range(k + 1)) > quality.DOUBT / (len(strata) * len(quality.RULES)):
                    break
                last = c
            if last is not None:
                want.add((s, rule, last))
    got = {tuple(r) for r in quality.cutoffs(counted, labels).collect()}
    assert got == want and {s for s, _, _ in want} == {"aa", "bb"}
    out = {r["doc_id"]: r for r in quality.judge(df, labels).collect()}
    harsh = {(s, rule): c for s, rule, c in want}
    for r in known:
        hit = any(r[a] * 1000 > r[b] * harsh[r["lang"] or "", rule] for rule, (a, b, _) in quality.RULES.items() if (r["lang"] or "", rule) in harsh)
        assert out[r["doc_id"]]["kept"] == (not out[r["doc_id"]]["base_failed"] and not hit)
    assert sum(not r["kept"] for r in out.values()) > 50


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 8))
    rows, i = [], 0
    for b in base:
        for _ in range(int(rng.integers(1, 8))):
            rows.append((i, (b + rng.normal(size=8) * 0.06).tolist(), int(i % 2)))
            i += 1
    rows += [(500, rows[0][1], rows[0][2]), (501, None, 1), (502, [0.0] * 8, 1), (503, rows[0][1], None), (504, [float("nan")] * 8, 1), (505, [None] * 8, 0), (506, [1e-200] * 8, 0), (507, [1e-200] * 8, 0), (508, [1.0, 2.0], 0), rows[3]]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, n string")
    got = {r["vec_id"]: r for r in embedding_graph.near_duplicates(df).collect()}
    ok = {v: (np.array(e) / np.abs(e).max(), lab) for v, e, lab in rows if e and lab is not None and None not in e and np.isfinite(e).all() and np.any(e)}
    ids = sorted(ok)
    cos = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98
    link = {a: [b for b in ids if b != a and ok[a][1] == ok[b][1] and cos(ok[a][0], ok[b][0])] for a in ids}
    comp = components(len(ids), [(ids.index(a), ids.index(b)) for a in ids for b in link[a]])
    for k, v in enumerate(ids):
        assert got[v]["n_links"] == len(link[v]) and got[v]["component_id"] == ids[comp[k]]
    assert all(got[v]["n_links"] == 0 and got[v]["kept"] for v in (501, 502, 503, 504, 505, 508))
    assert embedding_graph.near_duplicates(df.where("vec_id < 0")).collect() == []


def test_embedding_blocks_and_recall(spark, monkeypatch):
    """Shards over the bound are compared in blocks; the graph's recall is audited."""
    rng = np.random.default_rng(1)
    b = rng.normal(size=16)
    rows = [(i, (b + rng.normal(size=16) * 0.05).tolist(), 0) for i in range(120)] + [(200 + i, rng.normal(size=16).tolist(), 0) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.98).sum(1) - 1
    for most in (4096, 40):
        monkeypatch.setattr(embedding_graph, "SHARD", most)
        got = {r["vec_id"]: r["n_links"] for r in embedding_graph.near_duplicates(df).collect()}
        assert [got[r[0]] for r in rows] == want.tolist()
    monkeypatch.setattr(embedding_graph, "SHARD", 4096)
    audit = embedding_graph.near_duplicates(df, audit=True).collect()
    assert len(audit) == 11 and sum(r["found"] for r in audit) >= 0.9 * sum(r["actual"] for r in audit)


def test_embedding_groups_larger_than_the_candidates(spark):
    """Groups of more near copies than a vector's NEAR candidates are found whole."""
    rng = np.random.default_rng(2)
    rows = []
    for size in [70] * 8 + [100] * 4 + [300, 500]:
        b = rng.normal(size=64)
        rows += [(len(rows) + i, (b + rng.normal(size=64) * 0.1).tolist(), 0) for i in range(size)]
    rows += [(len(rows) + i, rng.normal(size=64).tolist(), 0) for i in range(300)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.98
    comp = components(len(rows), list(zip(*np.nonzero(near), strict=True)))
    got = {r["vec_id"]: r for r in embedding_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[r[0]]["n_links"] for r in rows] == (near.sum(1) - 1).tolist()
    assert [got[r[0]]["component_id"] for r in rows] == [int(comp[r[0]]) for r in rows]


def test_embedding_links_across_many_shards(spark, monkeypatch):
    """Each link is found by both ends wherever the medoids lie, in shards of either kind; the audit looks at the whole label."""
    monkeypatch.setattr(embedding_graph, "PER_MEDOID", 30)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1000):
        b = rng.normal(size=64)
        rows += [(2 * i, b.tolist(), 0), (2 * i + 1, (b + rng.normal(size=64) * 0.195).tolist(), 0)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = ((x @ x.T >= 0.98).sum(1) - 1).tolist()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for most, flat in ((4096, 128), (100, 6)):  # with six medoids at once they are fitted in two levels
        monkeypatch.setattr(embedding_graph, "SHARD", most)
        monkeypatch.setattr(embedding_graph, "FLAT", flat)
        got = {r["vec_id"]: r["n_links"] for r in embedding_graph.near_duplicates(df).collect()}
        assert [got[r[0]] for r in rows] == want
        audit = {r["vec_id"]: (r["actual"], r["found"]) for r in embedding_graph.near_duplicates(df, audit=True).collect()}
        assert audit == {i: (want[i], want[i]) for i in range(0, 2000, 20)}


def test_bpe_cases(docs, none):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load(BYTE, public_tokenizers.PATTERN).core._core_bpe and {b: i for i, b in byte_bpe.load(BYTE, public_tokenizers.PATTERN).bytes_of.items()}, special_tokens={})
    got = byte_bpe.encode_decode(docs, BYTE, public_tokenizers.PATTERN).collect()
    assert len(got) == 7 and byte_bpe.encode_decode(none, BYTE, public_tokenizers.PATTERN).collect() == []
    by = {r["doc_id"]: r for r in got}
    for i, t in TEXTS:
        ids = enc.encode_ordinary(t or "")
        assert by[i]["n_tokens"] == len(ids) and by[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert by[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_joins_anywhere(monkeypatch):
    """However small the leaves are, the ids are those of the library."""
    b = byte_bpe.Bpe(BYTE, public_tokenizers.PATTERN)
    monkeypatch.setattr(byte_bpe, "LEAF", 5)
    monkeypatch.setattr(byte_bpe, "LONG", 4)
    rng = random.Random(6)
    parts = ["a", "b", " ", "  ", "\n", "'", "'l", "l", "'re", "r", "1", "é", "!", "\t", "字", "🙂", "x" * 40, " the", "ing"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        assert np.frombuffer(b.encode(t), "<u4").tolist() == b.core.encode_ordinary(t)
        b.memory.clear()


def test_pipeline(spark, tmp_path):
    """Each stage against a brute-force reading of what it should do."""
    import corpus_pipeline

    rng = random.Random(5)
    words = ["sun", "river", "stone", "bird", "green", "walk", "under", "over", "light", "paper", "glass", "quiet", "number", "house"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    rows = [(i, text(40) + "\nShared line of all the documents here.\n" + text(30), "en", "s", 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, "mail me at x@y.org " + text(30), "en", "s", 0), (102, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs
        assert k == 4 or docs.columns == columns
    assert seen["toxicity"].count() == 63
    lines = {r["doc_id"]: r["text"] for r in seen["line_dedup"].collect()}
    assert "Shared line" in lines[0] and not any("Shared line" in lines[i] for i in range(1, 60)) and lines[100] == ""
    assert {r["doc_id"] for r in seen["simhash"].collect()} == {*range(60), 100, 101}
    clean = {r["doc_id"]: r for r in seen["pii"].collect()}
    assert clean[101]["text"].startswith("mail me at <email> ") and clean[101]["n_chars"] == len(clean[101]["text"])
    total = {r["doc_id"]: r["doc_tokens"] for r in seen["packing"].collect()}
    assert total == {i: len(tokens(r["text"])) for i, r in clean.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()


def test_pipeline_cases(spark, tmp_path):
    """Every stage on an empty table, and on nulls in any column, repeated rows, long texts and clashing names."""
    import corpus_pipeline

    wide = f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'`{c}` string' for c in CLASH)}"
    rest = [None] * len(CLASH)
    rows = [(None, None, None, None, None, *rest), (None, "no id, a@b.co and more words of it", "en", "s", 3, *rest), (1, LONG, "en", "s", 1, *rest), (2, "", "en", None, 0, *rest), (3, "Two of these.", "en", "s", 13, *rest), (3, "Two of these.", "en", "s", 13, *rest)]
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    whole = spark.createDataFrame(rows, wide)
    for docs in (whole, whole.limit(0)):
        columns, some = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, str(tmp_path))
            docs.write.mode("overwrite").parquet(f"{tmp_path}/{name}-{some}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{some}")
            assert name == "packing" or docs.columns == columns
            assert some or docs.count() == 0
            if some and name in ("line_dedup", "pii"):
                assert docs.count() == before.count()
            if some and name == "pii":
                assert {r["text"] for r in docs.where("doc_id is null").collect()} <= {None, "no id, <email> and more words of it"}
        assert not some or docs.select("doc_id").distinct().count() >= 3
