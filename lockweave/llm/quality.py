"""Quality rules whose cutoffs carry an exact guarantee.

Each rule compares a rate (per thousand) with a cutoff.  On labelled documents of
good quality, per stratum (language), a cutoff is admitted if the hypothesis "it
rejects more than ``RISK`` / number of rules of the good ones" is refuted by the
exact binomial test at level ``DOUBT`` / (strata x rules) -- Bonferroni over strata
and rules.  Along a rule's fixed grid the tests run from the mildest cutoff to the
harshest and stop at the first that fails, which needs no further correction.  A
stratum with too few labels admits none, and nothing is rejected there.

Everything is built-in SQL functions.  The same expressions, in DuckDB's dialect,
make ``ORACLE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockweave.llm.common import SPACE, need, table

#: Share of a stratum's good documents that all rules together may reject, and how often that may fail.
RISK, DOUBT = 0.05, 0.05
#: For each rule: what is counted, per what, and its cutoffs per thousand from mild to harsh (fixed values of this library).
RULES: dict[str, tuple[str, str, tuple[int, ...]]] = {
    "symbols": ("n_symbols", "n_words", (2000, 1500, 1000, 700, 500, 300, 200, 100, 50)),
    "lines": ("n_dup_lines", "n_lines", (900, 800, 700, 600, 500, 400, 300, 200, 100)),
    "repeats": ("n_repeat_words", "n_words", (200, 150, 100, 70, 50, 30)),
    "capitals": ("n_capitals", "word_chars", (900, 800, 700, 600, 500, 400, 300, 200)),
    "marks": ("n_marks", "n_words", (2000, 1500, 1000, 700, 500, 300, 200, 100)),
}
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"]


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.split(text, pattern)) - 1


def counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with the counts that the rules use.

    Repeated words: the hashes of a text's word windows are sorted; a window equal to
    a neighbour marks its words, overlaps counted once.  Only texts whose windows
    aren't all different take that step.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    t = F.col("_t")
    one = df.select(*others, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    parts = one.withColumn("_parts", F.split(t, f"[{SPACE}]")).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    listed = parts.select(
        *others,
        F.array_remove("_parts", "").alias("_w"),
        (F.length(t) - F.size("_parts") + 1).alias("word_chars"),
        _count(t, "[#*$%&|<>]").alias("n_symbols"),
        _count(t, "[A-Z]").alias("n_capitals"),
        _count(t, "!").alias("n_marks"),
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
    ).withColumn("n_words", F.size("_w"))
    hashed = listed.withColumn(
        "_h", F.when(F.col("n_words") > WINDOW, F.transform(F.sequence(F.lit(1), F.col("n_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    ).drop("_w")
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    ordered = hashed.withColumn("_s", F.when(repeated, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h")
    beside = lambda e, i: F.coalesce(e["h"] == F.get("_s", i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get("_s", i + 1)["h"], F.lit(False))
    places = ordered.withColumn("_p", F.array_sort(F.transform(F.filter("_s", beside), lambda e: e["i"]))).drop("_s")
    gaps = F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", j + 1) - p, F.lit(WINDOW))))
    done = places.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)))
    return done.select(*others, *[F.col(c).cast("long").alias(c) for c in COUNTS])


def _log_factorial(n: Column) -> Column:
    """Stirling's series from 10 on, products below."""
    x = F.greatest(n, F.lit(10)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(6.283185307179586 * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    small = F.aggregate(F.sequence(F.lit(0), F.least(n, F.lit(9)).cast("int")), F.lit(0.0), lambda a, i: a + F.log(F.greatest(i, F.lit(1)).cast("double")))
    return F.when(n >= 10, series).otherwise(small)


def binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of n trials, exact but for rounding."""
    term = lambda i: F.exp(_log_factorial(n) - _log_factorial(i) - _log_factorial(n - i) + i * F.log(F.lit(p)) + (n - i) * F.log(F.lit(1 - p)))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.lit(0.0), lambda a, i: a + term(i))


def failed_base() -> Column:
    """The fixed rule: under ten words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def cutoffs(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang", risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """stratum, rule, cutoff: the harshest admitted cutoff of each rule, where there is one."""
    good = need(labels, id_col, "quality").where("quality = 1").select(id_col).distinct()
    held = counted.join(good, id_col, "left_semi").where(~failed_base()).withColumn("stratum", F.coalesce(F.col(stratum), F.lit("")))
    grid = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).cast("long").alias("cutoff"), (F.col(a) * 1000 > F.col(b) * c).alias("out")) for r, (a, b, cs) in RULES.items() for c in cs])
    tried = held.select("stratum", F.explode(grid).alias("g")).groupBy("stratum", "g.rule", "g.cutoff").agg(F.count("*").alias("n"), F.count_if("g.out").alias("k"))
    strata = tried.agg(F.count_distinct("stratum").alias("m"))
    p = risk / len(RULES)
    test = F.when(F.col("k") > F.col("n") * p, F.lit(1.0)).otherwise(binomial_cdf(F.col("n"), F.least(F.col("k"), F.ceil(F.col("n") * p)), p))
    tested = tried.withColumn("admitted", test <= F.lit(doubt) / (F.lit(len(RULES)) * strata.scalar()))
    last = F.coalesce(F.max(F.when(~F.col("admitted"), F.col("cutoff"))), F.lit(-1))
    walked = tested.groupBy("stratum", "rule").agg(last.alias("stop"), F.array_sort(F.collect_list(F.when(F.col("admitted"), F.col("cutoff")))).alias("passed"))
    return walked.select("stratum", "rule", F.get(F.filter("passed", lambda c: c > F.col("stop")), F.lit(0)).alias("cutoff")).where("cutoff is not null")


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """The counts of every whole text and the verdict.

    Columns: ``id_col``, the base counts, base_failed, kept.  Defined cases: a null or
    empty text has no words and fails the base; a null stratum is a stratum of its
    own; rows with a null or repeated id are judged each, and a null id has no
    label; without labels only the base rejects; an empty table gives no row;
    further columns are not read.
    """
    src = need(df, id_col, stratum, text_col)
    counted = table(counts(src, text_col), "counts")
    rules = table(cutoffs(counted, labels, id_col, stratum, risk, doubt).groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]), "cutoffs")
    judged = counted.withColumn("stratum", F.coalesce(F.col(stratum), F.lit(""))).join(rules, "stratum", "left")
    out = F.lit(False)
    for r, (a, b, _) in RULES.items():
        out = out | F.coalesce(F.col(a) * 1000 > F.col(b) * F.col(f"cut_{r}"), F.lit(False))
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed_base().alias("base_failed"), (~failed_base() & ~out).alias("kept"))


def _oracle() -> str:
    """The whole query in DuckDB's dialect."""
    space = SPACE
    lgam = lambda x: f"(CASE WHEN {x} >= 10 THEN {x} * ln({x}::DOUBLE) - {x} + 0.5 * ln(6.283185307179586 * {x}) + 1.0 / (12.0 * {x}) - 1.0 / (360.0 * {x}::DOUBLE * {x} * {x}) + 1.0 / (1260.0 * {x}::DOUBLE * {x} * {x} * {x} * {x}) ELSE coalesce(list_sum(list_transform(range(1, {x} + 1), lambda q: ln(q::DOUBLE))), 0) END)"
    p = RISK / len(RULES)
    grid = ", ".join(f"('{r}', {c})" for r, (_, _, cs) in RULES.items() for c in cs)
    over = " ".join(f"WHEN rule = '{r}' THEN {a} * 1000 > {b} * cutoff" for r, (a, b, _) in RULES.items())
    cut = ", ".join(f"max(cutoff) FILTER (rule = '{r}') AS cut_{r}" for r in RULES)
    out = " OR ".join(f"coalesce({a} * 1000 > {b} * cut_{r}, false)" for r, (a, b, _) in RULES.items())
    base = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
    term = f"exp({lgam('n')} - {lgam('i')} - {lgam('(n - i)')} + i * ln({p}) + (n - i) * ln({1 - p}))"
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, stratum, t, list_filter(regexp_split_to_array(t, '[{space}]'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS ls FROM t),
g AS (SELECT *, list_transform(range(1, len(w) - {WINDOW} + 2), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM l),
r AS (SELECT t, count(DISTINCT j) AS n_repeat_words FROM (
    SELECT t, unnest(range(i, i + {WINDOW})) AS j FROM (
        SELECT t, i, count(*) OVER (PARTITION BY t, h) AS n FROM (SELECT t, unnest(h) AS h, generate_subscripts(h, 1) AS i FROM (SELECT DISTINCT t, h FROM g))) WHERE n > 1) GROUP BY t),
c AS (SELECT g.doc_id, g.stratum, len(w)::BIGINT AS n_words, length(regexp_replace(g.t, '[{space}]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(g.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
    length(regexp_replace(g.t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals, length(regexp_replace(g.t, '[^!]', '', 'g'))::BIGINT AS n_marks
    FROM g LEFT JOIN r ON g.t = r.t),
grid(rule, cutoff) AS (VALUES {grid}),
tried AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (CASE {over} END) AS k FROM c, grid
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND NOT {base} GROUP BY ALL),
tested AS (SELECT *, (CASE WHEN k > n * {p} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: {term})) END)
    <= {DOUBT} / ({len(RULES)} * (SELECT count(DISTINCT stratum) FROM tried)) AS admitted FROM tried),
chosen AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tested a WHERE admitted
    AND cutoff > coalesce((SELECT max(cutoff) FROM tested b WHERE b.stratum = a.stratum AND b.rule = a.rule AND NOT b.admitted), -1) GROUP BY ALL),
cuts AS (SELECT stratum, {cut} FROM chosen GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed, NOT {base} AND NOT ({out}) AS kept
FROM c LEFT JOIN cuts USING (stratum)"""


ORACLE = _oracle()
