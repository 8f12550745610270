"""One thin query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lockweave.llm.quality import ORACLE as _quality


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockweave.llm.line_dedup import dedup

    return dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), report=True)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockweave.llm.simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockweave.llm.warc import round_trip

    return round_trip(read(spark, sf_dir, "pages"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockweave.llm.html_text import extract

    return extract(read(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockweave.llm.pii import find

    return find(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockweave.llm.toxicity import fit, score

    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockweave.llm.quality import judge

    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lockweave.llm.embedding_graph import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lockweave.llm.byte_bpe import encode_decode

    return encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lockweave.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_html_text": op5_html_text,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_embedding_graph": op9_embedding_graph,
    "op10_byte_bpe": op10_byte_bpe,
}

#: A line goes if an earlier one (by document, then place) has a word set of Jaccard similarity 0.8 or more.
_LINES = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
e AS (SELECT doc_id, i, list_sort(list_distinct(list_filter(regexp_split_to_array(ls[i], '[\\x20\\x09-\\x0D]'), lambda x: x <> ''))) AS s
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
c AS (SELECT s, len(s) AS n, min((doc_id, i)) AS p FROM e WHERE len(s) > 0 GROUP BY s),
w AS (SELECT p, n, unnest(s) AS w FROM c WHERE n >= 4),
o AS (SELECT x.p AS x, y.p AS y, count(*) AS o, any_value(x.n) AS nx, any_value(y.n) AS ny
      FROM w x JOIN w y ON x.w = y.w AND x.p > y.p AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n GROUP BY 1, 2),
k AS (SELECT p FROM c WHERE p NOT IN (SELECT x FROM o WHERE 9 * o >= 4 * (nx + ny))),
r AS (SELECT e.doc_id, e.i, len(e.s) > 0 AS filled, k.p IS NOT NULL AS kept FROM e LEFT JOIN k ON k.p = (e.doc_id, e.i)),
d AS (SELECT doc_id, count(*) FILTER (filled) AS n_lines, count(*) FILTER (filled AND kept) AS n_kept, list(i ORDER BY i) FILTER (NOT filled OR kept) AS stay FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(list_transform(stay, lambda j: ls[j]), chr(10)), '') AS text, n_lines, n_kept FROM l JOIN d USING (doc_id)"""

_WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS m FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to FROM g"""

_LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.98),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, vec_id <= coalesce(c.b, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""

ORACLE_SQL: dict[str, str] = {"op9_embedding_graph": _LINKS, "op4_warc": _WARC, "op2_line_dedup": _LINES, "op8_quality": _quality}
