"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

The 64 bits are dealt to seven classes, the non-zero vectors of GF(2)^3.  Mask v
keeps the bits of the four classes that are not orthogonal to v.  Any two classes
are orthogonal to some common v, so two fingerprints that differ in at most two
bits agree under at least one of the seven masks: no pair is missed.

A bucket of more than ``BUCKET`` distinct fingerprints is not compared pair by
pair: its fingerprints differ only in the mask's free bits, and those are dealt to
seven classes again.  Two such refinements leave at most six free bits, that is 64
distinct fingerprints, so every bucket is bounded and none is capped.  Copies share
a fingerprint and are one row from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockweave.llm.common import need, renamed, table, tidy
from lockweave.llm.components import components

#: Distinct fingerprints that one bucket may hold when it is compared.
BUCKET = 128


def masks(free: int) -> list[int]:
    """The seven masks over the set bits of ``free``; each keeps about 4/7 of them."""
    bits = [i for i in range(64) if free >> i & 1]
    cls = {b: k % 7 + 1 for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (cls[b] & v).bit_count() & 1) for v in range(1, 8)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's word shingles; 0 for a text without words.

    Only A-Z are lower-cased; words are runs of anything but the six white-space characters.
    """
    import numpy as np
    import xxhash

    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    raw, digest = b" ".join(ws), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()[shingle - 1 :] or [len(raw)]
    count, n = np.zeros(64, np.int64), len(ends)
    for at in range(0, n, 1 << 16):
        some = np.array([digest(raw[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=False)], "<u8")
        count += np.unpackbits(some.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """id_col and ``fp``, the fingerprint as a signed long, for every row."""
    import pyarrow as pa

    src = need(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [_signed(fingerprint(t.as_py(), shingle, seed)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], [id_col, "fp"])
        tidy()

    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, fp bigint")


def _linked(batches: Iterator) -> Iterator:
    """For each bucket's fingerprints: links (a, b) that connect exactly those within two bits of each other."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        a, b = [], []
        for row in batch.column(0).to_pylist():
            fp = np.sort(np.array(row, np.int64))
            u = fp.view(np.uint64)
            near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 2
            todo = np.ones(len(fp), bool)
            for i in range(len(fp)):  # a star for each component within the bucket
                if not todo[i]:
                    continue
                todo[i] = False
                edge = [i]
                while edge:
                    news = np.flatnonzero(near[edge].any(0) & todo)
                    todo[news] = False
                    a += [int(fp[i])] * len(news)
                    b += fp[news].tolist()
                    edge = news.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that join all within two bits of each other."""
    def keyed(rows: DataFrame, by: list[tuple[str, list[int]]]) -> DataFrame:
        """by: for each path so far, the masks of its next level."""
        one = lambda path, ms: F.array(*[F.struct(F.lit(f"{path}{v}").alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for v, m in enumerate(ms)])
        choice: Column | None = None
        for path, ms in by:
            choice = F.when(F.col("path") == path, one(path, ms)) if choice is None else choice.when(F.col("path") == path, one(path, ms))
        return rows.select(F.explode(choice).alias("k"), "key", "fp").select("k.path", F.xxhash64("key", "k.path", "k.part").alias("key"), "fp")

    full = (1 << 64) - 1
    free = {"": full}
    rows, found = prints.select(F.lit("").alias("path"), F.lit(0).cast("long").alias("key"), "fp"), None
    for level in range(3):
        by = [(path, masks(f)) for path, f in free.items()]
        free = {f"{path}{v}": f & ~m for (path, ms), f in zip(by, list(free.values()), strict=True) for v, m in enumerate(ms)}
        dealt = table(keyed(rows, by), "buckets")
        sizes = table(dealt.groupBy("key").count().where("count > 1"), "sizes")
        both = dealt.join(sizes, "key")
        small = both if level == 2 else both.where(F.col("count") <= bucket)
        some = small.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_linked, "a bigint, b bigint")
        found = some if found is None else found.union(some)
        if level == 2 or not sizes.where(F.col("count") > bucket).limit(1).count():
            break
        rows = both.where(F.col("count") > bucket).select("path", "key", "fp")
    return found


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row its fingerprint and the smallest id that links of at most two bits lead to.

    Columns: ``id_col`` (integral), ``fingerprint`` (16 hex digits), ``component_id``.
    Defined cases: a null, empty or blank text has fingerprint 0 and is linked like
    any other; a repeated row is a copy; a null id stays null and counts for no
    component's smallest id (null if a component has no other); an empty table gives
    no row; further columns are not read.
    """
    prints = table(fingerprints(df, id_col, text_col).withColumnRenamed(id_col, "id"), "prints")
    classes = table(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    met = components(links(classes.select("fp")))
    whole = table(classes.join(met.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("c")), "members")
    least = table(whole.groupBy("c").agg(F.min("least").alias("component_id")), "least")
    named = table(whole.join(least, "c").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near-duplicates, the one with its smallest id; all columns stay.

    Of rows that repeat id and fingerprint any one stays.  A row with a null id goes if
    its component has an id; else all its rows stay, as none of them is the first.
    """
    columns, (df, new) = df.columns, renamed(df)
    id_col, text_col = new[id_col], new[text_col]
    back = [F.col(new[c]).alias(c) for c in columns]
    found = table(near_duplicates(df, id_col, text_col), "found")
    same = F.col(id_col).eqNullSafe(F.col("component_id"))
    firsts = found.where(same).groupBy(F.col(id_col).alias("_id"), F.col("fingerprint").alias("_fp")).agg(F.count("*").alias("_n"))
    twice = firsts.groupBy("_id").agg(F.sum("_n").alias("n")).where("n > 1 and _id is not null").limit(1).count()
    if not twice:
        return df.join(firsts.select("_id"), F.col(id_col).eqNullSafe(F.col("_id")), "left_semi").select(*back)
    shown = df.withColumn("_fp", F.lpad(F.lower(F.hex(_print_udf()(F.col(text_col)))), 16, "0"))
    kept = shown.join(firsts.select("_id", F.col("_fp").alias("_f")), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_fp") == F.col("_f")), "left_semi")
    return kept.where(F.col(id_col).isNull()).unionByName(kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, "_fp"])).select(*back)


def _print_udf():
    def prints(texts):
        return texts.map(lambda t: _signed(fingerprint(t)))

    return F.pandas_udf(prints, "bigint", F.PandasUDFType.SCALAR)
