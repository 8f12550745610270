"""What the operators share: the folder for intermediate tables and column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockweave.plans.loop import bounded, new_path, settle

__all__ = ["SPACE", "bounded", "need", "new_path", "renamed", "table", "tidy"]

#: The six characters that separate words in every word rule of this subpackage.
SPACE = "\\x20\\x09-\\x0D"


#: Write a table in the shared folder and read it: cuts lineage and survives lost executors.
table = settle


def tidy() -> None:
    """Give freed memory back to the system: a worker goes on to other tasks beside the executor's own process."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of ``df``, whatever others it has."""
    gone = [n for n in names if n not in df.columns]
    if gone:
        raise ValueError(f"the table lacks {', '.join(gone)}; it has {', '.join(df.columns)}")
    return bounded(df).select(*[F.col(f"`{n}`") for n in names])


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ... and the new name of each old one, so that no name clashes with an operator's own."""
    new = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*new.values()), new
