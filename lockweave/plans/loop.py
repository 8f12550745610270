"""Tables between rounds: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, one subfolder per application.

    It is the session's ``spark.checkpoint.dir``; only where that is unset (tests, a
    laptop) a temporary folder of this machine serves.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(context, "_lockweave_dir", None) or "file://" + tempfile.mkdtemp(prefix="lockweave-")
        context._lockweave_dir = base
    return f"{base.rstrip('/')}/lockweave-{context.applicationId}"


def ship(spark: SparkSession) -> None:
    """Give this package's code to the executors' Python workers, once an application."""
    context = spark.sparkContext
    if getattr(context, "_lockweave_shipped", False):
        return
    package, body = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/code-{uuid.uuid4().hex[:8]}/lockweave_code.zip")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(body.getvalue()))
    out.close()
    context.addPyFile(path.toString())
    context._lockweave_shipped = True


#: Bytes that pass to a Python worker at a time: rows can be long, and both sides hold a batch whole.
BATCH = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with the session's batches for Python workers held to ``BATCH`` bytes, and this code sent to them."""
    ship(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(key).rstrip("b")) <= BATCH:
        conf.set(key, str(BATCH))
    return df


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone by now; the folder's owner cleans up then
        pass


def settle(df: DataFrame, name: str = "round") -> DataFrame:
    """``df`` written as Parquet under the session's ``spark.checkpoint.dir`` and read again.

    Where the session has no such folder (tests, a laptop) a temporary one is set.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """``df``, whose next join shuffles and sorts both sides.

    A settled table is judged by its files, which are far smaller than its rows; else
    tables that grow with the input go through the driver to be broadcast, in every round.
    """
    return df.hint("merge")


def grow(seed: DataFrame, step, most: int = 1000, name: str = "round") -> DataFrame:
    """Least fixpoint, semi-naively: ``step(delta)`` derives rows from the newest ones; what is new goes on.

    Rows are compared on all columns.  Each round is a job; it ends when a round adds
    nothing, or after ``most`` rounds.  ``delta`` comes ``apart``.
    """
    known = delta = settle(seed.distinct(), name)
    for _ in range(most):
        news = step(apart(delta)).select(*known.columns).distinct()
        delta = settle(apart(news).join(known, known.columns, "left_anti"), name)
        if delta.isEmpty():
            return known
        known = known.union(delta)
    return known
