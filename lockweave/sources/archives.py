"""Finding a program's files, and unpacking archives."""

from __future__ import annotations

import io
import os
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, scope: str | None = None) -> DataFrame:
    """path, content: a file itself, or a folder's archives and images.

    A folder that has soong/system_server_dexjars is searched there, for jars whose
    name holds ``scope``; else its own jars, packages and images are taken, whatever
    the scope.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(hadoop):
        raise FileNotFoundError(path)
    if store.getFileStatus(hadoop).isFile():
        return spark.read.format("binaryFile").load(path).select("path", "content")
    jars = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/soong/system_server_dexjars")
    if store.exists(jars):
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jar").load(jars.toString()).select("path", "content")
        stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.jar$", "")
        return found.where(F.contains(stem, F.lit(scope))) if scope else found
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{jar,apk,dex}").load(path).select("path", "content")


def images(found: DataFrame) -> DataFrame:
    """path, member, content: every classes*.dex of an archive, in order; a file that is no archive is its own member."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(path.rsplit("/", 1)[-1], content)]
                if content[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(n, z.read(n)) for n in sorted(z.namelist()) if n.startswith("classes") and n.endswith(".dex")]
                if not rows:
                    raise ValueError(f"{path} holds no classes")
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([n for n, _ in rows]), pa.array([c for _, c in rows], pa.binary())], ["path", "member", "content"])

    return found.mapInArrow(run, "path string, member string, content binary")


def merge(parts: list[DataFrame]) -> DataFrame:
    """All rows of several programs' tables."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def tool() -> str:
    """The disassembler: LOCKWEAVE_DEXDUMP, or dexdump on the path."""
    found = os.environ.get("LOCKWEAVE_DEXDUMP") or shutil.which("dexdump")
    if not found:
        raise FileNotFoundError("no disassembler: set LOCKWEAVE_DEXDUMP or put dexdump on the path")
    return found


def disassembled(found: DataFrame, command: str | None = None) -> DataFrame:
    """path, value: the text of each image (path, member, content), as ``disassembly.lines`` takes it.

    The disassembler runs beside the task that holds the image, on a file that lives as
    long as the call.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = command or tool()
        for batch in batches:
            for path, member, content in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                with tempfile.NamedTemporaryFile(suffix=".dex") as f:
                    f.write(content)
                    f.flush()
                    done = subprocess.run([program, "-d", f.name], capture_output=True, check=False)
                if done.returncode:
                    raise ValueError(f"{path} {member}: {done.stderr.decode(errors='replace')[:500]}")
                yield pa.RecordBatch.from_arrays([pa.array([f"{path}!{member}"]), pa.array([done.stdout.decode(errors="replace")])], ["path", "value"])

    return found.select("path", "member", "content").mapInArrow(run, "path string, value string")
