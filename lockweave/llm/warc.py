"""WARC archives written from a table of pages and read back as a table of chunks.

Writing: each task streams its rows into one gzip archive, a member per record.  A
payload of ``LEAST`` bytes or more that several rows hold is written once, with the
row of the largest id; the others become revisit records that refer to it.  Which row
does what is decided on digests alone, with joins of plain tables, which Spark
can split where one digest is very frequent.

Reading: each task streams archives in blocks and yields a row per chunk: record id,
chunk number, the bytes' count, and the digest of the payload so far.  No record is
held whole; its last chunk carries the full payload's length and digest, and is
compared with the record's own digest header.

Archives lie in the shared folder under names that follow from the task, written to a
temporary name and renamed; a task that runs again writes the same archive again.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockweave.llm.common import need, new_path, table

#: Payloads of fewer bytes are always written whole.
LEAST = 1000
#: Bytes of a payload in one chunk row, and of an archive read at a time.
CHUNK, BLOCK = 64 * 1024, 256 * 1024
_LENGTH = "X-Original-Payload-Length"


def roles(pages: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """id_col, digest, n_bytes, refers_to: the id whose record holds the payload, null where a row's own does."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    meta = table(pages.select(F.col(id_col).alias("id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha1(body).alias("digest")), "meta")
    groups = meta.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    shared = table(groups.where("n > 1 and last is not null").select("digest", "last"), "shared")
    held = meta.join(shared, "digest", "left").withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last")))
    return held.select("id", "digest", "n_bytes", "refers_to")


def _uri(page: str | None) -> str:
    return "<urn:lockweave:page>" if page is None else f"<urn:lockweave:page:{quote(page, safe='')}>"


def _page(uri: str) -> str | None:
    parts = uri.strip("<>").split(":")
    return unquote(parts[3]) if len(parts) > 3 else None


def _record(page: str | None, url: str, body: memoryview, digest: str, length: int, refers: str | None) -> Iterator[bytes | memoryview]:
    """The record in parts: its head, the payload a chunk at a time, its end; the payload is never copied."""
    sha = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {_uri(page)}", f"WARC-Target-URI: {' '.join(url.split())}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: {sha}", f"{_LENGTH}: {length}"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers)}"]
        body = body[:0]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    yield "\r\n".join(head).encode() + b"\r\n\r\n"
    for at in range(0, len(body), CHUNK):
        yield body[at : at + CHUNK]
    yield b"\r\n\r\n"


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write the archives; returns a table of their paths and numbers of records."""
    import pyarrow as pa

    src = need(pages, id_col, url_col, text_col)
    role = table(roles(src, id_col, text_col, least), "roles")
    # rows that share an id are told apart by their payload
    key = F.sha1(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    once = role.distinct().withColumnRenamed("id", "_id")
    rows = src.withColumn("_d", key).join(once, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("digest")))
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), "digest", "n_bytes", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/part-{context.partitionId():06d}.warc.gz"
        draft, n, out = f"{path}.{context.taskAttemptId()}", 0, None
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = [c[i].as_buffer() if at == 2 else c[i].as_py() for at, c in enumerate(batch.columns)]
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(draft, compression=None)
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    for part in _record(row[0], row[1], memoryview(row[2]), row[3], row[4], row[5]):
                        out.write(member.compress(part))
                    out.write(member.flush())
                    n += 1
        finally:
            if out is not None:
                out.close()
        if n:
            store.move(draft, path)
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{context.partitionId():06d}.warc.gz"]), pa.array([n], pa.int64())], ["archive", "records"])

    return table(rows.mapInArrow(run, "archive string, records bigint"), "archives")


class Records:
    """Streams one archive: yields (headers, an iterator over the payload's blocks) for each record."""

    def __init__(self, stream, block: int = BLOCK):
        self.stream, self.block, self.buffer = stream, block, bytearray()
        self.gunzip, self.rest, self.ended = zlib.decompressobj(31), b"", False

    def _more(self) -> bool:
        """Decompress another block into the buffer."""
        while True:
            if not self.rest:
                self.rest = self.stream.read(self.block)
                if not self.rest:
                    return False
            if self.gunzip.eof:
                self.gunzip = zlib.decompressobj(31)
            got = self.gunzip.decompress(self.rest, self.block)
            self.rest = self.gunzip.unused_data if self.gunzip.eof else self.gunzip.unconsumed_tail
            if got:
                self.buffer += got
                return True

    def _take(self, n: int) -> bytes:
        """At most n bytes; none only at the archive's end."""
        if not self.buffer and not self._more():
            return b""
        part = bytes(self.buffer[:n])
        del self.buffer[:n]
        return part

    def _body(self, left: int) -> Iterator[bytes]:
        while left:
            part = self._take(min(left, CHUNK))
            if not part:
                raise ValueError("the archive ends within a record")
            left -= len(part)
            yield part

    def __iter__(self) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
        while True:
            while self.buffer[:2] == b"\r\n" or len(self.buffer) < 2:
                if len(self.buffer) >= 2:
                    del self.buffer[:2]
                elif not self._more():
                    return
            while (at := self.buffer.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    raise ValueError("the archive ends within a header")
            lines = bytes(self.buffer[:at]).decode().split("\r\n")
            del self.buffer[: at + 4]
            head = dict(x.split(": ", 1) for x in lines[1:])
            body = self._body(int(head["Content-Length"]))
            yield head, body
            for _ in body:  # what the reader left
                pass


def chunks(spark: SparkSession, folder: str, archives: DataFrame, keep: bool = False, size: int = CHUNK) -> DataFrame:
    """One row per chunk of every record; an empty payload has one empty chunk.

    Columns: record_id, chunk, n_bytes, upto (payload bytes so far), digest (SHA-1 of
    the payload so far), last, and of the record: record_type, refers_to, length and
    said (the full payload's length and digest by its headers); with ``keep`` also data.
    """
    import pyarrow as pa

    names = ["record_id", "chunk", "n_bytes", "upto", "digest", "last", "record_type", "refers_to", "length", "said"] + ["data"] * keep
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal held
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            held = 0
            return batch

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for head, body in Records(stream):
                        sha, upto, number, part = hashlib.sha1(), 0, 0, b""
                        own = [head["WARC-Type"], _page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None, int(head[_LENGTH]), base64.b32decode(head["WARC-Payload-Digest"].partition(":")[2]).hex()]
                        record, ahead = _page(head["WARC-Record-ID"]), next(body, None)
                        while True:
                            while ahead is not None and len(part) < size:
                                part, ahead = part + ahead, next(body, None)
                            now, part = part[:size], part[size:]
                            sha.update(now)
                            upto += len(now)
                            last = ahead is None and not part
                            rows.append((record, number, len(now), upto, sha.hexdigest(), last, *own) + ((now,) if keep else ()))
                            held += len(now) if keep else 0
                            if len(rows) >= 5000 or held > 8 << 20:
                                yield out()
                            if last:
                                break
                            number += 1
        if rows:
            yield out()

    some = archives.select("archive").repartition(max(1, spark.sparkContext.defaultParallelism * 2), "archive")
    kinds = {pa.string(): "string", pa.int64(): "bigint", pa.bool_(): "boolean", pa.binary(): "binary"}
    return some.mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in zip(names, types, strict=True)))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write all pages, read the archives back, and tell of each page what its record says.

    Columns: ``id_col``, payload_bytes, payload_digest, record_type, refers_to.  The
    length and digest of a response are those of the bytes read; each revisit's are
    compared with those of the response that it names.  Defined cases: a
    null text is an empty payload, a null url an empty one; rows that repeat an id and
    its payload are written each, as what the id is; a null id refers and is referred
    to as such and is never the one kept; an empty table gives no row; further columns
    are not read.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    kind = pages.schema[id_col].dataType.simpleString()
    read = table(chunks(spark, folder, write(pages, folder, id_col, url_col, text_col, least)).where("last").drop("chunk", "n_bytes", "last"), "records")
    known = read.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("digest").alias("said"), F.col("upto").alias("length")).distinct()
    named = read.where("record_type = 'revisit'").select("refers_to", "said", "length").distinct()
    lost = named.join(known, [named[c].eqNullSafe(known[c]) for c in known.columns], "left_anti").limit(3).collect()
    if lost:
        raise ValueError(f"revisits whose response isn't in the archives, or has another length or digest: {lost}")
    whole = F.col("record_type") == "response"
    sure = F.when(~whole | (F.col("digest") == F.col("said")), F.col("said")).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ in record "), F.col("record_id"))))
    return read.select(
        F.col("record_id").try_cast(kind).alias(id_col), F.when(whole, F.col("upto")).otherwise(F.col("length")).alias("payload_bytes"), sure.alias("payload_digest"), "record_type", F.col("refers_to").try_cast(kind).alias("refers_to")
    )
