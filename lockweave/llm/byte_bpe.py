"""Byte-level BPE as a monoid: encode halves, join neighbours at their boundary, decode up the tree.

An encoding of a text is an element (the list of pre-token matches of the text,
or for one very long match the list of its token ids).  Elements join
associatively:

* matches: a match stays what it is, whatever text follows, once the text has
  ``LOOK`` characters after the match's first one and one after its last (the
  pattern looks no further).  The join therefore re-scans a window from the last
  stable match start of the left half and accepts a re-scanned boundary that is
  also a match start of the right half: the scan has no memory but its place, so
  all later matches are the right half's.  If none is found the window doubles.
* tokens of one match: a sequence of tokens is the BPE encoding of its bytes
  exactly if each two neighbours are the encoding of their joined bytes.  The join
  re-encodes a window of tokens on both sides, and accepts it when its first and
  last token are the ones that stood there; otherwise the window doubles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from lockweave.llm.common import need, tidy

#: Characters after a match's first one that the pattern can read: an apostrophe and two letters.
LOOK = 3
#: Texts of up to so many characters, or ids, are leaves of the tree.
LEAF = 8192
#: One match of up to so many bytes is encoded at once.
LONG = 512
#: Matches remembered by a worker; when full the memory is emptied, which costs time only.
MEMORY = 200_000


class Bpe:
    """Ranks, pattern, and the joins."""

    def __init__(self, ranks_file: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.scan = regex.compile(pattern)
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.memory: dict[str, bytes] = {}

    # --- matches -----------------------------------------------------------
    def matches(self, text: str) -> list[str]:
        """The pattern's matches over ``text``, by halves."""
        if len(text) <= LEAF:
            return self.scan.findall(text)
        half = len(text) // 2
        return self.join(self.matches(text[:half]), self.matches(text[half:]))

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """The matches of two neighbouring texts, as one; ``left`` is reused."""
        if not left or not right:
            return left or right
        tail, n = [], 0
        while left and (len(tail) < 2 or n < LOOK + 1):
            tail.append(left.pop())
            n += len(tail[-1])
        head = "".join(reversed(tail))
        k = 4
        while True:
            window = head + "".join(right[:k])
            whole = k >= len(right)
            at, starts = len(head), {}
            for i, m in enumerate(right[:k]):
                starts[at] = i
                at += len(m)
            found, place = [], 0
            for m in self.scan.finditer(window):
                place = m.start()
                if place in starts:
                    left += found
                    left += right[starts[place] :] if starts[place] else right
                    return left
                if not whole and (m.end() + 1 > len(window) or place + LOOK > len(window)):
                    break
                found.append(m.group())
            if whole:
                return left + found
            k *= 2

    # --- tokens of one match -------------------------------------------------
    def piece(self, raw: bytes) -> list[int]:
        """The tokens of one match's bytes, by halves when it is long."""
        if len(raw) <= LONG:
            return self.core._encode_single_piece(raw)
        half = len(raw) // 2
        return self.join_tokens(self.piece(raw[:half]), self.piece(raw[half:]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        k = 8
        while True:
            a, b = left[-k:], right[:k]
            raw = b"".join(map(self.bytes_of.__getitem__, a + b))
            new = self.core._encode_single_piece(raw)
            from_left, to_right = k >= len(left) or new[0] == a[0], k >= len(right) or new[-1] == b[-1]
            if from_left and to_right:
                return left[:-k] + new + right[k:]
            k *= 2

    # --- texts -----------------------------------------------------------------
    def _ids(self, match: str) -> bytes:
        import numpy as np

        out = np.array(self.piece(match.encode()), "<u4").tobytes()
        if len(match) <= 64:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[match] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        get, new = self.memory.get, self._ids
        return b"".join([get(m) or new(m) for m in self.matches(text)])

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids: halves are decoded and joined, up the tree."""
        import numpy as np

        if len(ids) <= 4 * LEAF:
            return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        half = len(ids) // 8 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def load(ranks_file: str, pattern: str) -> Bpe:
    return Bpe(ranks_file, pattern)


def encode_decode(df: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Returns per row ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``;
    with ``keep`` also ``ids`` (binary, little-endian) and ``decoded`` (binary).
    Defined cases: a null or empty text has no tokens and the digests of nothing;
    rows with a null or repeated id each give a row; an empty table gives none;
    further columns of ``df`` are not read.  A text of any length is one row, read
    by halves; memory is in proportion to the longest text in a batch.
    """
    import pyarrow as pa

    src = need(df, id_col, text_col)
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: dict[str, list] = {"n": [], "i": [], "d": [], "ids": [], "raw": []}
                for text in part.column(1):
                    ids = bpe.encode(text.as_py() or "")
                    raw = bpe.decode(ids)
                    out["n"].append(len(ids) // 4)
                    out["i"].append(hashlib.sha256(ids).hexdigest())
                    out["d"].append(hashlib.sha256(raw).hexdigest())
                    if keep:
                        out["ids"].append(ids)
                        out["raw"].append(raw)
                cols = [part.column(0), pa.array(out["n"], pa.int64()), pa.array(out["i"], pa.string()), pa.array(out["d"], pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    cols += [pa.array(out["ids"], pa.binary()), pa.array(out["raw"], pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)
        bpe.memory.clear()
        tidy()

    more = ", ids binary, decoded binary" if keep else ""
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
