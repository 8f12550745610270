"""Packing of tokenised documents into sequences by the sum-of-squares rule.

Every task packs the documents it reads, online: a level array holds how many
windows are filled to each level, and a piece goes to the level at which the sum
of squared counts over partly filled levels becomes least (ties: the fullest).
Documents longer than a sequence fill whole sequences first; what is left is the
piece.  When a task ends its open windows are settled: as many of the fullest as its
ids can fill stay as the rule placed them, and the emptiest give their ids, cut
wherever a gap ends, to fill these up; the last short stretch is cut at powers of
two, which need no padding.

Nothing is shuffled and tasks share nothing, so a lost task is packed again from
its own input.  A task's memory holds one batch of texts and the open windows; when
these hold ``HELD`` ids they are settled in the same way, and packing goes on.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from lockweave.llm.common import need, tidy

#: Ids that a task's open windows hold at most.
HELD = 1 << 24
#: Words remembered by a worker; when full the memory is emptied, which costs time only.
MEMORY = 100_000
#: Characters below this one are split here.
BELOW = 0x180

Piece = tuple[object, int, bytes, int]  # doc_id, start, ids, the document's tokens


def _split() -> str:
    """The vocabulary's own split (kept: contractions, letters, single digits, other signs) for characters below ``BELOW``."""
    kinds: dict[str, str] = {"L": "", "N": "", "space": ""}
    for c in map(chr, range(BELOW)):
        kind = "space" if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += re.escape(c)
    return f"[{kinds['L']}]+|'s|'t|'re|'ve|'m|'ll|'d|[{kinds['N']}]|[^{kinds['space']}{kinds['L']}{kinds['N']}]+"


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable, else the next from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class WordBpe:
    """Ids of whole texts by a ``tokenizers`` file, words being encoded once.

    The file's words are independent of each other, so a text's ids are its
    words' ids in order.  Texts of characters below ``BELOW``, for which normalising
    is plain lower-casing, are split here and their words given to the file's BPE
    model once each; all other texts, and those that hold a special token's
    string, go through the library whole.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        self.model = self.tok.model
        self.split = re.compile(_split())
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.other = re.compile("|".join([f"[^\x00-{chr(BELOW - 1)}]", *special]))
        self.character = _byte_characters()
        self.memory: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        shown = "".join([self.character[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(shown)]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.other.search(text):
            ids = self.tok.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        get, new = self.memory.get, self._word
        return b"".join([get(w) or new(w) for w in self.split.findall(text.lower())])


@lru_cache(maxsize=2)
def load(file: str) -> WordBpe:
    return WordBpe(file)


class SumOfSquares:
    """The online packer of one task.  ``add`` and ``close`` yield finished sequences: lists of pieces."""

    def __init__(self, size: int, held_most: int = HELD):
        import numpy as np

        self.np, self.size, self.held_most = np, size, held_most
        self.count = np.zeros(size + 1, np.int64)  # the level array
        self.windows: list[list[list[Piece]]] = [[] for _ in range(size)]
        self.held = 0

    def level_for(self, s: int) -> int:
        """The level that a piece of ``s`` ids goes to; 0 is a new window."""
        np, c, size = self.np, self.count, self.size
        levels = np.flatnonzero(c[1 : size - s + 1]) + 1
        best, at = 2 * int(c[s]) + 1, 0
        if len(levels):
            to = levels + s
            cost = np.where(to == size, 1 - 2 * c[levels], 2 * (c[to] - c[levels]) + 2)
            k = len(levels) - 1 - int(cost[::-1].argmin())
            if cost[k] <= best:
                at = int(levels[k])
        return at

    def add(self, doc: object, ids: bytes) -> Iterator[list[Piece]]:
        size, n = self.size, len(ids) // 4
        whole = n // size * size
        for a in range(0, whole, size):
            yield [(doc, a, ids[4 * a : 4 * (a + size)], n)]
        if whole < n:
            piece = (doc, whole, ids[4 * whole :], n)
            s = n - whole
            at = self.level_for(s)
            if at:
                window = self.windows[at].pop()
                self.count[at] -= 1
            else:
                window = []
            window.append(piece)
            if at + s == size:
                self.held -= at
                yield window
            else:
                self.windows[at + s].append(window)
                self.count[at + s] += 1
                self.held += s
                if self.held > self.held_most:
                    yield from self._settle()

    def _settle(self) -> Iterator[list[Piece]]:
        """Fill the fullest windows up with the ids of the emptiest; what is less than a window stays open."""
        size = self.size
        todo = [(level, w) for level in range(size - 1, 0, -1) for w in self.windows[level]]
        full = self.held // size
        self.windows, self.held = [[] for _ in range(size)], self.held % size
        self.count[:] = 0
        given = [p for _, w in reversed(todo[full:]) for p in w]
        given.reverse()

        def take(room: int) -> Iterator[Piece]:
            while room:
                doc, start, ids, total = given.pop()
                n = min(room, len(ids) // 4)
                yield doc, start, ids[: 4 * n], total
                if 4 * n < len(ids):
                    given.append((doc, start + n, ids[4 * n :], total))
                room -= n

        for level, window in todo[:full]:
            yield [*window, *take(size - level)]
        if self.held:
            self.windows[self.held].append(list(take(self.held)))
            self.count[self.held] = 1

    def close(self) -> Iterator[list[Piece]]:
        yield from self._settle()
        left = [p for p in self.windows[self.held].pop()][::-1] if self.held else []
        while left:
            room, now = 1 << (self.held.bit_length() - 1), []
            self.held -= room
            while room:
                doc, start, ids, total = left.pop()
                n = min(room, len(ids) // 4)
                now.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    left.append((doc, start + n, ids[4 * n :], total))
                room -= n
            yield now


def pack(df: DataFrame, tokenizer_file: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Pack every document; one row per piece.

    Columns: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``; with ``keep`` also ``ids`` (binary).
    ``end_id`` follows each document.  Defined cases: a null or empty text is its
    end id alone; rows with a null or repeated id are packed like any other, each
    for itself; an empty table gives no row; further columns are not read; a very
    long text is cut into many pieces, never shortened.
    """
    import pyarrow as pa

    src = need(df, id_col, text_col)
    field = src.schema[id_col].dataType.simpleString()
    end = struct.pack("<I", end_id)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, packer, id_type = load(tokenizer_file), SumOfSquares(size), None
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def laid(pieces: list[Piece]) -> None:
            nonlocal sequence
            at = 0
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, sequence, at) + ((ids,) if keep else ()))
                at += n
            sequence += 1

        def out() -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * 6] + [pa.binary()] * keep
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                for pieces in packer.add(doc.as_py(), words.encode(text.as_py() or "") + end):
                    laid(pieces)
                if len(rows) >= 5000:
                    yield out()
        for pieces in packer.close():
            laid(pieces)
        if rows:
            yield out()
        words.memory.clear()
        tidy()

    more = ", ids binary" if keep else ""
    return src.mapInArrow(run, f"`{id_col}` {field}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint{more}")
