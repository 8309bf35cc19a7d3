"""Byte-level BPE as a monoid: encode halves, join neighbours at their common border, concatenate up the tree.

A node of the tree is a stretch of text with its ids. Two neighbours are joined by encoding anew a window around the border.
The window grows until its two ends are places where no token can differ from the neighbours' own:

* between pieces of the pattern, an end is a pair of characters between which every text has a piece border (such as a letter
  before white space, see ``_BORDER``); what the pattern matches after a border does not depend on what stands before it;
* inside one piece (a very long run of one kind), ids are stable once the window's first id is the left neighbour's id at that
  place and its last id the right one's. All adjacent ids are then pairs that BPE itself leaves unmerged, and a sequence of ids
  in which every adjacent pair is such a pair is the only one that BPE can give (each id of the vocabulary encodes to itself).

Nulls: a null text counts as empty and gives no ids; null ids decode to no bytes. An id outside the vocabulary raises.
Columns whose names clash with the output's are kept; the output's column gets a leading underscore (``free_name``).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, types as T

from thicket.llm.common import free_name, lean, list_array

LEAF_CHARS = 512
LEAF_BYTES = 512
LEAF_IDS = 4096

#: Between these characters every text has a border of pieces, whatever stands around them.
_BORDER = regex.compile(
    r"(?<=\S)(?=[ \n\t\r])|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])|(?<=')(?=\p{N})"
)


class TreeBPE:
    """Encoder and decoder over a rank file and a splitting pattern."""

    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self._table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self._table[rank] = token
        self._sizes = np.fromiter(map(len, self._table), dtype=np.int64)
        self._leaf_chars = max(2, leaf_chars)
        self._leaf_bytes = max(leaf_bytes, 2 * max(map(len, ranks)))

    # encoding -----------------------------------------------------------------------------------------------------------

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        return self._encode(text, 0, len(text)).astype(np.int32)

    def _encode(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self._leaf_chars:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _leaf(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, disallowed_special=())

    def _join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        start = end = None
        width = 32
        while start is None or end is None:
            if start is None:
                start = self._left_border(text, max(lo, mid - width), mid, lo)
            if end is None:
                end = self._right_border(text, mid, min(hi, mid + width), hi)
            width *= 2
        keep = self._ids_of(left[::-1], len(text[start:mid].encode()))
        skip = self._ids_of(right, len(text[mid:end].encode()))
        return np.concatenate([left[: len(left) - keep], self._window(text[start:end]), right[skip:]])

    @staticmethod
    def _left_border(text: str, a: int, mid: int, lo: int) -> int | None:
        """The last sure border in (a, mid), with both of its characters left of mid; lo itself is one."""
        found = None
        for m in _BORDER.finditer(text, a, mid):
            if a < m.start() < mid:
                found = m.start()
        return lo if found is None and a == lo else found

    @staticmethod
    def _right_border(text: str, mid: int, b: int, hi: int) -> int | None:
        """The first sure border in (mid, b), with both of its characters right of mid; hi itself is one."""
        part = text[mid:b]  # else the pattern would look behind mid
        for m in _BORDER.finditer(part):
            if 0 < m.start() < len(part):
                return mid + m.start()
        return hi if b == hi else None

    def _ids_of(self, ids: np.ndarray, size: int) -> int:
        """How many leading ids make up that many bytes."""
        n = 64
        while True:
            ends = np.cumsum(self._sizes[ids[:n]])
            if size == 0:
                return 0
            if len(ends) and ends[-1] >= size:
                at = int(np.searchsorted(ends, size))
                assert ends[at] == size, "a border inside a token"
                return at + 1
            assert n < len(ids), "fewer bytes than the border needs"
            n *= 4

    def _window(self, text: str) -> np.ndarray:
        if len(text) <= 2 * self._leaf_chars:
            return self._leaf(text)
        out = [self.encode_piece(m.group().encode()) for m in self._pieces.finditer(text)]
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)

    def encode_piece(self, piece: bytes) -> np.ndarray:
        """The ids of one match of the pattern, by a tree over its bytes."""
        if len(piece) <= self._leaf_bytes:
            return np.array(self._encoding._core_bpe.encode_single_piece(piece), dtype=np.uint32)
        left, right = self.encode_piece(piece[: len(piece) // 2]), self.encode_piece(piece[len(piece) // 2 :])
        n = 1
        while True:
            a, b = min(n, len(left)), min(n, len(right))
            around = b"".join(self._table[i] for i in (*left[len(left) - a :].tolist(), *right[:b].tolist()))
            mid = np.array(self._encoding._core_bpe.encode_single_piece(around), dtype=np.uint32)
            if (a == len(left) or mid[0] == left[-a]) and (b == len(right) or mid[-1] == right[b - 1]):
                return np.concatenate([left[: len(left) - a], mid, right[b:]])
            n *= 2

    # decoding -----------------------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            if ids and not 0 <= min(ids) <= max(ids) < len(self._table):
                raise ValueError("an id outside the vocabulary")
            return b"".join(map(self._table.__getitem__, ids))
        return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])


@lru_cache(maxsize=4)
def tree(ranks_path: str, pattern: str) -> TreeBPE:
    return TreeBPE(ranks_path, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text`` (array<int>)."""
    out = free_name(df, out)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree(ranks_path, pattern)
        for batch in batches:
            ids = [bpe.encode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, list_array(ids, pa.int32())], [*batch.schema.names, out])

    return df.mapInArrow(lean(run), T.StructType([*df.schema, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for (binary)."""
    out = free_name(df, out)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree(ranks_path, pattern)
        for batch in batches:
            texts = [bpe.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, out])

    return df.mapInArrow(lean(run), T.StructType([*df.schema, T.StructField(out, T.BinaryType())]))
