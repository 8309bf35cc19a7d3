"""Substring dedup on bytes: what ``LENGTH`` bytes in a row have in common with a document of smaller doc_id goes.

Sorting all suffixes of all shards against one another takes work in the square of the number of shards, so suffixes are first
dealt by content: a window of ``LENGTH`` bytes belongs to the least hash among its ``K``-byte strings (its anchor), so equal windows have
equal anchors, wherever they stand. The windows of a document that follow one another with the same anchor are one run (about
18), and only a run's anchor and a hash of all its bytes are dealt out, by anchor, in packed blocks.

A run whose bytes a smaller document among the same task's texts has is a copy as a whole and goes no further, so of what very many documents
share only a run a task and ``FLUSH`` runs meets the others. Where all these meet that have an anchor in common, a run whose bytes a smaller
document has too is a copy. The rest, anchors with different runs (edges of copied passages), is settled exactly by suffix arrays: the runs' bytes
come sorted by anchor and form shards of ``SHARD`` bytes, each gets a suffix array by Larsson-Sadakane refinement in numpy (prefix doubling, in
which only groups that are not settled are refined) and longest common prefixes as Kasai's (computed for all neighbours at once from the doubled
ranks). Only the shards of an anchor that has more than one are merged, by binary search of the windows of each in the sorted windows of those
before it, a range of at most ``MERGED`` windows at a time.

Memory of a task: ``FLUSH`` or ``HELD`` rows (beyond these, rows go to files of the task), one shard with its ranks (some 100 bytes a byte), or,
of an anchor of many shards, its bytes, two words a run and one or two a window.

Nulls: a null text is empty. Rows without a doc_id keep all their bytes and count for nothing. Rows that share a doc_id are one
document: neither is smaller than the other, and if their texts differ each loses its own copies.
"""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from thicket.llm.common import free_name, lean, materialize, utf8

LENGTH = 50
K = 16
WINDOW = LENGTH - K + 1
SIDE = (LENGTH - K + 1) // 2
SEGMENT = 1 << 20
FLUSH = 1 << 19
SHARD = 1 << 20
HELD = 1 << 19
FILES = 64
MERGED = 1 << 18

_RNG = np.random.default_rng(50)
_BYTE = _RNG.integers(0, 1 << 64, size=256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 1 << 63, dtype=np.uint64)) * 2 + 1
#: a: 40 bits of the anchor's hash and 12 each of what is left and right of it; c: hash of all bytes of the run; key: hash of the whole text;
#: at, from the top: 9 more bits of left and right, first window (31), number of windows (6).
_ROW = np.dtype([("a", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("at", "<i8")])
_DONE = ("doc", "key", "at")
_WINDOWS = (1 << 37) - 1


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def runs(text: bytes) -> np.ndarray:
    """The rows of a text's runs, without document and key."""
    out = [_runs(text[i : i + SEGMENT + LENGTH - 1], i) for i in range(0, max(1, len(text) - LENGTH + 1), SEGMENT)] if len(text) >= LENGTH else []
    return np.concatenate(out) if out else np.zeros(0, dtype=_ROW)


def _runs(text: bytes, base: int) -> np.ndarray:
    h1 = _BYTE[np.frombuffer(text, dtype=np.uint8)]
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    h32 = h16[:-16] * _power(16) + h16[16:]
    n = len(text) - LENGTH + 1
    whole = _mix(h32[:n] * _power(18) + h16[32 : 32 + n] * _power(2) + h2[48 : 48 + n])
    anchors = _mix(h16)
    low = np.uint64((1 << 21) - 1)
    least = (anchors & ~low) | np.arange(len(anchors), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[: -(WINDOW - width)], least[WINDOW - width :])
    first = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    count = np.diff(np.append(first, n))
    place = (least[first] & low).astype(np.int64)
    end = first + count - 1 + LENGTH
    # A window around an anchor of K bytes has SIDE bytes more on the left of it or on the right.
    h33 = _mix(h32[:-1] * _power(1) + h1[32:])
    left = np.where(place - SIDE >= first, _short(h33[np.maximum(place - SIDE, 0)]), 0)
    right = np.where(place + K + SIDE <= end, _short(h33[np.minimum(place, len(h33) - 1)]), 0)
    table = np.zeros(len(first), dtype=_ROW)
    table["a"] = (anchors[place] >> np.uint64(24) << np.uint64(24)) | (left >> 9 << 12).astype(np.uint64) | (right >> 9).astype(np.uint64)
    table["c"] = _mix(whole[first] + (whole[first + count - 1] << np.uint64(1)) + count.astype(np.uint64))
    table["at"] = (left & 511) << 46 | (right & 511) << 37 | (first + base) << 6 | count
    return table


def _short(h: np.ndarray) -> np.ndarray:
    """21 bits of a hash, never 0."""
    return np.maximum(h >> np.uint64(43), np.uint64(1)).astype(np.int64)


def _dealt(df: DataFrame, partitions: int) -> DataFrame:
    """(part, done, block): rows of runs, packed by the part that their anchor belongs to; done: of runs that are copies for sure."""

    def blocks(rows: list[np.ndarray]) -> pa.RecordBatch:
        table = np.concatenate(rows)
        order = np.argsort(table["c"], kind="stable")
        c, anchor, doc = table["c"][order], table["a"][order] >> np.uint64(24), table["doc"][order]
        first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (anchor[1:] != anchor[:-1])))
        least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(doc))))
        copies = np.zeros(len(table), dtype=bool)
        copies[order[doc > least]] = True
        done, table = table[copies], table[~copies]
        part = ((table["a"] >> np.uint64(24)) % np.uint64(partitions)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        table, part = table[order], part[order]
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        pieces = np.split(table, cut[1:])
        # by column: equal high bytes then lie together, which the shuffle's compression uses
        packed = [b"".join(p[c].tobytes() for c in _ROW.names) for p in pieces]
        parts = part[cut].tolist()
        if len(done):
            parts.append(int(done["key"][0]) % partitions)
            packed.append(b"".join(done[c].tobytes() for c in _DONE))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([False] * len(pieces) + [True] * bool(len(done))), pa.array(packed, pa.binary())], ["part", "done", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            for doc, raw, key in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if doc is None or raw is None or len(raw) < LENGTH:
                    continue
                table = runs(raw)
                table["doc"] = doc
                table["key"] = key
                waiting.append(table)
                held += len(table)
                if held > FLUSH:
                    yield blocks(waiting)
                    waiting, held = [], 0
        if held:
            yield blocks(waiting)

    return df.mapInArrow(lean(run), "part int, done boolean, block binary")


def _unpacked(data: bytes, names: tuple[str, ...] = _ROW.names) -> np.ndarray:
    n = len(data) // (8 * len(names))
    table = np.zeros(n, dtype=_ROW)
    for i, c in enumerate(names):
        table[c] = np.frombuffer(data, dtype=_ROW[c], count=n, offset=8 * n * i)
    return table


def _met(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """(doc, key, at, a, whole) of runs that are copies, and of those that a suffix array must settle."""

    def out(table: np.ndarray, whole: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(table), 1 << 16):
            few = table[i : i + (1 << 16)]
            anchor = (few["a"] >> np.uint64(24)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(few[c].copy()) for c in _DONE), pa.array(anchor), pa.array(whole[i : i + (1 << 16)])], [*_DONE, "a", "whole"])

    with contextlib.ExitStack() as stack:
        tables, held, files = [], 0, []
        for batch in batches:
            for done, block in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if done:
                    copies = _unpacked(block.as_buffer(), _DONE)
                    yield from out(copies, np.ones(len(copies), dtype=bool))
                    continue
                tables.append(_unpacked(block.as_buffer()))
                held += len(tables[-1])
                if held > most:
                    files = files or [stack.enter_context(tempfile.TemporaryFile()) for _ in range(FILES)]
                    _put(tables, files)
                    held = 0
        if not files:
            if tables:
                yield from out(*_decided(tables))
            return
        if tables:
            _put(tables, files)
        for file in files:
            file.seek(0)
            if data := file.read():
                tables, data = [np.frombuffer(data, dtype=_ROW)], None
                yield from out(*_decided(tables))


def _put(tables: list[np.ndarray], files: list) -> None:
    """Empty ``tables`` into the files: all rows of an anchor into the same one."""
    table = np.concatenate(tables)
    tables.clear()
    which = (_mix(table["a"] >> np.uint64(24)) >> np.uint64(32)) % np.uint64(len(files))
    order = np.argsort(which, kind="stable")
    for file, few in zip(files, np.split(order, np.searchsorted(which[order], np.arange(1, len(files)))), strict=True):
        file.write(table[few].tobytes())


def _decided(tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of whole anchors (``tables`` is emptied), those of copies and those to settle; which are copies."""
    table = np.concatenate(tables)
    tables.clear()
    anchor = table["a"] >> np.uint64(24)
    order = np.lexsort((table["doc"], table["c"], anchor))
    table, anchor = table[order], anchor[order]
    c, doc = table["c"], table["doc"]
    new_a = np.append(True, anchor[1:] != anchor[:-1])
    new_c = new_a | np.append(True, c[1:] != c[:-1])
    group, kind = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
    whole = doc > doc[np.flatnonzero(new_c)][kind]
    # Of runs that are not copies, those may have a window in common with another document's that have the bytes left or right of
    # their anchor in common with it.
    rest = np.flatnonzero(~whole)
    some = np.zeros(len(table), dtype=bool)
    a, at = table["a"][rest].astype(np.int64), table["at"][rest]
    for side in ((a >> 12 & 4095) << 9 | at >> 46 & 511, (a & 4095) << 9 | at >> 37 & 511):
        have = np.flatnonzero(side)
        key = group[rest[have]] << 21 | side[have]
        have = have[by := np.argsort(key, kind="stable")]
        if not len(have):
            continue
        first = np.flatnonzero(np.append(True, np.diff(key[by]) != 0))
        docs = doc[rest[have]]
        differ = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
        some[rest[have[np.repeat(differ, np.diff(np.append(first, len(have))))]]] = True
    take = np.flatnonzero(whole | some)
    return table[take], whole[take]


# suffix arrays ----------------------------------------------------------------------------------------------------------


def suffix_ranks(text: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Order of all suffixes by their first ``depth`` bytes (shorter ones first), and the ranks by 1, 2, 4... bytes on the way.

    Larsson-Sadakane: a rank is the place of a group's last member; groups of one are settled and not sorted again.
    """
    n = len(text)
    order = np.argsort(text, kind="stable").astype(np.int32)
    rank = (np.cumsum(np.bincount(text, minlength=256)) - 1).astype(np.int32)[text]
    ranks, h = {1: rank.copy()}, 1
    while h < depth:
        step = min(h, depth - h)
        key = np.full(n, -1, dtype=np.int32)
        key[: n - step] = rank[step:]
        size = np.bincount(rank, minlength=n)
        loose = np.flatnonzero(size[rank[order]] > 1)  # places of members of groups that are not settled
        at = order[loose]
        at = at[np.lexsort((key[at], rank[at]))]
        order[loose] = at
        new = np.append(True, (rank[at][1:] != rank[at][:-1]) | (key[at][1:] != key[at][:-1]))
        last = np.append(np.flatnonzero(new)[1:], len(at)) - 1
        fresh = rank.copy()
        fresh[at] = loose[last][np.cumsum(new) - 1] if len(at) else fresh[at]
        rank, h = fresh, h + step
        ranks[h] = rank.copy()
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: dict[int, np.ndarray]) -> np.ndarray:
    """Kasai's array up to the depth of the ranks: common prefix of each suffix in order and the one before it (first: 0)."""
    n = len(order)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    i, j = order[1:].copy(), order[:-1].copy()
    length = np.zeros(n - 1, dtype=np.int64)
    for h in sorted(ranks, reverse=True):
        inside = (i + h <= n) & (j + h <= n)
        same = inside & (ranks[h][np.minimum(i, n - 1)] == ranks[h][np.minimum(j, n - 1)])
        length[same] += h
        i[same] += h
        j[same] += h
    out[1:] = np.minimum(length, max(ranks))
    return out


class _Shard:
    """The windows of a shard's runs in the order of their bytes: a representative of each distinct one, and the least document.

    As a sequence: the bytes of each distinct window, in order, as rows of big-endian words, the last filled up with zeros; made when asked for.
    """

    def __init__(self, text: np.ndarray, sizes: np.ndarray, docs: np.ndarray):
        self.text, self.docs = text, docs
        self.starts = np.cumsum(np.append(0, sizes))[:-1]
        order, ranks = suffix_ranks(text)
        piece = np.repeat(np.arange(len(sizes)), sizes)
        valid = np.arange(len(text)) - self.starts[piece] <= sizes[piece] - LENGTH
        order_at = np.flatnonzero(valid[order])
        lcp = common_prefixes(order, ranks)
        cut = np.cumsum(lcp < LENGTH)  # suffixes between two cuts have their first LENGTH bytes in common
        self.window = order[order_at]
        groups = cut[order_at]
        new = np.append(True, groups[1:] != groups[:-1]) if len(groups) else np.zeros(0, dtype=bool)
        self.first = np.flatnonzero(new).astype(np.int32)
        self.least = np.minimum.reduceat(docs[piece[self.window]], self.first) if len(self.first) else np.zeros(0, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.first)

    def __getitem__(self, which: np.ndarray) -> np.ndarray:
        at = self.window[self.first[which]]
        out = np.zeros((len(at), 8 * _KEY_WORDS), dtype=np.uint8)
        if len(at):
            out[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(self.text, LENGTH)[at]
        return out.view(">u8").astype(np.uint64)

    def gone(self) -> tuple[np.ndarray, np.ndarray]:
        """(piece, window) of each window that a smaller document has."""
        piece = np.searchsorted(self.starts, self.window, side="right") - 1
        least = np.repeat(self.least, np.diff(np.append(self.first, len(self.window))))
        at = np.flatnonzero(self.docs[piece] > least)
        return piece[at], self.window[at] - self.starts[piece[at]]


_KEY_WORDS = -(-LENGTH // 8)


def _search(rows: np.ndarray | _Shard, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of all ``wanted`` at once in sorted ``rows``: where each belongs, and whether it is there."""
    lo, hi = np.zeros(len(wanted), dtype=np.int64), np.full(len(wanted), len(rows), dtype=np.int64)
    at = np.arange(len(wanted))
    for _ in range(len(rows).bit_length()):
        mid = np.minimum((lo + hi) // 2, len(rows) - 1)
        some = rows[mid]
        column = (some != wanted).argmax(axis=1)
        less = (lo < hi) & (some[at, column] < wanted[at, column])
        lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
    found = np.zeros(len(wanted), dtype=bool)
    inside = np.flatnonzero(lo < len(rows))
    found[inside] = (rows[lo[inside]] == wanted[inside]).all(axis=1)
    return lo, found


def merge(shards: list[_Shard]) -> None:
    """Let each distinct window know the least document of all shards: by ranges of their order, so that the bytes of few are held at once."""
    step = max(1, MERGED // (2 * len(shards)))
    samples = np.concatenate([s[np.arange(step - 1, len(s), step)] for s in shards])
    bounds = samples[np.lexsort(samples.T[::-1])[len(shards) - 1 :: len(shards)]]
    ends = [np.concatenate([[0], _search(s, bounds)[0], [len(s)]]) for s in shards]
    for r in range(len(bounds) + 1):
        parts = [(s, np.arange(e[r], e[r + 1])) for s, e in zip(shards, ends, strict=True) if e[r] < e[r + 1]]
        keys = [s[part] for s, part in parts]
        rows, least = np.zeros((0, _KEY_WORDS), dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for (shard, part), mine in zip(parts, keys, strict=True):
            at, found = _search(rows, mine) if len(rows) else (np.zeros(len(mine), dtype=np.int64), np.zeros(len(mine), dtype=bool))
            least[at[found]] = np.minimum(least[at[found]], shard.least[part[found]])
            rows, least = np.insert(rows, at[~found], mine[~found], axis=0), np.insert(least, at[~found], shard.least[part[~found]])
        for (shard, part), mine in zip(parts, keys, strict=True):
            shard.least[part] = least[_search(rows, mine)[0]]


def _settled(text: np.ndarray, sizes: np.ndarray, docs: np.ndarray, shard_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pieces, windows) of the windows whose bytes a piece of a smaller document has, from each shard."""
    ends = np.cumsum(sizes)
    cuts = [0]
    while cuts[-1] < len(sizes):
        begin = ends[cuts[-1]] - sizes[cuts[-1]]
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, begin + shard_bytes, side="right"))))
    shards = [_Shard(text[ends[i] - sizes[i] : ends[j - 1]], sizes[i:j], docs[i:j]) for i, j in zip(cuts, cuts[1:])]
    if len(shards) > 1:
        merge(shards)
    for shard, base in zip(shards, cuts):
        piece, window = shard.gone()
        yield base + piece, window


def settle(pieces: list[bytes], docs: np.ndarray, shard_bytes: int = SHARD) -> list[tuple[int, int]]:
    """(piece, window) of each window whose bytes a piece of a smaller document has."""
    text, sizes = np.frombuffer(b"".join(pieces), dtype=np.uint8), np.array([len(p) for p in pieces], dtype=np.int64)
    return [x for piece, window in _settled(text, sizes, docs, shard_bytes) for x in zip(piece.tolist(), window.tolist(), strict=True)]


def _anchors(batches: Iterator[pa.RecordBatch], enough: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches sorted by their first column, in lists: all rows of an anchor in one, and not many more than ``enough`` bytes of pieces unless an anchor has."""
    waiting, held, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        a = batch.column(0).to_numpy()
        size = batch.column(batch.num_columns - 1).nbytes
        at = int(np.searchsorted(a, a[-1]))
        if held + size > enough and (at or last != a[-1]):
            whole, waiting, batch = waiting + [batch.slice(0, at)] * bool(at), [], batch.slice(at)
            if whole:
                yield whole
            held, size = 0, batch.column(batch.num_columns - 1).nbytes
        waiting.append(batch)
        held, last = held + size, a[-1]
    if waiting:
        yield waiting


def _flat(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary columns without nulls, one after another, and the size of each value."""
    texts, sizes = [], []
    for c in columns:
        kind = np.int64 if pa.types.is_large_binary(c.type) else np.int32
        ends = np.frombuffer(c.buffers()[1], dtype=kind)[c.offset : c.offset + len(c) + 1].astype(np.int64)
        texts.append(np.frombuffer(c.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]])
        sizes.append(np.diff(ends))
    return np.concatenate(texts), np.concatenate(sizes)


# the operator -----------------------------------------------------------------------------------------------------------


def copied(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, key, at): runs of windows (first << 6 | number) of each document whose bytes a smaller document has."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    dealt = _dealt(docs, n).repartitionById(n, F.col("part"))
    met = materialize(dealt.mapInArrow(lean(lambda batches: _met(batches, HELD)), "doc long, key long, at long, a long, whole boolean"), "met")
    windows = F.col("at").bitwiseAND(F.lit(_WINDOWS))
    open_runs = met.where("not whole").groupBy("doc", "key").agg(F.collect_list(F.struct("a", windows.alias("at"))).alias("runs"))
    wanted = docs.join(open_runs, ["doc", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, raw, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3), strict=True):
                flat = some.values
                a, at = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                first, count = (at >> 6).tolist(), (at & 63).tolist()
                pieces = [raw[f : f + c + LENGTH - 1] for f, c in zip(first, count, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array([doc] * len(a), pa.int64()), pa.array([key] * len(a), pa.int64()), pa.array(first, pa.int64()), pa.array(pieces, pa.binary())], ["a", "doc", "key", "first", "piece"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _anchors(batches, SHARD):
            text, sizes = _flat([b.column(4) for b in some])
            doc, key, first = (np.concatenate([b.column(i).to_numpy() for b in some]) for i in (1, 2, 3))
            some.clear()
            for piece, window in _settled(text, sizes, doc, SHARD):
                if len(piece):
                    yield pa.RecordBatch.from_arrays([pa.array(doc[piece]), pa.array(key[piece]), pa.array((first[piece] + window) << 6 | 1)], ["doc", "key", "at"])

    pieces = wanted.select("doc", "key", "text", "runs").mapInArrow(lean(cut), "a long, doc long, key long, first long, piece binary")
    late = pieces.repartition(n, "a").sortWithinPartitions("a").mapInArrow(lean(sort), "doc long, key long, at long")
    return met.where("whole").select("doc", "key", windows.alias("at")).union(late)


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "kept") -> DataFrame:
    """``df`` without ``text``, with the bytes that stay (``kept``, binary: cuts may fall inside a character), n_bytes, n_removed and n_spans."""
    rest = [c for c in df.columns if c != text]
    base = df.select(*rest)
    names = [free_name(base, c) for c in ("n_bytes", "n_removed", "n_spans", out)]
    doc, key, at = (free_name(df, x) for x in ("doc_of_runs", "key_of_runs", "runs"))
    gone = copied(df, doc_id, text).groupBy(F.col("doc").alias(doc), F.col("key").alias(key)).agg(F.collect_list("at").alias(at))
    width = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for raw, some in zip(utf8(batch.column(width)), batch.column(width + 1), strict=True):
                raw = raw or b""
                sizes.append(len(raw))
                if not some.is_valid:
                    removed.append(0)
                    spans.append(0)
                    kept.append(raw)
                    continue
                places = some.values.to_numpy()
                edge = np.zeros(len(raw) + 1, dtype=np.int64)
                np.add.at(edge, places >> 6, 1)
                np.add.at(edge, (places >> 6) + (places & 63) + LENGTH - 1, -1)
                cut = np.cumsum(edge[:-1]) > 0
                removed.append(int(cut.sum()))
                spans.append(int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()))
                kept.append(np.frombuffer(raw, dtype=np.uint8)[~cut].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())], [*rest, *names])

    same = (F.col(doc_id).cast("long") == F.col(doc)) & (F.xxhash64(text) == F.col(key))
    joined = df.join(gone, same, "left").select(*(df[c] for c in rest), df[text], at)
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.BinaryType()]
    return joined.mapInArrow(lean(run), T.StructType([*base.schema, *(T.StructField(c, k) for c, k in zip(names, kinds, strict=True))]))
