"""Word bigrams with modified Kneser-Ney discounts on top of a spelling model, kept in sorted arrays of hashes.

A word is a run of ASCII letters, digits and bytes above 127, with A-Z lower-cased; it is known by 32 bits of a hash (with its language),
and a bigram by the 32 bits of its first word and 28 of its second. The probability of a word w after v is interpolated:

    p(w | v) = (c(vw) - D(c(vw)) + g(v) * spelled(w)) / c(v.)        g(v) = D1 N1(v.) + D2 N2(v.) + D3 N3+(v.)

where spelled(w) comes from the modified Kneser-Ney trigrams of bytes, which give every word a probability, also one never seen. The
number of bigrams grows with the corpus, so no task and no broadcast ever holds them all:

* Documents are read in chunks of at most ``CHUNK_TOKENS`` words or so. A chunk sends each of its distinct bigrams once, as a sorted array of
  hashes and counts for each of ``parts`` ranges of first words (``requests``).
* A task for each part merges the arrays of all chunks. It answers each array, place by place, with the counts of the bigrams and of
  their contexts (``answer``); how many bigrams have a count of 1 to 4 is summed for the discounts.
* The chunks' documents, as places in these arrays (``states``), meet the answers, chunk by chunk, and are scored (``scored``).

Texts are dealt into two folds by their hash, and each is scored with the counts of the other fold, so no text (nor a copy of it) vouches
for itself. Contexts that are very frequent (``wide``) are spread over several parts; their few totals are put together in the driver: at
most ``8 * parts`` words, since each makes up ``1 / (8 * parts)`` of the corpus. A chunk is named by a hash of its arrays, so reading the
documents anew (as after a lost executor) finds the same chunks; if a table changes meanwhile, the job fails instead of mixing them.

Null and empty texts have no words and no score.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from thicket.llm.common import lean, materialize, release

CHUNK_TOKENS = 2_000_000
#: Words that a part should get at most; a part's distinct bigrams lie in a task's memory.
PART_TOKENS = 16_000_000
SEGMENT = 1 << 20
START = 0

_SECOND = 28
_LOW = np.uint64((1 << _SECOND) - 1)
_FOLD = np.uint64(1 << 60)
#: Steps of the log probabilities of spelled words, which are kept in a byte.
STEP = 0.25

_RNG = np.random.default_rng(2)
_BYTE = _RNG.integers(0, 1 << 64, size=256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 1 << 63, dtype=np.uint64)) * 2 + 1
_IN_WORD = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _IN_WORD[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE[65:91] = _BYTE[97:123]


# words ------------------------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2^64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SEGMENT + (1 << 12))
        _powers = tuple(np.cumprod(np.full(size, x, dtype=np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column one after another, and where each row begins (and the last ends)."""
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), at


def _segments(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``SEGMENT`` bytes that end with a row or between two words."""
    lo, end = int(at[0]), int(at[-1])
    while lo < end:
        hi = min(end, lo + SEGMENT)
        if hi < end:
            row_end = int(at[np.searchsorted(at, hi, side="right") - 1])
            if row_end > lo:
                hi = row_end
            else:
                size = 1 << 12
                while hi < end and len(gaps := np.flatnonzero(~_IN_WORD[data[hi : hi + size]])) == 0:
                    hi, size = min(end, hi + size), 2 * size
                hi = min(hi + int(gaps[0]), int(at[np.searchsorted(at, lo, side="right")])) if hi < end else end
        yield lo, hi
        lo = hi


def words(data: np.ndarray, at: np.ndarray, seeds: np.ndarray, spelling: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, row, spelled) of all words: 32 bits, never ``START``. seeds: a number for each row, of its language. spelling: log probabilities of
    byte trigrams, given their rows; spelled is the sum over a word by itself, between two spaces before and one behind, in steps."""
    ids, rows, spelled = [], [], []
    row_at = at[:-1]
    for lo, hi in _segments(data, at):
        b = data[lo:hi]
        inside = _IN_WORD[b]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        first = row_at[np.searchsorted(row_at, lo, side="left") : np.searchsorted(row_at, hi, side="left")] - lo
        begins[first] = inside[first]
        first = first[first > 0]
        ends[first - 1] = inside[first - 1]
        start, stop = np.flatnonzero(begins), np.flatnonzero(ends)
        if not len(start):
            continue
        up, down = _power_tables(len(b))
        weighted = _BYTE[b] * up[: len(b)]
        total = np.cumsum(weighted)
        row = np.searchsorted(at, start + lo, side="right") - 1
        h = _mix((total[stop] - total[start] + weighted[start]) * down[start] ^ seeds[row])
        ids.append(np.maximum(h >> np.uint64(32), np.uint64(1)).astype(np.uint32))
        rows.append(row)
        if spelling is not None:
            low = _LOWER[b].astype(np.int32)
            one, two = np.full(len(b), 32, dtype=np.int32), np.full(len(b), 32, dtype=np.int32)
            one[1:] = np.where(begins[1:], 32, low[:-1])
            two[2:] = np.where(begins[2:] | begins[1:-1], 32, low[:-2])
            of = np.flatnonzero(inside)
            size = stop - start + 1
            logs = spelling(two[of] << 16 | one[of] << 8 | low[of], np.repeat(row, size))
            value = np.add.reduceat(logs, np.cumsum(size) - size) + spelling(one[stop] << 16 | low[stop] << 8 | 32, row)
            spelled.append(np.clip(np.round(-value / STEP), 0, 255).astype(np.uint8))
    if not ids:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    return np.concatenate(ids), np.concatenate(rows), np.concatenate(spelled) if spelled else np.zeros(0, dtype=np.uint8)


def before(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The word before each in its row."""
    out = np.full(len(ids), START, dtype=np.uint32)
    out[1:] = np.where(rows[1:] == rows[:-1], ids[:-1], np.uint32(START))
    return out


def seed_of(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), seed=1))


def seeds_of(langs: list[str]) -> np.ndarray:
    by = {x: seed_of(x) for x in set(langs)}
    return np.array([by[x] for x in langs], dtype=np.uint64)


# packed arrays ----------------------------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """An array of unsigned integers, compressed by planes of bytes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


# chunks -----------------------------------------------------------------------------------------------------------------


class Chunk:
    """The words of some documents of one language. keys: distinct bigrams by part, sorted within each."""

    def __init__(self, lang: str, words: np.ndarray, contexts: np.ndarray, folds: np.ndarray, parts: int, wide: np.ndarray, spread: np.ndarray, inverse: bool):
        key = contexts.astype(np.uint64)
        key <<= np.uint64(_SECOND)
        key |= words & np.uint32(_LOW)
        key[folds == 1] |= _FOLD
        self.lang = lang
        if inverse:
            distinct, place = np.unique(key, return_inverse=True)
        else:
            distinct, self.counts = np.unique(key, return_counts=True)
        part = part_of(distinct, parts, wide, spread)
        order = np.argsort(part, kind="stable")
        self.keys, self.part = distinct[order], part[order]
        if inverse:
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            self.place = rank[place]
        else:
            self.counts = self.counts[order]
        self.name = xxhash.xxh64_intdigest(distinct.tobytes() + lang.encode()) - (1 << 63)


def part_of(keys: np.ndarray, parts: int, wide: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The part of each bigram: its context's range of hashes; a wide context has several, by the second word."""
    context = keys >> np.uint64(_SECOND) & np.uint64(0xFFFFFFFF)
    part = (context * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    if len(wide):
        at = np.minimum(np.searchsorted(wide, context.astype(np.uint32)), len(wide) - 1)
        hit = np.flatnonzero(wide[at] == context)
        part[hit] = (part[hit] + (keys[hit] & _LOW).astype(np.int64) % spread[at[hit]]) % parts
    return part.astype(np.uint16 if parts < 1 << 16 else np.uint32)


def chunks(batches: Iterator[pa.RecordBatch], parts: int, wide: np.ndarray, spread: np.ndarray, spelling: object = None) -> Iterator[tuple[Chunk, dict]]:
    """Chunks of batches (lang, text, doc). With spelling, what they need to be scored comes too: docs, sizes and spelled words."""
    held: dict[str, list[tuple]] = defaultdict(list)
    total = 0

    def flush() -> Iterator[tuple[Chunk, dict]]:
        for lang in sorted(held):
            ids, contexts, spelled, docs, sizes = (np.concatenate(x) for x in zip(*held.pop(lang), strict=True))
            chunk = Chunk(lang, ids, contexts, np.repeat((docs & 1).astype(np.uint8), sizes), parts, wide, spread, spelling is not None)
            del ids, contexts
            more = {}
            if spelling is not None:
                of_key = np.zeros(len(chunk.keys), dtype=np.uint8)
                of_key[chunk.place] = spelled
                more = {"docs": docs, "sizes": sizes, "spelled": of_key}
            yield chunk, more
            del chunk, more
            release()

    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, at = raw_texts(batch.column(1))
        names, code = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True) if langs else (np.zeros(0, dtype=str), np.zeros(0, dtype=int))
        known = None if spelling is None else spelling.codes(names.tolist())[code]
        ids, rows, spelled = words(data, at, seeds_of(langs), None if spelling is None else lambda grams, r, known=known: spelling.logs(grams, known[r]))
        if not len(ids):
            continue
        doc = batch.column(2).to_numpy()
        contexts, of = before(ids, rows), code[rows]
        for k, lang in enumerate(names.tolist()):
            some = np.flatnonzero(of == k) if len(names) > 1 else slice(None)
            if len(ids[some]):
                row = rows[some]
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                held[lang].append((ids[some], contexts[some], spelled[some] if len(spelled) else spelled, doc[row[first]], np.diff(np.append(first, len(row)))))
        total += len(ids)
        if total >= CHUNK_TOKENS:
            yield from flush()
            total = 0
    yield from flush()


def requests(docs: DataFrame, parts: int, wide: np.ndarray, spread: np.ndarray) -> DataFrame:
    """(lang, chunk, part, keys, counts) of docs (lang, text, doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in chunks(batches, parts, wide, spread):
            cut = np.flatnonzero(np.append(True, chunk.part[1:] != chunk.part[:-1]))
            ends = np.append(cut[1:], len(chunk.part))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk.lang] * len(cut), pa.string()),
                    pa.array([chunk.name] * len(cut), pa.int64()),
                    pa.array(chunk.part[cut].astype(np.int32), pa.int32()),
                    pa.array([pack_sorted(chunk.keys[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary()),
                    pa.array([pack(chunk.counts[a:b].astype(np.uint32)) for a, b in zip(cut, ends, strict=True)], pa.binary()),
                ],
                ["lang", "chunk", "part", "keys", "counts"],
            )

    return docs.mapInArrow(lean(run), "lang string, chunk long, part int, keys binary, counts binary")


# parts ------------------------------------------------------------------------------------------------------------------

_ANSWER = pa.schema(
    [("kind", pa.int32()), ("lang", pa.string()), ("chunk", pa.int64()), ("part", pa.int32()), ("word", pa.int64()), ("numbers", pa.list_(pa.int64())), ("reply", pa.binary())]
)
_REPLY, _WIDE, _COUNTS = 0, 1, 2


def _contexts(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted bigrams: their contexts (with the fold), and for each the sum of counts and how many counts are 1, 2, and 3 or more."""
    context = keys >> np.uint64(_SECOND)
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    kinds = [n, n == 1, n == 2, n >= 3]
    return context[first], np.stack([np.add.reduceat(x.astype(np.int64), first) for x in kinds], axis=1)


def answer(table: pa.Table, wide: np.ndarray) -> pa.Table:
    """The replies to all requests of one part: other-fold counts of each key, and the other-fold totals of each context in turn."""
    out: dict[str, list] = {f.name: [] for f in _ANSWER}

    def row(*values: object) -> None:
        for column, value in zip(out.values(), values, strict=True):
            column.append(value)

    part = table.column("part")[0].as_py()
    langs = np.array(table.column("lang").to_pylist(), dtype=object)
    for lang in sorted(set(langs)):
        some = table.take(pa.array(np.flatnonzero(langs == lang)))
        arrays = [unpack_sorted(x, np.uint64) for x in some.column("keys").to_pylist()]
        counts = np.concatenate([unpack(x, np.uint32) for x in some.column("counts").to_pylist()])
        keys, where = np.unique(np.concatenate(arrays), return_inverse=True)
        n = np.bincount(where, weights=counts).astype(np.int64)
        twin = np.minimum(np.searchsorted(keys, keys ^ _FOLD), len(keys) - 1)
        other = np.where(keys[twin] == keys ^ _FOLD, n[twin], 0)
        contexts, totals = _contexts(keys, n)
        across = contexts ^ (_FOLD >> np.uint64(_SECOND))
        twin = np.minimum(np.searchsorted(contexts, across), len(contexts) - 1)
        others = np.where((contexts[twin] == across)[:, None], totals[twin], 0)
        first_word = (contexts & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        is_wide = np.isin(first_word, wide)
        fold = (contexts >> np.uint64(32)).astype(np.int64)
        for f, word, numbers in zip(fold[is_wide].tolist(), first_word[is_wide].tolist(), totals[is_wide].tolist(), strict=True):
            row(_WIDE, lang, 0, part, word, [0] * 4 * f + numbers + [0] * 4 * (1 - f), None)
        of_key = keys >> np.uint64(60)
        row(_COUNTS, lang, 0, part, 0, [int(((n == k) & (of_key == f)).sum()) for f in (0, 1) for k in (1, 2, 3, 4)], None)
        group = np.searchsorted(contexts, keys >> np.uint64(_SECOND))
        at = 0
        for name, array in zip(some.column("chunk").to_pylist(), arrays, strict=True):
            place = where[at : at + len(array)]
            at += len(array)
            new = np.append(True, group[place][1:] != group[place][:-1])
            mine = group[place][new]
            marks = np.flatnonzero(is_wide[mine])
            pieces = [
                pack(other[place].astype(np.uint32)),
                pack(np.diff(np.append(np.flatnonzero(new), len(place))).astype(np.uint32)),
                pack(_residues(others[mine])),
                pack((fold[mine][marks].astype(np.uint64) << np.uint64(32) | first_word[mine][marks].astype(np.uint64))),
                pack(marks.astype(np.uint32)),
            ]
            sizes = np.array([len(x) for x in pieces], dtype="<u4").tobytes()
            row(_REPLY, lang, name, part, 0, None, sizes + b"".join(pieces))
    answers = pa.Table.from_pydict(out, schema=_ANSWER)
    del table, out
    release()
    return answers


def _residues(totals: np.ndarray) -> np.ndarray:
    """Totals of contexts (sum, and how many counts are 1, 2, 3 or more), as what each leaves of the one before: mostly zeros."""
    t, k1, k2, k3 = np.minimum(totals, (1 << 32) - 1).T  # those of wide contexts are not read
    return np.concatenate([t, t - k1, np.maximum(t - k1 - 2 * k2, 0), k3]).astype(np.uint32)


def _from_residues(packed: np.ndarray) -> np.ndarray:
    t, rest, high, k3 = packed.reshape(4, -1).astype(np.int64)
    return np.stack([t, t - rest, (rest - high) // 2, k3])


def _read_reply(data: bytes) -> tuple[np.ndarray, ...]:
    sizes = np.frombuffer(data, dtype="<u4", count=5)
    ends = 20 + np.cumsum(sizes.astype(np.int64))
    kinds = (np.uint32, np.uint32, np.uint32, np.uint64, np.uint32)
    return tuple(unpack(data[e - s : e], k) for s, e, k in zip(sizes.tolist(), ends.tolist(), kinds, strict=True))


# scores -----------------------------------------------------------------------------------------------------------------


def states(docs: DataFrame, parts: int, wide: np.ndarray, spread: np.ndarray, spelling: Broadcast) -> DataFrame:
    """(lang, chunk, docs, sizes, places, spelled): a row a chunk, all packed; places of each document's bigrams among the chunk's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, more in chunks(batches, parts, wide, spread, spelling.value):
            owner = np.repeat(np.arange(len(more["sizes"]), dtype=np.uint64), more["sizes"])
            both = np.sort(owner << np.uint64(32) | chunk.place)  # a document's places in order: small steps
            place = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            step = np.diff(place, prepend=np.uint32(0))
            first = np.cumsum(more["sizes"]) - more["sizes"]
            step[first] = place[first]
            packed = [pack(more["docs"].view(np.uint64)), pack(more["sizes"].astype(np.uint32)), pack(step), pack(more["spelled"])]
            yield pa.RecordBatch.from_arrays([pa.array([chunk.lang]), pa.array([chunk.name], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], ["lang", "chunk", "docs", "sizes", "places", "spelled"])

    return docs.mapInArrow(lean(run), "lang string, chunk long, docs binary, sizes binary, places binary, spelled binary")


_SCORE = pa.schema([("lang", pa.string()), ("doc", pa.int64()), ("total", pa.float64()), ("n", pa.int64())])


def log_probabilities(replies: list[bytes], spelled: np.ndarray, discounts: np.ndarray, wide: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Of each key of a chunk. discounts: by fold that counts, for counts of 0, 1, 2, and 3 or more. totals: of each wide context, 4 numbers a fold."""
    out, at = [], 0
    for reply in replies:
        n, sizes, numbers, marked, marks = _read_reply(reply)
        numbers = _from_residues(numbers).astype(np.float64)
        if len(marks):
            fold, word = (marked >> np.uint64(32)).astype(np.int64), marked.astype(np.uint32)
            found = totals.reshape(-1, 2, 4)[np.searchsorted(wide, word), 1 - fold]  # of the other fold
            numbers[:, marks] = found.T
        # the fold that a key's counts come from: keys of fold 0 stand before those of fold 1 in each array
        out.append((n, np.repeat(numbers, sizes.astype(np.int64), axis=1)))
    n = np.concatenate([x[0] for x in out])
    t, k1, k2, k3 = np.concatenate([x[1] for x in out], axis=1)
    lower = np.exp(-STEP * spelled.astype(np.float64))
    d = discounts
    left = d[1] * k1 + d[2] * k2 + d[3] * k3
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(t > 0, (n - d[np.minimum(n, 3)] + left * lower) / t, lower)
    return np.log(p)


def scored(of_chunks: DataFrame, replies: DataFrame, discounts: dict[str, np.ndarray], wide: np.ndarray, totals: np.ndarray) -> DataFrame:
    """(lang, doc, total, n): sums of the log probabilities of each document's words, and their number, for each chunk that has words of it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        by_part = dict(zip(right.column("part").to_pylist(), right.column("reply").to_pylist(), strict=True))
        ordered = [by_part[k] for k in sorted(by_part)]
        for row in left.to_pylist():
            spelled = unpack(row["spelled"], np.uint8)
            logs = log_probabilities(ordered, spelled, discounts[row["lang"]], wide, totals) if ordered else np.zeros(0)
            if len(logs) != len(spelled):
                raise RuntimeError("the documents have changed between two readings")
            docs, sizes, step = unpack(row["docs"], np.uint64).view(np.int64), unpack(row["sizes"], np.uint32).astype(np.int64), unpack(row["places"], np.uint32).astype(np.int64)
            first = np.cumsum(sizes) - sizes
            place = np.cumsum(step)
            place -= np.repeat(place[first] - step[first], sizes)
            rows.append(pa.Table.from_arrays([pa.array([row["lang"]] * len(docs), pa.string()), pa.array(docs), pa.array(np.add.reduceat(logs[place], first)), pa.array(sizes)], schema=_SCORE))
        return pa.concat_tables(rows) if rows else _SCORE.empty_table()

    met = of_chunks.groupBy("chunk").cogroup(replies.select("chunk", "part", "reply").groupBy("chunk"))
    return met.applyInArrow(run, "lang string, doc long, total double, n long")


def word_scores(docs: DataFrame, n_words: int, frequent: dict[int, int], spelling: Broadcast, discounts_of: Callable[..., np.ndarray]) -> DataFrame:
    """(lang, doc, word_score) of docs (lang, text, doc): mean negative log probability of the words of each text.

    frequent: counts of the words that may be wide; spelling: log probabilities of byte trigrams, by language.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words // PART_TOKENS))
    wide = np.array(sorted(w for w, n in frequent.items() if 8 * parts * n >= n_words), dtype=np.uint32)
    spread = np.array([min(parts, 1 + 2 * parts * frequent[w] // max(1, n_words)) for w in wide.tolist()], dtype=np.int64)
    met = requests(docs, parts, wide, spread).groupBy("part").applyInArrow(lambda t: answer(t, wide), "kind int, lang string, chunk long, part int, word long, numbers array<long>, reply binary")
    met = materialize(met, "answers")
    sums = [F.sum(F.get("numbers", F.lit(i))).alias(f"n{i}") for i in range(8)]
    found = met.where(F.col("kind") != _REPLY).groupBy("kind", F.when(F.col("kind") == _COUNTS, F.col("lang")).alias("lang"), "word").agg(*sums).collect()
    numbers = {(r["kind"], r["lang"], r["word"]): [r[f"n{i}"] for i in range(8)] for r in found}
    # both folds' counts of counts together: the folds are halves of one corpus
    discounts = {lang: discounts_of(*(max(1, n[k] + n[4 + k]) for k in range(4))) for (kind, lang, _), n in numbers.items() if kind == _COUNTS}
    totals = np.array([numbers.get((_WIDE, None, w), [0] * 8) for w in wide.tolist()], dtype=np.int64).reshape(-1, 8)
    each = scored(states(docs, parts, wide, spread, spelling), met.where(F.col("kind") == _REPLY), discounts, wide, totals)
    return each.groupBy("lang", "doc").agg(F.round(-F.sum("total") / F.sum("n"), 6).alias("word_score"))
