"""SimHash near-dedup with pivot distance tables.

Fingerprint: 64 bits over 4-word shingles (see ``fingerprint``). Equal fingerprints are one class, so copies are never compared.
Classes at ``MAX_BITS`` or fewer differing bits are linked, and documents of linked classes form components.

Candidates: a random 64-bit code passes one pivot's test (distances to a reference that differ by at most 4) in more than half of
all pairs, so the table alone cannot be searched in less than all pairs. Codes are therefore met block by block first: 64 bits are
cut into six blocks, and two codes with at most four differing bits agree in two blocks at least, so all links are found among
the codes that share one of 15 pairs of blocks (about 21 bits). Within such a bucket a table of distances to reference
fingerprints discards pairs by maximum coordinate difference (the triangle inequality, so none is lost); survivors are verified.

A bucket is first contracted: all members linked to its least code are joined by one link each. What is left to compare is members
that do not hang together yet: those far from the least code, with one another and with the rest. Large buckets are cut into chunks of
``CHUNK`` codes, and each pair of chunks is a task of its own, so no task holds more than two chunks; a task returns only links that join parts, fewer than it has codes, never all pairs.

Nulls: null, empty and blank texts have the fingerprint zero, linked like any other. Rows without an id get a fingerprint and,
if any row of their component has an id, its component; repeated rows are copies of one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from thicket.llm.common import free_name, lean, materialize, utf8
from thicket.llm.components import components

SHINGLE = 4
MAX_BITS = 4
BLOCKS = 6
PIVOTS = 16
CHUNK = 8192


# fingerprints -----------------------------------------------------------------------------------------------------------


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of all shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=42)
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    begin, end = starts[: len(words) - shingle + 1].tolist(), (starts[shingle:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(begin, end, strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", keep_text: bool = True) -> DataFrame:
    """``df`` with the fingerprint of ``text`` as a signed long."""
    at, out = df.columns.index(text), free_name(df, out)
    columns = [i for i in range(len(df.columns)) if keep_text or i != at]
    fields = [df.schema[i] for i in columns]
    names = [*(f.name for f in fields), out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(x) for x in utf8(batch.column(at))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in columns), pa.array(codes, pa.int64())], names)

    return df.mapInArrow(lean(run), T.StructType([*fields, T.StructField(out, T.LongType())]))


# pivot tables -----------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def pivots() -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random codes."""
    return np.random.default_rng(42).integers(0, 1 << 64, size=PIVOTS, dtype=np.uint64)


def pivot_table(codes: np.ndarray) -> np.ndarray:
    """Hamming distances of codes to each reference fingerprint (a row each)."""
    return np.bitwise_count(codes[:, None] ^ pivots()[None, :]).astype(np.int8)


def links_within(codes: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Index pairs of linked codes that join all components of the links among ``codes``: a spanning forest, not all pairs.

    Breadth first: a code that hangs on is compared with all that do
    not hang on yet, so a tight group of n codes costs about n comparisons a member that reaches further.
    """
    table = pivot_table(codes)
    order = np.argsort(table[:, 0], kind="stable")
    codes, table = codes[order], table[order]
    free = np.arange(len(codes))
    out: list[tuple[int, int]] = []
    while len(free):
        queue, free = [int(free[0])], free[1:]
        while queue and len(free):
            i = queue.pop()
            first = table[free, 0].astype(np.int16)  # sorted: a window of them is near enough at the first pivot
            lo, hi = np.searchsorted(first, int(table[i, 0]) - max_bits), np.searchsorted(first, int(table[i, 0]) + max_bits, side="right")
            near = free[lo:hi]
            for p in range(1, PIVOTS):
                if len(near) < 64:
                    break
                near = near[np.abs(table[near, p] - table[i, p]) <= max_bits]
            near = near[np.bitwise_count(codes[near] ^ codes[i]) <= max_bits]
            if len(near):
                out.extend((int(order[i]), int(order[j])) for j in near)
                queue.extend(near.tolist())
                free = np.setdiff1d(free, near, assume_unique=True)
    return out


# links ------------------------------------------------------------------------------------------------------------------


def _masks() -> list[int]:
    """For each pair of blocks, the bits of both."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _within(a: Column, b: Column, max_bits: int) -> Column:
    """Whether two codes are linked: first by their distances to the references (made where codes meet, as they cost less than to be carried)."""
    near = F.lit(True)
    for p in pivots().view(np.int64).tolist():
        near &= F.abs(F.bit_count(a.bitwiseXOR(F.lit(p))) - F.bit_count(b.bitwiseXOR(F.lit(p)))) <= max_bits
    return near & (F.bit_count(a.bitwiseXOR(b)) <= max_bits)


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) of ids of classes (columns fp, id; one row a fingerprint) that span the components of all links."""
    if max_bits > BLOCKS - 2:
        raise ValueError(f"{BLOCKS} blocks find links of up to {BLOCKS - 2} bits")
    keys = F.array(*(F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(_masks())))
    buckets = classes.select("fp", "id", F.explode(keys).alias("key")).select("fp", "id", "key.k", "key.v")
    least = buckets.groupBy("k", "v").agg(F.min(F.struct("fp", "id")).alias("least"), F.count("*").alias("n")).where("n > 1")
    met = materialize(buckets.join(least, ["k", "v"]).select("k", "v", "n", "fp", "id", F.col("least.fp").alias("fp0"), F.col("least.id").alias("id0")), "buckets")
    near = _within(F.col("fp"), F.col("fp0"), max_bits)
    stars = met.where(near).where("id != id0").select(F.col("id").alias("a"), F.col("id0").alias("b")).distinct()
    # A member that hangs on the least code needs no links to others that do; one that doesn't is compared with all. A bucket of
    # two is done, and so is one whose members all hang on.
    # A bucket of more than CHUNK codes is cut: chunks of far codes meet pairwise, and each meets the chunks of near codes.
    far = met.where("n > 2").groupBy("k", "v").agg(F.sum(F.when(near, 0).otherwise(1)).alias("far")).where("far > 0")
    left = met.where("n > 2").join(far, ["k", "v"])
    far_chunks, near_chunks = (F.ceil(x / CHUNK).cast("int") for x in (F.col("far"), F.col("n") - F.col("far")))
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    each = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.pmod(F.xxhash64("fp"), F.when(near, near_chunks).otherwise(far_chunks)).cast("int")
    pairs = (
        F.when(F.col("n") <= CHUNK, F.array(pair(F.lit(0), F.lit(0))))
        .when(near, F.transform(each(far_chunks), lambda i: pair(i, far_chunks + own)))
        .otherwise(F.concat(F.transform(each(far_chunks), lambda j: pair(F.least(own, j), F.greatest(own, j))), F.transform(each(near_chunks), lambda j: pair(own, far_chunks + j))))
    )
    mixed = (F.col("n") > CHUNK) & (F.col("pair.j") >= far_chunks)
    dealt = left.select("k", "v", "n", "far", "fp", "id", near.alias("near"), F.explode(pairs).alias("pair")).select("k", "v", "pair.i", "pair.j", "near", "fp", "id", mixed.alias("mixed"))
    group = ["k", "v", "i", "j"]
    rest = dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(lean(lambda batches: _compare(batches, max_bits)), "a long, b long")
    return stars.union(rest)


SMALL = 32


def _compare(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links within the groups (k, v, i, j) of sorted rows; a group's rows follow one another, over borders of batches too."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        keys = [batch.column(c).to_numpy() for c in range(4)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1
        if len(new):  # all groups but the last are whole
            waiting[-1] = batch.slice(0, int(new[-1]))
            yield from _links_of(pa.Table.from_batches(waiting), max_bits)
            waiting = [batch.slice(int(new[-1]))]
        elif len(waiting) > 1 and any(waiting[-2].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in range(4)):
            yield from _links_of(pa.Table.from_batches(waiting[:-1]), max_bits)
            waiting = [batch]
    if waiting:
        yield from _links_of(pa.Table.from_batches(waiting), max_bits)


def _links_of(table: pa.Table, max_bits: int) -> Iterator[pa.RecordBatch]:
    columns = [c.to_numpy() for c in table.columns]
    near, codes, ids, mixed = columns[4].astype(bool), columns[5].view(np.uint64), columns[6], columns[7].astype(bool)
    new = np.ones(len(ids), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)
    starts = np.append(np.flatnonzero(new), len(ids))
    sizes = np.diff(starts)
    group, small = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes <= SMALL, sizes)
    pivot = pivot_table(codes)
    a, b = [], []
    for d in range(1, min(SMALL, len(ids))):  # all small groups at once, by the distance of rows
        i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]) & ~(near[:-d] & near[d:]) & (~mixed[:-d] | (near[:-d] != near[d:])))
        i = i[np.abs(pivot[i] - pivot[i + d]).max(axis=1, initial=0) <= max_bits]
        i = i[np.bitwise_count(codes[i] ^ codes[i + d]) <= max_bits]
        a.append(ids[i])
        b.append(ids[i + d])
    for g in np.flatnonzero(sizes > SMALL):
        at = slice(starts[g], starts[g + 1])
        far_at, near_at = np.flatnonzero(~near[at]) + starts[g], np.flatnonzero(near[at]) + starts[g]
        found = [] if mixed[starts[g]] else [(far_at[i], far_at[j]) for i, j in links_within(codes[far_at], max_bits)]
        for i in far_at if len(near_at) else ():
            rest = near_at[np.abs(pivot[near_at] - pivot[i]).max(axis=1) <= max_bits]
            hit = rest[np.bitwise_count(codes[rest] ^ codes[i]) <= max_bits]
            found.extend((i, j) for j in hit[:1])  # near ones hang together already
        a.append(ids[[i for i, _ in found]])
        b.append(ids[[j for _, j in found]])
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])


def classify(coded: DataFrame, doc_id: str = "doc_id", fp: str = "fp", max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component_id) of each fingerprint in ``coded``: the smallest doc_id reachable over links."""
    classes = materialize(coded.groupBy(F.col(fp).alias("fp")).agg(F.min(F.col(doc_id).cast("long")).alias("least")), "classes")
    # nodes are classes named by their own code: ids may be missing
    found = components(links(classes.select("fp", F.col("fp").alias("id")), max_bits))
    labelled = classes.join(found, classes["fp"] == found["a"], "left").select("fp", "least", F.coalesce("b", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return labelled.join(ids, "root").select("fp", "component_id")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    coded = materialize(fingerprints(df.select(doc_id, text), text, "fp", keep_text=False), "fingerprints")
    return coded.join(classify(coded, doc_id, "fp", max_bits), "fp").select(doc_id, "fp", "component_id")
