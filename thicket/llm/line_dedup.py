"""Line dedup by range partitions of line hashes, giving per-document keep bitmaps instead of text.

Every line of at least ``min_chars`` code points (stripped, A-Z lower-cased) gives a row (96-bit hash, document, position). Rows
are range-partitioned by hash, document and position, so one line that a third of the corpus holds is spread over many partitions,
and sorted within them. One pass over a partition's stream decides each line group that lies inside it, and holds no more of a group than its
first few documents and its largest one. The groups at a partition's two ends may go on in its neighbours: their rows are passed on as open, and are decided by what all partitions together know of these
hashes (at most two a partition, so that table is small whatever the corpus).

The result of a document is a bitmap with a bit for each line (1: keep), deflated; ``apply`` puts the kept lines together again.

A line is dropped where its key is found in at least ``min_docs`` documents, except in the largest doc_id that holds it. Rows
that share a doc_id count as one document; if their texts differ, each row's lines are dropped by its own positions. Rows
without a doc_id keep all their lines and count for nothing; null and empty texts are one empty line.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from thicket.llm.common import ASCII_WS, free_name, lean, materialize, utf8

MIN_CHARS = 20
MIN_DOCS = 3

_ROWS = "h long, h2 int, doc long, row_key long, pos int"


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode()) >= least)


def line_rows(df: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(h, h2, doc, row_key, pos) of each long enough line. row_key: a hash of the text, for rows that share a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, positions, docs, keys = [], [], [], []
            for doc, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if doc is None or not raw or len(raw) < min_chars:
                    continue
                before = len(hashes)
                for pos, line in enumerate(raw.lower().split(b"\n")):
                    if _long_enough(key := line.strip(ASCII_WS), min_chars):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        positions.append(pos)
                docs.extend([doc] * (len(hashes) - before))
                keys.extend([xxhash.xxh64_intdigest(raw, seed=42)] * (len(hashes) - before))  # as Spark's xxhash64
            h = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0].copy(), pa.int64()), pa.array(h[:, 1].astype(np.int32), pa.int32()), pa.array(docs, pa.int64()), pa.array(np.array(keys, dtype=np.uint64).view(np.int64), pa.int64()), pa.array(positions, pa.int32())],
                ["h", "h2", "doc", "row_key", "pos"],
            )

    return df.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(lean(run), _ROWS)


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Where a new group begins in rows sorted by these columns."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


_NO_ROWS = np.zeros(0, dtype=[("h", "<i8"), ("h2", "<i4"), ("doc", "<i8"), ("row_key", "<i8"), ("pos", "<i4")])


def decide(rows: DataFrame, partitions: int, min_docs: int) -> DataFrame:
    """(doc, row_key, pos, h, h2, open) of the lines that go, and of those that a look at all partitions must decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = _NO_ROWS, True  # rows of the last group so far, and whether it is the first, too

        def out(rows: np.ndarray, is_open: bool) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 1 << 16):
                few = rows[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([*(pa.array(few[c].copy()) for c in ("doc", "row_key", "pos", "h", "h2")), pa.array(np.full(len(few), is_open))], ["doc", "row_key", "pos", "h", "h2", "open"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.empty(batch.num_rows, dtype=_NO_ROWS.dtype)
            for i, c in enumerate(_NO_ROWS.dtype.names):
                new[c] = batch.column(i).to_numpy()
            rows = np.concatenate([held, new])
            starts = np.flatnonzero(_groups(rows["h"], rows["h2"]))
            if first and len(starts) > 1:  # the partition's first group may have begun before it
                yield from out(rows[: starts[1]], True)
                rows, starts, first = rows[starts[1] :], starts[1:] - starts[1], False
            whole, last = rows[: starts[-1]], rows[starts[-1] :]
            if len(whole):
                group = np.cumsum(_groups(whole["h"], whole["h2"])) - 1
                docs = np.bincount(group, weights=_groups(whole["h"], whole["h2"], whole["doc"]))
                ends = np.append(starts[1:-1], len(whole)) - 1
                yield from out(whole[(docs[group] >= min_docs) & (whole["doc"] != whole["doc"][ends][group])], False)
            # of a group that goes on, what lies between its first documents and its largest so far goes for sure
            number = np.cumsum(_groups(last["doc"]))
            between = (number >= min_docs) & (number < number[-1])
            yield from out(last[between], False)
            held = last[~between]
        yield from out(held, True)

    ordered = rows.repartitionByRange(partitions, "h", "h2", "doc", "pos").sortWithinPartitions("h", "h2", "doc", "pos")
    return ordered.mapInArrow(lean(run), "doc long, row_key long, pos int, h long, h2 int, open boolean")


def dropped_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, row_key, pos) of each line that goes."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    decided = materialize(decide(line_rows(df, doc_id, text, min_chars), partitions, min_docs), "lines")
    waiting = decided.where("open")
    # two hashes a partition at most: small enough for every executor, at any size of the corpus
    known = waiting.groupBy("h", "h2").agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("last")).where(F.col("docs") >= min_docs)
    late = waiting.join(F.broadcast(known), ["h", "h2"]).where("doc < last")
    return decided.where("not open").select("doc", "row_key", "pos").union(late.select("doc", "row_key", "pos"))


def keep_bitmaps(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, row_key, bitmap) of the documents that lose lines: a deflated bit for each line up to the last that goes, 1 to keep it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for positions in batch.column(2):
                at = positions.values.to_numpy()
                bits = np.ones((int(at.max()) // 8 + 1) * 8, dtype=bool)
                bits[at] = False
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], ["doc", "row_key", "bitmap"])

    by_doc = dropped_lines(df, doc_id, text, min_chars, min_docs).groupBy("doc", "row_key").agg(F.collect_set("pos").alias("at"))
    return by_doc.mapInArrow(lean(pack), "doc long, row_key long, bitmap binary")


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which of the lines stay."""
    keep = np.ones(n_lines, dtype=bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8)).astype(bool)
        keep[: min(n_lines, len(bits))] = bits[:n_lines]
    return keep


def apply(df: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with only the kept lines in ``text``, and the columns n_lines (before) and n_dropped."""
    at, width = df.columns.index(text), len(df.columns)
    n_lines, n_dropped = free_name(df, "n_lines"), free_name(df, "n_dropped")
    doc, key, bitmap = (free_name(df, x) for x in ("doc_of_map", "key_of_map", "bitmap"))
    names = [*df.columns, n_lines, n_dropped]
    maps = bitmaps.select(F.col("doc").alias(doc), F.col("row_key").alias(key), F.col("bitmap").alias(bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, gone = [], [], []
            for raw, bits in zip(utf8(batch.column(at)), batch.column(width).to_pylist(), strict=True):
                lines = (raw or b"").split(b"\n")
                before.append(len(lines))
                if bits is not None:
                    keep = unpack(bits, len(lines))
                    raw = b"\n".join(x for x, k in zip(lines, keep.tolist(), strict=True) if k)
                texts.append(raw)
                gone.append(0 if bits is None else int((~keep).sum()))
            columns = [*batch.columns[:width], pa.array(before, pa.int64()), pa.array(gone, pa.int64())]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    same = (F.col(doc_id).cast("long") == F.col(doc)) & (F.xxhash64(text) == F.col(key))
    joined = df.join(maps, same, "left").select(*(df[c] for c in df.columns), bitmap)
    return joined.mapInArrow(lean(run), T.StructType([*df.schema, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())]))


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Bitmaps made and applied."""
    return apply(df, keep_bitmaps(df, doc_id, text, min_chars, min_docs), doc_id, text)
