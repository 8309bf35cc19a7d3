"""Substring dedup over sliding sentence spans.

Texts are cut into sentences; every run of ``SPAN`` consecutive sentences is hashed (128 bits) and all runs of all documents are
joined on their hash. A run that has been seen before, in a document with a smaller doc_id or earlier in the same one, is a copy,
and every sentence that a copy covers goes. What stays is put together with the white space that followed each sentence.

A sentence ends at a line's end, or after a word that ends in one of ``.!?`` or an ideographic stop. Every run of ``SPAN`` sentences
counts, whatever its words; fewer sentences count as a run if they have ``LONG_WORDS`` words or more. A run whose sentences all lie in
shorter runs that count is not hashed itself: if it is a copy, these are too. A repeated passage is found if ``SPAN`` whole
sentences lie in it, or fewer with ``LONG_WORDS`` words together; one that lies inside long sentences is not.

The rows of one very common run are counted on each task before they meet, and joined with the one row that says where its first
is, which is a join whose large side Spark can split. Null texts have no sentences; rows without a doc_id keep everything and
count for nothing; rows that share a doc_id and text are one document, so neither loses its text to the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from thicket.llm.common import free_name, lean, materialize, utf8

SPAN = 3
LONG_WORDS = 12

#: A sentence with the white space after it.
_SENTENCE = regex.compile(rb"[^\n]*?(?:(?:[.!?]|\xe3\x80\x82)[\"')\]]*(?:[ \t\r]+|(?=\n)|\Z)[\n]*|\n+|\Z)")


def sentences(text: bytes | None) -> list[bytes]:
    """The sentences of a text, white space included: their concatenation is the text."""
    return [s for s in _SENTENCE.findall(text) if s] if text else []


def runs(parts: list[bytes], span: int = SPAN, long_words: int = LONG_WORDS) -> list[tuple[bytes, int, int]]:
    """(hash, first sentence, sentences) of every run that shorter ones do not stand for; case and white space inside don't matter."""
    words = [p.lower().split() for p in parts]
    at = [i for i, w in enumerate(words) if w]  # blank ones are no sentences
    plain = [b" ".join(words[i]) for i in at]
    sizes = [len(words[i]) for i in at]
    out = []
    counts = [False] * (len(at) + 1)  # of runs one sentence shorter, by where they start
    for n in range(1, span + 1):
        shorter, counts = counts, [n == span or sum(sizes[k : k + n]) >= long_words for k in range(len(at) - n + 1)]
        for k, wanted in enumerate(counts):
            if wanted and not (n > 1 and shorter[k] and shorter[k + 1]):
                out.append((xxhash.xxh3_128_digest(b"\n".join(plain[k : k + n])), at[k], at[k + n - 1] - at[k] + 1))
    return out


def run_rows(df: DataFrame, doc_id: str, text: str, span: int, long_words: int) -> DataFrame:
    """(h, h2, doc, row_key, pos, n) of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys, hashes, pos, size = [], [], [], [], []
            for doc, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if doc is None or not raw:
                    continue
                found = runs(sentences(raw), span, long_words)
                docs.extend([doc] * len(found))
                keys.extend([xxhash.xxh64_intdigest(raw, seed=42)] * len(found))  # as Spark's xxhash64
                for h, p, n in found:
                    hashes.append(h)
                    pos.append(p)
                    size.append(n)
            h = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0].copy(), pa.int64()), pa.array(h[:, 1].astype(np.int32), pa.int32()), pa.array(docs, pa.int64()), pa.array(np.array(keys, dtype=np.uint64).view(np.int64), pa.int64()), pa.array(pos, pa.int32()), pa.array(size, pa.int32())],
                ["h", "h2", "doc", "row_key", "pos", "n"],
            )

    return df.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(lean(run), "h long, h2 int, doc long, row_key long, pos int, n int")


def repeated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc, row_key, covered): the sentences of each document that a copy of an earlier run covers."""
    rows = materialize(run_rows(df, doc_id, text, span, long_words), "runs")  # read twice, made once
    first = rows.groupBy("h", "h2").agg(F.min(F.struct("doc", "row_key", "pos")).alias("first"), F.count("*").alias("seen")).where("seen > 1")
    copies = rows.join(first, ["h", "h2"]).where(F.struct("doc", "row_key", "pos") != F.col("first"))
    covered = copies.select("doc", "row_key", F.explode(F.sequence("pos", F.col("pos") + F.col("n") - 1)).alias("at"))
    return covered.groupBy("doc", "row_key").agg(F.collect_set("at").alias("covered"))


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, long_words: int = LONG_WORDS) -> DataFrame:
    """``df`` with the sentences that stay in ``text``, and the columns n_sentences and n_removed."""
    at, width = df.columns.index(text), len(df.columns)
    total, removed = free_name(df, "n_sentences"), free_name(df, "n_removed")
    names = [*df.columns, total, removed]
    doc, key, covered = (free_name(df, x) for x in ("doc_of_runs", "key_of_runs", "covered"))
    gone = repeated(df, doc_id, text, span, long_words).select(F.col("doc").alias(doc), F.col("row_key").alias(key), F.col("covered").alias(covered))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, lost = [], [], []
            for raw, cut in zip(utf8(batch.column(at)), batch.column(width).to_pylist(), strict=True):
                parts, cut = sentences(raw), set(cut or ())
                real = [i for i, p in enumerate(parts) if p.strip()]
                before.append(len(real))
                lost.append(sum(i in cut for i in real))
                texts.append(b"".join(p for i, p in enumerate(parts) if i not in cut) if cut else raw)
            columns = [*batch.columns[:width], pa.array(before, pa.int64()), pa.array(lost, pa.int64())]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    same = (F.col(doc_id).cast("long") == F.col(doc)) & (F.xxhash64(text) == F.col(key))
    joined = df.join(gone, same, "left").select(*(df[c] for c in df.columns), covered)
    return joined.mapInArrow(lean(run), T.StructType([*df.schema, T.StructField(total, T.LongType()), T.StructField(removed, T.LongType())]))
