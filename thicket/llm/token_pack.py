"""Token ids in a binary file format: fixed-width bit packing with block offsets.

A shard file (little-endian): the header ``_HEADER``; the documents' ids (int64; those of the first n_null documents, which have none, are 0);
the start of each document within the shard, in ids, and the end of the last (uint64); the byte offset of each block and the end
of the last (uint64); the blocks. A block holds ``BLOCK_IDS`` token ids of ``width`` bits each, lowest bit first, padded to a whole
byte. ``width`` is the least that holds every id of the vocabulary, so any id is found by arithmetic and a block is unpacked by
numpy alone.

Shards cover ranges of doc_id in ascending order and hold about ``SHARD_BYTES`` of ids at most (or one document). A shard is written under
a name of its own attempt and then renamed, so a task that runs twice leaves one whole file. Readers ask for ranges of documents and read
the blocks that hold them, not whole files. The folder must be one that all executors share and pyarrow can open; others are refused.

Texts are encoded chunk by chunk between white space (which the tokenizer drops, and across which none of its steps reaches); the
library encodes each distinct chunk, or a chunk's letters and trailing signs, once while it stays in a bounded cache. This holds for
tokenizers with the steps in ``_STEPS``; with any other, and where a special token's string in a text counts as that token
(``special_tokens``, the library's default), the library encodes whole texts.

Nulls: a null text is empty and holds the end id alone. Documents without a doc_id come first. Rows that share a doc_id are
ordered by their ids' bytes.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from thicket.llm.common import lean, scratch_path

MAGIC = b"TKPACK01"
#: magic, width, ids in a block, documents, documents without a doc_id, ids, blocks
_HEADER = struct.Struct("<8sIIQQQQ")
BLOCK_IDS = 4096
#: Entries of each generation of the encoder's cache: about 100 MB a worker at most.
CACHE_WORDS = 250_000

#: Ids' bytes in a shard, about.
SHARD_BYTES = 32 << 20
#: Ids that a reader takes at once, about.
RANGE_IDS = 1 << 21

#: The tokenizer's steps before BPE for which texts may be cut at white space.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}

# A chunk of these letters (composed, one lower-case letter each) and signs is split by the tokenizer between the two.
_LETTERS, _SIGNS = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[.,;:!?|*%&$#]"


# encoding ---------------------------------------------------------------------------------------------------------------


class _Recent(dict):
    """A bounded cache in two generations: what was not asked for while the young one filled up is forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self._most, self._old = most, {}

    def missing(self, keys: list) -> list:
        """The keys that are not known; all others can then be read."""
        if len(self) > self._most:
            self._old = dict(self)
            self.clear()
        out, old = [], self._old
        for k in [k for k in keys if k not in self]:
            v = old.get(k)
            if v is None:
                out.append(k)
            else:
                self[k] = v
        return out


class ChunkEncoder:
    """Ids of texts. Splitting, finding distinct chunks and laying out ids are Arrow and numpy; only distinct words meet Python."""

    def __init__(self, path: str, special_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self._tokenizer.to_str())
        self._whole = any(steps.get(k) != v for k, v in _STEPS.items()) or any(x["normalized"] or not x["special"] for x in steps["added_tokens"])
        self._special = [x["content"] for x in steps["added_tokens"]] if special_tokens else []
        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = not special_tokens
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary = self._tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self._words = _Recent(CACHE_WORDS)

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct words, one after another, and how many each has."""
        unknown = self._words.missing(words)
        found = self._tokenizer.encode_batch_fast(unknown, add_special_tokens=False)
        self._words.update((w, np.array(e.ids, dtype=self.kind).tobytes()) for w, e in zip(unknown, found, strict=True))
        raw = list(map(self._words.__getitem__, words))
        return np.frombuffer(b"".join(raw), dtype=self.kind), np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // self.kind.itemsize

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self._whole:
            return self._by_library(texts)
        odd = np.zeros(len(texts), dtype=bool)
        for x in self._special:
            odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._by_chunks(texts)
        ids, sizes = self._by_chunks(pc.if_else(pa.array(odd), "", texts))
        more, more_sizes = self._by_library(texts.filter(pa.array(odd)))
        at = np.cumsum(sizes)[odd]  # where ids of texts with special tokens go in
        sizes = sizes.copy()
        sizes[odd] = more_sizes
        return np.insert(ids, np.repeat(at, more_sizes), more), sizes

    def _by_library(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(self._library.encode(x, add_special_tokens=False).ids, dtype=self.kind) for x in texts.to_pylist()]
        return np.concatenate([*found, np.zeros(0, dtype=self.kind)]), np.array([len(x) for x in found], dtype=np.int64)

    def _by_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        chunks = split.values.dictionary_encode()
        kinds, at = chunks.dictionary, chunks.indices.to_numpy()
        simple = pc.match_substring_regex(kinds, f"^{_LETTERS}+{_SIGNS}*$")
        core = pc.if_else(simple, pc.utf8_lower(pc.replace_substring_regex(kinds, f"{_SIGNS}*$", "")), kinds)
        tail = pc.if_else(simple, pc.replace_substring_regex(kinds, f"^{_LETTERS}+", ""), "")
        both = pa.concat_arrays([core, tail]).dictionary_encode()
        ids, sizes = self._pieces(both.dictionary.to_pylist())
        of_kind = both.indices.to_numpy().reshape(2, -1)
        pieces = of_kind[:, at].T.ravel()  # letters and signs of each chunk, in turn
        size = sizes[pieces]
        ends = np.cumsum(size)
        starts = (np.cumsum(sizes) - sizes)[pieces]
        flat = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + size, size)]
        offsets = 2 * split.offsets.to_numpy().astype(np.int64)
        upto = np.append(0, ends)
        return flat, upto[offsets[1:] - offsets[0]] - upto[offsets[:-1] - offsets[0]]


@lru_cache(maxsize=2)
def encoder(path: str, special_tokens: bool = False) -> ChunkEncoder:
    return ChunkEncoder(path, special_tokens)


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids of ``width`` bits each, lowest bit first, padded to a byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None].astype(np.uint64) >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{width // 8}", count=n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


# shard files ------------------------------------------------------------------------------------------------------------


def build_shard(doc_ids: list[int | None], docs: list[np.ndarray], width: int) -> bytes:
    starts = np.zeros(len(docs) + 1, dtype="<u8")
    np.cumsum([len(x) for x in docs], out=starts[1:])
    ids = np.concatenate(docs) if docs else np.zeros(0, dtype=np.uint32)
    blocks = [pack(ids[i : i + BLOCK_IDS], width) for i in range(0, len(ids), BLOCK_IDS)]
    at = _HEADER.size + 8 * len(docs) + 8 * len(starts) + 8 * (len(blocks) + 1)
    offsets = np.zeros(len(blocks) + 1, dtype="<u8")
    offsets[0] = at
    np.cumsum([len(b) for b in blocks], out=offsets[1:])
    offsets[1:] += np.uint64(at)
    head = _HEADER.pack(MAGIC, width, BLOCK_IDS, len(docs), sum(d is None for d in doc_ids), len(ids), len(blocks))
    return b"".join([head, np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """A shard, with random access to documents and ranges of ids. read: the bytes from an offset on, so many."""

    def __init__(self, data: bytes | Callable[[int, int], bytes]):
        self._read = data if callable(data) else lambda at, n: data[at : at + n]
        magic, self.width, self.block_ids, self.n_docs, self.n_null, self.n_ids, self.n_blocks = _HEADER.unpack_from(self._read(0, _HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of packed ids")

    def _numbers(self, table: int, first: int, n: int) -> np.ndarray:
        """Of the tables after the header: ids of documents (0), their starts (1), offsets of blocks (2)."""
        at = _HEADER.size + 8 * (self.n_docs * min(table, 1) + (self.n_docs + 1) * max(0, table - 1) + first)
        return np.frombuffer(self._read(at, 8 * n), dtype="<i8" if table == 0 else "<u8")

    def names(self, lo: int, hi: int) -> list[int | None]:
        """The doc_ids of documents lo to hi."""
        return [None if lo + i < self.n_null else d for i, d in enumerate(self._numbers(0, lo, hi - lo).tolist())]

    def starts(self, lo: int, hi: int) -> np.ndarray:
        """Where documents lo to hi begin, and the last of them ends."""
        return self._numbers(1, lo, hi - lo + 1).astype(np.int64)

    @property
    def doc_ids(self) -> list[int | None]:
        return self.names(0, self.n_docs)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids in [start, end), from the blocks that hold them."""
        if start >= end:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        offsets = self._numbers(2, first, last - first + 2).astype(np.int64)
        data = memoryview(self._read(int(offsets[0]), int(offsets[-1] - offsets[0])))
        offsets -= offsets[0]
        sizes = [min(self.block_ids, self.n_ids - k * self.block_ids) for k in range(first, last + 1)]
        out = [unpack(data[a:b], self.width, n) for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), sizes, strict=True)]
        return np.concatenate(out)[start - first * self.block_ids : end - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.starts(i, i + 1).tolist())


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder with a scheme, and the folder's path in it."""
    return pafs.FileSystem.from_uri(re.sub("^s3a://", "s3://", re.sub("^file:/(?!/)", "file:///", folder)))


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file whole or not at all."""
    fs, path = _opened(folder)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, f"{path}/{name}")


def write(
    df: DataFrame,
    tokenizer_path: str,
    end_id: int,
    folder: str,
    doc_id: str = "doc_id",
    text: str = "text",
    partitions: int | None = None,
    special_tokens: bool = False,
    shard_bytes: int = SHARD_BYTES,
) -> list[tuple[str, int, int]]:
    """Encode ``df`` and write shards in ascending doc_id order to ``folder``, a place that all executors share.

    Returns (file with the folder, documents, ids) of each shard, in order: a row a shard.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = width_of(encoder(tokenizer_path, special_tokens).vocabulary)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    folder = files.makeQualified(hadoop).toString()  # as executors must read it, whatever their default file system
    _opened(folder)  # raises if pyarrow knows no such file system
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # borders between partitions from the ids alone: the texts are not read for this, and encoded only once
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("c")).first()["c"] if n > 1 else None
    borders = np.array(sorted(set(cuts or ())), dtype=np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(tokenizer_path, special_tokens)
        for batch in batches:
            ids, sizes = to_ids.encode(batch.column(1))
            packed, counts, end = [], [], np.array([end_id], dtype=to_ids.kind)
            for last, size in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
                packed.append(pack(np.append(ids[last - size : last], end), width))
                counts.append(size + 1)
            doc = batch.column(0)
            part = np.searchsorted(borders, doc.fill_null(0).to_numpy())
            part[~doc.is_valid().to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays([doc, pa.array(counts, pa.int64()), pa.array(packed, pa.binary()), pa.array(part, pa.int32())], ["doc_id", "n", "packed", "part"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, docs, held, number = [], [], 0, 0

        def flush(part: int) -> pa.RecordBatch:
            nonlocal held, number
            _put(folder, name := f"shard-{part:06d}-{number:06d}.bin", build_shard(doc_ids, docs, width))
            row = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(docs)], pa.int64()), pa.array([sum(map(len, docs))], pa.int64())], ["file", "docs", "ids"])
            doc_ids.clear()
            docs.clear()
            held, number = 0, number + 1
            return row

        part = 0
        for batch in batches:
            for doc, count, data, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held + len(data) > shard_bytes:
                    yield flush(part)
                doc_ids.append(doc)
                docs.append(unpack(data, width, count))
                held += len(data)
        if docs:
            yield flush(part)

    packed = rows.mapInArrow(lean(encode), "doc_id long, n long, packed binary, part int")
    dealt = packed.repartitionById(n, F.col("part")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "packed")
    return sorted(tuple(r) for r in dealt.mapInArrow(lean(store), "file string, docs long, ids long").collect())


def read(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the shards, ``ids`` as little-endian uint32 bytes."""
    ranges, base = [], 0
    for file, docs, ids in shards:
        step = max(1, min(docs, docs * RANGE_IDS // max(1, ids)))
        ranges.extend((file, base, lo, min(lo + step, docs)) for lo in range(0, docs, step))
        base += ids

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = _opened(file)
                with fs.open_input_file(path) as f:
                    shard = Shard(lambda at, n, f=f: f.read_at(n, at))
                    for a in range(lo, hi, 256):
                        b = min(a + 256, hi)
                        starts = shard.starts(a, b)
                        flat = shard.ids(int(starts[0]), int(starts[-1])).astype("<u4")
                        docs = [flat[x:y].tobytes() for x, y in pairwise((starts - starts[0]).tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard.names(a, b), pa.int64()), pa.array(before + starts[:-1]), pa.array(np.diff(starts)), pa.array(docs, pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )

    # two numbers and a name a range of documents, dealt out in turn
    wanted = spark.createDataFrame(ranges, "file string, before long, lo long, hi long").repartition(max(1, min(len(ranges), 100_000)))
    return wanted.mapInArrow(lean(parse), "doc_id long, start long, n_tokens long, ids binary")


def pack_table(df: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", special_tokens: bool = False) -> DataFrame:
    """Write ``df`` to shards in the shared folder and read them back."""
    folder = scratch_path(df.sparkSession, "tokens")
    return read(df.sparkSession, write(df, tokenizer_path, end_id, folder, doc_id, text, special_tokens=special_tokens))
