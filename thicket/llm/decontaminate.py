"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a fixed mask over ``SPAN`` consecutive words: hashes cover only the positions marked 1, so a hit survives substituted words
elsewhere. Hashes of all places in documents meet the hashes of all places in the benchmark. Around each hit the document is laid
along the item without gaps, and the pair counts if in some window of ``WINDOW`` words (or the whole item, if shorter) at least
``SIMILARITY`` of the words agree.

Words are runs of letters and digits of the lower-cased text. Items shorter than a window have too few places for the masks: they are
cut into one piece more than words may differ, so one piece is always intact, and the pieces are their seeds. Items of fewer words than a
mask spans must agree word for word and are one piece; items of fewer than ``LEAST`` words prove nothing and are not looked for, unless ``least`` says so. Null and empty texts hold
no words. Rows without a doc_id cannot be named in the result and are left alone; repeated rows give one result.

The benchmark's hashes are broadcast if there are at most ``BROADCAST_SEEDS`` (16 MB or so), which is counted first; beyond it they
are joined by shuffled hash, and the documents with hits are read again to verify them.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from thicket.llm.common import free_name, materialize

#: Fixed masks of weight 6; each ignores other positions.
MASKS = ("1101100101", "1011010011", "1100101011", "1110010101")
SPAN, WEIGHT = 10, 6
WINDOW = 13
SIMILARITY = 0.8
LEAST = 4
BROADCAST_SEEDS = 500_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text (array<long>)."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _places(words: Column, span: int) -> Column:
    """Each place where a mask fits; none if there is none."""
    return F.when(F.size(words) >= span, F.sequence(F.lit(0), F.size(words) - span)).otherwise(F.array().cast("array<int>"))


def _pieces(n: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of an item of n words, one of which no accepted pair has a difference in."""
    k = 1 if n < SPAN else n - ceil(SIMILARITY * n) + 1
    edges = [n * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _whole(words: str, at: Column, n: int) -> Column:
    """The key of n words in a row."""
    return F.xxhash64(F.lit(-n), *(F.get(words, at + o) for o in range(n)))


def _hashed(df: DataFrame, words: str, at: str, spans: list[int]) -> DataFrame:
    """A row for each mask and place, with columns ``at`` and ``key``; spans: lengths of the pieces of short items."""
    # masks are rows too: one hash in the generated loop keeps its code small enough for the JIT compiler
    masks = F.array(*(F.array(F.lit(i), *(F.lit(o) for o, bit in enumerate(m) if bit == "1")) for i, m in enumerate(MASKS)))
    place = df.select("*", F.explode(_places(F.col(words), SPAN)).alias(at)).select("*", F.explode(masks).alias("mask"))
    key = F.xxhash64(F.get("mask", F.lit(0)), *(F.get(words, F.col(at) + F.get("mask", F.lit(i))) for i in range(1, WEIGHT + 1)))
    parts = [place.select("*", key.alias("key")).drop("mask")]
    for n in spans:
        parts.append(df.select("*", F.explode(_places(F.col(words), n)).alias(at)).select("*", _whole(words, F.col(at), n).alias("key")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _laid(words: Column, item: Column, shift: Column) -> list[Column]:
    """The words of the document under an item whose word p lies on document word p + shift, and how many item words hang over before."""
    over = F.greatest(F.lit(0), -shift)
    return [F.slice(words, F.greatest(F.lit(0), shift) + 1, F.size(item) - over).alias("part"), over.alias("over")]


def _best(part: Column, item: Column, over: Column) -> Column:
    """The most words that agree in a window of the item."""
    same = F.zip_with(part, F.slice(item, over + 1, F.size(part)), lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    size = F.least(F.lit(WINDOW), F.size(item))
    windows = F.when(F.size(part) >= size, F.sequence(F.lit(1), F.size(part) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.transform(windows, lambda i: F.aggregate(F.slice(same, i, size), F.lit(0), lambda a, b: a + b))), F.lit(0))


def overlaps(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, n_matched, n_window, similarity): each document and item that overlap, with their best window.

    least: words that an item must have; with 1, a document that has the word of an item of one word overlaps with it.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), word_hashes(F.col(item_text)).alias("item")).where((F.size("item") >= max(1, least)) & F.col("item_id").isNotNull())
    items = materialize(items, "items")
    # lengths of short items: fewer than WINDOW of them
    sizes = sorted(r[0] for r in items.where(F.size("item") < WINDOW).select(F.size("item")).distinct().collect())
    spans = sorted({length for n in sizes for _, length in _pieces(n)})
    seeds = _hashed(items.where(F.size("item") >= WINDOW), "item", "item_at", [])
    for n in sizes:
        for start, length in _pieces(n):
            seeds = seeds.unionByName(items.where(F.size("item") == n).select("*", F.lit(start).alias("item_at"), _whole("item", F.lit(start), length).alias("key")))
    seeds = seeds.distinct()
    small = seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    docs = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), word_hashes(F.col(text)).alias("words"))
    if small:
        hits = _hashed(docs, "words", "doc_at", spans).join(F.broadcast(seeds), "key").withColumn("shift", F.col("doc_at") - F.col("item_at"))
    else:
        met = _hashed(docs, "words", "doc_at", spans).select("key", "doc_id", "doc_at").join(seeds.select("key", "item_id", "item_at"), "key")
        pairs = met.select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
        hits = pairs.join(docs, "doc_id").join(items, "item_id")
    # Hits on one line are one. The words under the item are aggregated, not grouped by: the optimizer then cannot push the
    # verification into the join, whose loop stays small and emits nothing but hits, and no row carries a whole document.
    laid = hits.select("doc_id", "item_id", "item", *_laid(F.col("words"), F.col("item"), F.col("shift")), "shift")
    laid = laid.groupBy("doc_id", "item_id", "shift", F.xxhash64("part").alias("same")).agg(F.first("part").alias("part"), F.first("item").alias("item"), F.first("over").alias("over"))
    best = laid.select("doc_id", "item_id", F.least(F.lit(WINDOW), F.size("item")).alias("n_window"), _best(F.col("part"), F.col("item"), F.col("over")).alias("n_matched"))
    found = best.where(F.col("n_matched") >= F.when(F.col("n_window") < SPAN, F.col("n_window")).otherwise(F.ceil(F.lit(SIMILARITY) * F.col("n_window"))))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_matched").alias("n_matched"), F.max("n_window").alias("n_window")).withColumn("similarity", F.col("n_matched") / F.col("n_window"))


def clean(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of ``df`` that overlap with no item."""
    hit = free_name(df, "contaminated")
    found = overlaps(df, benchmark, doc_id, text, item_id, item_text, least=least).select(F.col("doc_id").alias(hit)).distinct()
    return df.join(found, F.col(doc_id) == F.col(hit), "left_anti")
