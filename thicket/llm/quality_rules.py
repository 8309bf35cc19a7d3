"""Quality rules: counts of words, symbols and repeats, and language-specific bands of n-gram perplexity.

Two models with modified Kneser-Ney smoothing score each text, both counted by Spark over all documents of a language:

* Bytes (trigrams), for spelling and markup. A language has at most 256^3 of them (200 MB as sorted arrays of hashes; real ones have
  about 10,000), so this model is bounded by the alphabet and may be broadcast.
* Words (bigrams, which leave what they lack to the spelling), see ``word_model``. They grow with the corpus and stay distributed as
  sorted arrays of hashes. Each text is scored with the counts of the other fold, so it does not vouch for itself.

A document's scores are its mean negative log probability a byte and a word (the logs of its perplexities). Each language gets a band
around its median score. Documents outside the band of bytes are rejected, above it (noise, markup, other languages) and below it
(repetition), and those above the band of words (words in no plausible order). Below the latter lie texts with a near copy in the
other fold, which is not a fault. The bands are ``BAND`` robust standard deviations wide on either side, and wider for short texts
(``SLACK / sqrt(bytes)``, ``WORD_SLACK / sqrt(words)``, the spread of a mean) and for languages with few documents. Median and spread
are exact over all documents, with copies counted once.

Nulls: a null text has no words and fails the base rules; null languages make one group. A null id is carried along.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from thicket.llm import word_model
from thicket.llm.common import ASCII_WS, free_name, lean, materialize, utf8

MIN_WORDS = 50
MAX_REPEATED = 0.5
SYMBOLS = b"#*$%&|<>"
BAND = 3.0
SLACK = 1.0
WORD_SLACK = 3.0
BIN = 1e-4
_FLUSH = 1 << 22
#: A word is surveyed as frequent where it makes up this share of a task's words: at most ``1 / SHARE`` rows a task.
SHARE = 2.0**-16


# counting ---------------------------------------------------------------------------------------------------------------


def _grams(text: bytes) -> np.ndarray:
    """The trigram that ends at each byte; two zero bytes stand before the text."""
    a = np.frombuffer(b"\0\0" + text, dtype=np.uint8).astype(np.int32)
    return (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]


_GRAM, _WORD, _WORDS = 0, 1, 2


def survey(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(kind, lang, code, n) over every whole text; tasks count their own rows first. Kinds: byte trigrams, contexts of words that make up
    ``SHARE`` or more of a task's words, and the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = defaultdict(list)
        held: Counter[str] = Counter()
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        contexts: list[np.ndarray] = []
        kinds, total = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)), 0

        def merged(before: tuple[np.ndarray, np.ndarray] | None, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.unique(np.concatenate(values), return_counts=True)
            if before is None or not len(before[0]):
                return keys, n
            both, where = np.unique(np.concatenate([before[0], keys]), return_inverse=True)
            return both, np.bincount(where, weights=np.concatenate([before[1], n])).astype(np.int64)

        def flush(key: str) -> None:
            found[key] = merged(found.get(key), waiting.pop(key))
            held[key] = 0

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for key, raw in zip(langs, utf8(batch.column(1)), strict=True):
                if raw:
                    waiting[key].append(_grams(raw))
                    held[key] += len(raw)
                    if held[key] > _FLUSH:
                        flush(key)
            ids, rows, _ = word_model.words(*word_model.raw_texts(batch.column(1)), word_model.seeds_of(langs))
            contexts.append(word_model.before(ids, rows))
            total += len(ids)
            if sum(map(len, contexts)) > _FLUSH:
                kinds, contexts = merged(kinds, contexts), []
        for key in list(waiting):
            flush(key)
        if contexts:
            kinds = merged(kinds, contexts)
        often = kinds[1] >= SHARE * total
        rows = [(_GRAM, key, *x) for key, x in found.items()] + [(_WORD, "", kinds[0][often], kinds[1][often]), (_WORDS, "", np.zeros(1), np.array([total]))]
        for kind, key, codes, counts in rows:
            n = len(codes)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([key] * n, pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], ["kind", "lang", "code", "n"])

    texts = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text"))
    return texts.mapInArrow(lean(run), "kind int, lang string, code long, n long").groupBy("kind", "lang", "code").agg(F.sum("n").alias("n"))


def count_grams(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) of the byte trigrams of every whole text."""
    return survey(df, text, lang).where(F.col("kind") == _GRAM).select("lang", F.col("code").cast("int").alias("gram"), "n")


# the model --------------------------------------------------------------------------------------------------------------


def _hash(order: int, codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams; one to one, as both steps can be undone."""
    x = (codes.astype(np.uint64) | np.uint64(order << 32)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@dataclass
class KneserNey:
    """hashes: sorted, of all n-grams of each order; logp, backoff: of the same n-grams, natural logs."""

    hashes: np.ndarray
    logp: np.ndarray
    backoff: np.ndarray

    def _find(self, order: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = _hash(order, codes)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return at, self.hashes[at] == wanted

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Of the last byte of each trigram after its first two."""
        at, seen = self._find(3, grams)
        out = np.where(seen, self.logp[at], 0.0).astype(np.float64)
        left = np.flatnonzero(~seen)
        for order, mask in ((2, 0xFFFF), (1, 0xFF)):
            context, known = self._find(order, grams[left] >> 8 & mask)
            lower, found = self._find(order, grams[left] & mask)
            out[left] += np.where(known, self.backoff[context], 0.0) + np.where(found, self.logp[lower], 0.0)
            left = left[~found]
        out[left] += float(self.backoff[np.searchsorted(self.hashes, _hash(0, np.zeros(1, dtype=np.int64)))[0]]) + np.log(1 / 256)
        return out


def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2, and 3 or more."""
    return _discounts_of(*(max(1, int((n == i).sum())) for i in (1, 2, 3, 4)))


def _discounts_of(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """The same from how many n-grams have a count of 1, 2, 3 and 4."""
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.85])


def _smooth(codes: np.ndarray, n: np.ndarray, lower: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interpolated probabilities of n-grams, and the weight that each context leaves to the lower order. width: of contexts' codes, in bits."""
    d = _discounts(n)
    context = codes >> 8
    size = 1 << width
    total = np.bincount(context, weights=n, minlength=size)
    kinds = np.minimum(n, 3)
    left = sum(d[k] * np.bincount(context[kinds == k], minlength=size) for k in (1, 2, 3))
    with np.errstate(divide="ignore", invalid="ignore"):
        gamma = left / total
        p = (n - d[kinds]) / total[context] + gamma[context] * lower
    return p, gamma, total


def kneser_ney(grams: np.ndarray, n: np.ndarray) -> KneserNey:
    """The model of one language from all its trigrams and their counts."""
    order = np.argsort(grams)
    grams, n = grams[order].astype(np.int64), n[order].astype(np.int64)
    pairs, followers = np.unique(grams & 0xFFFF, return_counts=True)  # in how many kinds of trigram
    ends, kinds = np.unique(pairs & 0xFF, return_counts=True)
    p1, gamma0, _ = _smooth(ends, kinds, np.full(len(ends), 1 / 256), 0)
    by_end = np.zeros(256)
    by_end[ends] = p1
    p2, gamma1, total1 = _smooth(pairs, followers, by_end[pairs & 0xFF], 8)
    by_pair = np.zeros(1 << 16)
    by_pair[pairs] = p2
    p3, gamma2, total2 = _smooth(grams, n, by_pair[grams & 0xFFFF], 16)
    seen2 = np.union1d(pairs, np.flatnonzero(total2))
    seen1 = np.union1d(ends, np.flatnonzero(total1))
    with np.errstate(divide="ignore", invalid="ignore"):
        lower2 = np.where(by_pair[seen2] > 0, by_pair[seen2], gamma1[seen2 >> 8] * by_end[seen2 & 0xFF])
        lower2 = np.where(lower2 > 0, lower2, 1 / 256)
        lower1 = np.where(by_end[seen1] > 0, by_end[seen1], gamma0[0] / 256)
        arrays = [
            (_hash(0, np.zeros(1, dtype=np.int64)), np.zeros(1), np.log(np.maximum(gamma0[:1], 1e-12))),
            (_hash(3, grams), np.log(p3), np.zeros(len(grams))),
            (_hash(2, seen2), np.log(lower2), np.nan_to_num(np.log(gamma2[seen2]), nan=0.0, neginf=0.0)),
            (_hash(1, seen1), np.log(lower1), np.nan_to_num(np.log(gamma1[seen1]), nan=0.0, neginf=0.0)),
        ]
    hashes, logp, backoff = (np.concatenate(x) for x in zip(*arrays, strict=True))
    order = np.argsort(hashes)
    return KneserNey(hashes[order], logp[order].astype(np.float32), backoff[order].astype(np.float32))


class Spelling:
    """Log probabilities of byte trigrams by language, from their models, as a table with a row for each context of two bytes.

    Workers get the models' arrays and make the table once: a row (1 KB) for each of a language's contexts, at most 256^2 of them.
    """

    def __init__(self, models: dict[str, KneserNey]):
        self.langs = sorted(models)
        self._models = models
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def codes(self, langs: list[str]) -> np.ndarray:
        at = {x: i for i, x in enumerate(self.langs)}
        return np.array([at.get(x, -1) for x in langs], dtype=np.int64)

    def _built(self) -> tuple[np.ndarray, np.ndarray]:
        if self._table is None:
            rows, tables, base = np.zeros((len(self.langs), 1 << 16), dtype=np.int32), [], 0
            every = np.arange(256, dtype=np.int64)
            for i, lang in enumerate(self.langs):
                model = self._models[lang]
                _, seen = model._find(2, np.arange(1 << 16, dtype=np.int64))
                contexts = np.flatnonzero(seen)
                # contexts that were never seen differ by their second byte alone
                free = np.argmin(seen.reshape(256, 256), axis=0) << 8 | every
                contexts = np.concatenate([free, contexts])
                rows[i] = base + np.tile(every, 256)
                rows[i][contexts[256:]] = base + 256 + np.arange(len(contexts) - 256)
                for k in range(0, len(contexts), 1024):
                    some = contexts[k : k + 1024]
                    tables.append(model.log_probabilities((some[:, None] << 8 | every).ravel()).astype(np.float32))
                base += len(contexts)
            self._table = rows.ravel(), np.concatenate(tables) if tables else np.zeros(0, dtype=np.float32)
        return self._table

    def logs(self, grams: np.ndarray, lang: np.ndarray | int) -> np.ndarray:
        """Of trigrams, and the codes of their languages."""
        rows, table = self._built()
        return table[rows[(grams >> 8) + (lang << 16)].astype(np.int64) * 256 + (grams & 255)]


def _surveyed(df: DataFrame, text: str, lang: str) -> tuple[dict[str, KneserNey], dict[int, int], int]:
    """The spelling models, the counts of frequent contexts, and the number of words."""
    counts = survey(df, text, lang).toArrow()
    kind, langs = counts.column("kind").to_numpy(), np.array(counts.column("lang").to_pylist(), dtype=object)
    codes, n = counts.column("code").to_numpy(), counts.column("n").to_numpy()
    grams = kind == _GRAM
    models = {key: kneser_ney(codes[at], n[at]) for key in dict.fromkeys(langs[grams].tolist()) for at in [np.flatnonzero(grams & (langs == key))]}
    return models, dict(zip(codes[kind == _WORD].tolist(), n[kind == _WORD].tolist(), strict=True)), int(n[kind == _WORDS].sum())


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, KneserNey]:
    """A spelling model for each language, counted over all documents."""
    return _surveyed(df, text, lang)[0]


# rules ------------------------------------------------------------------------------------------------------------------


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or b""
    words = text.split()
    kept = text.translate(None, ASCII_WS)
    chars = len(kept) if kept.isascii() else len(kept.decode())
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        marks = bytearray(len(words))
        for i, x in enumerate(windows):
            if seen[x] > 1:
                marks[i : i + 3] = b"\1\1\1"
        repeated = sum(marks)
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = (*COUNTS, "log_perplexity", "word_log_perplexity", "base_failed", "kept")


def score(df: DataFrame, spelling: Broadcast, text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` without ``text``, with one more column, ``quality``: a struct of the base counts, n_bytes, score (null without text) and lang."""
    out = free_name(df, "quality")
    with_key = df.withColumn(key := free_name(df, "lang_key"), F.coalesce(F.col(lang).cast("string"), F.lit("")))
    at, at_key = df.columns.index(text), len(df.columns)
    columns = [i for i in range(at_key) if i != at]
    fields = [df.schema[i] for i in columns]
    kinds = pa.struct([*((c, pa.int64()) for c in COUNTS), ("n_bytes", pa.int64()), ("score", pa.float64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spelling.value
        for batch in batches:
            rows = []
            langs = batch.column(at_key).to_pylist()
            for language, code, raw in zip(langs, model.codes(langs).tolist(), utf8(batch.column(at)), strict=True):
                value = -float(model.logs(_grams(raw), code).mean(dtype=np.float64)) if raw and code >= 0 else None
                rows.append((*base_counts(raw), len(raw or b""), value, language))
            struct = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], fields=list(kinds))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in columns), struct], [*(f.name for f in fields), out])

    struct = T.StructType([*(T.StructField(c, T.LongType()) for c in (*COUNTS, "n_bytes")), T.StructField("score", T.DoubleType()), T.StructField("lang", T.StringType())])
    return with_key.mapInArrow(lean(run), T.StructType([*fields, T.StructField(out, struct)]))


def bands(scored: DataFrame, lang: Column, size: Column, score: Column) -> dict[str, tuple[float, float]]:
    """Median and robust spread of the scores of each language; texts of the same size and score count once.

    At most one row for each language and score in steps of ``BIN`` comes to the driver; scores lie under log(2^40).
    """
    rows = scored.select(lang.alias("lang"), size.alias("n"), score.alias("s")).where("s is not null").distinct()
    binned = rows.groupBy("lang", F.round(F.col("s") / BIN).cast("long").alias("bin")).count().toArrow()
    by: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for x in binned.to_pylist():
        by[x["lang"]].append((x["bin"], x["count"]))
    return {key: _middle(np.array(sorted(x), dtype=np.float64)) for key, x in by.items()}


def _middle(x: np.ndarray) -> tuple[float, float]:
    def median(values: np.ndarray, weights: np.ndarray) -> float:
        order = np.argsort(values, kind="stable")
        up = np.cumsum(weights[order])
        return float(values[order][np.searchsorted(up, up[-1] / 2)])

    mid = median(x[:, 0], x[:, 1])
    spread = 1.4826 * median(np.abs(x[:, 0] - mid), x[:, 1]) * BIN
    return mid * BIN, max(spread, 0.005) + 0.5 / np.sqrt(x[:, 1].sum())


def _over(found: dict[str, tuple[float, float]], lang: Column, score: Column, slack: Column) -> Column:
    """How far a score lies above (below: under 0) its language's median, in units of the room it has; null without a score."""
    if not found:
        return F.lit(None).cast("double")
    table = F.create_map(*(x for key, (mid, spread) in sorted(found.items()) for x in (F.lit(key), F.array(F.lit(mid), F.lit(spread)))))
    return (score - table[lang][0]) / (BAND * table[lang][1] + slack)


def verdict(scored: DataFrame, of_bytes: dict[str, tuple[float, float]], of_words: dict[str, tuple[float, float]], quality: str, word_score: str) -> tuple[Column, Column]:
    """Columns base_failed and kept for the rows of ``score`` with their word scores."""
    q = F.col(quality)
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > 100 * MAX_REPEATED * q["n_words"])
    spelled = F.abs(_over(of_bytes, q["lang"], q["score"], SLACK / F.sqrt(q["n_bytes"]))) <= 1
    ordered = _over(of_words, q["lang"], F.col(word_score), WORD_SLACK / F.sqrt(q["n_words"])) <= 1
    return failed, ~failed & F.coalesce(spelled, F.lit(True)) & F.coalesce(ordered, F.lit(True))


def _judged(df: DataFrame, text: str, lang: str) -> tuple[DataFrame, Column, Column, Column, Column]:
    """The rows of ``df`` without the text, with a column of counts and one of word scores (by columns); base_failed and kept."""
    spark = df.sparkSession
    models, frequent, n_words = _surveyed(df, text, lang)
    spelling = spark.sparkContext.broadcast(Spelling(models))  # see Spelling for its bound
    by_text = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("doc"))
    words = materialize(word_model.word_scores(by_text, n_words, frequent, spelling, _discounts_of), "word-scores")
    doc = free_name(df, "text_hash")
    plain = score(df.withColumn(doc, F.xxhash64(text)), spelling, text, lang)
    name, out = plain.columns[-1], free_name(plain, "word_score")
    right = words.select(F.col("lang").alias("_l"), F.col("doc").alias("_d"), F.col("word_score").alias("_s"))
    left = plain.alias("p")
    at = [F.col(f"p.`{c}`") for c in plain.columns]
    joined = left.join(right, (F.col(f"p.`{name}`")["lang"] == F.col("_l")) & (F.col(f"p.`{doc}`") == F.col("_d")), "left")
    scored = materialize(joined.select(*at, F.col("_s").alias(out)), "quality")
    q, w = F.col(name), F.col(out)
    failed, kept = verdict(scored, bands(scored, q["lang"], q["n_bytes"], q["score"]), bands(scored, q["lang"], q["n_words"], w), name, out)
    return scored, q, w, failed, kept


def rules(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts, scores and verdict of every document: its columns without the text, the counts, log_perplexity (a byte), word_log_perplexity,
    base_failed, kept. A column of ``df`` with one of these names stays under a name with underscores before it."""
    rest = [c for c in df.columns if c != text]
    scored, q, w, failed, kept = _judged(df, text, lang)
    new = dict(zip(RESULT, (*(q[c] for c in COUNTS), q["score"], w, failed, kept), strict=True))
    taken, old = {*rest, *RESULT}, []
    for c in rest:
        name = c
        if c in RESULT:
            while name in taken:
                name = f"_{name}"
            taken.add(name)
        old.append(F.col(f"`{c}`").alias(name))
    return scored.select(*old, *(value.alias(c) for c, value in new.items()))


def kept(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` that the rules keep, columns unchanged. The verdict is the same for rows of one text and language."""
    few = df.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.xxhash64(text).alias("doc"))
    scored, _, _, _, good = _judged(few, "text", "lang")
    gone = scored.where(~good).select(F.col("lang").alias("_l"), F.col("doc").alias("_d")).distinct()
    left = df.alias("p")
    same = (F.coalesce(F.col(f"p.`{lang}`").cast("string"), F.lit("")) == F.col("_l")) & (F.xxhash64(F.col(f"p.`{text}`")) == F.col("_d"))
    return left.join(gone, same, "left_anti").select(*(F.col(f"p.`{c}`") for c in df.columns))
