"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

Grades: 0 toxic, 1 poor, 2 good. P(grade <= k) = sigmoid(t_k - s), with ordered thresholds t_0 < t_1 and one score s that all grades share:
the sum of the weights of the hashed words and word beginnings that a text has, of their shapes, and of its share of different words. The expected
grade is 2 - P(<=0) - P(<=1); the tail probability P(grade = 2) selects.

Fitting takes at most ``MAX_LABELLED`` labelled documents (those whose ids hash lowest, so the choice is fixed and even over sources),
whose feature lists come to the driver: about 30 MB. Every document is scored, over its whole text. The model has ``BITS`` + a few weights.

Nulls: a null text has no words and the score of the shapes alone; labels without grades are not used; without any label every
document is expected to be good. Repeated labels of a document count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from thicket.llm.common import free_name, lean, list_array, utf8

BITS = 18
MAX_LABELLED = 20_000
GRADES = 3
KEEP = 0.5
EPOCHS = 12
L1 = 2e-5
CACHE_WORDS = 300_000

_SIGNS = b".,;:!?|*%&$#\"'()<>-"
_SHAPES = 4 * (len(_SIGNS) + 2)
_SHARES = 11
SIZE = (1 << BITS) + _SHAPES + _SHARES


def _hash(kind: bytes, part: bytes) -> int:
    return xxhash.xxh32_intdigest(kind + part) & ((1 << BITS) - 1)


def _word(word: bytes) -> tuple[int, ...]:
    """The features of a word: its letters and how they begin, hashed, and its shape (capitals, and its last sign)."""
    core = word.strip(_SIGNS)
    last = _SIGNS.find(word[-1:]) + 1 if word[-1:] not in (b".", b",") else 0
    upper = (2 if len(core) > 1 and core.isupper() else 0) + (not core)
    shape, low = (1 << BITS) + 4 * last + upper, core.lower()
    return (_hash(b"", low), shape) if len(low) <= 4 else (_hash(b"", low), shape, _hash(b"4", low[:4]), _hash(b"5", low[:5]))


class Features:
    """Sorted distinct features of a text. Words already met are kept, up to a bound."""

    def __init__(self) -> None:
        self._known: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        kinds = set(words)
        if len(self._known) > CACHE_WORDS:
            self._known = {}
        known = self._known
        for w in kinds:
            if w not in known:
                known[w] = _word(w)
        share = SIZE - _SHARES + (int(10 * len(kinds) / len(words)) if len(words) >= 20 else 10)
        return np.unique(np.array([share, *(x for w in kinds for x in known[w])], dtype=np.int32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum())

    def cumulative(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) of each score for k below the top grade."""
        return _sigmoid(self.thresholds[None, :] - scores[:, None])


def fit(rows: list[np.ndarray], grades: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> OrdinalModel:
    """Maximum likelihood with an L1 penalty, by Adagrad over small batches."""
    w, g2 = np.zeros(SIZE), np.full(SIZE, 1e-2)
    share = np.cumsum([(grades == k).sum() + 1 for k in range(GRADES)])[:-1] / (len(grades) + GRADES)
    t = np.log(share / (1 - share))  # increases with k
    if not len(rows):
        return OrdinalModel(w.astype(np.float32), np.array([-4.0, -2.0]))
    t2 = np.full(GRADES - 1, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 64):
            some = order[i : i + 64]
            columns = np.concatenate([rows[j] for j in some])
            owner = np.repeat(np.arange(len(some)), [len(rows[j]) for j in some])
            s, y = np.bincount(owner, weights=w[columns], minlength=len(some)), grades[some]
            above, below = np.append(t, np.inf)[y] - s, np.append(-np.inf, t)[y] - s
            a, b = _sigmoid(np.minimum(above, 40)), _sigmoid(np.maximum(below, -40))
            a, b = np.where(np.isinf(above), 1.0, a), np.where(np.isinf(below), 0.0, b)
            ds = 1 - a - b  # of the negative log likelihood
            p = np.maximum(a - b, 1e-9)
            dt = np.zeros(GRADES - 1)
            np.add.at(dt, y[y < GRADES - 1], -(a * (1 - a) / p)[y < GRADES - 1])
            np.add.at(dt, y[y > 0] - 1, (b * (1 - b) / p)[y > 0])
            touched, where = np.unique(columns, return_inverse=True)
            grad = np.bincount(where, weights=ds[owner]) / len(some)
            g2[touched] += grad**2
            rate = 0.1 / np.sqrt(g2[touched])
            stepped = w[touched] - rate * grad
            w[touched] = np.sign(stepped) * np.maximum(np.abs(stepped) - rate * L1, 0)
            t2 += (dt / len(some)) ** 2
            t = np.sort(t - 0.05 * dt / len(some) / np.sqrt(t2))
            t[1:] = np.maximum(t[1:], t[:-1] + 1e-3)
    return OrdinalModel(w.astype(np.float32), t)


def grade(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality.isNotNull(), 2)


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MAX_LABELLED) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of at most ``most`` labelled documents."""
    chosen = labels.select(F.col(doc_id).alias("labelled"), grade(F.col("quality"), F.col("toxic")).alias("grade")).where("labelled IS NOT NULL AND grade IS NOT NULL")
    chosen = chosen.orderBy(F.xxhash64("labelled"), "labelled", "grade").limit(most)  # at most ``most`` rows of 12 bytes: small enough to broadcast
    plain = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    met = plain.join(F.broadcast(chosen), F.col("doc") == F.col("labelled")).select("labelled", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_array([features(x) for x in utf8(batch.column(2))], pa.int32())], ["doc_id", "grade", "features"])

    found = met.mapInArrow(lean(run), "doc_id long, grade int, features array<int>").toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    return [x.values.to_numpy() for x in found.column("features")], found.column("grade").to_numpy().astype(np.int64)


def grades(df: DataFrame, model: OrdinalModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with the columns expected_grade, tail_probability and kept."""
    at = df.columns.index(text)
    columns = [i for i in range(len(df.columns)) if keep_text or i != at]
    fields = [df.schema[i] for i in columns]
    out = [free_name(df, c) for c in ("expected_grade", "tail_probability", "kept")]
    names = [*(f.name for f in fields), *out]
    broadcast = df.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, fitted = Features(), broadcast.value
        for batch in batches:
            scores = np.array([fitted.score(features(x)) for x in utf8(batch.column(at))])
            below = fitted.cumulative(scores)
            tail = 1 - below[:, -1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in columns), pa.array((GRADES - 1) - below.sum(axis=1)), pa.array(tail), pa.array(tail >= KEEP)], names)

    kinds = [T.DoubleType(), T.DoubleType(), T.BooleanType()]
    return df.mapInArrow(lean(run), T.StructType([*fields, *(T.StructField(c, k) for c, k in zip(out, kinds, strict=True))]))
