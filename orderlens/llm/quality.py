"""Quality classifier from trusted positives and unlabelled text.

Documents marked as good are the positives; documents drawn without regard to
their labels are the unlabelled part.  The share of good documents in it is
estimated first (best-bin estimate: the smallest ratio of the shares of both
samples above a threshold of a classifier that tells them apart), then an
additive logistic model minimises the non-negative unbiased risk

    prior * R_pos(+)  +  max(0, R_unl(-) - prior * R_pos(-)).

Every feature is a figure of the whole text; its range is cut at quantiles of
the unlabelled sample and each interval has a weight.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import fold, ship_package

#: Bounds of the two samples that are fitted, in rows expected.
POSITIVES, UNLABELLED = 4000, 8000
BINS = 16
STEPS, RATE, DECAY = 1200, 0.2, 1e-5
THRESHOLD = 0.3
HELD_OUT_FOLD, FOLDS = 0, 5
FEATURES = ("log_chars", "letters", "upper", "digits", "marks", "odd_marks", "breaks", "distinct_words", "top_word",
            "repeats", "word_chars", "letterless_words", "marked_words", "distinct_lines", "line_words", "word_spread")


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Per code point: 0 other, 1 lower-case or caseless letter, 2 upper, 3 digit, 4 white space, 5 plain mark."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in map(chr, range(0x110000)):
        if c.isalpha():
            table[ord(c)] = 2 if c.isupper() else 1
        elif c.isdigit():
            table[ord(c)] = 3
        elif c.isspace():
            table[ord(c)] = 4
    table[[ord(c) for c in ".,;:'\"?-()"]] = 5
    return table


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; a null text counts as empty (all zero)."""
    text = text or ""
    n = len(text)
    if n == 0:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    other, lower, upper, digits, _, plain = np.bincount(kinds()[codes], minlength=6)[:6]
    letters = lower + upper
    words = text.split()
    counts = Counter(words)
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x]
    lettered = sum(k for w, k in counts.items() if any(c.isalpha() for c in w))
    marked = sum(k for w, k in counts.items() if len(w) > 1 and not w[-1].isalnum() and not w[-2].isalnum())
    return [float(np.log1p(n)), letters / n, upper / max(letters, 1), digits / n, (other + plain) / n,
            other / max(other + plain, 1), text.count("\n") / n, len(counts) / m**0.7,
            max(counts.values(), default=0) / m, sum(a == b for a, b in zip(words, words[1:])) / m,
            float(lengths.mean()), 1 - lettered / m, marked / m, len(set(lines)) / max(len(lines), 1),
            m / max(len(lines), 1), float(lengths.std())]


@dataclass
class QualityModel:
    """``edges`` cut the features, ``weights`` has a row of BINS for each."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_expand(x, self.edges) @ self.weights.ravel() + self.bias).astype(np.float64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _expand(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One column for each interval of each feature."""
    out = np.zeros((len(x), len(edges) * BINS), dtype=np.float32)
    for j, cuts in enumerate(edges):
        out[np.arange(len(x)), j * BINS + np.searchsorted(cuts, x[:, j], side="right")] = 1
    return out


def _descend(pos: np.ndarray, unl: np.ndarray, gradient) -> tuple[np.ndarray, float]:
    """Adam on the weights; ``gradient(z_pos, z_unl)`` gives the slopes of the risk."""
    w, b = np.zeros(pos.shape[1], np.float32), 0.0
    m, v = np.zeros(pos.shape[1] + 1), np.zeros(pos.shape[1] + 1)
    for t in range(1, STEPS + 1):
        gp, gu = gradient(pos @ w + b, unl @ w + b)
        gp, gu = gp.astype(np.float32), gu.astype(np.float32)
        g = np.append(gp @ pos + gu @ unl + DECAY * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - step[-1]
    return w, b


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Best-bin estimate of the share of positives in ``unl``: a classifier of
    one half of each sample against the other kind, measured on the other half."""
    def apart(zp: np.ndarray, zu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -_sigmoid(-zp) / len(zp), _sigmoid(zu) / len(zu)

    w, b = _descend(pos[::2], unl[::2], apart)
    sp, su = pos[1::2] @ w + b, unl[1::2] @ w + b
    if not len(sp) or not len(su):
        return 0.5
    cuts = np.unique(np.concatenate([sp, su]))
    above_p = 1 - np.searchsorted(np.sort(sp), cuts, side="left") / len(sp)
    above_u = 1 - np.searchsorted(np.sort(su), cuts, side="left") / len(su)
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (len(sp) ** -0.5 + len(su) ** -0.5)
    usable = above_p > 0.05
    bound = (above_u[usable] + slack) / above_p[usable]
    best = int(np.argmin(bound))
    return float(np.clip(above_u[usable][best] / above_p[usable][best], 0.02, 0.98))


def fit(positives: np.ndarray, unlabelled: np.ndarray) -> QualityModel:
    """The model of two samples of features; without one of them every text scores a half."""
    if not len(positives) or not len(unlabelled):
        return QualityModel(np.zeros((len(FEATURES), BINS - 1)), np.zeros((len(FEATURES), BINS)), 0.0, 0.5)
    edges = np.quantile(unlabelled, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    pos, unl = _expand(positives, edges), _expand(unlabelled, edges)
    prior = estimate_prior(pos, unl)

    def risk(zp: np.ndarray, zu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = prior * -_sigmoid(-zp) / len(zp)
        minus_p, minus_u = -prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
        if negative < 0:  # overfitted: undo the negative part instead
            return -minus_p, -minus_u
        return up + minus_p, minus_u

    w, b = _descend(pos, unl, risk)
    return QualityModel(edges, w.reshape(len(FEATURES), BINS), float(b), prior)


def _featured(rows: DataFrame) -> np.ndarray:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:i + 1],
                                                  pa.array([features(batch.column(1)[i].as_py())])], ["u", "x"])

    got = rows.select("u", "text").mapInArrow(measure, "u double, x array<double>").collect()
    got.sort(key=lambda r: (r["u"], r["x"]))
    return np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES))


def trained_model(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES,
                  unlabelled: int = UNLABELLED) -> QualityModel:
    """Learn from rows outside the held-out fold of ids.  Both samples are
    chosen by a hash of the id and bounded as rows expected; their features,
    16 numbers a row, come to the driver."""
    ship_package(docs.sparkSession)
    def u(seed: str) -> Column:
        return F.xxhash64(F.lit(seed), F.col("doc_id")).bitwiseAND(0xFFFFFF) / float(1 << 24)

    learn = fold("doc_id", FOLDS) != HELD_OUT_FOLD
    good = labels.where(learn & (F.col("quality") == 1)).select("doc_id").distinct()
    rows = docs.where(learn).select("doc_id", "text")
    n_good, n_rows = good.count(), rows.count()
    ids = good.where(u("good") < min(1.0, positives / max(n_good, 1)))  # about `positives` rows of 8 bytes
    trusted = rows.join(F.broadcast(ids), "doc_id").withColumn("u", u("good"))
    drawn = rows.withColumn("u", u("web")).where(F.col("u") < min(1.0, unlabelled / max(n_rows, 1)))
    return fit(_featured(trusted), _featured(drawn))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row; null and empty texts are scored alike."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t.as_py()) for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(x))],
                                                 ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, score double")


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (a null id is in no fold)."""
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT_FOLD, F.lit(False))
    return score(docs, trained_model(docs, labels)).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
