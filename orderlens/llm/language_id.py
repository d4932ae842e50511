"""Language ID with a blended-spectrum string kernel.

A text is the set of its letter n-grams of one to three characters (lower
case, runs of other characters as one space), hashed to ``WIDTH`` bits.  The
kernel of two texts is the number of n-grams in both over the root of the
product of their set sizes.  Landmark texts of the sample span a Nyström
feature space; one ridge regression per language (that language against the
rest) is fitted in it.  A score is linear in the kernel values to the
landmarks, which are linear in the presence bits, so both maps are folded into
one matrix and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import bound_batches, fold, keep_only, resting, ship_package

WIDTH_BITS = 14
WIDTH = 1 << WIDTH_BITS
LENGTHS = (1, 2, 3)
#: Bound of the labelled sample that is fitted: rows in all, and at least so many of a language.
SAMPLE_ROWS, SAMPLE_LEAST = 3000, 16
LANDMARKS = 192
RIDGE = 1e-3
UNKNOWN = "und"
#: Characters and texts of one matrix product; longer texts are read in pieces.
PIECE_CHARS, BATCH_TEXTS = 1 << 18, 128


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    size = len(codes) - n + 1
    h = np.full(max(size, 0), 0x9E3779B1 * n & 0xFFFFFFFF, dtype=np.uint32)
    for i in range(n if size > 0 else 0):
        h ^= codes[i:i + size]
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - WIDTH_BITS)


def presence(texts: list[str | None], piece: int = PIECE_CHARS) -> np.ndarray:
    """A row of WIDTH bits (as bytes) for every text; no bit where it has no letter."""
    keep_only("language_id", letter_table.cache_clear)
    out = np.zeros((len(texts), WIDTH), dtype=np.uint8)
    letters = letter_table()
    for row, text in zip(out, texts):
        low = (text or "").lower() + " "  # ends a last run of letters
        # what a piece leaves for the next: its last codes, so that no n-gram over the border is missed
        tail, open_run = np.array([32], np.uint32), False
        for at in range(0, len(low), piece):
            codes = _codes(low[at:at + piece])
            is_letter = letters[codes]
            keep = is_letter.copy()
            keep[1:] |= is_letter[:-1]  # one space after a run of letters
            keep[0] |= open_run
            open_run = bool(is_letter[-1])
            if not keep.any():
                continue
            plain = np.concatenate([tail, np.where(is_letter, codes, np.uint32(32))[keep].astype(np.uint32)])
            for n in LENGTHS if letters[plain].any() else ():
                row[_grams(plain, n)] = 1
            tail = plain[1 - LENGTHS[-1]:]
    return out


@dataclass
class LanguageModel:
    """``weights`` is WIDTH by languages; ``score = weights of the bits / root of their number + bias``."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, bits: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(bits.sum(axis=1, dtype=np.int64), 1))
        return bits.astype(np.float32) @ self.weights / size[:, None] + self.bias


def fit(bits: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Kernel ridge regression, one against the rest, on presence bits."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((WIDTH, 0), np.float32), np.zeros(0, np.float32))
    index = np.array([names.index(x) for x in langs])
    size = np.sqrt(np.maximum(bits.sum(axis=1, dtype=np.int64), 1))
    each = max(1, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(index == i)[:each] for i in range(len(names))])
    marks = bits[chosen].astype(np.float32) / size[chosen, None].astype(np.float32)
    # kernel values in blocks of rows: the sample is never held as floats
    kernel = np.vstack([bits[i:i + 256].astype(np.float32) @ marks.T for i in range(0, len(bits), 256)]) / size[:, None]
    values, vectors = np.linalg.eigh(kernel[chosen].astype(np.float64))
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    features = np.hstack([features, np.ones((len(features), 1))])
    wanted = np.where(index[:, None] == np.arange(len(names)), 1.0, -1.0)
    # languages weigh the same however many rows of each were sampled
    weight = 1.0 / np.bincount(index)[index]
    weight *= len(index) / weight.sum()
    gram = features.T @ (features * weight[:, None]) + ridge * len(index) * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, features.T @ (wanted * weight[:, None]))
    folded = marks.T @ (root @ solved[:-1]).astype(np.float32)
    return LanguageModel(names, folded.astype(np.float32), solved[-1].astype(np.float32))


def sampled(docs: DataFrame, trained: Column, id_col: str, text_col: str, lang_col: str,
            rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, list[str]]:
    """Presence bits and labels of a bounded sample, an equal number of rows of
    each language, chosen by a hash of the id.  The bits are made in the
    cluster; 2 KB a row come to the driver."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    has = trained & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")
    marked = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                         ((F.xxhash64(F.lit("sample"), F.col(id_col)).bitwiseAND(0xFFFFFF)) / float(1 << 24)).alias("u"),
                         has.alias("has")).where("has")
    counts = {r["lang"]: r["n"] for r in marked.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return np.zeros((0, WIDTH), np.uint8), []
    each = max(SAMPLE_LEAST, rows // len(counts))
    below = F.lit(0.0)
    for lang, n in counts.items():
        below = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.2 * each / n))).otherwise(below)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                packed = np.packbits(presence([batch.column(0)[i].as_py()])).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(1)[i:i + 1], batch.column(2)[i:i + 1],
                                                  pa.array([packed], pa.binary())], ["lang", "u", "bits"])

    # 1.2 times the wanted rows are expected; the rank, by text where ids repeat, bounds them whatever the ids are
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", F.xxhash64("text")))
    got = (marked.where(F.col("u") < below).select("text", "lang", "u", rank.alias("rank")).where(F.col("rank") <= each).drop("rank")
           .mapInArrow(resting(bits), "lang string, u double, bits binary").collect())
    kept = sorted(got, key=lambda r: (r["u"], bytes(r["bits"])))
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in kept), np.uint8).reshape(len(kept), WIDTH // 8)
    return np.unpackbits(packed, axis=1), [r["lang"] for r in kept]


def predicted(model: LanguageModel, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The language and score of each text.

    The score of the best language lies between 0 and 1 (a half: the
    regression says neither yes nor no).  A text that is null or has no letter,
    or any text where nothing was learned, gets ``und`` and 0.
    """
    langs, best = [], []
    for at in range(0, len(texts), BATCH_TEXTS):
        bits = presence(texts.slice(at, BATCH_TEXTS).to_pylist())
        known = bits.any(axis=1) & bool(model.langs)
        names, score = np.full(len(bits), UNKNOWN, dtype=object), np.zeros(len(bits))
        if known.any():
            value = model.scores(bits)
            top = value.argmax(axis=1)
            score = np.where(known, np.clip((value[np.arange(len(bits)), top] + 1) / 2, 0, 1), 0.0)
            names[known] = np.array(model.langs, dtype=object)[top[known]]
        langs.append(pa.array(names, pa.string()))
        best.append(pa.array(score, pa.float64()))
    return pa.concat_arrays(langs or [pa.array([], pa.string())]), pa.concat_arrays(best or [pa.array([], pa.float64())])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", least_score: float | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, which replace columns of
    these names; rows with ``und`` or a score below ``least_score`` are left out
    if that is given.  Only the texts go to the Python workers and only the two
    values come back."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH times the languages, 4 bytes each

    def score(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(predicted(shared.value, texts), ["lang_pred", "lang_score"])

    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "lang_score")]
    # not to be repeated for a filter on its result
    found = F.arrow_udf(score, "lang_pred string, lang_score double").asNondeterministic()(F.col(f"`{text_col}`"))
    out = docs.select(*names, found.alias("_language"))
    if least_score is not None:
        out = out.where((F.col("_language.lang_pred") != UNKNOWN) & (F.col("_language.lang_score") >= least_score))
    return out.select(*names, "_language.lang_pred", "_language.lang_score")


def trained_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  held_out_fold: int = 1, folds: int = 3) -> LanguageModel:
    """A model of the labelled rows outside the held-out fold of ids."""
    trained = F.coalesce(fold(id_col, folds) != held_out_fold, F.lit(False))
    return fit(*sampled(docs, trained, id_col, text_col, lang_col))


def language_table(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (a null id is
    in no fold: neither learned from nor held out)."""
    shared = docs.sparkSession.sparkContext.broadcast(trained_model(docs))
    rows = docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("text").alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *predicted(shared.value, batch.column(2))],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    schema = rows.select("doc_id", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(resting(score), schema)
