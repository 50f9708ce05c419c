"""Languages of texts by string kernels: n-gram presence, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from freshet.llm.base import arrow_rows, shipped_by_value, stored

shipped_by_value(__name__)

#: The kernel is the sum of the presence kernels of 1- to 3-grams, hashed to this many features.
N_MAX, FEATURES = 3, 1 << 14
LANDMARKS = 128
#: The classifier is fitted on at most so many labelled rows of a language, and so many of all.
PER_LANGUAGE, SAMPLE = 300, 4000
RIDGE = 1e-3
#: Texts handed to Python at a time; their presence matrix is a row of FEATURES numbers each.
BATCH = 256
UNDETERMINED = "und"
#: Of texts with n different n-grams, the part FAMILIAR * (n - FEWEST) / (n + GRAMS) at least must lie in the space of the
#: landmarks to be known; fewer than FEWEST n-grams show too little, so only the score of such texts counts.
FAMILIAR, FEWEST, GRAMS = 0.3, 40, 50


def _tables(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every code point up to the largest here: its lower case, if that is one character, and whether it is a letter."""
    lower, letter = np.arange(codes.max() + 1, dtype=np.uint32), np.zeros(codes.max() + 1, bool)
    for k in np.flatnonzero(np.bincount(codes)):
        c = chr(k)
        letter[k] = c.isalpha()
        small = c.lower()
        if letter[k] and len(small) == 1:
            lower[k] = ord(small)
    return lower, letter


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(present, has_letters): which hashed n-grams each whole text has, letters lower-cased, all else one blank."""
    codes = [np.frombuffer((" " + t + " ").encode("utf-32-le", "surrogatepass"), np.uint32) if t else np.array([32, 32], np.uint32) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    all_codes = np.concatenate(codes)
    lower, letter = _tables(all_codes)
    is_letter = letter[all_codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one blank after every word
    keep[0] = True
    keep[1:] |= row[1:] != row[:-1]  # and one before the first
    c = np.where(is_letter, lower[all_codes], 32)[keep].astype(np.uint64)
    row = row[keep]
    present = np.zeros((len(texts), FEATURES), bool)
    rolled = np.zeros(len(c), np.uint64)
    for n in range(1, N_MAX + 1):
        rolled = rolled[:len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1:] + np.uint64(n)
        mixed = (rolled ^ (rolled >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        inside = row[:len(c) - n + 1] == row[n - 1:]
        present[row[:len(c) - n + 1][inside], (mixed[inside] >> np.uint64(50)).astype(np.int64)] = True
    has_letters = np.zeros(len(texts), bool)
    has_letters[row[c != 32]] = True
    return present, has_letters


def _kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shared n-grams of every two rows, as a cosine."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    norm = np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(y.sum(axis=1), 1))[None, :]
    return (x @ y.T) / norm


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    landmarks: np.ndarray  # n-grams of each
    weights: np.ndarray  # from kernel values and a constant to one score per language
    root: np.ndarray  # from kernel values to coordinates in the space of the landmarks

    def scores(self, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, familiar): one score per language, and whether enough of the text lies in the space of the landmarks."""
        k = _kernel(present, self.landmarks)
        n = present.sum(axis=1)
        return (np.hstack([k, np.ones((len(k), 1), np.float32)]) @ self.weights,
                ((k @ self.root) ** 2).sum(axis=1) >= FAMILIAR * (n - FEWEST) / (n + GRAMS))


def fit(present: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-versus-rest kernel ridge regression in the space that the first rows span (Nyström)."""
    names = sorted(set(languages))
    marks = present[:landmarks]
    values, vectors = np.linalg.eigh(_kernel(marks, marks).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.hstack([_kernel(present, marks) @ root, np.ones((len(present), 1))])
    goal = np.array([[float(x == n) for n in names] for x in languages])
    penalty = ridge * len(present) * np.eye(phi.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(phi.T @ phi + penalty, phi.T @ goal)
    return Model(tuple(names), marks, np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32),
                 root.astype(np.float32))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """(rank, lang, text) of the sample: labelled rows that aren't held out, the first of each language in an order by hash.

    The ranks use doc_id and lang alone; only the sample's ids, ``SAMPLE`` rows at
    most, then pick texts.  Rows that repeat a doc_id and lang count once, with
    the first of their texts.
    """
    labelled = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL").filter(~is_held_out(F.col("doc_id")))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id")
    chosen = (labelled.select("doc_id", "lang").distinct().withColumn("rank", F.row_number().over(order))
              .filter(F.col("rank") <= PER_LANGUAGE).orderBy("rank", "lang").limit(SAMPLE))
    texts = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    return texts.groupBy("rank", "lang").agg(F.min("text").alias("text"))


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            present, letters = presence(batch["text"].tolist())
            yield pd.DataFrame({"rank": batch["rank"], "lang": batch["lang"],
                                "bits": [x.tobytes() for x in np.packbits(present, axis=1)]})[letters]


def train(docs: DataFrame) -> Model | None:
    """The model of the sample; None where no row is labelled."""
    with arrow_rows(docs.sparkSession, BATCH):
        rows = training_rows(docs).mapInPandas(_pack, "rank int, lang string, bits binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["rank"], r["lang"], bytes(r["bits"])))  # landmarks: the first of every language in turn
    bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8).reshape(len(rows), -1)
    return fit(np.unpackbits(bits, axis=1).astype(bool), [r["lang"] for r in rows])


def _predict(model: Model | None, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    language, score, familiar = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.zeros(len(texts), bool)
    present, letters = presence(texts)
    if model is not None and letters.any():
        s, familiar[letters] = model.scores(present[letters])
        language[letters] = np.array(model.languages, object)[s.argmax(axis=1)]
        score[letters] = np.clip(s.max(axis=1), 0, 1)
    return language, score, familiar


def _predictor(shared, text: str, least: float | None = None):
    """Tasks that predict.  With ``least``: that pass on the familiar rows with that score."""
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value) if shared.value else None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index(text)
            language, score, familiar = _predict(model, batch.column(at).to_pylist())
            if least is not None:
                yield batch.filter(pa.array(familiar & (score >= least)))
            else:
                kept = [k for k in range(batch.num_columns) if k != at]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(language, pa.string()), pa.array(score)],
                                                 [*(batch.schema.names[k] for k in kept), "lang_pred", "score"])
    return predict


def _shared_model(docs: DataFrame):
    model = train(docs)
    return docs.sparkSession.sparkContext.broadcast((model.languages, model.landmarks, model.weights, model.root) if model else None)


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (0 to 1).

    Learns from text and language of labelled documents whose crc32(doc_id) mod 4
    isn't 2, at most ``SAMPLE`` of them; every text is predicted whole and from
    nothing else.  NULL texts, texts without a letter and all texts where nothing
    is labelled are ``und`` with score 0.  A NULL doc_id is neither learned from
    nor held out.  Repeated rows get a row each.  The model is LANDMARKS rows of
    FEATURES bits and is sent to every task.
    """
    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    with arrow_rows(docs.sparkSession, BATCH):
        return stored(rows.mapInArrow(_predictor(_shared_model(docs), "text"), "doc_id long, held_out boolean, lang_pred string, score double"), "languages")


def keep_known(docs: DataFrame, least: float = 0.42) -> DataFrame:
    """The documents, with all their columns, in a language that was learned: with a score of ``least`` or more, and familiar.

    The scores of a text sum to 1 whatever it is.  Of three languages or more,
    texts in another one or in many at once get low scores for all; clean texts,
    but for some of a few words, get over 0.42.  What shares too little with the
    landmarks (:data:`FAMILIAR`), as other scripts or gibberish, goes whatever its
    score.  Texts without a letter go.
    """
    with arrow_rows(docs.sparkSession, BATCH):
        return stored(docs.mapInArrow(_predictor(_shared_model(docs), "text", least), docs.schema), "known")
