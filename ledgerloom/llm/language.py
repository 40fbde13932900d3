"""Language of texts by a hierarchy of linear support vector machines.

A text becomes the frequencies of its hashed byte 1- to 3-grams.  One-versus-one machines first decide the
language family; within the chosen family one-versus-one machines separate the languages, which are close
to each other there.  Machines are MLlib's ``LinearSVC``, learned from a bounded sample: at most
``SAMPLE`` texts of each language, those with the smallest hash of their id.  Every whole text is predicted.

Defined results: a text that is null or has no letter is ``und`` with score 0; with no labelled row every
text is ``und``; with one language that language has score 1; repeated rows are each answered; an empty
table gives no row; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import SAMPLE_PARTS, blocks, bounded_sample
from .ship import session_of

WIDTH = 4096
SAMPLE = 1500
UNKNOWN = "und"

# ISO 639 codes by family; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
    "turkic": ("az", "kk", "tr", "uz"),
}


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes), lang)


# Bytes that are neither letters nor parts of other characters count as one space.
_KEPT = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], dtype=np.uint32)


def frequencies(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 3-grams, of length one."""
    b = _KEPT[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
    two = b[:-1] * np.uint32(257) + b[1:]
    three = (two[:-1] * np.uint32(263) + b[2:]) * np.uint32(2654435761)
    counts = np.bincount(three >> np.uint32(20), minlength=WIDTH)
    counts += np.bincount((two * np.uint32(2246822519)) >> np.uint32(20), minlength=WIDTH)
    counts[:256] += np.bincount(b, minlength=256)
    return np.sqrt(counts / counts.sum())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Machines:
    """One-versus-one machines over named classes; a margin above 0 is for the first of a pair."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def shares(self, x: np.ndarray) -> np.ndarray:
        """For each row of ``x`` a share for each class: the mean of its pairs' logistic margins."""
        out = np.zeros((len(x), len(self.names)))
        if len(self.names) == 1:
            return out + 1
        sure = 1 / (1 + np.exp(-np.clip(2 * (x @ self.weights.T + self.bias), -40, 40)))
        for k, (i, j) in enumerate(self.pairs):
            out[:, i] += sure[:, k]
            out[:, j] += 1 - sure[:, k]
        return out / len(self.pairs)


@dataclass
class LanguageModel:
    families: Machines
    within: list[Machines]

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.families.names:
            return names, scores
        at = [i for i, t in enumerate(texts) if t and has_letter(t)]
        for begin in range(0, len(at), 256):
            part = at[begin : begin + 256]
            x = np.stack([frequencies(texts[i]) for i in part])
            top = self.families.shares(x)
            best = top.argmax(axis=1)
            for f in np.unique(best).tolist():
                rows = np.flatnonzero(best == f)
                own = self.within[f].shares(x[rows])
                for row, lang, share in zip(rows.tolist(), own.argmax(axis=1).tolist(), own.max(axis=1).tolist(), strict=True):
                    names[part[row]] = self.within[f].names[lang]
                    scores[part[row]] = float(min(1.0, share * top[row, f]))
        return names, scores


def _machines(rows: DataFrame, column: str, names: list[str]) -> Machines:
    pairs, weights, bias = list(combinations(range(len(names)), 2)), [], []
    for i, j in pairs:
        own = rows.where(F.col(column).isin(names[i], names[j])).withColumn("label", (F.col(column) == names[i]).cast("double"))
        model = LinearSVC(maxIter=30, regParam=1e-4, standardization=False, aggregationDepth=2).fit(own.select("features", "label"))
        weights.append(model.coefficients.toArray())
        bias.append(model.intercept)
    return Machines(names, pairs, np.array(weights), np.array(bias))


def _labelled(docs: DataFrame, wanted: Column) -> DataFrame:
    """(doc_id, text, lang) of the rows that are ``wanted``, have a language and a letter."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.where(wanted & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))


def _drawn(docs: DataFrame, learned_from: Column, most: int) -> DataFrame:
    """(doc_id, text, lang) of at most ``most`` labelled ids of each language; a repeated id gives its smallest text."""
    labelled = _labelled(docs, learned_from)
    chosen = bounded_sample(labelled.select("doc_id", "lang"), "lang", most).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    # At most ``most`` ids of each language, so they are sent to the texts and not the texts to them.
    rows = labelled.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")
    return rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "text", "lang")


def fit(docs: DataFrame, learned_from: Column, most: int = SAMPLE) -> LanguageModel:
    """Learn from ``docs(doc_id, text, lang)`` where ``learned_from`` holds and the label is known."""
    session_of(docs)
    rows = _drawn(docs, learned_from, most)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, size=1 << 19):
            values = np.concatenate([frequencies(t) for t in block.column(1).to_pylist()])
            rows = pa.ListArray.from_arrays(pa.array(np.arange(block.num_rows + 1) * WIDTH, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([block.column(2).cast(pa.string()), rows], names=["lang", "counts"])

    made = rows.select("doc_id", "text", "lang").mapInArrow(vectors, "lang string, counts array<double>")
    made = made.repartition(SAMPLE_PARTS).select("lang", array_to_vector("counts").alias("features")).persist()
    langs = sorted(r.lang for r in made.select("lang").distinct().collect())
    groups: dict[str, list[str]] = {}
    for lang in langs:
        groups.setdefault(family_of(lang), []).append(lang)
    place = F.create_map(*[F.lit(x) for lang in langs for x in (lang, family_of(lang))]) if langs else None
    try:
        families = _machines(made.withColumn("family", place[F.col("lang")]), "family", list(groups)) if langs else Machines([], [], np.zeros((0, WIDTH)), np.zeros(0))
        return LanguageModel(families, [_machines(made, "lang", own) for own in groups.values()])
    finally:
        made.unpersist()


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs(doc_id, text)``."""
    sent = session_of(docs).sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            names, scores = sent.value(block.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(apply, "doc_id long, lang_pred string, score double")


def floor_of(docs: DataFrame, held_out: Column, model: LanguageModel) -> float:
    """Half the lowest score of all labelled rows that the model has not learned from; 0 if there are none."""
    lowest = predict(_labelled(docs, held_out), model).agg(F.min("score")).first()[0]
    return 0.0 if lowest is None else lowest / 2


def keep_known(docs: DataFrame, model: LanguageModel, floor: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and a score of at least ``floor``; all, if nothing was learned."""
    if not model.families.names:
        return docs
    sent = session_of(docs).sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, at):
            names, scores = sent.value(block.column(at).to_pylist())
            yield block.filter(pa.array([n != UNKNOWN and s >= floor for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)
