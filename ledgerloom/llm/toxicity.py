"""Toxicity of texts: boosted trees over dense features, with isotonic calibration.

The labelled rows are cut by hash into three parts.  The first gives a lexicon: words and word beginnings
that stand in far more toxic than clean texts.  The second fits MLlib's gradient-boosted trees on features
of a text: densities of lexicon words, how near they are to the second person, capitals, punctuation, and
signs of obfuscation.  The third, drawn as it is distributed, fits an isotonic curve from the trees' margin
to a probability.  Each part is a bounded sample, at most ``SAMPLE`` rows of a label, those with the
smallest hash of their id; every whole text is scored.

Defined results: a null text is empty and is scored like an empty text; without labelled rows of both kinds
every score is 0; repeated rows are each answered; an empty table gives no row; other columns are not
looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import SAMPLE_PARTS, blocks, bounded_sample
from .ship import session_of

SAMPLE = 3000
LEXICON = 4000
LEAST_TEXTS = 4
LEAST_ODDS = 2.0
NEAR = 6

# Words of the second person in the languages the tables hold.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur tu toi te ton ta tes vous votre vos du dich dir dein deine deinen deinem deiner ihr euch euer sie usted ustedes tú ti tus vosotros".split())
# Signs that stand for letters.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")

_EDGES = re.compile(r"^[^\w@$]+|[^\w@$]+$")
_INNER = re.compile(r"[^\w]|_")
FEATURES = (
    "log_words", "hits", "hit_density", "weight_density", "top_weight", "start_hits", "start_density", "start_top", "near_second", "near_density",
    "second_density", "capital_share", "capital_words", "exclaim_rate", "question_rate", "punctuation_rate", "digit_rate", "obfuscated", "obfuscated_density",
    "masked_hits", "repeat_density", "mean_word",
)


def normal(word: str) -> str:
    return _EDGES.sub("", word).lower()


def clear(word: str) -> str:
    """The word with signs read as letters and other signs dropped."""
    return _INNER.sub("", word.translate(LOOKALIKES))


def starts(word: str) -> list[str]:
    return [f"{word[:k]}~" for k in (3, 4, 5, 6) if len(word) > k]


@dataclass
class Features:
    """Dense features of texts by a lexicon of words and of word beginnings (which end in ``~``)."""

    lexicon: dict[str, float]
    known: dict[str, tuple[float, float, int]] = field(default_factory=dict)

    # Signs of a word beside its weights.
    SECOND, CAPITAL, OBFUSCATED, MASKED, REPEAT = 1, 2, 4, 8, 16

    def _word(self, word: str) -> tuple[float, float, int]:
        plain = normal(word)
        weight = self.lexicon.get(plain, 0.0)
        begin = max((self.lexicon.get(s, 0.0) for s in starts(plain)), default=0.0)
        signs = self.SECOND * (plain in SECOND_PERSON) | self.CAPITAL * (len(plain) > 1 and word.upper() == word != word.lower())
        inner = clear(plain)
        if inner != plain and any(map(str.isalpha, plain)):
            signs |= self.OBFUSCATED
            if not weight and inner in self.lexicon:
                weight, signs = self.lexicon[inner], signs | self.MASKED
        if any(a == b == c for a, b, c in zip(plain, plain[1:], plain[2:], strict=False)):
            signs |= self.REPEAT
        return weight, begin, signs

    def of(self, text: str) -> list[float]:
        words = text.split()
        n = len(words)
        known = self.known
        if len(known) > 200_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self._word(w)
        rows = np.array([known[w] for w in words]) if n else np.zeros((0, 3))
        weight, begin, signs = rows[:, 0], rows[:, 1], rows[:, 2].astype(np.int64)
        hits = np.flatnonzero(weight)
        seconds = np.flatnonzero(signs & self.SECOND)
        near = 0
        if len(hits) and len(seconds):
            right = np.searchsorted(seconds, hits)
            gap = np.minimum(np.abs(hits - seconds[np.minimum(right, len(seconds) - 1)]), np.abs(hits - seconds[np.maximum(right - 1, 0)]))
            near = int((gap <= NEAR).sum())
        count = lambda sign: int(np.count_nonzero(signs & sign))
        data = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256) if text else np.zeros(256, np.int64)
        size, per = max(1, int(data.sum())), max(1, n)
        upper, lower = int(data[65:91].sum()), int(data[97:123].sum())
        signs_all = int(data[33:48].sum() + data[58:65].sum() + data[91:97].sum() + data[123:127].sum())
        begins = int(np.count_nonzero(begin))
        return [
            math.log1p(n), float(len(hits)), len(hits) / per, float(weight.sum()) / per, float(weight.max()) if n else 0.0, float(begins), begins / per, float(begin.max()) if n else 0.0, float(near), near / per,
            len(seconds) / per, upper / max(1, upper + lower), count(self.CAPITAL) / per, int(data[33]) / size, int(data[63]) / size, signs_all / size, int(data[48:58].sum()) / size, float(count(self.OBFUSCATED)), count(self.OBFUSCATED) / per,
            float(count(self.MASKED)), count(self.REPEAT) / per, size / per,
        ]


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: object
    curve: object

    def score(self, features: DataFrame) -> DataFrame:
        """``features`` with a column ``score``; the margin of the trees put through the curve."""
        if self.trees is None:
            return features.withColumn("score", F.lit(0.0))
        judged = self.trees.transform(features.withColumn("features", array_to_vector("x")))
        judged = judged.withColumn("margin", vector_to_array("rawPrediction")[1])
        judged = self.curve.setFeaturesCol("margin").setPredictionCol("_p").transform(judged)
        return judged.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_p"))))


def _features(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """(doc_id, toxic, x) of ``rows(doc_id, text, toxic)``."""
    sent = session_of(rows).sparkContext.broadcast(lexicon)
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(sent.value)
        for block in blocks(batches):
            x = [features.of(t or "") for t in block.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array(x, schema.types[2])], schema=schema)

    return rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("toxic").cast("int")).mapInArrow(make, "doc_id long, toxic int, x array<double>")


def _lexicon(rows: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """Log odds of words and word beginnings that stand in toxic texts; the ``most`` surest."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for block in blocks(batches):
            for text, toxic in zip(block.column(1).to_pylist(), block.column(2).to_pylist(), strict=True):
                words = {normal(w) for w in (text or "").split()}
                for unit in words | {s for w in words for s in starts(w)}:
                    counts.setdefault(unit, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["unit", "toxic", "clean"])

    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sums = rows.select("doc_id", "text", "toxic").mapInArrow(units, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (totals.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (totals.get(0, 0) + 1))
    kept = sums.where((F.col("toxic") >= LEAST_TEXTS) & (F.length("unit") > 1)).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    return {r.unit: r.odds for r in kept.orderBy(F.desc("odds"), "unit").limit(most).collect()}


def fit(docs: DataFrame, labels: DataFrame, learned_from, most: int = SAMPLE, trees: int = 25) -> ToxicityModel:
    """Learn from the rows of ``labels(doc_id, toxic)`` where ``learned_from`` holds."""
    session_of(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(learned_from & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))
    known = known.withColumn("part", F.when(part == 2, "curve").when(part == 1, F.concat(F.lit("trees"), F.col("toxic"))).otherwise(F.concat(F.lit("words"), F.col("toxic"))))
    chosen = bounded_sample(known, "part", most)
    # At most ``most`` ids of each part, so they are sent to the texts and not the texts to them.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy(*chosen.columns).agg(F.min("text").alias("text")).persist()  # a repeated id gives its smallest text
    x = None
    try:
        words = rows.where(F.col("part").startswith("words"))
        lexicon = _lexicon(words)
        x = _features(rows.where(~F.col("part").startswith("words")).withColumn("toxic", F.col("toxic") + F.when(F.col("part") == "curve", 2).otherwise(0)), lexicon).repartition(SAMPLE_PARTS).persist()
        own = x.where("toxic < 2").select(F.col("toxic").cast("double").alias("label"), array_to_vector("x").alias("features"))
        if own.select("label").distinct().count() < 2:
            return ToxicityModel(lexicon, None, None)
        model = GBTClassifier(maxIter=trees, maxDepth=4, stepSize=0.2, seed=7, maxBins=64, minInstancesPerNode=3).fit(own)
        held = model.transform(x.where("toxic >= 2").select((F.col("toxic") - 2).cast("double").alias("label"), array_to_vector("x").alias("features")))
        held = held.select("label", vector_to_array("rawPrediction")[1].alias("margin"))
        if not held.take(1):
            held = model.transform(own).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
        curve = IsotonicRegression(featuresCol="margin", labelCol="label").fit(held)
        return ToxicityModel(lexicon, model, curve)
    finally:
        rows.unpersist()
        if x is not None:
            x.unpersist()


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs(doc_id, text)``."""
    x = _features(docs.select("doc_id", "text", F.lit(0).alias("toxic")), model.lexicon)
    return model.score(x).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
