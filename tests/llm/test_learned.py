"""Language and toxicity: held-out accuracy, and what happens at the edges."""

import zlib

from pyspark.sql import functions as F

from ledgerloom.llm import language, toxicity
from ledgerloom.llm.learning import bounded_sample, remainder
from ledgerloom.llm.queries import QUERIES

from .conftest import EDGES


def test_remainder_is_that_of_the_id_as_text(spark):
    rows = spark.range(-3, 40).withColumnRenamed("id", "doc_id").select("doc_id", remainder(5).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


def test_bounded_sample_is_stable(spark):
    rows = spark.range(500).withColumnRenamed("id", "doc_id").withColumn("kind", F.col("doc_id") % 3)
    a = {tuple(r) for r in bounded_sample(rows, "kind", 20).collect()}
    assert a == {tuple(r) for r in bounded_sample(rows.repartition(7), "kind", 20).collect()} and len(a) == 60


def test_language_of_whole_table(spark, folder, documents):
    got = QUERIES["op6_language"](spark, folder).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == documents.count() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.95
    assert (held.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4) == 2).all()


def test_language_edges(docs, documents):
    model = language.fit(documents, remainder(4) != 2, most=40)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs([*EDGES, (50, "12 34 !?"), (51, "²")]), model).collect()}
    assert all(got[d] == ("und", 0.0) for d in (0, 1, 2, 50, 51))
    assert got[3][0] != "und" and got[4][0] != "und" and got[5][0] != "und"
    kept = language.keep_known(docs([*EDGES, (50, "12 34 !?")]), model)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in EDGES if d not in (0, 1, 2))
    assert language.predict(docs([]), model).collect() == []


def test_language_with_nothing_or_one_language_to_learn(docs):
    none = language.fit(docs([]), F.lit(True))
    assert [r.lang_pred for r in language.predict(docs([(1, "a text")]), none).collect()] == ["und"]
    one = language.fit(docs([(1, "some text"), (2, "more text")]), F.lit(True))
    assert [tuple(r)[1:] for r in language.predict(docs([(1, "a text")]), one).collect()] == [("en", 1.0)]


def test_language_stage_keeps_what_it_should(spark, docs, documents):
    """Nothing learned drops nothing; a floor drops what fits no language, and no labelled document."""
    none = language.fit(docs([]), F.lit(True))
    assert language.keep_known(docs(EDGES), none).count() == len(EDGES)
    model = language.fit(documents, remainder(4) != 2, most=60)
    floor = language.floor_of(documents, remainder(4) == 2, model)
    assert 0 < floor <= 0.5
    kept = language.keep_known(documents, model, floor)
    labelled = documents.where(F.col("lang").isNotNull() & (remainder(4) == 2) & F.col("text").rlike(r"\p{L}"))
    assert labelled.join(kept.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
    assert language.keep_known(documents, model, 1.1).count() == 0 and language.floor_of(documents, F.lit(False), model) == 0


def test_floor_looks_at_every_held_out_text(spark, docs, documents):
    """The text that fits worst counts, however many there are and wherever its id hashes to."""
    model = language.fit(documents, remainder(4) != 2, most=60)
    last = spark.range(1, language.SAMPLE + 200).orderBy(F.desc(F.xxhash64("id"))).first().id
    rows = docs([(i, "qzx wvq" if i == last else "the house by the sea and the people in it") for i in range(1, language.SAMPLE + 200)])
    scores = {r.doc_id: r.score for r in language.predict(rows, model).collect()}
    assert scores[last] < min(s for i, s in scores.items() if i != last)
    assert language.floor_of(rows, F.lit(True), model) == scores[last] / 2


def test_language_learns_from_null_and_repeated_ids(docs):
    rows = [(None, "some words of text"), (None, "other words here"), (1, "a b c"), (1, "a b c d"), (1, None), (2, "12")]
    model = language.fit(docs(rows), F.lit(True))
    assert model.families.names and language._drawn(docs(rows), F.lit(True), 10).count() == 2
    assert {r.lang_pred for r in language.predict(docs(rows), model).collect()} == {"en", "und"}


def test_toxicity_of_whole_table(spark, folder, documents):
    got = QUERIES["op5_toxicity"](spark, folder)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert got.count() == documents.count()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()


def test_toxicity_finds_what_it_has_learned(spark, docs):
    texts = [(i, ("you worthless moron, " if i % 3 == 0 else "a lovely day, ") + f"said number {i} to the others in the house by the sea") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i in range(400)], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs(texts), labels, remainder(5) != 0, trees=3)
    tests = [*EDGES, (1000, "nobody is as worthless as you, moron"), (1001, "W0RTHLESS m0r0n you"), (1002, "what a nice house by the sea"), (1002, "what a nice house by the sea")]
    got = {r.doc_id: r for r in toxicity.score(docs(tests), model).collect()}
    assert toxicity.score(docs(tests), model).count() == len(tests)
    assert got[1000].predicted == 1 and got[1002].predicted == 0 and got[1].score == got[0].score
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(docs([]), model).collect() == []


def test_toxicity_without_labels(spark, docs):
    model = toxicity.fit(docs(EDGES), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert {r.score for r in toxicity.score(docs(EDGES), model).collect()} == {0.0}


def test_features():
    found = dict(zip(toxicity.FEATURES, toxicity.Features({"moron": 3.0, "trash~": 2.0}).of("YOU m0r*n! moron trashed... soooo"), strict=True))
    assert found["hits"] == 1.0 and found["start_hits"] == 1.0 and found["near_second"] >= 1 and found["capital_words"] > 0
    assert found["obfuscated"] == 1.0 and found["repeat_density"] > 0 and found["exclaim_rate"] > 0
    assert len(toxicity.Features({}).of("")) == len(toxicity.FEATURES)
