"""The registered queries and the pipeline."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tools.check import close, rows_of

import __spark_entry__ as entry
from ledgerloom.llm import leaks, near_copies, pieces, secrets
from ledgerloom.llm.queries import ORACLES, QUERIES, vocabulary

from .conftest import EDGES


def test_one_query_for_each_number():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in sorted(QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))] == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_answer_as_sql(spark, duck, name, folder):
    df = QUERIES[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = rows_of(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols) and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(close(x, y) for x, y in zip(a, b, strict=True)), (a, b)


def test_pipeline_keeps_what_its_stages_keep(spark, folder, documents):
    """The rows of ``run`` from the operators' own reports, which have tests against brute force."""
    rows = corpus_pipeline.run(spark, folder).toPandas().set_index("doc_id")
    first = near_copies.near_copies(documents).where("doc_id = class_id").select("doc_id").distinct()
    kept = documents.join(first, "doc_id", "left_semi")
    leaking = leaks.find_leaks(kept, spark.read.parquet(f"{folder}/benchmark.parquet")).select("doc_id").distinct()
    texts = {r.doc_id: r.text for r in kept.join(leaking, "doc_id", "left_anti").collect()}
    assert sorted(rows.index) == sorted(texts) and rows.lossless.all()
    scanner, coder = secrets.Scanner(), pieces.Pieces(vocabulary("piece_bpe_32k.model"), 0.1, 0, 8)
    for doc_id, text in texts.items():
        spans = scanner([text])[0]
        assert coder.decode(rows.ids[doc_id].tolist()) == (secrets._cut(text, spans, "[secret]") if spans else text)


def test_stages_keep_columns_and_survive_edges(spark, folder, docs):
    rows = docs(EDGES)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, rows, folder)
        assert out.columns == rows.columns and out.dtypes == rows.dtypes
        assert out.count() <= len(EDGES) and stage(spark, docs([]), folder).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs([]), folder).count() == 0
    language_id = corpus_pipeline.STAGES[0][1]
    known = language_id(spark, rows, folder)
    assert known.columns == rows.columns and sorted(str(r.doc_id) for r in known.collect()) == sorted(str(d) for d, _ in EDGES if d not in (0, 1, 2))
    unlabelled = rows.withColumn("lang", F.lit(None).cast("string"))
    assert language_id(spark, unlabelled, folder).count() == len(EDGES)
    assert language_id(spark, docs([]), folder).count() == 0
