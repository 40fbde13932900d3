import random

import numpy as np
import pytest

from ledgerloom.llm import leaks
from ledgerloom.llm.queries import QUERIES

from .conftest import EDGES


def plain(rows, items, overlap=leaks.OVERLAP):
    """Items of which enough shingles stand in a text, item by item."""
    out = set()
    for d, t in rows:
        words = leaks.words_of(t)
        for i, text in items:
            shares = []
            for wanted in map(leaks.shingles, leaks.parts_of(text or "")):
                size = len(next(iter(wanted), ()))
                have = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if size else set()
                shares.append(len(wanted & have) / len(wanted) if size else 0)
            if min(shares) >= overlap:
                out.add((d, i))
    return out


def items_of(rng, n, size=30):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(200)]
    return [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, size))).capitalize() + ". " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 9))) + ".") for i in range(n)], vocabulary


@pytest.mark.parametrize("least", [0.05, 0.2, 0.6])
def test_pruning_loses_nothing(least):
    rng = random.Random(1)
    items, vocabulary = items_of(rng, 120)
    index = leaks.Index.of(items)
    for _ in range(40):
        words = set(rng.choice(items)[1].lower().replace(".", "").split()) if rng.random() < 0.5 else set()
        query = np.array(sorted({index.terms[w] for w in words | {rng.choice(vocabulary) for _ in range(20)} if w in index.terms}))
        scores = np.zeros(len(items))
        for t in query:
            a, b = index.first[t], index.first[t + 1]
            scores[index.item[a:b]] += index.impact[a:b]
        want = {i for i in range(len(items)) if scores[i] >= least}
        got = index.retrieve(query, least)
        assert {i for i, _ in got} == want and all(abs(scores[i] - s) < 1e-9 for i, s in got)
        assert not want or index.promising(np.zeros(len(query), int), query, 1, least).tolist() == [0]


def test_an_item_scores_one_for_itself():
    items, _ = items_of(random.Random(2), 20)
    index = leaks.Index.of(items)
    for i, (_, text) in enumerate(items):
        query = np.array(sorted({index.terms[w] for w in leaks.words_of(text)}))
        assert abs(dict(index.retrieve(query, 0.99))[i] - 1) < 1e-9


def test_as_item_by_item(spark, docs, monkeypatch):
    rng = random.Random(3)
    items, vocabulary = items_of(rng, 40, 200)
    fill = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(400 + i, fill(rng.randint(0, 400)) + " " + rng.choice(items)[1].upper().replace(" ", "  ") + " " + fill(rng.randint(0, 400))) for i in range(25)]
    rows += [(100 + i, fill(300)) for i in range(20)] + [(200 + i, items[i][1][: len(items[i][1]) // 2]) for i in range(20)] + EDGES
    rows += [(300, items[0][1]), (300, items[0][1]), (301, items[1][1] + " " + items[2][1])]
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in [*items, (None, items[3][1]), (900, None), (901, ""), (902, "...")]], "item_id long, text string, score double")
    want = plain(rows, [*items, (None, items[3][1])])
    got = leaks.find_leaks(docs(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) > len(rows) // 3
    monkeypatch.setattr(leaks, "PASS_ITEMS", 10)
    monkeypatch.setattr(leaks, "PART", 3)
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs(rows), bench).collect()} == want
    kept = leaks.without_leaks(docs(rows), bench)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, _ in rows if not any(d == x for x, _ in want))
    assert kept.columns == docs(rows).columns


def test_empty_tables(spark, docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert leaks.find_leaks(docs(EDGES), nothing).collect() == []
    assert leaks.without_leaks(docs(EDGES), nothing).count() == len(EDGES)
    assert leaks.find_leaks(docs([]), spark.createDataFrame([(1, "some words to find here")], "item_id long, text string")).collect() == []


def test_whole_table(spark, folder, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    want = plain([tuple(r) for r in documents.select("doc_id", "text").collect()], items)
    assert {(r.doc_id, r.item_id) for r in QUERIES["op9_leaks"](spark, folder).collect()} == want


def test_scores_do_not_depend_on_parts_passes_or_slices(spark, docs, monkeypatch):
    """As many items, cut otherwise: the same rows with the same scores; a long text with many items in it."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12, 40))) + ".\n" + " ".join(rng.choice(words) for _ in range(6)) for _ in range(60)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    long = " ".join(rng.choice(words) for _ in range(300))
    rows = [(k, " ".join(rng.choice(words) for _ in range(200)) + " " + texts[k] + " " + long) for k in range(0, 60, 7)]
    rows.append((1000, (" " + long + " ").join(texts)))
    found = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in leaks.find_leaks(docs(rows), items).collect())
    want = found()
    assert {r[:2] for r in want} >= {(1000, k) for k in range(60)} | {(k, k) for k in range(0, 60, 7)}
    monkeypatch.setattr(leaks, "PART", 7)
    monkeypatch.setattr(leaks, "BOUNDS", 50)
    assert found() == want
    monkeypatch.setattr(leaks, "PASS_ITEMS", 25)
    assert found() == want
    kept = leaks.without_leaks(docs([*rows, (7777, long)]), items)
    assert [r.doc_id for r in kept.collect()] == [7777]
