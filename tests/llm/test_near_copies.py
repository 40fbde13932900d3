import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import near_copies as nc
from ledgerloom.llm.components import components
from ledgerloom.llm.prefixes import SLOT_BITS, possible_pairs, prefix
from ledgerloom.llm.sampling import CHUNK, COMMON, TOP, Sampler, Weights, shingle_lists, shingles, similarity, word_hashes, word_lists

from .conftest import EDGES


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def edited(rng, own, n):
    out = list(own)
    for _ in range(n):
        out[rng.randrange(len(out))] = "edit" + str(rng.random())
    return out


def exact_classes(rows, weights, least=nc.LEAST):
    """Classes by comparing every text with every other."""
    ids = sorted(d for d, _ in rows)
    own = {d: (h, weights(h, c)) for d, t in rows for h, c in [shingles(t)]}
    parent = {d: d for d in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if similarity(own[a], own[b]) >= least:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: top(d) for d in ids}


@pytest.mark.parametrize("share", [0.3, 0.6, 0.8, 0.95])
def test_samples_agree_as_often_as_sets_are_similar(share):
    rng, sampler, agreed, true = np.random.default_rng(1), Sampler(), [], []
    for _ in range(60):
        k = int(400 * (1 - share) / (1 + share))
        both = rng.integers(0, 1 << 63, 400 - k, dtype=np.uint64)
        sets = []
        for _ in range(2):
            h = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, k, dtype=np.uint64)]))
            sets.append((h, np.where(h % np.uint64(5) == 0, 1.1 + (h % np.uint64(7)).astype(float) / 3, TOP)))
        true.append(similarity(*sets))
        agreed.append((sampler(*sets[0]) == sampler(*sets[1])).mean())
    assert abs(np.mean(true) - np.mean(agreed)) < 0.03


def test_common_shingles_are_counted_exactly(docs):
    rng = random.Random(3)
    banner = words(rng, 12)
    rows = [(i, " ".join((banner if i % 3 == 0 else []) + words(rng, 30) + (banner[:6] if i % 25 == 0 else []))) for i in range(150)]
    weights = nc.weights_of(docs(rows, 5))
    counts = Counter(h for _, t in rows for h in shingles(t)[0].tolist())
    assert weights.common.tolist() == sorted(h for h, n in counts.items() if n >= COMMON * len(rows))
    few = Weights(len(rows), weights.common, np.array([counts[h] for h in weights.common.tolist()]))
    assert np.allclose(weights.idf, few.idf)


def test_classes_as_all_pairs(docs):
    rng = random.Random(8)
    bases = [words(rng, 80) for _ in range(12)]
    rows = []
    for b, base in enumerate(bases):
        rows += [(len(rows) + i, " ".join(edited(rng, base, e))) for i, e in enumerate([0, 0, 1, 1, 2, 3] if b < 8 else [0])]
    hot = words(rng, 90)
    rows += [(1000 + i, " ".join(edited(rng, hot, rng.choice([0, 1, 1, 2])))) for i in range(80)]
    df = docs(rows)
    got = {r.doc_id: r.class_id for r in nc.near_copies(df).collect()}
    want = exact_classes(rows, nc.weights_of(df))
    assert got == want
    kept = nc.first_of_each(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(got.values())) and set(kept[0].asDict()) == set(df.columns)


def test_next_ones_over_many_partitions(spark):
    """Every pair within ``LAG`` places, wherever ranges cut buckets; small buckets are compared whole."""
    rng = random.Random(4)
    rows, doc = [], 0
    for key in range(-20, 20):
        for _ in range(rng.choice([2, 5, nc.LAG + 1, nc.LAG + 1, 60])):
            doc += 1
            rows.append((key, rng.randrange(3), rng.randrange(3), rng.randrange(3), doc, doc if rng.random() < 0.8 else key))
    rows.sort()
    want = {(max(x[4], y[4]), min(x[4], y[4])) for i, x in enumerate(rows) for y in rows[i + 1 : i + 1 + nc.LAG] if x[0] == y[0] and x[5] != y[5]}
    assert len(want) > 2000
    df = spark.createDataFrame(rows, "key long, k1 long, k2 long, k3 long, doc_id long, class long")
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    old = [spark.conf.get(n) for n in names]
    try:
        for parts in (1, 7, 40):
            for name, value in zip(names, (str(parts), "false"), strict=True):
                spark.conf.set(name, value)
            got = [(r.a, r.b) for r in nc._next_ones(df).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    finally:
        for name, value in zip(names, old, strict=True):
            spark.conf.set(name, value)


def test_copies_that_share_a_template(docs):
    """Pairs whose keys come from a template that many texts have are found as by all pairs."""
    rng = random.Random(9)
    template, rows = words(rng, 300), []
    for _ in range(60):
        own = words(rng, 45)
        for _ in range(2):
            rows.append((len(rows), " ".join(template + own[:24] + words(rng, 21))))
    df = docs(rows)
    weights = nc.weights_of(df)
    want = exact_classes(rows, weights)
    assert 40 <= len(set(want.values())) <= 110
    assert {r.doc_id: r.class_id for r in nc.near_copies(df).collect()} == want


def templated(rng, n, template, own):
    return [(k, " ".join(template + words(rng, own))) for k in range(n)]


def test_a_template_alone_pairs_nothing(spark, docs):
    """Texts with 82 % of their weight in a template: none alike, and candidates grow no faster than texts."""
    rng = random.Random(12)
    template = words(rng, 300)
    found = {}
    for n in (100, 300):
        rows = templated(rng, n, template, 40)
        df = docs(rows).select("doc_id", "text", F.col("doc_id").alias("class"), F.lit(1).cast("long").alias("n_class"))
        weights = nc.weights_of(df)
        h, c = shingles(rows[0][1])
        shared = np.isin(h, shingles(rows[1][1])[0])
        w = weights(h, c)
        assert 0.8 < w[shared].sum() / w.sum() < 0.86
        found[n] = possible_pairs(df, spark.sparkContext.broadcast(weights), nc.LEAST).count()
    assert found[300] <= 4 * found[100] + 300
    assert {r.doc_id: r.class_id for r in nc.near_copies(docs(rows)).collect()} == {d: d for d, _ in rows}


@pytest.mark.parametrize("cell", [3, 2000])
def test_possible_pairs_hold_all_that_are_similar(spark, docs, cell):
    rng = random.Random(13)
    template = words(rng, 120)
    rows = templated(rng, 30, template, 30)
    for base in range(12):
        own = template[: 40 + 5 * base] + words(rng, 60)
        rows += [(1000 * (base + 1) + e, " ".join(edited(rng, own, e))) for e in (0, 1, 2, 5)]
    kinds = {d: d // 2 for d, _ in rows}
    df = docs(rows).select("doc_id", "text", F.floor(F.col("doc_id") / 2).alias("class"), F.lit(2).cast("long").alias("n_class"))
    weights = nc.weights_of(df)
    got = [(r.a, r.b) for r in possible_pairs(df, spark.sparkContext.broadcast(weights), nc.LEAST, cell).collect()]
    assert len(got) == len(set(got)) and all(kinds[a] != kinds[b] for a, b in got)
    own = {d: (h, weights(h, c)) for d, t in rows for h, c in [shingles(t)]}
    similar = {(a, b) for a in own for b in own if b < a and kinds[a] != kinds[b] and similarity(own[a], own[b]) >= nc.LEAST}
    assert len(similar) > 10 and similar <= {(max(p), min(p)) for p in got}
    assert len(got) < 0.2 * len(rows) ** 2


def test_prefixes():
    h, w = np.arange(10, dtype=np.uint64) << np.uint64(60), np.ones(10)
    order = np.zeros(1 << SLOT_BITS, np.int64)
    order[(h >> np.uint64(64 - SLOT_BITS)).view(np.int64)] = np.arange(10)[::-1]
    shingle, left, posted, size = prefix(h, w, order, 0.8)
    assert size == 10 and left.tolist() == [10, 9, 8] and posted.tolist() == [True, True, False]
    assert (shingle == h[[9, 8, 7]]).all()
    assert prefix(h[:0], w[:0], order, 0.8)[3] == 0


def test_words_as_split():
    """Words of many texts together, of single texts and of texts cut into parts, as by the text's own methods."""
    rng = random.Random(14)
    odd = ["", None, " ", "a\u3000b\xa0c\x85d\x1ce", "\u0130x \u00dcn\u00ef\n\n", "x" * (CHUNK + 5), "y " + "z" * (2 * CHUNK) + " w", "q " * CHUNK, "x" * (CHUNK - 1) + " b c" + "x" * (CHUNK - 1)]
    texts = odd + [" ".join(words(rng, rng.randrange(40))) for _ in range(200)]
    h, n = word_lists(texts)
    assert n.tolist() == [len((t or "").lower().split()) for t in texts]
    assert (np.concatenate([word_hashes(t) for t in texts]) == h).all()
    known = {}
    for word, value in zip([w for t in texts for w in (t or "").lower().split()], h.tolist(), strict=True):
        assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)
    for t, (own, counts) in zip(texts, shingle_lists(texts), strict=True):
        assert (own == shingles(t)[0]).all() and (counts == shingles(t)[1]).all()


def test_edges(docs):
    got = Counter((r.doc_id, r.class_id) for r in nc.near_copies(docs(EDGES)).collect())
    assert got == Counter([(0, 0), (1, 0), (2, 2), (3, 3), (3, 3), (4, 4), (5, 5), (None, 6), (6, 6), (7, 7), (8, 8)])
    rows = [*EDGES, (None, "nameless"), (None, "nameless")]
    kept = Counter(r.doc_id for r in nc.first_of_each(docs(rows)).collect())
    assert kept == Counter([0, 2, 3, 4, 5, 6, 7, 8, None])
    assert nc.near_copies(docs([])).collect() == [] and nc.first_of_each(docs([])).collect() == []


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(500, x) for x in range(501, 560)]
    parent = {x: x for e in links for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = {r["node"]: r["class"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {a for a, b in links if a == b}
    assert {k: v for k, v in got.items() if k not in alone} == {x: top(x) for x in parent if x not in alone}
