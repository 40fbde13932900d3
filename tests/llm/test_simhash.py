"""Fingerprints, edits along the chain of documents and the search within a radius, against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import simhash
from ledgerloom.llm.queries import QUERIES
from ledgerloom.llm.sampling import shingles, word_hashes
from ledgerloom.llm.simhash import Tables, document_fingerprints, fingerprint, fingerprints, likeness, spelt, within

from .conftest import EDGES, LONG


def plain(text):
    """Bit by bit, term by term."""
    votes = [0] * 128
    runs, counts = shingles(text)
    terms = [(int(h), round(16 * (1 + math.log(c)))) for h, c in zip(runs, counts, strict=True)]
    for w, c in Counter(word_hashes(text).tolist()).items():
        terms.append((int(simhash._mixed(np.array([w], np.uint64) ^ simhash._SECOND)[0]), round(8 * (1 + math.log(c)))))
    for h, weight in terms:
        second = int(simhash._mixed(np.array([h], np.uint64) + simhash._SECOND)[0])
        bits = "".join(f"{b:08b}" for b in h.to_bytes(8, "little") + second.to_bytes(8, "little"))
        for k, bit in enumerate(bits):
            votes[k] += weight if bit == "1" else -weight
    whole = int("".join("1" if v > 0 else "0" for v in votes), 2)
    return whole >> 64, whole & (1 << 64) - 1


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n))


def test_votes_bit_by_bit():
    rng = random.Random(1)
    for text in ["", " \n", "one", "one one one", "a b c d e", "a b c d e f a b c d e", words(rng, 400), LONG, None]:
        assert fingerprint(text) == plain(text or "")


def test_long_texts_vote_in_parts(monkeypatch):
    text = words(random.Random(2), 3000)
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "_VOTES", 100)
    assert fingerprint(text) == whole and likeness(whole, whole) == 1


def expected(rows, radius):
    """Answers by following the whole list; rows of one id in any order that fits."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    prints = [fingerprint(t) for _, t in rows]
    out = []
    for i, (doc_id, text) in enumerate(rows):
        k = (i + 1) % len(rows)
        given = len(text) // 3
        edited = text[: len(text) - given] + rows[k][1][:given]
        new = fingerprint(edited)
        near = sum(1 - likeness(prints[i], p) <= radius / 128 for p in prints) - 1
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), spelt(prints[i]), spelt(new), likeness(prints[i], new), likeness(prints[i], prints[k]), near))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 5])
def test_whole_table_as_by_the_whole_list(spark, docs, parts):
    rng = random.Random(3)
    rows = [(i * 3, words(rng, rng.choice([0, 1, 3, 40, 200]))) for i in range(60)]
    base = words(rng, 300).split()
    for i in range(30):  # near copies
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(300)] = words(rng, 1)
        rows.append((1000 + i, " ".join(own)))
    rows += [(2000 + i, rows[5][1]) for i in range(4)] + [(3000, None), (3001, "é🙂" * 50 + " ü")]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = document_fingerprints(docs(rows, parts), radius=12, blocks=14)
        assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_within"]
        want = expected(rows, 12)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
        assert sum(r[-1] > 0 for r in want) > 25
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_edges(docs):
    rows = [*EDGES, (None, None), (None, "no id"), (None, "no id")]
    got = document_fingerprints(docs(rows)).collect()
    assert Counter((r.doc_id, r.n_chars, r.fingerprint) for r in got) == Counter((d, len(t or ""), spelt(fingerprint(t))) for d, t in rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    # Without its repeated ids the chain is the list's own.
    once = [r for r in EDGES if r[0] not in (3, None)]
    assert sorted((tuple(r) for r in document_fingerprints(docs(once)).collect()), key=repr) == expected(once, simhash.RADIUS)
    alone = document_fingerprints(docs([(4, "only this one here")])).collect()
    assert [tuple(r) for r in alone] == expected([(4, "only this one here")], 4) and alone[0].near_next == 1
    assert document_fingerprints(docs([])).collect() == [] and fingerprints(docs([])).collect() == []


def by_all_pairs(rows, radius):
    values = [(int(a) & (1 << 64) - 1, int(b) & (1 << 64) - 1) for a, b in rows]
    return {v: sum((v[0] ^ u[0]).bit_count() + (v[1] ^ u[1]).bit_count() <= radius for u in values) - 1 for v in values}


@pytest.mark.parametrize("radius,blocks,bucket", [(4, 5, 2048), (3, 5, 8), (2, 3, 8), (0, 2, 4), (6, 8, 16)])
def test_search_as_by_all_pairs(spark, radius, blocks, bucket):
    """Also where buckets are too large for one key: longer keys, then slices."""
    rng = random.Random(radius * 100 + blocks)
    values = []
    for _ in range(12):
        base = rng.getrandbits(128)
        values += [base] * rng.choice([1, 1, 4])
        for _ in range(rng.choice([2, 10, 60])):
            x = base
            for _ in range(rng.randrange(radius + 4)):
                x ^= 1 << rng.choice([rng.randrange(128), rng.randrange(20)])  # many share all but a few bits
            values.append(x)
    rows = [tuple(simhash._signed([v >> 64, v & (1 << 64) - 1]).tolist()) for v in values]
    df = spark.createDataFrame(rows, "high long, low long")
    got = {(r.high & (1 << 64) - 1, r.low & (1 << 64) - 1): r.near for r in within(df, radius, blocks, bucket).collect()}
    assert got == by_all_pairs(rows, radius)


def test_every_close_pair_counts_under_exactly_one_key():
    rng = random.Random(7)
    for radius, blocks in ((4, 5), (3, 6), (1, 2)):
        tables = Tables(radius, blocks)
        for _ in range(200):
            x = sum({1 << rng.randrange(128) for _ in range(rng.randrange(radius + 1))})
            high, low = np.array([x >> 64], np.uint64), np.array([x & (1 << 64) - 1], np.uint64)
            assert sum(bool(tables.counts_here(t, None, high, low)[0]) for t in range(len(tables.keys))) == 1
            assert sum(bool(tables.counts_here(t, p, high, low)[0]) for t in range(len(tables.keys)) for p in range(radius + 1)) == 1
    with pytest.raises(ValueError):
        Tables(5, 5)


def test_edits_are_nearer_than_the_next_document(spark, folder):
    rows = QUERIES["op13_document_fingerprints"](spark, folder).toPandas()
    apart = rows[rows.near_next < 1]
    assert (apart.near_edited > apart.near_next).mean() > 0.97
    same = rows.groupby("fingerprint").n_within
    assert (same.nunique() == 1).all() and (same.first() >= same.size() - 1).all()
