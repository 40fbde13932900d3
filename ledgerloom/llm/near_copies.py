"""Near copies of documents by consistent weighted sampling over weighted word shingles.

Equal texts are one text.  Its shingles, weighted by frequency and by how common they are in all documents
(:mod:`.sampling`), give 64 consistent weighted samples; runs of four make the keys of 16 bands, and two texts
of similarity 0.8 share a key with probability over 0.999.  Texts that share keys are verified by their
weighted Jaccard similarity; classes are the connected components of what holds.

A bucket is never paired out.  First each text is verified against the smallest of its bucket.  In buckets
that still hold several classes, texts are then sorted by their next keys, which puts together those that
agree longest, and each is verified against the ``LAG`` after it that are of another class; a bucket of up to
``LAG + 1`` texts is thereby compared whole.  Texts of larger buckets that still hold several classes are at
last compared without a cap, by prefixes of their rare shingles (:mod:`.prefixes`): a template that many of them share
comes last in the order of shingles and pairs nothing.
So work grows with the number of texts however large a group of copies is.  Pairs go to tasks by salted
centre: a task reads a centre once and streams its partners.

The common shingles are found exactly in two passes: a shingle in ``COMMON`` of all documents is in a fourth
of that share of some task's documents; those candidates, whose number is bounded, are then counted.

Defined results: a null text is empty; empty texts are copies of each other; rows that share a ``doc_id`` are
one document; rows without an id are in the class of their text, null if no row with that text has an id; an
empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .files import fresh_folder
from .learning import blocks
from .prefixes import possible_pairs
from .sampling import COMMON, SAMPLES, Sampler, Weights, shingle_lists, similarity
from .ship import session_of

LEAST = 0.8
ROWS = 4
LAG = 8
PARTNERS = 500
HELD = 1_500_000
FILE_TEXTS = 50_000


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def weights_of(docs: DataFrame, share: float = COMMON) -> Weights:
    """Weights by the exact number of documents that hold each shingle of at least ``share`` of them."""
    spark = session_of(docs)
    texts = docs.select("text")
    local = share / 4

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """Distinct shingles of documents, some millions at a time."""
        held, size, n = [], 0, 0
        for block in blocks(batches, 0):
            for h, _ in shingle_lists(block.column(0).to_pylist()):
                held.append(h)
                size, n = size + len(h), n + 1
                if size >= HELD:
                    yield n, np.sort(np.concatenate(held))
                    held, size, n = [], 0, 0
        if n:
            yield n, np.sort(np.concatenate(held))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, h in runs(batches):
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.append(begin, len(h)))
            kept = count >= local * n
            names = [None, *h[begin][kept].view(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([n, *count[kept].tolist()], pa.int64()), pa.array([n] * len(names), pa.int64())], names=["shingle", "count", "n"])

    # A row without a shingle says how many documents a run has.  What a run does not propose is in less than
    # ``local`` of its documents, so these sums bound from above how many documents hold a shingle.
    proposed = texts.mapInArrow(propose, "shingle long, count long, n long").groupBy("shingle").agg(F.sum("count").alias("count"), F.sum("n").alias("n"))
    folder = fresh_folder(spark, "common-shingles")
    proposed.write.parquet(folder)
    proposed = spark.read.parquet(folder)
    whole = proposed.where("shingle IS NULL").first()
    total = whole["count"] if whole else 0
    possible = proposed.where(F.col("shingle").isNotNull() & (F.col("count") + local * (total - F.col("n")) >= share * total))
    # At most (mean shingles of a document) / (0.75 * share) of them, whatever the number of documents.
    candidates = np.sort(np.array([r.shingle for r in possible.select("shingle").collect()], dtype=np.int64).view(np.uint64))
    if not len(candidates):
        return Weights(total, candidates, np.zeros(0))
    sent = spark.sparkContext.broadcast(candidates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        sums = np.zeros(len(common), np.int64)
        for _, h in runs(batches):
            at = np.minimum(np.searchsorted(common, h), len(common) - 1)
            sums += np.bincount(at[common[at] == h], minlength=len(common))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(common))), pa.array(sums)], names=["at", "count"])

    counted = texts.mapInArrow(count, "at long, count long").groupBy("at").agg(F.sum("count").alias("count")).collect()
    sent.destroy()
    held_by = np.zeros(len(candidates))
    for r in counted:
        held_by[r.at] = r["count"]
    common = held_by >= share * total
    return Weights(total, candidates[common], held_by[common])


def signed(docs: DataFrame, sent: Broadcast[Weights], samples: int = SAMPLES, rows: int = ROWS) -> DataFrame:
    """(doc_id, same, keys): a key of the text itself and one of each band; no bands for an empty text."""
    session_of(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("same", pa.string()), ("keys", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, weigh = Sampler(samples), sent.value
        band = np.arange(1, samples // rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for block in blocks(batches):
            keys = []
            for h, counts in shingle_lists(block.column(1).to_pylist()):
                if len(h):
                    drawn = sampler(h, weigh(h, counts)).reshape(-1, rows)
                    key = band.copy()
                    for k in range(rows):
                        key = (key ^ drawn[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
                        key ^= key >> np.uint64(33)
                    keys.append(key.view(np.int64).tolist())
                else:
                    keys.append([])
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array(keys, schema.types[2])], schema=schema)

    return docs.select("doc_id", "text", F.md5("text").alias("same")).mapInArrow(sign, "doc_id long, same string, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, sent: Broadcast[Weights], least: float = LEAST) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts are at least ``least`` similar; ``b`` is the side many pairs share."""
    session_of(pairs)
    salts = pairs.groupBy("b", F.hash("b").alias("_")).agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("salts")).select(F.col("b").alias("centre"), "salts")
    members = pairs.join(salts, F.col("b") == F.col("centre")).select("centre", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("place"), F.col("a").alias("doc_id"))
    centres = salts.select("centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("place"), F.col("centre").alias("doc_id"))
    rows = members.unionByName(centres).join(texts, "doc_id").select("centre", "salt", "place", "doc_id", "text")
    rows = rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "place", "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, held, own = sent.value, None, None
        for block in blocks(batches, 4):
            links: list[tuple[int, int]] = []
            names = zip(*(block.column(k).to_pylist() for k in (0, 2, 3)), strict=True)
            for (centre, place, doc_id), (h, counts) in zip(names, shingle_lists(block.column(4).to_pylist()), strict=True):
                weighted = h, weigh(h, counts)
                if place == 0:
                    held, own = centre, weighted
                elif held == centre and similarity(own, weighted) >= least:
                    links.append((doc_id, centre))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def _next_ones(buckets: DataFrame, lag: int = LAG) -> DataFrame:
    """Pairs of texts of one bucket that follow each other within ``lag`` places and are of different classes.

    Where a range ends, a bucket may be cut.  So a partition also gives its first and last ``lag`` rows and how many
    it has, from which the driver makes the pairs across partitions.
    """
    spark = session_of(buckets)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("key", pa.int64()), ("class", pa.int64())])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tail, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            key, doc, group = (batch.column(k).to_numpy() for k in (0, 4, 5))
            if n < lag:
                yield edges(part, n, key[: lag - n], doc[: lag - n], group[: lag - n])
            n += len(key)
            new = 0
            if tail is not None:
                new = len(tail[0])
                key, doc, group = (np.concatenate(x) for x in zip(tail, (key, doc, group), strict=True))
            found = []
            for k in range(1, lag + 1):
                at = np.arange(max(0, new - k), max(0, len(key) - k))
                at = at[(key[at] == key[at + k]) & (group[at] != group[at + k])]
                found.append((doc[at], doc[at + k]))
            tail = key[-lag:], doc[-lag:], group[-lag:]
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), none.cast(pa.int32()), none, none, none], schema=schema)
        if n > lag:
            new = min(len(tail[0]), n - lag)
            yield edges(part, n - new, *(x[-new:] for x in tail))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, part, n, None, None), schema.types, strict=True)], schema=schema)

    def edges(part: int, place: int, key: np.ndarray, doc: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        columns = [doc, None, np.full(len(key), part), np.arange(place, place + len(key)), key, group]
        return pa.RecordBatch.from_arrays([pa.nulls(len(key), t) if c is None else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    order = ["key", "k1", "k2", "k3", "doc_id"]
    ranges = buckets.select(*order, "class").repartitionByRange(*order).sortWithinPartitions(*order)
    folder = fresh_folder(spark, "next-ones")
    ranges.mapInArrow(pair, "a long, b long, part int, place long, key long, class long").write.parquet(folder)
    found = spark.read.schema("a long, b long, part int, place long, key long, class long").parquet(folder)
    # At most two times ``lag`` rows and one more of each partition.
    rows = found.where("part IS NOT NULL").collect()
    before, total = {}, 0
    for part, n in sorted((r.part, r.place) for r in rows if r.a is None):
        before[part], total = total, total + n
    ends = sorted((before[r.part] + r.place, r.part, r.key, r.a, r["class"]) for r in rows if r.a is not None)
    across = []
    for i, (place, part, key, doc, group) in enumerate(ends):
        for other, far, same, text, kind in ends[i + 1 : i + 1 + lag]:
            if other - place <= lag and far != part and same == key and kind != group:
                across.append((max(doc, text), min(doc, text)))
    return found.where("part IS NULL").select("a", "b").unionByName(spark.createDataFrame(across, "a long, b long"))


def _mixed(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of buckets that hold several classes, with their ``class``."""
    classed = buckets.join(classes.withColumnRenamed("node", "_node"), F.col("doc_id") == F.col("_node"), "left").select("key", "k1", "k2", "k3", "doc_id", F.coalesce("class", "doc_id").alias("class"))
    mixed = classed.groupBy("key", F.hash("key").alias("_")).agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select(F.col("key").alias("_key"))
    return classed.join(mixed, F.col("key") == F.col("_key")).drop("_key")


def near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, class_id) of every row; the class is the smallest id of a group of copies and near copies."""
    spark = session_of(docs)
    folder = fresh_folder(spark, "near-copies")

    def kept(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
        (df if parts is None else df.coalesce(parts)).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    texts = _texts(docs)
    known_weights = weights_of(texts)
    # Tables of numbers are written in files of about so many texts.
    few = max(8, -(-known_weights.documents // FILE_TEXTS))
    # Bounded by the mean length of a text, and gone from the executors when the classes are known.
    weights = spark.sparkContext.broadcast(known_weights)
    every = kept(signed(texts, weights), "signed")
    # One text stands for its copies.
    first = every.groupBy("same", F.hash("same").alias("_")).agg(F.min("doc_id").alias("first")).select("same", "first")
    first = kept(first, "first", few)
    single = every.join(first, (every["same"] == first["same"]) & (every["doc_id"] == first["first"])).select("doc_id", every["same"], "keys").dropDuplicates(["doc_id", "same"])
    count = SAMPLES // ROWS
    following = [F.element_at("keys", F.pmod(F.col("band") + k, F.lit(count)) + 1).alias(f"k{k}") for k in (1, 2, 3)]
    buckets = single.select("doc_id", "keys", F.posexplode("keys").alias("band", "key")).select("key", "band", "doc_id", *following)
    shared = buckets.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("centre")).where("n > 1").select(F.col("key").alias("_key"), "centre", "n")
    buckets = kept(buckets.join(shared, F.col("key") == F.col("_key")).select("key", "k1", "k2", "k3", "doc_id", "centre", "n"), "buckets", few)
    involved = buckets.select("doc_id").distinct()
    candidates = kept(texts.join(involved, "doc_id", "left_semi"), "candidates")
    stars = buckets.where("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct()
    links = kept(verified(stars, candidates, weights, least), "stars")
    classes = kept(components(links), "star-classes", few)
    classed = _mixed(buckets, classes)
    nexts = kept(_next_ones(classed).distinct().join(stars, ["a", "b"], "left_anti"), "more-pairs", few)
    more = kept(verified(nexts, candidates, weights, least), "more")
    # What is linked already goes on as its classes.
    stars_of = classes.select(F.col("node").alias("a"), F.col("class").alias("b"))
    classes = kept(components(stars_of.unionByName(more)), "next-classes", few)
    left = kept(_mixed(buckets.where(F.col("n") > LAG + 1), classes).select("doc_id", "class").distinct(), "left", few)
    if not left.isEmpty():
        sizes = left.groupBy("class", F.hash("class").alias("_")).agg(F.count(F.lit(1)).alias("n_class")).select(F.col("class").alias("_class"), "n_class")
        left = left.join(sizes, F.col("class") == F.col("_class")).select(F.col("doc_id").alias("_doc"), "class", "n_class")
        left = kept(candidates.join(left, F.col("doc_id") == F.col("_doc")).select("doc_id", "class", "n_class", "text"), "left-texts")
        known = stars.unionByName(nexts).select(F.greatest("a", "b").alias("_a"), F.least("a", "b").alias("_b"))
        rare = possible_pairs(left, weights, least)
        rare = kept(rare.join(known, (F.greatest("a", "b") == F.col("_a")) & (F.least("a", "b") == F.col("_b")), "left_anti"), "rare-pairs", few)
        rare = kept(verified(rare, candidates, weights, least), "rare")
        stars_of = classes.select(F.col("node").alias("a"), F.col("class").alias("b"))
        classes = kept(components(stars_of.unionByName(rare)), "classes", few)
    weights.destroy()
    named = first.join(classes, F.col("first") == F.col("node"), "left").select(F.col("same").alias("_same"), F.coalesce("class", "first").alias("class_id"))
    # Grouped anew, so that the join has an exchange on both sides and a text with many copies can be split.
    named = named.groupBy("_same", F.hash("_same").alias("_")).agg(F.first("class_id").alias("class_id"))
    return every.select("doc_id", "same").join(named, F.col("same") == F.col("_same")).select("doc_id", "class_id")


def first_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that stand for their class, one of each.

    A row without an id stays if no row with an id has its text, one row for each text.
    """
    classes = near_copies(docs, least)
    chosen = classes.where("doc_id = class_id").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.join(chosen, docs["doc_id"] == chosen["_kept"], "left_semi").dropDuplicates(["doc_id"])
    same = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    known = docs.where(F.col("doc_id").isNotNull()).select(same.alias("_text")).distinct()
    nameless = docs.where(F.col("doc_id").isNull()).withColumn("_own_text", same)
    nameless = nameless.join(known, nameless["_own_text"] == known["_text"], "left_anti").dropDuplicates(["_own_text"]).drop("_own_text")
    return named.unionByName(nameless)
