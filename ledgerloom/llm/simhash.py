"""Fingerprints of documents whose bits are votes of weighted terms, and the search within a Hamming radius.

A text's terms are its runs of five words (all its words, if fewer) and, at half their weight, its single words;
a term weighs ``1 + ln tf``.  Each term's hash votes on 128 signed bits (Charikar 2002).  Weights are rounded to whole
sixteenths, so sums are exact and equal texts have equal fingerprints everywhere.

Search (Manku, Jain and Das Sarma 2007): the bits are cut into ``blocks`` blocks; two fingerprints within ``radius``
agree on at least ``blocks - radius`` of them.  For each such choice of blocks there is a table, in which the
fingerprints are keyed by the chosen bits; those with equal keys are compared.  A pair counts in the first table
in which it agrees.  A key with more than ``BUCKET`` fingerprints gets longer keys in the same way: the rest of the
bits is cut into ``radius + 1`` pieces, of which a pair agrees on one at least.  What then still is larger is cut into
slices, and pairs of slices are dealt out.  Copies are one fingerprint with a number, and only sums leave a task,
so a group of copies of any size costs nothing, and a group of near copies is never written out as pairs.

For a document's edit, its last ``floor(n / 3)`` code points give way to as many first ones of the next document.
Documents follow each other by descending ``doc_id``, rows of one id by a hash of their text, rows without an id
last; after the last comes the first.  Texts are shuffled once, into ranges of that order; a range leaves its first and
last rows beside its results, and a join of those closes the gaps between ranges.

Defined results: a null text is empty; a text without a word has the fingerprint zero; a single document is its
own next one; repeated rows are each answered; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import fresh_folder
from .learning import blocks as text_blocks
from .sampling import _mixed, shingles_of, word_hashes
from .ship import session_of

BITS = 128
RADIUS = 4
BLOCKS = 5
BUCKET = 2048
_VOTES = 1 << 16
_SECOND = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None) -> tuple[int, int]:
    """The 128 bits of a text as two unsigned numbers."""
    words = word_hashes(text)
    if not len(words):
        return 0, 0
    runs, counts = shingles_of(words)
    single, often = np.unique(words, return_counts=True)
    # Whole sixteenths; a single word votes apart from a run that is that word alone.
    weight = np.concatenate([np.rint(16 * (1 + np.log(counts))), np.rint(8 * (1 + np.log(often)))]).astype(np.float32)
    low = np.concatenate([runs, _mixed(single ^ _SECOND)])
    both = np.stack([low, _mixed(low + _SECOND)], axis=1)
    votes = np.zeros(BITS)
    for begin in range(0, len(low), _VOTES):  # sums of a part are below 2 ** 24, exact in a float
        bits = np.unpackbits(both[begin : begin + _VOTES].view(np.uint8), axis=1)
        votes += weight[begin : begin + _VOTES] @ bits.astype(np.float32)
    # As many votes for as against give no bit.
    set_ = 2 * votes > float(weight.sum(dtype=np.float64))
    high, rest = np.packbits(set_).view(">u8")
    return int(high), int(rest)


def likeness(a: tuple[int, int], b: tuple[int, int]) -> float:
    """The share of bits in which two fingerprints agree."""
    return 1 - ((a[0] ^ b[0]).bit_count() + (a[1] ^ b[1]).bit_count()) / BITS


def spelt(print_: tuple[int, int]) -> str:
    return f"{print_[0]:016x}{print_[1]:016x}"


def _signed(numbers: list[int]) -> np.ndarray:
    return np.array(numbers, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, high, low) of every row, the bits as two numbers."""
    session_of(docs)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            found = [fingerprint(t) for t in block.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(_signed([f[k] for f in found])) for k in (0, 1))], names=["doc_id", "high", "low"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(apply, "doc_id long, high long, low long")


def _cut(places: list[int], pieces: int) -> list[tuple[int, int]]:
    """Masks (high, low) of so many runs of bits, about equally long."""
    out = []
    for k in range(pieces):
        run = places[len(places) * k // pieces : len(places) * (k + 1) // pieces]
        mask = sum(1 << p for p in run)
        out.append((mask >> 64, mask & (1 << 64) - 1))
    return out


class Tables:
    """Masks of the tables' keys, and of the longer keys of their large buckets."""

    def __init__(self, radius: int, blocks: int):
        if not 0 <= radius < blocks <= BITS:
            raise ValueError("there must be more blocks than the radius")
        cut = _cut(list(range(BITS)), blocks)
        self.radius = radius
        self.keys, self.longer = [], []
        for chosen in itertools.combinations(range(blocks), blocks - radius):
            key = tuple(sum(cut[b][w] for b in chosen) for w in (0, 1))
            whole = key[0] << 64 | key[1]
            rest = [p for p in range(BITS) if not whole >> p & 1]
            self.keys.append(key)
            self.longer.append([(key[0] | m[0], key[1] | m[1]) for m in _cut(rest, radius + 1)])

    @staticmethod
    def _first(masks: list[tuple[int, int]], high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The first mask under which differences vanish."""
        first = np.full(len(high), len(masks))
        for k in range(len(masks) - 1, -1, -1):
            first[(high & np.uint64(masks[k][0]) == 0) & (low & np.uint64(masks[k][1]) == 0)] = k
        return first

    def counts_here(self, table: int, piece: int | None, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Whether pairs with these differences count under this key, and not under one before it."""
        here = self._first(self.keys[: table + 1], high, low) == table
        return here if piece is None else here & (self._first(self.longer[table][: piece + 1], high, low) == piece)


def _key(masks: tuple[int, int], *names: int):
    high, low = _signed(list(masks)).tolist()
    return F.xxhash64(*map(F.lit, names), F.col("high").bitwiseAND(F.lit(high)), F.col("low").bitwiseAND(F.lit(low)))


def _compared(rows: DataFrame, tables: Tables) -> DataFrame:
    """(high, low, found): for each of ``rows(key, side, table, piece, high, low, many)`` the rows of documents near it
    under its key; where sides are given, only those of the other one.  A key is whole in one task."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            held = [x[cut:] for x in now]
            if cut:
                yield pairs([x[:cut] for x in now])
        if held is not None:
            yield pairs(held)

    def pairs(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, side, table, piece, high, low, many = columns
        high, low, found = high.view(np.uint64), low.view(np.uint64), np.zeros(len(key), np.int64)
        at, lag = np.arange(len(key)), 0
        while len(at):
            lag += 1
            at = at[at + lag < len(key)]
            at = at[key[at] == key[at + lag]]
            for begin in range(0, len(at), 1 << 20):
                i = at[begin : begin + (1 << 20)]
                j = i + lag
                apart = [w[i] ^ w[j] for w in (high, low)]
                near = (np.bitwise_count(apart[0]) + np.bitwise_count(apart[1]) <= tables.radius) & ((side[i] < 0) | (side[i] != side[j]))
                i, j, apart = i[near], j[near], [a[near] for a in apart]
                for t, p in set(zip(table[i].tolist(), piece[i].tolist(), strict=True)):
                    same = (table[i] == t) & (piece[i] == p)
                    same[same] = tables.counts_here(t, None if p < 0 else p, *(a[same] for a in apart))
                    np.add.at(found, i[same], many[j[same]])
                    np.add.at(found, j[same], many[i[same]])
        some = np.flatnonzero(found)
        return pa.RecordBatch.from_arrays([pa.array(high[some].view(np.int64)), pa.array(low[some].view(np.int64)), pa.array(found[some])], names=["high", "low", "found"])

    columns = ["key", "side", "table", "piece", "high", "low", "many"]
    return rows.select(*columns).repartition("key").sortWithinPartitions("key").mapInArrow(apply, "high long, low long, found long")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose key others have too, with how many have it."""
    # Grouped by more than the key, so that the join has an exchange on both sides and a large bucket can be split.
    n = rows.groupBy("key", F.hash("key").alias("_")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("_key"), "n")
    return rows.join(n, F.col("key") == F.col("_key")).drop("_key")


def within(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """(high, low, near): for each distinct fingerprint of ``prints(high, low)`` the other rows within ``radius``.

    Rows with the same fingerprint count too, but for one, the row itself.
    """
    spark = session_of(prints)
    folder, tables = fresh_folder(spark, "fingerprints"), Tables(radius, blocks)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    own = kept(prints.groupBy("high", "low").agg(F.count(F.lit(1)).alias("many")), "distinct")
    keys = F.array(*[F.struct(F.lit(t).alias("table"), _key(m, t).alias("key")) for t, m in enumerate(tables.keys)])
    rows = kept(_shared(own.select("high", "low", "many", F.inline(keys))), "tables").withColumns({"side": F.lit(-1), "piece": F.lit(-1)})
    found = _compared(rows.where(F.col("n") <= bucket), tables)
    choices = F.element_at(
        F.array(*[F.array(*[F.struct(F.lit(p).alias("piece"), _key(m, t, p).alias("key")) for p, m in enumerate(pieces)]) for t, pieces in enumerate(tables.longer)]),
        F.col("table") + 1,
    )
    longer = rows.where(F.col("n") > bucket).select("high", "low", "many", "table", "side", F.inline(choices))
    longer = kept(_shared(longer), "longer")
    found = found.unionByName(_compared(longer.where(F.col("n") <= bucket), tables))
    # Slices of what is still larger; every two of them meet once, and each with itself.
    sliced = longer.where(F.col("n") > bucket).withColumn("slices", F.ceil(F.col("n") / (bucket // 2)).cast("int"))
    sliced = sliced.withColumn("own", F.pmod(F.xxhash64("low", "high"), F.col("slices")).cast("int"))
    sliced = sliced.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    sliced = sliced.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"), "table", "piece", "high", "low", "many")
    found = found.unionByName(_compared(sliced, tables))
    sums = found.groupBy("high", "low").agg(F.sum("found").alias("found"))
    return own.join(sums, ["high", "low"], "left").select("high", "low", (F.col("many") - 1 + F.coalesce("found", F.lit(0))).alias("near"))


_ROW = "doc_id long, n_chars long, edited_sha256 string, high long, low long, edited_fingerprint string, near_edited double, near_next double, part int, head boolean, text string"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in _ROW.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], schema=pa.schema(list(zip(_NAMES, _TYPES, strict=True))))


def _answer(doc_id: int | None, text: str, own: tuple[int, int], after: str, next_: tuple[int, int]) -> tuple:
    given = len(text) // 3
    edited = text[: len(text) - given] + after[:given]
    new = fingerprint(edited)
    seal = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), seal, *_signed(list(own)).tolist(), spelt(new), likeness(own, new), likeness(own, next_), None, None, None


def chained(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, high, low, edited_fingerprint, near_edited, near_next) of every row."""
    spark = session_of(docs)
    folder = fresh_folder(spark, "chained")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The place in the table only spreads rows that are alike in everything.
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.select(F.col("doc_id"), "text", order[1].alias("_hash"), order[2].alias("_place"))
    order = [order[0], "_hash", "_place"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for block in text_blocks(batches):
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in block.columns), strict=True):
                now = doc_id, text, fingerprint(text)
                if before is None:
                    out.append((*([None] * 8), part, True, text))
                else:
                    out.append(_answer(*before, *now[1:]))
                before = now
            if out:
                yield _batch(out)
        if before is not None:
            yield _batch([(before[0], *([None] * 7), part, False, before[1])])

    rows.mapInArrow(apply, _ROW).write.parquet(folder)
    found = spark.read.schema(_ROW).parquet(folder)
    ends = found.where("part IS NOT NULL")
    # One number for each range that has rows.
    parts = sorted(r.part for r in ends.where("head").select("part").collect())
    follow = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    tails = ends.where("NOT head").select("doc_id", "text", "part").join(follow, "part")
    heads = ends.where("head").select(F.col("part").alias("next"), F.col("text").alias("after"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _batch([_answer(doc_id, text, fingerprint(text), after, fingerprint(after))])

    closed = tails.join(heads, "next").select("doc_id", "text", "after").mapInArrow(close, _ROW)
    return found.where("part IS NULL").unionByName(closed).drop("part", "head", "text")


def document_fingerprints(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within) of every row.

    ``n_within`` counts the other rows whose fingerprint lies within ``radius``.
    """
    spark = session_of(docs)
    folder = fresh_folder(spark, "prints")
    chained(docs).write.parquet(folder)
    rows = spark.read.parquet(folder)
    near = within(rows.select("high", "low"), radius, blocks)
    # Grouped anew, so that the join has an exchange on both sides and a fingerprint with many copies can be split.
    near = near.groupBy(F.col("high").alias("_high"), F.col("low").alias("_low"), F.hash("high").alias("_")).agg(F.max("near").alias("n_within"))
    named = F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in ("high", "low")]).alias("fingerprint")
    joined = rows.join(near, (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low")))
    return joined.select("doc_id", "n_chars", "edited_sha256", named, "edited_fingerprint", "near_edited", "near_next", "n_within")
