"""Benchmark items that stand in documents: an inverted index of the items, asked with every passage.

The items are indexed for BM25, scaled so that an item's own text scores 1 for it.  Every document is read as
overlapping passages, long enough that an item lies whole in one of them, and every passage is a query for
all items that score at least ``least``.  Pruning is that of block-max WAND: posting lists are cut into
blocks of items with their largest impact; a passage whose summed block bounds stay below ``least`` in every
block is dropped without looking at an item, and for the rest cursors skip to the next pivot whose list
bounds and block bounds reach ``least``.  What is retrieved is verified: at least ``overlap`` of the
five-word shingles of the item's question, and as much of its answer, must stand in the passage.

The answer of an item is its last line, or else its last sentence; an item with one sentence is question and
answer in one.  Words are runs of letters and digits without regard to case.

The items travel to the tasks in index parts of at most ``PART`` items, ``PASS_ITEMS`` items in one pass over
the documents; more items take more passes, so what is broadcast is bounded however many items there are.

Defined results: a null text or item is empty and matches nothing; repeated documents and items are each
answered; empty tables give no row; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import fresh_folder
from .learning import blocks
from .ship import session_of

LEAST = 0.6
OVERLAP = 0.8
SHINGLE = 5
#: Bounds of passages and blocks that are kept at once.
BOUNDS = 1 << 21
PART = 4096
PASS_ITEMS = 65_536
BLOCK = 4
K1, B = 1.2, 0.75

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    lines = [x for x in text.strip().split("\n") if words_of(x)]
    pieces = lines if len(lines) > 1 else [x for x in _SENTENCE.split(text.strip()) if words_of(x)]
    if len(pieces) < 2:
        return words_of(text), words_of(text)
    return words_of(" ".join(pieces[:-1])), words_of(pieces[-1])


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


@dataclass
class Statistics:
    """What scores need of all items, whatever part of them an index holds: their number, mean length and how many hold a word."""

    items: int
    mean: float
    held_by: dict[str, int]

    @classmethod
    def of(cls, words: list[list[str]]) -> Statistics:
        return cls(len(words), sum(map(len, words)) / max(1, len(words)), Counter(w for own in words for w in set(own)))


@dataclass
class Index:
    """Posting lists of some items; item numbers are places in ``items``."""

    items: list[tuple[int | None, str]]
    terms: dict[str, int]
    first: np.ndarray  # per term, where its postings begin
    item: list[int]
    impact: np.ndarray
    top: np.ndarray  # per term, its largest impact
    block_first: np.ndarray  # per term, where its blocks begin
    block: list[int]
    block_top: np.ndarray
    wide: np.ndarray  # per term, its row in ``wide_top`` if it is in many blocks, else -1
    wide_top: np.ndarray  # bounds of such terms in every block
    block_array: np.ndarray  # ``block`` again, to be taken many at a time
    blocks: int

    @classmethod
    def of(cls, items: list[tuple[int | None, str]], statistics: Statistics | None = None) -> Index:
        words = [words_of(t) for _, t in items]
        known = statistics or Statistics.of(words)
        terms = {w: i for i, w in enumerate(sorted({w for own in words for w in own}))}
        mean, idf = max(1.0, known.mean), {w: np.log(1 + (known.items - known.held_by[w] + 0.5) / (known.held_by[w] + 0.5)) for w in terms}
        rows = []
        for number, own in enumerate(words):
            scale = K1 * (1 - B + B * len(own) / mean)
            impacts = {w: idf[w] * n * (K1 + 1) / (n + scale) for w, n in Counter(own).items()}
            whole = sum(impacts.values())
            rows += [(terms[w], number, x / whole) for w, x in impacts.items()]
        rows.sort()
        term, item, impact = (np.array(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        n, count = len(terms), -(-len(items) // BLOCK)
        first = np.searchsorted(term, np.arange(n + 1))
        top = np.maximum.reduceat(impact, first[:-1]) if n else np.zeros(0)
        cells, begin = np.unique(term * (count + 1) + item // BLOCK, return_index=True)
        block_first = np.searchsorted(cells, np.arange(n + 1) * (count + 1))
        block_top = np.maximum.reduceat(impact, begin) if n else np.zeros(0)
        many = np.flatnonzero(np.diff(block_first) > max(4, count // 4))
        wide = np.full(n, -1)
        wide[many] = np.arange(len(many))
        block, wide_top = cells % (count + 1), np.zeros((len(many), count))
        for row, t in enumerate(many.tolist()):
            own = slice(block_first[t], block_first[t + 1])
            wide_top[row, block[own]] = block_top[own]
        return cls(items, terms, first, item.tolist(), impact, top, block_first, block.tolist(), block_top, wide, wide_top, block, count)

    def promising(self, passage: np.ndarray, term: np.ndarray, passages: int, least: float) -> np.ndarray:
        """Passages with a block of items whose bound reaches ``least``; pairs (passage, term) are distinct."""
        row = self.wide[term]
        present = np.zeros((passages, len(self.wide_top)))
        present[passage[row >= 0], row[row >= 0]] = 1
        passage, term = passage[row < 0], term[row < 0]
        size = self.block_first[term + 1] - self.block_first[term]
        at = np.repeat(self.block_first[term] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        bound = np.bincount(np.repeat(passage, size) * self.blocks + self.block_array[at], self.block_top[at], minlength=passages * self.blocks)
        bound = bound.reshape(passages, self.blocks) + present @ self.wide_top
        return np.flatnonzero(bound.max(axis=1, initial=0.0) >= least - 1e-9)

    def retrieve(self, query: np.ndarray, least: float) -> list[tuple[int, float]]:
        """Every item that scores at least ``least`` for the terms, by block-max WAND."""
        lists = [[int(self.first[t]), int(self.first[t + 1]), float(self.top[t]), int(t)] for t in query]
        item, impact, out = self.item, self.impact, []
        least -= 1e-9
        while lists:
            lists.sort(key=lambda c: item[c[0]])
            bound, pivot = 0.0, None
            for k, cursor in enumerate(lists):
                bound += cursor[2]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            target = item[lists[pivot][0]]
            while pivot + 1 < len(lists) and item[lists[pivot + 1][0]] == target:
                pivot += 1
            own = target // BLOCK
            if sum(self._block_top(c[3], own) for c in lists[: pivot + 1]) < least:
                # No item of this block up to the next list's can reach the threshold.
                goal = (own + 1) * BLOCK
                if pivot + 1 < len(lists):
                    goal = min(goal, item[lists[pivot + 1][0]])
                goal = max(goal, target + 1)
            elif item[lists[0][0]] == target:
                score = float(sum(impact[c[0]] for c in lists if item[c[0]] == target))
                if score >= least:
                    out.append((target, score))
                goal = target + 1
            else:
                goal = target
            for cursor in lists[: pivot + 1]:
                if item[cursor[0]] < goal:
                    cursor[0] = bisect_left(item, goal, cursor[0], cursor[1])
            lists = [c for c in lists if c[0] < c[1]]
        return out

    def _block_top(self, term: int, block: int) -> float:
        a, b = int(self.block_first[term]), int(self.block_first[term + 1])
        at = bisect_left(self.block, block, a, b)
        return float(self.block_top[at]) if at < b and self.block[at] == block else 0.0


class Detector:
    """Items that stand in texts, for some parts of the index."""

    def __init__(self, parts: list[list[tuple[int | None, str]]], least: float = LEAST, overlap: float = OVERLAP, statistics: Statistics | None = None):
        words = [words_of(t) for p in parts for _, t in p]
        statistics = statistics or Statistics.of(words)
        self.parts = [Index.of(p, statistics) for p in parts]
        self.least, self.overlap = least, overlap
        longest = max((len(words_of(t)) for p in parts for _, t in p), default=0)
        self.stride = max(64, longest)
        self.checks = [[tuple(map(shingles, parts_of(t))) for _, t in p] for p in parts]

    def __call__(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text (item_id, score, question overlap, answer overlap) of its best passage for each item."""
        words = [words_of(t) for t in texts]
        return [list(best.values()) for best in self._found(words)]

    def _found(self, words: list[list[str]]) -> list[dict]:
        out: list[dict] = [{} for _ in words]
        stride = self.stride
        # Passage k of a text has its words from k * stride on, two strides of them.
        counts = np.array([max(1, -(-len(w) // stride) - 1) for w in words], dtype=np.int64)
        base = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(words)), counts)
        for number, index in enumerate(self.parts):
            get = index.terms.get
            pairs = []
            for own, begin, count in zip(words, base.tolist(), counts.tolist(), strict=True):
                ids = np.array([get(w, -1) for w in own], dtype=np.int64)
                at = np.flatnonzero(ids >= 0)
                cell, ids = at // stride, ids[at]
                low, high = cell < count, cell > 0
                pairs.append(np.concatenate([(begin + cell[low]) * len(index.terms) + ids[low], (begin + cell[high] - 1) * len(index.terms) + ids[high]]))
            cells = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
            if not len(cells):
                continue
            cells.sort()
            cells = cells[np.concatenate([[True], cells[1:] != cells[:-1]])]
            passage, term = cells // len(index.terms), cells % len(index.terms)
            for p in self._promising(index, passage, term, int(counts.sum())):
                a, b = np.searchsorted(passage, [p, p + 1])
                found = index.retrieve(term[a:b], self.least)
                if found:
                    doc = int(owner[p])
                    begin = (p - int(base[doc])) * stride
                    self._verify(out[doc], words[doc][begin : begin + 2 * stride], number, found)
        return out

    def _promising(self, index: Index, passage: np.ndarray, term: np.ndarray, passages: int) -> Iterator[int]:
        """Passages that may hold an item, some at a time: bounds are kept for every passage and block."""
        step = max(1, BOUNDS // max(1, index.blocks + len(index.wide_top)))
        for begin in range(0, passages, step):
            stop = min(passages, begin + step)
            a, b = np.searchsorted(passage, [begin, stop])
            yield from (index.promising(passage[a:b] - begin, term[a:b], stop - begin, self.least) + begin).tolist()

    def _verify(self, best: dict, passage: list[str], number: int, found: list[tuple[int, float]]) -> None:
        by_size: dict[int, set] = {}
        for item, score in found:
            shares = []
            for wanted in self.checks[number][item]:
                size = len(next(iter(wanted), ()))
                if size and size not in by_size:
                    by_size[size] = {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}
                shares.append(len(wanted & by_size[size]) / len(wanted) if size else 0.0)
            if min(shares) >= self.overlap:
                key = (number, item)
                if key not in best or best[key][1] < score:
                    best[key] = (self.parts[number].items[item][0], score, *shares)


def _counted(rows: DataFrame) -> DataFrame:
    """(word, n): how many items hold each word, and under a null word how many words all items have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(0).to_pylist()]
            held = Counter(w for own in words for w in set(own))
            yield pa.RecordBatch.from_arrays([pa.array([None, *held], pa.string()), pa.array([sum(map(len, words)), *held.values()], pa.int64())], names=["word", "n"])

    return rows.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _detectors(items: DataFrame, least: float, overlap: float) -> Iterator[tuple[Detector, bool]]:
    """One detector a pass, and whether it is the last; each holds at most about ``PASS_ITEMS`` items."""
    spark = session_of(items)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(r"\w"))
    total = rows.count()
    passes = max(1, -(-total // PASS_ITEMS))
    counted = None
    if passes > 1:
        folder = fresh_folder(spark, "item-words")
        _counted(rows).write.parquet(folder)
        counted = spark.read.parquet(folder)
    for k in range(passes):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        pairs, statistics = [(r.item_id, r.text) for r in own], None
        if counted is not None:  # of all items, the words of this pass
            words = {w for _, t in pairs for w in words_of(t)}
            mine = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
            held = {r.word: r.n for r in counted.join(mine, "word", "left_semi").collect()}
            statistics = Statistics(total, counted.where("word IS NULL").first().n / total, held)
        yield Detector([pairs[i : i + PART] for i in range(0, len(pairs), PART)], least, overlap, statistics), k == passes - 1


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def find_leaks(docs: DataFrame, items: DataFrame, least: float = LEAST, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every item that stands in a document."""
    spark = session_of(docs)
    folder, schema = fresh_folder(spark, "leaks"), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    for detector, _ in _detectors(items, least, overlap):
        sent = spark.sparkContext.broadcast(detector)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches):
                names, texts = (c.to_pylist() for c in block.columns)
                rows = [(d, *leak) for d, leaks in zip(names, sent.value(texts), strict=True) for leak in leaks]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types, strict=True)], schema=_OUT)

        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, schema).write.mode("append").parquet(folder)
        sent.destroy()
    return spark.read.schema(schema).parquet(folder)


def without_leaks(docs: DataFrame, items: DataFrame, least: float = LEAST, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` in which no item stands.  With several passes, each but the last is written."""
    spark, at, schema = session_of(docs), docs.columns.index("text"), docs.schema
    folder = fresh_folder(spark, "without-leaks")
    for number, (detector, last) in enumerate(_detectors(items, least, overlap)):
        sent = spark.sparkContext.broadcast(detector)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, at):
                yield block.filter(pa.array([not leaks for leaks in sent.value(block.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(keep, schema)
        if not last:
            docs.write.parquet(f"{folder}/{number}")
            sent.destroy()
            docs = spark.read.schema(schema).parquet(f"{folder}/{number}")
    return docs
