"""Token ids of documents as binary shards whose document boundaries are Elias-Fano coded.

A shard is one little-endian file: a fixed header, the document ids and the document boundaries as two
Elias-Fano sequences, then the concatenated ids at two or four bytes each.  A sequence of ``n`` ascending
numbers below ``u`` takes about ``2 + log2(u / n)`` bits a number; every 256th upper position is kept so that
one boundary is found by looking at one short stretch of bits, with no table of 64-bit offsets.

Documents are dealt out by range of ``doc_id`` and sorted in their task; a task streams over its documents
and closes a shard when it holds ``shard_ids`` ids, so memory is bounded by a shard or by one document.

Defined results: a null text is empty and gets the end id alone; null document ids come first; rows that
repeat a document id are all kept, ordered by their text; an empty table gives no shard and no row; other
columns are not looked at.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import Writer, fresh_folder, reader
from .ship import session_of

MAGIC = b"EFTOKEN1"
HEADER = struct.Struct("<8sQQQQqIIII")  # magic, documents, null ids, ids, id bytes, first doc_id, bytes of the four sections before the ids
SAMPLE = 256
SHARD_IDS = 4_000_000
KNOWN_UNITS = 800_000
WORDS_AT_ONCE = 512
#: Bytes of texts whose units are told apart at once.
SLICE_BYTES = 8 << 20


# --- Elias-Fano ---------------------------------------------------------------------------------


class EliasFano:
    """An ascending sequence of numbers from 0; ``select(i)`` gives the i-th."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        upper = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros((int(upper[-1]) if n else 0) + 1, dtype=np.uint8)
        ones[upper] = 1
        lower = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, bits, np.packbits(lower.ravel(), bitorder="little"), np.packbits(ones, bitorder="little"), upper[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QIQQI", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, lows, highs, samples = struct.unpack_from("<QIQQI", data)
        at = struct.calcsize("<QIQQI")
        low = np.frombuffer(data, np.uint8, lows, at)
        high = np.frombuffer(data, np.uint8, highs, at + lows)
        return cls(n, bits, low, high, np.frombuffer(data, "<u4", samples, at + lows + highs))

    def _lower(self, i: int) -> int:
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (chunk >> (first % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th number, from one sampled position and the bits after it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        skipped = bin(int(self.high[byte]) & ((1 << (at % 8)) - 1)).count("1")
        left += skipped
        while left >= (ones := bin(int(self.high[byte])).count("1")):
            left, byte = left - ones, byte + 1
        position = byte * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[left])
        return ((position - i) << self.low_bits) | self._lower(i)

    def all(self) -> np.ndarray:
        """Every number, in order."""
        upper = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        lower = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else 0
        return (upper.astype(np.int64) << self.low_bits) | lower


# --- encoding -----------------------------------------------------------------------------------

# The tokenizer never joins a letter to a sign or to white space after it, nor a sign to white space after
# it, nor a single white space that is no blank to what follows.  So a text falls into units, and the ids of
# a text are those of its units.
_BLANK, _BREAK, _LETTER, _SIGN = 1, 2, 3, 4
_CLASS = np.zeros(256, dtype=np.uint8)  # bytes beyond ASCII and control characters stay 0
_CLASS[ord("!") : ord("~") + 1] = _SIGN
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[9:14], _CLASS[ord(" ")] = _BREAK, _BLANK
# A unit of one word, which can be encoded in one text with others like it.
_WORD = re.compile(r" ?\S+")


def _white(kind: np.ndarray) -> np.ndarray:
    return (kind == _BLANK) | (kind == _BREAK)


def _unit_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where units begin in the UTF-8 bytes of texts that begin at ``starts``, and the end of the bytes.

    Units begin at white space after something else, at a sign after a word, and after a line's end.
    """
    kind = _CLASS[data]
    lead = np.flatnonzero(data == 0xC3)  # À to ÿ but for the signs × and ÷
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    at = np.flatnonzero(kind != _LETTER)
    own = kind[at]
    white = _white(own)
    # What lies before the first byte of a text is looked at too, but a unit begins there anyhow.
    after_word = np.diff(at, prepend=0) > 1
    after_word[1:] &= white[:-1]
    bounds = at[(own == _SIGN) & after_word]
    before = kind[at - 1]
    spaces = at[white & ~_white(before)]
    # Characters beyond ASCII that are, or may be, white space themselves.
    far = np.flatnonzero(data[spaces - 1] >= 0x80)
    one, two, three = (data[spaces[far] - k] for k in (1, 2, 3))
    doubt = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    doubt |= ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
    spaces = np.delete(spaces, far[doubt])
    breaks = spaces[kind[spaces] == _BREAK] + 1
    breaks = breaks[breaks < len(data)]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[bounds] = begins[spaces] = begins[breaks[kind[breaks] >= _LETTER]] = begins[starts] = begins[-1] = True
    return np.flatnonzero(begins)


class Encoder:
    """Ids of texts by the ``tokenizers`` library; units seen before are not encoded again."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.code = f"<u{self.width}", {2: "H", 4: "I"}[self.width]
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if len(line_end) == 1 else -1
        self.known: dict[str, bytes] = {}

    def _packed(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 4096):
            for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False):
                yield array(self.code, e.ids).tobytes()

    def _packed_words(self, words: list[str]) -> Iterator[bytes]:
        """The same for units of one word, a line each of longer texts."""
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends = (np.flatnonzero(ids == self.line_end) * self.width).tolist()
            if len(ends) != len(some) - 1:  # of another kind of tokenizer
                yield from self._packed(some)
                continue
            packed, start = ids.tobytes(), 0
            for end in ends:
                yield packed[start:end]
                start = end + self.width
            yield packed[start:]

    def _of_units(self, units: list[str]) -> list[bytes]:
        """Ids of units that are all different."""
        found = list(map(self.known.get, units))
        fresh = [k for k, ids in enumerate(found) if ids is None]
        words = [k for k in fresh if _WORD.fullmatch(units[k])]
        others = sorted(set(fresh).difference(words))
        for own, packed in ((words, self._packed_words), (others, self._packed)):
            for k, ids in zip(own, packed([units[k] for k in own]), strict=True):
                found[k] = ids
                if len(self.known) < KNOWN_UNITS:
                    self.known[units[k]] = ids
        return found

    def _of_texts(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
        begins = _unit_starts(data, bounds[:-1])
        units = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(data)).dictionary_encode()
        ids = pa.array(self._of_units(units.dictionary.to_pylist()), pa.large_binary()).take(units.indices)
        _, places, packed = ids.buffers()
        ends = np.frombuffer(places, np.int64)[np.searchsorted(begins, bounds)].tolist()
        packed = memoryview(packed)
        for start, end in zip(ends[:-1], ends[1:], strict=True):
            yield bytes(packed[start:end])

    def __call__(self, texts: list[str | None] | pa.Array) -> Iterator[bytes]:
        """Ids of each text, worked out for some megabytes of texts at a time; a null text is empty."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        column, at = pc.fill_null(column, ""), 0
        _, places, letters = column.buffers()
        bounds = np.frombuffer(places, np.int64)[column.offset :][: len(column) + 1] if len(column) else np.zeros(1, np.int64)
        while at < len(column):
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, "right")) - 1)
            first, last = bounds[at], bounds[stop]
            if first == last:
                yield from [b""] * (stop - at)
            else:
                yield from self._of_texts(np.frombuffer(letters, np.uint8)[first:last], bounds[at : stop + 1] - first)
            at = stop


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- shards -------------------------------------------------------------------------------------


def shard_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    """One shard; ``doc_ids`` ascend, nulls first."""
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    names = EliasFano.of(np.array([d - first for d in known], dtype=np.uint64)).to_bytes()
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(lengths)])).to_bytes()
    head = HEADER.pack(MAGIC, len(doc_ids), len(doc_ids) - len(known), len(ids) // width, width, first, len(names), len(bounds), 0, 0)
    return head + names + bounds + ids


def read_shard(stream) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, boundaries and ids of an open shard."""
    magic, n, nulls, _, width, first, names, bounds, _, _ = HEADER.unpack(stream.read(HEADER.size))
    if magic != MAGIC:
        raise ValueError("not a token shard")
    known = EliasFano.from_bytes(stream.read(names)).all()
    ends = EliasFano.from_bytes(stream.read(bounds)).all()
    return [None] * nulls + (known + first).tolist(), ends, np.frombuffer(stream.read(), dtype=f"<u{width}")


def read_document(stream, i: int) -> np.ndarray:
    """The ids of the i-th document of an open shard, found by two selects and one read."""
    _, _, _, _, width, _, names, bounds, _, _ = HEADER.unpack(stream.read(HEADER.size))
    stream.seek(HEADER.size + names)
    ends = EliasFano.from_bytes(stream.read(bounds))
    start, stop = ends.select(i), ends.select(i + 1)
    stream.seek(HEADER.size + names + bounds + start * width)
    return np.frombuffer(stream.read((stop - start) * width), dtype=f"<u{width}")


MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into shards under ``folder``; returns the committed manifest."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, encoder = TaskContext.get().partitionId(), 0, _encoder(tokenizer)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        doc_ids, lengths, pieces, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, lengths, pieces, held, seq
            with Writer(folder, f"part-{part:06d}-{seq:05d}.eft") as out:
                out.write(shard_bytes(doc_ids, np.array(lengths), b"".join(pieces), encoder.width))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": out.uri, "n_docs": len(doc_ids), "n_ids": held}], schema=_MANIFEST)
            doc_ids, lengths, pieces, held, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(batch.column(1)), strict=True):
                doc_ids.append(doc_id)
                pieces.append(ids + end)
                lengths.append(len(pieces[-1]) // encoder.width)
                held += lengths[-1]
                if held >= shard_ids:
                    yield close()
        if doc_ids:
            yield close()

    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    spark, manifest = session_of(docs), f"{folder}/manifest"
    dealt.mapInArrow(encode, MANIFEST).write.parquet(manifest)
    return spark.read.parquet(manifest)


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_DOCUMENT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_documents(manifest: DataFrame) -> DataFrame:
    """Read every shard back: place, length and checksum of each document in the whole id array."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                with reader(path) as stream:
                    doc_ids, ends, ids = read_shard(stream)
                wide = ids.astype("<u4")
                sums = [zlib.crc32(wide[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns = [doc_ids, ends[:-1] + base, np.diff(ends), sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _DOCUMENT.types, strict=True)], schema=_DOCUMENT)

    # Sums over tasks first, so that the window without a key sees one row a task, not one a shard.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = manifest.withColumn("inside", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part")
    spread = placed.select("path", (F.col("base") + F.col("inside")).alias("base")).repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2)
    return spread.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_binary(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write ``docs`` as token shards in the shared folder and read them back, a row a document."""
    return read_documents(write_shards(docs, fresh_folder(session_of(docs), "token-shards"), tokenizer, end_id, shard_ids))
