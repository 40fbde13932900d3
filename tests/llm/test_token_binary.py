import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.llm import token_binary as tb
from ledgerloom.llm.queries import vocabulary

from .conftest import EDGES

PATH = vocabulary("byte_bpe_50k.json")


@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano_keeps_ascending_numbers(values):
    values = np.sort(np.array(values, dtype=np.int64))
    kept = tb.EliasFano.from_bytes(tb.EliasFano.of(values).to_bytes())
    assert kept.all().tolist() == values.tolist()
    assert [kept.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 1000, 100_000))
    assert len(tb.EliasFano.of(ends).to_bytes()) * 8 / len(ends) < 2 + np.log2(ends[-1] / len(ends)) + 1
    with pytest.raises(IndexError):
        tb.EliasFano.of(ends).select(len(ends))


@given(st.lists(st.text(alphabet="aé's ll\n\t\xa0  1,!_<|endoftext|>中\x1cſ🙂x×ª\x85\r", max_size=30), max_size=8))
def test_units_give_the_ids_of_whole_texts(texts):
    coder = tb._encoder(PATH)
    whole = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, coder.kind).tolist() for b in coder(texts)] == whole


class _Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_words_are_encoded_many_at_once():
    coder = tb.Encoder(PATH)
    texts = [" ".join(f"{a}{b}{c}x" for c in "abcdefghij") + ",\n" for a in "klmnopqrst" for b in "uvwxyzabcd"]
    whole = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    counted = coder.tokenizer = _Counted(coder.tokenizer)
    assert [np.frombuffer(b, coder.kind).tolist() for b in coder(texts * 3)] == whole * 3
    assert counted.texts < 20  # of 1000 different words
    assert [np.frombuffer(b, coder.kind).tolist() for b in coder(texts)] == whole
    assert counted.texts < 20


@pytest.mark.parametrize("known", [0, 5, 800_000])
@pytest.mark.parametrize("slice_bytes", [1, 40, 8 << 20])
def test_columns_are_encoded_in_slices_with_any_memory_of_units(monkeypatch, known, slice_bytes):
    monkeypatch.setattr(tb, "KNOWN_UNITS", known)
    monkeypatch.setattr(tb, "SLICE_BYTES", slice_bytes)
    coder = tb.Encoder(PATH)
    texts = ["left out", None, "", "One,two 3's\r\nend", "\n", "ab\n\ncd\n \t e ", "", "né×ÿ, À÷! “x” y\u3000z", " ", None, "One <|endoftext|> two\n", "Ã", ""]
    whole = [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kind in (pa.string(), pa.large_string()):
        assert [np.frombuffer(b, coder.kind).tolist() for b in coder(pa.array(texts, kind)[1:])] == whole[1:]
        assert list(coder(pa.array([None, "", None], kind))) == [b""] * 3
        assert list(coder(pa.array([], kind))) == []
    assert len(coder.known) <= known


def test_units_begin_at_spaces_signs_and_lines():
    texts = ["One, two's x1\nthree  four \n", "", "é, \"a\" 中 b"]
    data = [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, data)])
    begins = tb._unit_starts(np.frombuffer(b"".join(data), np.uint8), starts[:-1])
    units = [b"".join(data)[a:b].decode() for a, b in zip(begins[:-1], begins[1:])]
    assert units == ["One", ",", " two", "'s", " x", "1", "\n", "three", "  four", " \n", "é", ",", ' "a"', " 中", " b"]


def test_one_document_is_read_by_select():
    ids = [np.arange(n, dtype="<u2") for n in (3, 1, 500, 2)]
    shard = tb.shard_bytes([4, 9, 9, 30], np.array([3, 1, 500, 2]), b"".join(x.tobytes() for x in ids), 2)
    for i, x in enumerate(ids):
        assert tb.read_document(io.BytesIO(shard), i).tolist() == x.tolist()
    assert tb.read_shard(io.BytesIO(shard))[0] == [4, 9, 9, 30]


def _expected(rows):
    coder, out, start = tb._encoder(PATH).tokenizer, [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(coder.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_ids", [5, 4_000_000])
def test_edges(docs, shard_ids):
    got = [tuple(r) for r in tb.token_binary(docs(EDGES), PATH, shard_ids=shard_ids).collect()]
    assert sorted(got, key=lambda r: r[1]) == _expected(EDGES)


def test_empty_table(docs):
    assert tb.token_binary(docs([]), PATH).collect() == []


def test_whole_table(spark, documents, folder):
    from ledgerloom.llm.queries import QUERIES

    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op1_token_binary"](spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == _expected(rows)
