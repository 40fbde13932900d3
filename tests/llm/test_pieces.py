import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.llm import pieces
from ledgerloom.llm.queries import QUERIES, vocabulary

from .conftest import EDGES

PATH = vocabulary("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = st.text(alphabet="aeéthings ing  \n\t.,'12中🙂ß", max_size=40)


def agenda(coder, unit, variant):
    """The agenda of one unit, a candidate at a time."""
    import heapq
    import zlib

    mask = (1 << 64) - 1
    score = {p: LIBRARY.get_score(i) for p, i in coder.id_of.items()}
    place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
    parts = [pieces.SPACE if c == " " else "\n" + c if c == pieces.SPACE else c for c in unit]
    key = zlib.crc32(unit.encode(), zlib.crc32(b"%d/%d" % (coder.seed, variant))) if coder.limit else 0
    starts, skipped = list(range(len(parts))), set()
    while True:
        waiting = [(place[score[parts[i] + parts[i + 1]]], starts[i], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in score and (starts[i], parts[i], parts[i + 1]) not in skipped]
        if not waiting:
            break
        rank, start, i = heapq.nsmallest(1, waiting)[0]
        if coder.limit:
            h = (key ^ start * 0x9E3779B1 ^ rank * 0x85EBCA77) * 0xFF51AFD7ED558CCD & mask
            if ((h ^ h >> 29) * 0xC4CEB9FE1A85EC53 & mask) >> 16 & 0xFFFFFFFF < coder.limit:
                skipped.add((start, parts[i], parts[i + 1]))
                continue
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del starts[i + 1]
    return [x for p in parts for x in ([coder.id_of[p]] if p in coder.id_of else [coder.byte_id[b] for b in p.removeprefix("\n" if len(p) > 1 else "").encode()])]


@given(TEXTS)
def test_without_dropout_as_the_library(text):
    coder = pieces._coder(PATH)
    assert coder.encode([text], [0])[0].tolist() == LIBRARY.encode(text)


@given(st.text(max_size=60), st.integers(0, 9))
def test_lossless(text, document):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    coder = pieces._coder(PATH, 0.3, 1, 4)
    assert coder.decode(coder.encode([text], [document])[0]) == text


def test_agendas_side_by_side_as_one_by_one():
    import numpy as np

    coder = pieces.Pieces(PATH, 0.2, 9, 4)
    units = [" things", " thing", "▁▁", " 12", "lleeriest", " aaaaaaaa", "\n", "   ", " é🙂é", " standing", "theretherethere"]
    for variant in range(4):
        packed = coder.segment(units, [variant] * len(units))
        assert [np.frombuffer(b, coder.kind).tolist() for b in packed] == [agenda(coder, u, variant) for u in units]


def test_seed_and_document_vary_the_cut():
    text = "there is nothing so practical as an understanding of things " * 5
    cuts = {tuple(pieces._coder(PATH, 0.3, seed, 4).encode([text], [document])[0].tolist()) for seed in (0, 1) for document in (0, 1, 2)}
    assert len(cuts) == 6
    again = pieces.Pieces(PATH, 0.3, 1, 4).encode([text], [2])[0].tolist()
    assert again == pieces._coder(PATH, 0.3, 1, 4).encode([text], [2])[0].tolist()


def test_edges_and_round_trip(docs):
    coded = pieces.encode(docs(EDGES), PATH, seed=3)
    rows = coded.collect()
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in rows)
    back = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in pieces.decode(coded, PATH).collect())
    assert back == sorted((-1 if d is None else d, t or "") for d, t in EDGES)
    assert pieces.encode(docs([]), PATH).collect() == []


@pytest.mark.parametrize("name", ["op4_pieces"])
def test_whole_table(spark, folder, documents, name):
    coded = QUERIES[name](spark, folder)
    assert coded.where("not lossless").count() == 0 and coded.count() == documents.count()
    texts = pieces.decode(coded, PATH).join(documents.select("doc_id", documents["text"].alias("was")), "doc_id")
    assert texts.where("text <> coalesce(was, '')").count() == 0


def test_roomy_workers_give_the_same_ids(docs):
    rows = docs(EDGES)
    own = lambda **more: sorted((str(r.doc_id), list(r.ids)) for r in pieces.encode(rows, vocabulary("piece_bpe_32k.model"), **more).collect())
    assert own() == own(roomy=True)
