"""SentencePiece encoding with merge dropout keyed by a seed, and its lossless decoding.

A text is cut into units that no piece of the vocabulary crosses.  In a unit the candidate merges wait in an
agenda, best score first and leftmost among equals; a candidate that is taken up is skipped with probability
``dropout``, as a hash of the seed, the variant, the unit, the place and the piece says.  A skipped candidate
comes back only if a neighbour changes.  Each occurrence of a unit gets one of ``variants`` variants by a
hash of seed, document and place, so a text is cut in the same way wherever and whenever it is encoded, and
units met before need not be worked out again.  Without dropout the ids are those of the library.

Characters outside the vocabulary become byte pieces, and so does the sign that stands for a space when it is
itself in a text; decoding gives back exactly the text.

Defined results: a null text is empty; an empty text has no ids; repeated rows are each answered, alike if
their id is alike; a null id counts as one more id; an empty table gives no row; other columns are not
looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import blocks
from .ship import session_of

SPACE = "▁"
_LETTER, _SIGN = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-@\[-`{-~"
_UNIT = re.compile(rf"\n| *[{_LETTER}]+(?=[ \n{_SIGN}]|\Z)| *[^ \n]+| +")
_CROSSED = re.compile(rf"[^{SPACE}]{SPACE}|\n|[{_LETTER}][{_SIGN}]")
#: Units whose ids a worker remembers while a task lasts, some thirty megabytes.
KNOWN_UNITS = 100_000
#: The same for a worker that has room for it; it also remembers them between tasks.  Some two hundred megabytes.
MANY_UNITS = 600_000
LONG_UNIT = 32


class Pieces:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, dropout: float = 0.0, seed: int = 0, variants: int = 8, remembered: int = KNOWN_UNITS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id_of = {model.id_to_piece(i): i for i in plain}
        # Places in the agenda: 0 is the best score; equal scores share a place.
        place = {x: k for k, x in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        # Every way to make a piece of two others, sorted by (left, right).
        made = sorted((self.id_of[p[:k]] << 32 | self.id_of[p[k:]], place[model.get_score(i)], i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of)
        self.pair, self.rank, self.joined = (np.array(column, dtype=np.int64) for column in zip(*made, strict=True))
        self.char_id = np.full(0x110000, -1, dtype=np.int64)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.char_id[32], self.char_id[ord(SPACE)] = self.id_of.get(SPACE, -1), -1
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = [b""] * len(ids)
        for p, i in self.id_of.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_id):
            self.bytes_of[i] = bytes([b])
        self.kind = "<u2" if len(ids) <= 1 << 16 else "<u4"
        self.whole = any(_CROSSED.search(p) for p in self.id_of)
        self.limit, self.seed = int(dropout * (1 << 32)), seed
        self.variants, self.remembered = variants if dropout else 1, remembered
        self.known: list[dict[str, bytes]] = [{} for _ in range(self.variants)]

    def _candidates(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where in the table of pairs the two pieces are, or -1."""
        key = np.where((left < 0) | (right < 0), -1, left << 32 | right)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, at, -1)

    def segment(self, units: list[str], variants: list[int]) -> list[bytes]:
        """Ids of many units, packed; the agendas of all units are worked off side by side, a step a round."""
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(units)), sizes)
        place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        piece = self.char_id[code]
        keys = np.array([zlib.crc32(u.encode("utf-8", "surrogatepass"), zlib.crc32(b"%d/%d" % (self.seed, v))) for u, v in zip(units, variants, strict=True)] if self.limit else [0] * len(units), dtype=np.uint64)
        done: list[tuple] = []
        never = len(self.pair)

        def ranks(at: np.ndarray) -> np.ndarray:
            """Place in the table of the pair that starts at these symbols; ``never`` if there is none."""
            after = np.minimum(at + 1, len(piece) - 1)
            found = self._candidates(piece[at], np.where((at + 1 < len(piece)) & (owner[after] == owner[at]), piece[after], -1))
            return np.where(found < 0, never, found)

        pair = ranks(np.arange(len(piece))) if len(piece) else np.zeros(0, np.int64)
        order = np.append(self.rank, np.iinfo(np.int64).max)
        while len(piece):
            # The candidate each unit takes up: best rank, leftmost among equals.
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            rank = order[pair]
            best = np.minimum.reduceat(rank, first)
            if (best == order[-1]).any():
                spent = np.repeat(best == order[-1], np.diff(np.append(first, len(piece))))
                done.append((owner[spent], place[spent], piece[spent], code[spent]))
                owner, place, piece, code, pair = (x[~spent] for x in (owner, place, piece, code, pair))
                continue
            hit = np.flatnonzero(rank == np.repeat(best, np.diff(np.append(first, len(piece)))))
            hit = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])]
            if self.limit:
                h = (keys[owner[hit]] ^ place[hit].astype(np.uint64) * np.uint64(0x9E3779B1) ^ rank[hit].astype(np.uint64) * np.uint64(0x85EBCA77)) * np.uint64(0xFF51AFD7ED558CCD)
                h = ((h ^ h >> np.uint64(29)) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(16)) & np.uint64(0xFFFFFFFF)
                skipped = h < self.limit
                pair[hit[skipped]] = never
                hit = hit[~skipped]
                if not len(hit):
                    continue
            piece[hit] = self.joined[pair[hit]]
            stays = np.ones(len(piece), dtype=bool)
            stays[hit + 1] = False
            hit -= np.arange(len(hit))  # one symbol has gone before each later one
            owner, place, piece, code, pair = (x[stays] for x in (owner, place, piece, code, pair))
            near = np.concatenate([hit, hit[hit > 0] - 1])
            near = near[np.isin(near, hit) | (owner[near] == owner[np.minimum(near + 1, len(owner) - 1)])]
            pair[near] = ranks(near)
        return self._collected(done, len(units))

    def _collected(self, done: list[tuple], n: int) -> list[bytes]:
        """Symbols of finished units in order, characters without a piece as bytes."""
        if not done:
            return [b""] * n
        owner, place, piece, code = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((place, owner))
        owner, piece, code = owner[order], piece[order], code[order]
        if (piece < 0).any():
            spelt = [[self.byte_id[b] for b in chr(c).encode("utf-8", "surrogatepass")] if p < 0 else [p] for p, c in zip(piece.tolist(), code.tolist(), strict=True)]
            owner = np.repeat(owner, [len(x) for x in spelt])
            piece = np.array([i for x in spelt for i in x], dtype=np.int64)
        data = piece.astype(self.kind).tobytes()
        ends = (np.searchsorted(owner, np.arange(n + 1)) * np.dtype(self.kind).itemsize).tolist()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: list[str], documents: list[int]) -> list[np.ndarray]:
        """Ids of texts; a document's number and the seed choose the variants of its units."""
        known, cut = self.known, []
        fresh: set[tuple[str, int]] = set()
        for text, document in zip(texts, documents, strict=True):
            units = ([" " + text] if self.whole else _UNIT.findall(" " + text)) if text else []
            chosen = (_spread(self.seed, document, len(units)) % np.uint64(self.variants)).tolist()
            fresh.update([(u, v) for u, v in zip(units, chosen, strict=True) if u not in known[v]])
            cut.append((units, chosen))
        todo = list(fresh)
        packed = self.segment([u for u, _ in todo], [v for _, v in todo])
        held: list[dict[str, bytes]] = [{} for _ in range(self.variants)]
        room = self.remembered - sum(map(len, known))
        for k, ((u, v), ids) in enumerate(zip(todo, packed, strict=True)):
            (known if k < room and len(u) <= LONG_UNIT else held)[v][u] = ids
        if any(held):
            data = [b"".join([own[u] if u in (own := known[v]) else held[v][u] for u, v in zip(*both, strict=True)]) for both in cut]
        else:
            data = [b"".join([known[v][u] for u, v in zip(*both, strict=True)]) for both in cut]
        return [np.frombuffer(d, dtype=self.kind).astype(np.int32) for d in data]

    def forget(self) -> None:
        for known in self.known:
            known.clear()

    def decode(self, ids) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return data[1:].decode("utf-8", "surrogatepass")


def _spread(seed: int, document: int, n: int) -> np.ndarray:
    first = (seed * 0x9E3779B97F4A7C15 + document * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF
    h = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(first)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


_coders: dict[tuple, Pieces] = {}
_OUT = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.list_(pa.int32())), ("lossless", pa.bool_())])


def _coder(*key) -> Pieces:
    if key not in _coders:
        _coders[key] = Pieces(*key)
    return _coders[key]


def encode(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 0, variants: int = 8, roomy: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids, lossless) of every row; every row is decoded again and compared.

    ``roomy`` is for jobs that do nothing else: workers remember more units, and take more text at once.
    """
    session_of(docs)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, dropout, seed, variants, MANY_UNITS if roomy else KNOWN_UNITS)
        for block in blocks(batches, size=1 << (22 if roomy else 20)):
            names, texts = (c.to_pylist() for c in block.columns)
            ids = coder.encode([t or "" for t in texts], [-1 if d is None else d for d in names])
            same = [coder.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]
            sizes = np.array([len(i) for i in ids], dtype=np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(sizes), lists.cast(_OUT.types[2]), pa.array(same)], schema=_OUT)
        if not roomy:
            coder.forget()  # the worker goes on to other work

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(apply, "doc_id long, n_pieces long, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of ``encoded(doc_id, ids)``; null ids are an empty text."""
    session_of(encoded)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            texts = [coder.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(apply, "doc_id long, text string")
