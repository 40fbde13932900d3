"""Secrets in texts: all rules run as one automaton over the bytes, a line with a hit is then read exactly.

The automaton of :mod:`.automaton` says in one pass over the bytes which rules can match in which lines.
Only there the rule itself gives the spans, leftmost first and without overlap within a kind.  A line decides
alone, except for rules with ``lines``: a private key goes from its header through the matching end line, or
else through the base64 lines that follow, and is read from the whole text of a document with a header.

Positions are code points, the end is exclusive.  Defined results: a null text is empty and has no span;
repeated rows are each answered; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton
from .learning import blocks
from .ship import session_of


@dataclass(frozen=True)
class Rule:
    """``sieve`` must end somewhere in every line where ``exact`` has a match that is kept."""

    kind: str
    sieve: str
    exact: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0
    base: bool = False
    lines: bool = False


# A header without its end line: what base64 (and encryption headers) follows it, also where line ends are escaped.
_PEM_END = r"(?:[^-]++|-(?!----BEGIN |----END \1PRIVATE KEY-----))*+-----END \1PRIVATE KEY-----"
_PEM_REST = r"(?:\s*(?:Proc-Type|DEK-Info):[^\n]*)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2})*+(?:(?<=[A-Za-z0-9+/]{16})(?:\s|\\[nr])++[A-Za-z0-9+/]{1,15}+={0,2}(?![^\s\\]))?"

# The base rules first, in the order of their kinds, then known forms of credentials.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14}", r"AKIA[A-Z0-9]+", False, 0, 18, True),
    Rule("hex", r"[0-9a-f]{16}", r"[0-9a-f]+", False, 0, 16, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{3}", r"gh[pousr]_[A-Za-z0-9]+", False, 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{3}", r"xox[abprs]-[A-Za-z0-9-]+", False, 0, 24),
    Rule("google", r"AIza[A-Za-z0-9_-]{3}", r"AIza[A-Za-z0-9_-]+", False, 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0, 40),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY", rf"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:{_PEM_END}|{_PEM_REST})", False, 0, 0, False, True),
)


class Scanner:
    """Spans of all rules in many texts at once."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.automaton = Automaton.of([(r.sieve, r.ignore_case) for r in rules])
        self.exact = [re.compile(r.exact, re.ASCII | (re.IGNORECASE if r.ignore_case else 0)) for r in rules]

    def __call__(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end) triples in order."""
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(coded) + b"\n"
        first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        offsets, bits = self.automaton.scan(np.frombuffer(data, np.uint8))
        line_end, line_rules, lines = -1, 0, []
        for offset, rules in zip(offsets.tolist(), bits.tolist(), strict=True):
            if offset > line_end:
                line_end = data.index(b"\n", offset)
                lines.append([data.rfind(b"\n", 0, offset) + 1, line_end, 0])
            lines[-1][2] |= rules
        across: set[tuple[int, int]] = set()
        owners = (np.searchsorted(first, [x[0] for x in lines], side="right") - 1).tolist() if lines else []
        text, at, before = -1, 0, 0
        for (start, end, rules), owner in zip(lines, owners, strict=True):
            line = data[start:end].decode("utf-8", "surrogatepass")
            if owner != text:
                text, at, before = owner, int(first[owner]), 0
            # Code points are counted on from the last line with a hit, so every byte once.
            before += len(data[at:start].decode("utf-8", "surrogatepass"))
            at = start
            for i, rule in enumerate(self.rules):
                if rules >> i & 1 and rule.lines:
                    across.add((owner, i))
                elif rules >> i & 1:
                    for m in self.exact[i].finditer(line):
                        if len(m[rule.group]) >= rule.least:
                            out[owner].append((before + m.start(), i, before + m.end()))
        for owner, i in across:
            out[owner] += [(m.start(), i, m.end()) for m in self.exact[i].finditer(texts[owner]) if len(m[self.rules[i].group]) >= self.rules[i].least]
        for spans in out:
            spans.sort()
        return out


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[i].kind}:{a}:{b}" for a, i, b in spans)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row a document: counts of the base kinds, the checksum of their spans, and all spans."""
    spark = session_of(docs)
    sent = spark.sparkContext.broadcast(Scanner(rules))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        empty = hashlib.sha256(b"").hexdigest()
        kinds = {r.kind: i for i, r in enumerate(rules)}
        for block in blocks(batches):
            names, texts = (c.to_pylist() for c in block.columns)
            found = scanner(texts)
            columns = [names, [], [], [], [], []]
            for spans in found:
                base = [s for s in spans if rules[s[1]].base]
                for column, kind in zip(columns[1:4], ("assign", "access", "hex"), strict=True):
                    column.append(sum(s[1] == kinds.get(kind) for s in base))
                columns[4].append(hashlib.sha256(_joined(base, rules).encode()).hexdigest() if base else empty)
                columns[5].append(_joined(spans, rules))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _OUT.types, strict=True)], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of every rule replaced by ``mark``; null texts stay null.

    A column ``n_chars`` is counted again where the text has changed.
    """
    spark = session_of(docs)
    sent = spark.sparkContext.broadcast(Scanner(rules))
    schema, at = docs.schema, docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        for block in blocks(batches, at):
            texts = block.column(at).to_pylist()
            columns = block.columns
            sizes = columns[counted].to_pylist() if counted is not None else []
            for i, spans in enumerate(scanner(texts)):
                if spans:
                    texts[i] = _cut(texts[i], spans, mark)
                    if counted is not None:
                        sizes[i] = len(texts[i])
            if counted is not None:
                columns[counted] = pa.array(sizes, columns[counted].type)
            columns[at] = pa.array(texts, block.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=block.schema)

    return docs.mapInArrow(scan, schema)


def _cut(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]
