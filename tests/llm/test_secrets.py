import hashlib
import random
import re
import time

from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.llm import secrets
from ledgerloom.llm.automaton import Automaton
from ledgerloom.llm.queries import QUERIES

from .conftest import EDGES

SCANNER = secrets.Scanner()
PARTS = ["token", "secret", "PassWord", "api_key", "apikey", " ", "=", ":", "'", '"', "abc", "0123456789abcdef", "AKIA", "ABCDEFGHIJKL", "é", "\n", "ghp_", "xoxb-", "eyJ", ".", "-----BEGIN RSA PRIVATE KEY-----", *"abf09AZ_-/+ſK"]


def plain(text):
    """Spans by the rules alone."""
    out = []
    for i, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.exact, text or "", re.ASCII | (re.IGNORECASE if rule.ignore_case else 0)):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def test_random_texts_as_the_rules_alone():
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert SCANNER(texts) == [plain(t) for t in texts]
    assert sum(map(len, SCANNER(texts))) > 1000


@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join))
def test_one_text(text):
    assert SCANNER([text]) == [plain(text)]


def test_a_span_across_lanes_is_found():
    text = "x " * 700 + "token = " + "Q" * 5000 + " y" * 700
    assert SCANNER([text, None, ""]) == [plain(text), [], []]


def test_minimal_automaton():
    made = Automaton.of([("a(b|c)*d{2}", False)])
    assert made.states == 4
    import numpy as np

    data = np.frombuffer(b"xabcbddabdxadd", np.uint8)
    assert made.scan(data, lane=3)[0].tolist() == [6, 13]


def digest(text):
    spans = [s for s in plain(text) if secrets.RULES[s[1]].base]
    kinds = [sum(s[1] == k for s in spans) for k in range(3)]
    join = lambda x: ",".join(f"{secrets.RULES[i].kind}:{a}:{b}" for a, i, b in x)
    return (*kinds, hashlib.sha256(join(spans).encode()).hexdigest(), join(plain(text)))


def test_edges(docs):
    rows = [*EDGES, (20, 'é token="abcdefghijkl" 0123456789abcdef'), (21, "secret: " * 3 + "x" * 12)]
    got = sorted((tuple(r) for r in secrets.find_secrets(docs(rows)).collect()), key=repr)
    assert got == sorted([(d, *digest(t)) for d, t in rows], key=repr)
    assert secrets.find_secrets(docs([])).collect() == []


def test_redaction(docs):
    rows = [(1, "a token = abcdefghijkl b 0123456789abcdef0 c"), (2, None), (3, "clean")]
    out = {r.doc_id: r for r in secrets.redact(docs(rows)).collect()}
    assert out[1].text == "a [secret] b [secret] c" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "clean" and out[3].score == 0.5


def test_redaction_of_private_keys(docs):
    rng = random.Random(6)
    body = ["".join(rng.choice("ABCdef0189+/") for _ in range(64)) for _ in range(12)] + ["Qx7+abc/9g=="]
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    whole, cut = "\n".join([head, *body, end]), "\n".join([head, "Proc-Type: 4,ENCRYPTED", "", *body])
    rows = [(1, f"é before\n{whole}\nafter"), (2, f"a\n{cut}\nplain words follow"), (3, "k = '" + whole.replace("\n", "\\n") + "';"), (4, f"x {head}\r\n" + "\r\n".join(body)), (5, f"{whole}\n{cut}\n{whole}"), (6, f"the line {head} starts a key")]
    out = {r.doc_id: r.text for r in secrets.redact(docs(rows)).collect()}
    assert out[1] == "é before\n[secret]\nafter" and out[2] == "a\n[secret]\nplain words follow"
    assert out[3] == "k = '[secret]';" and out[4] == "x [secret]" and out[5] == "[secret]\n[secret]\n[secret]"
    assert out[6] == "the line [secret] starts a key"


def test_whole_table(spark, folder, documents):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_secrets"](spark, folder).collect()}
    assert got == {r.doc_id: digest(r.text) for r in documents.select("doc_id", "text").collect()}


def test_a_long_text_with_a_hit_in_every_line():
    """Places are counted once: twice the text takes about twice the time, and spans are those of the rules alone."""
    line = "é token = abcdefghijkl0123456789 🙂 and more words\n"
    scanner, took = SCANNER, []
    for n in (4000, 16000):
        began = time.perf_counter()
        spans = scanner([line * n])[0]
        took.append(time.perf_counter() - began)
        assert len(spans) == n and [s[0] for s in spans[:3]] == [len(line) * k + spans[0][0] for k in range(3)]
        assert (spans[-1][0], spans[-1][2]) == (spans[0][0] + len(line) * (n - 1), spans[0][2] + len(line) * (n - 1))
    assert took[1] < 10 * took[0]
