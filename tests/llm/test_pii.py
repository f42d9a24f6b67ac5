"""Base spans against the plain patterns, the decoder against all labellings and whole texts, quality on unseen forms, table cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from cairn.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        spans = []
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                spans.append(m.span())
        out[kind] = spans
    return out


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(2)
    pieces = ["1", "4111111111111111", "12", "255", "256", ".", "..", "-", " ", "+", "(", ")", "@", "a", "b.c", "x-y", "%", "_", "é", "٣", "4111 1111 1111 1111", "+49 30 123", "10.0.0.1", "a@b.cd", "\n", "00", "7992739871300000"]
    for _ in range(20000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == plain(text), text


@pytest.fixture(scope="module")
def model():
    return pii.train()


def test_decoder_finds_the_best_labelling(model):
    """Scores of all labellings of short texts: none is above that of the labelling found."""
    rng, outside = random.Random(3), len(pii.KINDS)
    for _ in range(150):
        text = pii._generated(rng)[0]
        tokens = pii.tokenise(text, 0, len(text))[:14]
        lattice = pii.candidates(text, tokens)

        def best(at, label):
            if at == len(tokens):
                return 0.0
            out = model.between[label, outside] + best(at + 1, outside)
            for end, active in lattice[at].items():
                scores = model.weights[active].sum(axis=0) + pii.possible(active)
                for kind in range(outside):
                    if scores[kind] > -1e6:
                        out = max(out, model.between[label, kind] + scores[kind] + best(end, kind))
            return out

        found, at, label = 0.0, 0, outside
        for kind, i, j in model.segments(text, tokens):
            for _ in range(at, i):
                found, label = found + model.between[label, outside], outside
            found += model.between[label, kind] + model.weights[lattice[i][j]][:, kind].sum()
            at, label = j, kind
        for _ in range(at, len(tokens)):
            found, label = found + model.between[label, outside], outside
        assert found == pytest.approx(best(0, outside), abs=1e-9)


def test_stretches_give_the_spans_of_the_whole_text(model):
    rng = random.Random(5)
    for n in range(60):
        words = [rng.choice(("lorem", "ipsum", "x" * 90, "a.b-c/d_e" * 30, "et,", "dolor")) for _ in range(rng.randint(0, 60))]
        parts = [pii._generated(rng)[0] for _ in range(3)]
        text = " ".join([*words, parts[0], *words, *words, parts[1], "y" * (5000 if n % 7 == 0 else 1) + "7" * 3, *words, parts[2]])
        tokens = pii.tokenise(text, 0, len(text))
        whole = [(pii.KINDS[y], tokens[i][0], tokens[j - 1][1]) for y, i, j in model.segments(text, tokens)]
        assert pii.crf_spans(text, model) == whole


def unseen(rng):
    """A sentence of other forms than the training sentences, with its spans."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    name = lambda: rng.choice(("miller", "anna", "jo", "smith", "kowalski", "garcia", "lee"))
    card = "5" + digits(14)
    card += next(x for x in "0123456789" if pii.luhn(card + x))
    wrong = card[:-1] + str((int(card[-1]) + 3) % 10)
    forms = [
        ("write to {} today", f"{name()} (at) {name()} (dot) org", "email"),
        ("reach me under {} or so", f"{name()}_{name()} [at] host{digits(1)} [dot] net", "email"),
        ("my mailbox: {}", f"{name()}.{name()}@{name()}-mail.co.uk", "email"),
        ("logged in from {} at night", f"192.168.{rng.randint(0, 255)}.{rng.randint(0, 255)}", "ip"),
        ("pay with {} please", "-".join(card[k : k + 4] for k in range(0, 16, 4)), "card"),
        ("the number {} was charged", card, "card"),
        ("order number {} is late", wrong, ""),
        ("mobile {} after six", f"({rng.randint(201, 989)}) {digits(3)}-{digits(4)}", "phone"),
        ("fax {} is dead", f"{rng.randint(201, 989)}-{digits(3)}-{digits(4)}", "phone"),
        ("dial {} now", f"+44 20 {digits(4)} {digits(4)}", "phone"),
        ("export API_TOKEN={} first", pick("0123456789abcdef", 32), "secret"),
        ('secret: "{}"', pick("0123456789abcdef", 40), "secret"),
        ("id {} leaked", "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "secret"),
        ("on {} we met", f"{rng.randint(1900, 2030)}-0{rng.randint(1, 9)}-1{digits(1)}", ""),
        ("version {} is out", f"{digits(1)}.{digits(2)}.{digits(1)}", ""),
        ("about {} people", f"{rng.randint(1, 9)},{digits(3)},{digits(3)}", ""),
        ("see us at {} street", f"{digits(3)} main", ""),
        ("pages {} to the end", f"{digits(3)}-{digits(3)}", ""),
    ]
    form, entity, kind = rng.choice(forms)
    before = form.index("{}")
    return form.replace("{}", entity), (kind, before, before + len(entity)) if kind else None


def quality(model, sentences=1500, seed=11):
    """{kind: (precision, recall)} over all spans, base ones included."""
    rng, right, said, true = random.Random(seed), {}, {}, {}
    for _ in range(sentences):
        text, want = unseen(rng)
        base, added = pii.find(text, model)
        got = {(k, a, b) for k, spans in base.items() for a, b in spans} | set(added)
        if want:
            true[want[0]] = true.get(want[0], 0) + 1
            right[want[0]] = right.get(want[0], 0) + (want in got)
        for k, _, _ in got:
            said[k] = said.get(k, 0) + 1
    return {k: (right.get(k, 0) / max(1, said.get(k, 0)), right.get(k, 0) / true[k]) for k in true}


def test_quality_on_unseen_forms(model):
    found = quality(model)
    assert set(found) == set(pii.KINDS)
    for kind, (precision, recall) in found.items():
        assert precision >= 0.9 and recall >= 0.8, (kind, precision, recall)


def test_added_cards_have_a_valid_checksum(model):
    rng = random.Random(9)
    for _ in range(2000):
        number = "".join(rng.choice("0123456789") for _ in range(16))
        base, added = pii.find(f"order {number} card {number[:4]} {number[4:8]} {number[8:12]} {number[12:]}", model)
        assert bool(base["card"]) == pii.luhn(number) or not pii.luhn(number)
        assert all(k != "card" for k, _, _ in added) or pii.luhn(number)


def test_cases_of_documents(spark, model):
    long = "filler " * 40000 + "mail a.b@c.de end " + "filler " * 40000
    texts = {1: "mail a.b@c.de, 10.1.2.3", 2: None, 3: "", 4: "nothing here", 5: long, 6: "x" * 300000 + " +49 30 1234567"}
    rows = [(i, t, "base", 9) for i, t in texts.items()] + [(1, texts[1], "base", 9), (None, texts[1], "base", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int")
    out = pii.personal_data(df, model=model)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[1]) == 2 and got[1][0] == got[1][1] and got[None][0][1:] == got[1][0][1:]
    one, empty = got[1][0], hashlib.sha256(b"").hexdigest()
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 0, 0)
    assert one.base_sha256 == hashlib.sha256(b"email:5:13,ip:15:23").hexdigest() and one.spans == "email:5:13,ip:15:23"
    assert all((got[i][0].spans, got[i][0].base_sha256, got[i][0].n_added) == ("", empty, 0) for i in (2, 3, 4))
    at = long.index("a.b@")
    assert got[5][0].spans == f"email:{at}:{at + 8}" and got[6][0].n_phone == 1
    assert pii.personal_data(df.limit(0), model=model).count() == 0
    assert np.isfinite(model.weights).all()
