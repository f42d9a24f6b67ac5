"""Decontamination against a plain version without hashes and joins, and its cases."""

import random
from collections import Counter

import regex
from cairn.llm import decontaminate as D

SLOTS = {D.NUMBER, D.NAME, D.UNIT}


def bare(x):
    return regex.sub(r"^[^\p{L}\p{N}]+", "", x)


def found_words(text):
    return regex.findall(D._WORD, text or "")


def marked(raw):
    def first(x):
        plain = bare(x)
        low = plain.lower()
        return D.NUMBER if regex.match(r"\p{N}", plain) else D._MARK + low if low != plain and plain.upper() != plain else low

    out = []
    for i, x in enumerate(raw):
        low, head = x.lower(), x[0]
        if "0" <= head <= "9":
            out.append(D.NUMBER)
        elif low == x:
            out.append(D.UNIT if i and low in D.UNITS and regex.search(r"\p{N}$", raw[i - 1]) else x if head.lower() != head.upper() else first(x))
        elif head.lower() != head:
            out.append(low if x.upper() == x else D.NAME)
        else:
            out.append(first(x))
    return out


def templates(text):
    m = marked(found_words(text))
    return [y.removeprefix(D._MARK) for y in m], [D.NAME if y.startswith(D._MARK) else y for y in m]


def held(text, item):
    """In how many windows a text holds an item."""
    raw, iraw = ([bare(x) for x in found_words(t)] for t in (text, item))
    n = len(iraw)
    k = min(n, D.WINDOW)
    if not n:
        return 0
    own = templates(text)[1]
    plain = sum(y not in SLOTS for y in marked(found_words(item))) < D.LITERAL
    if plain:
        low, ilow = [x.lower() for x in raw], [x.lower() for x in iraw]
        hits = {(at, at - i) for at in range(len(low) - k + 1) for i in range(n - k + 1) if low[at : at + k] == ilow[i : i + k]}
    else:
        begun = regex.sub(r"^[^\p{L}\p{N}]+", "", item)
        keys = set()
        for form in (begun[:1].upper() + begun[1:], ". " + begun, (". " + begun).upper(), (". " + begun).lower()):
            m = marked(found_words(form))
            for t in templates(form):
                keys |= {(tuple(t[i : i + k]), i) for i in range(len(t) - k + 1) if any(y not in SLOTS for y in m[i : i + k])}
        hits = {(at, at - i) for at in range(len(own) - k + 1) for w, i in keys if tuple(own[at : at + k]) == w}
    windows = {}
    for at, diagonal in hits:
        windows.setdefault(diagonal, set()).add(at)
    good_places = set()
    for diagonal, ats in windows.items():
        covered = {p for s in ats for p in range(s, s + k)}
        slot = [p for p in covered if own[p] in SLOTS]
        filled = {p: (iraw[p - diagonal], raw[p]) for p in slot}
        meant = {}
        for a in {a for a, _ in filled.values()}:
            votes = Counter(b for x, b in filled.values() if x == a)
            meant[a] = max(votes, key=lambda b: (votes[b], b == a, b))
        odd = {p for p, (a, b) in filled.items() if meant[a] != b}
        good = {s for s in ats if not any(s <= p < s + k for p in odd)}
        kept = {p for s in good for p in range(s, s + k)}
        said = sum(own[p] not in SLOTS for p in kept)
        whole = len(kept) == n and all(a.lower() == b.lower() for a, b in filled.values())
        if good and (whole or not plain and said >= D.LITERAL):
            good_places |= {(diagonal, s) for s in good}
    return len(good_places)


NAMES, THINGS = ["Tom", "Anna", "Élise", "Bo"], ["apples", "km", "litres of milk", "boxes", "red hats"]


def sentence(rng):
    return rng.choice(("{n} has {d} {t} and {n} buys {d} more.", "If {n} sells {d} {t} at {d} euros, what does {n} get?", "Then {n} walks {d} km to the shop.", "How many {t} are left for {n}?", "{d} plus {d} is {d}.", "the price was {d},{d} in all; why")).format(
        n="{n}", d="{d}", t="{t}"
    )


def filled(rng, form):
    for key, some in (("{n}", NAMES), ("{t}", THINGS)):
        while key in form:
            form = form.replace(key, rng.choice(some), 1)
    while "{d}" in form:
        form = form.replace("{d}", str(rng.randint(2, 40)), 1)
    return form


def variant(rng, text):
    for _ in range(rng.randint(0, 3)):
        kind = rng.randrange(6)
        if kind == 0:
            text = text.replace(rng.choice(NAMES), rng.choice(NAMES))
        elif kind == 1:
            text = regex.sub(r"\d+", lambda m: str(rng.randint(2, 40)), text, count=rng.randint(1, 3))
        elif kind == 2:
            text = rng.choice((text.upper(), text.lower(), text.title()))
        elif kind == 3:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice((" oh ", ". ", "", "\n", ", 7 ")) + text[at:]
        elif kind == 4:
            text = rng.choice(("Well: ", "he said ", "\n\n", "Yes. ")) + text + rng.choice((" End.", " and 4 km more", ""))
        else:
            text = text.replace("12", "twelve")
    return text


def test_equals_a_plain_version(spark):
    rng = random.Random(8)
    items = {i: filled(rng, " ".join(sentence(rng) for _ in range(rng.randint(1, 3)))) for i in range(14)}
    items |= {20: "Why?", 21: "12 13 14 15 16 17", 22: "7 km", 23: "Tom Anna Bo", 24: "?!", 25: "What is 12 plus 7?", 26: items[3]}
    texts = {i: variant(rng, rng.choice(list(items.values()))) + " " + variant(rng, filled(rng, sentence(rng))) for i in range(60)}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r for r in D.contamination(docs, bench).collect()}
    some = 0
    for i, text in texts.items():
        want = {j: n for j, item in items.items() if (n := held(text, item))}
        assert (out[i]["items"], out[i].n_windows, out[i].contaminated) == (sorted(want), sum(want.values()), bool(want)), (text, want)
        some += bool(want)
    assert 5 < some


def test_cases_of_documents(spark):
    item = "If the farmer sells 12 baskets to Anna and 30 baskets to Tom at 5 dollars, how much money does the farmer get in all?"
    bench = spark.createDataFrame([(1, item, 0), (2, item, 0), (None, item, 0), (3, None, 0), (4, "", 0), (5, "hm hm", 0)], "item_id long, text string, doc_id int")
    long = "word " * 60000
    texts = [(None, item), (None, "clean"), (1, long + item + " " + long), (2, long), (3, "12 13 14 " * 20000), (4, "well hm hm well"), (4, "well hm hm well"), (5, "hm well hm"), (6, None)]
    docs = spark.createDataFrame([(*t, 1, "i", True) for t in texts], "doc_id long, text string, item int, items string, contaminated boolean")
    out = sorted((r.doc_id if r.doc_id is not None else -1, r.contaminated, tuple(r["items"])) for r in D.contamination(docs, bench).collect())
    assert out == [(-1, False, ()), (-1, True, (1, 2)), (1, True, (1, 2)), (2, False, ()), (3, False, ()), (4, True, (5,)), (4, True, (5,)), (5, False, ()), (6, False, ())]
    kept = D.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 3, 5, 6]
    assert D.contamination(docs.limit(0), bench).count() == 0 and D.keep_clean(docs, bench.limit(0)).count() == len(texts)
