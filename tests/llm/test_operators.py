"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties, repeated rows, clashing names."""

import base64
import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import bpe_encode, decontaminate, html_text, language_id, line_dup, near_dup, pii, substring_dup, token_counts, vector_forest
from cairn.llm.shingles import shingle_set

rng = np.random.default_rng(3)
WORDS = [f"w{i}" for i in range(400)]
BASE = [str(x) for x in rng.choice(WORDS, 200)]


def _texts():
    out = [None, "", "  \n ", "one", "Été <|endoftext|> 北京 ok", "x" * 3000, "a b c", "A B c"]
    for edits in (0, 0, 1, 2, 6, 30):
        w = list(BASE)
        for at in rng.choice(200, edits, replace=False):
            w[at] = f"new{at}"
        out.append(" ".join(w))
    out += [" ".join(BASE[60:150]), "zz " + " ".join(BASE[20:75]) + "\nyy", " ".join(str(x) for x in rng.choice(WORDS, 5000))]
    return out


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], "s", i, 1, 2, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[8], (None, TEXTS[8], "en", None, 0, 1, 2, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, key int, label int, k string")


def test_near_duplicates(docs):
    out = near_dup.near_duplicates(docs, shingle=4).collect()
    sets = {i: set(shingle_set(t, 4).tolist()) for i, t in enumerate(TEXTS)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert len(out) == len(TEXTS) + 2
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    assert near_dup.keep_one_of_each(docs).columns == docs.columns


def test_odd_sketch_never_exceeds_the_difference(spark):
    """Sketches of any two sets within a factor of two, folded by the operator's own expression."""
    rows, differ, folded = [], [], 0
    for n, cut, more in ((5, 1, 0), (100, 7, 0), (100, 7, 60), (85, 0, 85), (340, 5, 40), (1000, 5, 900), (4000, 900, 0), (4000, 10, 3900), (20000, 5, 19000)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[cut:], rng.integers(0, 1 << 63, cut + more, dtype=np.uint64))))
        x, y = near_dup.odd_sketch(a), near_dup.odd_sketch(b)
        folded += len(x) != len(y)
        rows += [(len(rows), x.tolist(), y.tolist()), (len(rows) + 1, y.tolist(), x.tolist())]
        differ += [len(np.setxor1d(a, b))] * 2
    assert folded >= 3
    found = {r.i: r.d for r in spark.createDataFrame(rows, "i int, x array<long>, y array<long>").select("i", near_dup.apart("x", "y").alias("d")).collect()}
    assert all(found[i] <= differ[i] for i in found)


def test_thresholds_that_bands_would_miss_are_refused(docs):
    for options in ({"percent": 50}, {"percent": 40, "bands": 200, "rows": 2}, {"rows": 12}):
        with pytest.raises(ValueError):
            near_dup.near_duplicates(docs, **options)


def test_near_duplicates_of_a_large_group(spark):
    """Chains and stars around texts that hundreds share, with other texts in the same buckets."""
    local = np.random.default_rng(12)
    base = [f"c{i}" for i in range(120)]
    texts = []
    for i in range(320):
        w = list(base)
        for at in local.choice(120, int(local.integers(0, 9)), replace=False):
            w[at] = f"n{local.integers(0, 40)}"
        texts.append(" ".join(w))
    sets = [set(shingle_set(t, 4).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, shingle=4).collect()}
    assert got == {i: root(i) for i in range(len(texts))} and len(set(got.values())) > 3


def test_substring(docs):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in enumerate(TEXTS)}
    first = {}
    for i, w in words.items():
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    for r in substring_dup.remove_repeats(docs).where("doc_id is not null").collect():
        w = words[r.doc_id]
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < r.doc_id for p in range(s, s + 50)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring_dup.remove_repeats(docs.limit(0)).count() == 0


def test_substring_repeated_and_null_ids_first(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    for i in (1, None):
        rows = [(i, f"a {passage}"), (i, f"a {passage}" if i else f"c {passage}"), (2, f"b {passage} d"), (5, f"{passage} e")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        out = sorted((r.doc_id or 9, r.n_removed) for r in substring_dup.remove_repeats(docs).collect())
        assert out == ([(1, 0), (1, 0), (2, 60), (5, 60)] if i else [(2, 0), (5, 60), (9, 60), (9, 60)])
        two = sorted((r.doc_id or 9, r.n_removed) for r in substring_dup.remove_repeats(docs.where("doc_id is null or doc_id < 5")).collect())
        assert two == ([(1, 0), (1, 0), (2, 60)] if i else [(2, 0), (9, 60), (9, 60)])


def test_substring_windows_that_repeat_inside_a_document(spark):
    """Documents of few different words: every window stands many times in them."""
    texts = {1: "a b " * 100, 2: "x " * 3 + "a b " * 60 + "y", 3: "z " * 400, 4: "z " * 55, 5: "b a " * 24 + "b c", 6: "q " + "a b " * 25 + "a a " * 40, 7: "a " * 49}
    words = {i: t.split() for i, t in texts.items()}
    rows = [*texts.items(), (None, texts[2]), (None, texts[4])]
    out = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect() if r.doc_id}
    first = {}
    for i, w in words.items():
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    for i, w in words.items():
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for p in range(s, s + 50)}
        assert out[i] == (len(w), len(gone))


def test_bpe_and_counts(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe_encode.VOCABULARY), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe_encode.round_trip(docs).where("doc_id is not null").collect():
        t = TEXTS[r.doc_id] or ""
        ids = np.array(own.encode_ordinary(t), dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = {r.doc_id: bytes(r.data).decode() for r in bpe_encode.decode(bpe_encode.encode(docs)).collect() if r.doc_id is not None}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    library = Tokenizer.from_file(P.path(token_counts.TOKENIZER))
    for r in token_counts.token_counts(docs).where("doc_id is not null").collect():
        t = TEXTS[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
    assert token_counts.token_counts(docs.limit(0)).count() == bpe_encode.round_trip(docs.limit(0)).count() == 0


def test_lines(spark, docs):
    rows = spark.createDataFrame([(1, "a\nb\nc", 0), (2, "x\na\n\nb\ny", 0), (3, "b\nc\nb\nc", 0), (4, None, 0), (5, "", 0), (6, "a", 0)], "doc_id long, text string, key int")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dup.line_runs_removed(rows).collect()}
    assert got == {1: ("a\nb\nc", 3, 0), 2: ("x\ny", 4, 2), 3: ("", 4, 4), 4: (None, 0, 0), 5: ("", 0, 0), 6: ("a", 1, 0)}
    assert line_dup.line_runs_removed(docs).count() == len(TEXTS) + 2 and line_dup.digests(docs.limit(0)).count() == 0


def test_single_long_lines(spark):
    long, other = "all of this text may be used by anyone", "one two three four five six"
    texts = {1: f"a\n{long}\nb", 2: f"c\n  {long}\n\nd", 3: long, 4: f"e\n{other}\nf\n{other}\ng", 5: "a", 6: "h\none two three four five", 7: "one two three four five\ni", 8: f"a\n{long}\nj"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dup.line_runs_removed(rows, long_line=6).collect()}
    assert got == {1: (texts[1], 0), 2: ("c\n\nd", 1), 3: ("", 1), 4: (f"e\n{other}\nf\ng", 1), 5: ("a", 0), 6: (texts[6], 0), 7: (texts[7], 0), 8: ("j", 2)}
    assert not any(r.n_removed for r in line_dup.line_runs_removed(rows.where("doc_id < 8 and doc_id != 4")).collect())
    docs = rows.selectExpr("*", "'en' lang", "'s' source", "length(text) n_chars")
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").where("doc_id in (2, 3)").collect()} == {2: "c\n\nd"}


ITEM = "If the farmer sells 12 baskets to Anna and 30 baskets to Tom at 5 dollars, how much money does the farmer get in all?"


def test_decontaminate(spark):
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short")], "item_id long, text string")
    texts = {
        1: "Filler here. " + ITEM + " More filler.",
        2: "So. " + ITEM.upper(),
        3: "Well. " + ITEM.replace("12", "17").replace("Anna", "Mary"),
        10: ITEM.lower(),
        4: "The farmer sells many things to many people all day.",
        5: None,
        6: "",
    }
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(1, texts[1], 1)], "doc_id long, text string, item int")
    out = decontaminate.contamination(docs, bench).collect()
    assert len(out) == 8 and {r.doc_id: r.contaminated for r in out} == {1: True, 2: True, 3: True, 10: True, 4: False, 5: False, 6: False}
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()) == [4, 5, 6]
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def _found(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["items"] for r in sorted(decontaminate.contamination(docs, bench).collect(), key=lambda r: r.doc_id)]


def test_decontaminate_names_at_sentence_starts(spark):
    item = "Tom has 12 apples and buys 5 more at the shop. Tom then eats 3 of them. How many are left?"
    anna = item.replace("Tom", "Anna")
    texts = [item.replace("12", "17"), anna, "Some words here. " + anna, "Well:\n" + anna, "and, " + anna, "Anna has many apples. Anna eats them at the shop."]
    assert _found(spark, [item], texts) == [[0], [0], [0], [0], [0], []]


def test_decontaminate_short_items(spark):
    items = ["What is the capital city of France?", "What is 12 plus 7?", "is he 6 or 7?"]
    before = ["", "Some words here. ", "Here\n", "and, ", "So: "]
    texts = [b + x + after for x in items for b in before for after in ("", " Then more.")]
    assert _found(spark, items, texts) == [[i] for i in range(3) for _ in range(10)]
    assert _found(spark, items, ["So. What is 13 plus 7?", "So. What was 12 plus 7?"]) == [[], []]


def test_language(spark):
    english, german = "the cat and the dog went over the hill again", "der hund und die katze gehen nicht über den berg"
    rows = [(i, (english, german)[i % 2] + f" {i}", ("en", "de")[i % 2]) for i in range(80)]
    rows += [(100, None, "en"), (101, "123 !?", "de"), (None, english, "en"), (102, german, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert all(out[i].lang_pred == ("en", "de")[i % 2] for i in range(80)) and out[102].lang_pred == "de"
    assert (out[100].lang_pred, out[101].lang_pred, out[100].score) == ("und", "und", 0.0)
    assert any(out[i].held_out for i in range(80)) and all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in language_id.identify(docs.where("lang is null")).collect()} == {"und"}


def test_pii():
    text = "mail a.b+c@x-y.example.org now, 10.0.0.300 or 10.20.30.40, 4111 1111 1111 1111, +49 (30) 1234-567"
    base = pii.base_spans(text)
    assert {k: [text[a:b] for a, b in v] for k, v in base.items()} == {"email": ["a.b+c@x-y.example.org"], "ip": ["10.20.30.40"], "card": ["4111 1111 1111 1111"], "phone": ["+49 (30) 1234-567"]}
    model = pii.train()
    _, added = pii.find("please write to john [at] acme [dot] com today", model)
    assert added and pii.find(None, model) == ({k: [] for k in pii.BASE_KINDS}, [])
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for t in ("a@b.c@d.e", "@@a@b", "x@y.z.", "a@b a@b.c", "..@a.b-"):
        assert pii.emails(t) == [m.span() for m in email.finditer(t)]


def test_html():
    page = "<html><head><title>t</title></head><body><nav><a href=/>x</a></nav><div class=ad>buy, buy, buy</div><article><h1>A &amp; B</h1><p>One,\n two <b>three<br>four</b><p>Five.<div class=comments>nice, one</div></article><footer>f</footer>"
    assert html_text.extract(page) == "A & B\n\nOne, two three four\n\nFive."
    assert html_text.extract(None) == html_text.extract("") == "" and html_text.extract("plain  text") == "plain text"


def test_vectors(spark):
    v = rng.standard_normal((120, 8)).astype(np.float32)
    v[60] = v[50]
    rows = [(i, v[i].tolist(), 1) for i in range(120)] + [(200, None, 1), (250, [0.0] * 8, 1), (300, [float("nan")] * 8, 1)]
    out = vector_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    unit = v.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for q in (0, 50, 100):
        s = unit @ unit[q]
        want = sorted((i for i in range(120) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])] == want
    assert {r.query_id for r in out} == {0, 50, 100}
