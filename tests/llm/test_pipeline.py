"""The pipeline against plain versions of its stages, one after the other."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from cairn.llm import bpe_encode, language_id, line_dup
from cairn.llm.frames import in_slices
from cairn.llm.shingles import shingle_set
from tests.llm.test_decontaminate import held

ENGLISH = "the of and to in that is was for with his they at be this from have or by one had not but what all were when we there can".split()
GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split()
ITEM = "If the farmer sells 12 baskets to Anna and 30 baskets to Tom at 5 dollars, how much money does the farmer get in all?"


def _documents():
    rng = random.Random(6)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    texts = []
    for i in range(40):
        words = (ENGLISH, GERMAN)[i % 2]
        texts.append("\n".join(say(words, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))))
    shared = "all of this text may be used by anyone\nand the other line of it"
    texts += [f"{texts[0]}\n{shared}", f"{shared}\n{texts[3]}", shared, texts[5], texts[5].replace(" and ", " oder ", 1)]
    base = say(ENGLISH, 150).split()
    for edits in (0, 1, 3, 40):
        w = list(base)
        for at in rng.sample(range(150), edits):
            w[at] = f"x{at}"
        texts.append(" ".join(w))
    texts += [say(ENGLISH, 30) + ". " + ITEM, say(ENGLISH, 30) + ". " + ITEM.replace("12", "17").replace("Anna", "Mary"), None, "", "123 !?", "  \n\n ", "the", say(ENGLISH, 12000), f"{ITEM}\n\n{say(GERMAN, 40)}"]
    rows = [(i, t, ("en", "de")[i % 2] if i % 5 else None, f"s{i % 3}", len(t) if t else 0) for i, t in enumerate(texts)]
    rows += [rows[10], rows[42], (None, texts[7], "de", None, len(texts[7])), (None, say(GERMAN, 50), "de", None, 0)]
    return rows


def _lines(rows):
    """(row, text) after removal, by the rule of the operator, for every pair of lines and every long line."""
    order = lambda r: r[0] if r[0] is not None else line_dup.LAST
    filled, first = {}, {}
    for r in rows:
        if r[1] is not None and (order(r), r[1]) not in filled:
            filled[order(r), r[1]] = [(i, x.strip(" ")) for i, x in enumerate(r[1].split("\n")) if x.strip(" ")]
    for key, lines in sorted(filled.items(), key=lambda x: x[0][0]):
        for s in range(len(lines)):
            for k in (1, 2):
                if s + k <= len(lines) and (k == 2 or len(re.findall(r"\S+", lines[s][1])) >= line_dup.LONG_LINE):
                    first.setdefault(tuple(x for _, x in lines[s : s + k]), (key[0], key[1], s))
    out = []
    for r in rows:
        lines = filled.get((order(r), r[1]), [])
        gone = set()
        for s in range(len(lines)):
            for k in (1, 2):
                if (place := first.get(tuple(x for _, x in lines[s : s + k]))) is not None and s + k <= len(lines):
                    if place[0] < order(r) or place[0] == order(r) and place[1] == r[1] and place[2] < s:
                        gone |= set(range(s, s + k))
        if not gone:
            out.append(r)
        elif len(gone) < len(lines):
            every, cut = r[1].split("\n"), set()
            for p in gone:  # blank lines inside a run go with it
                cut.add(lines[p][0])
                if p + 1 in gone:
                    cut |= set(range(lines[p][0], lines[p + 1][0]))
            text = "\n".join(x for i, x in enumerate(every) if i not in cut)
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def _first_of_each(rows):
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets[r[0]] = set(shingle_set(r[1], 5).tolist())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and label[i] < label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[j], changed = label[i], True
    return [r for r in rows if r[0] is None or label[r[0]] == r[0]]


def test_run_equals_plain_stages(spark, tmp_path):
    rows = _documents()
    names = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, names)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    model = language_id.train(docs)
    kept = [r for r in rows if (p := model.predict(r[1]))[0] != "und" and p[1] >= language_id.REJECTED_BELOW]
    assert [r[1] for r in rows if r not in kept and r[1] and re.search("[a-z]{2}.* [a-z]{2}", r[1])] == []
    after = _lines(kept)
    assert sum(len(r[1]) for r in after) < sum(len(r[1]) for r in kept)
    one = _first_of_each(after)
    assert len(one) < len(after)
    clean = [r for r in one if not held(r[1], ITEM)]
    assert len(clean) < len(one)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe_encode.VOCABULARY), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def digest(r):
        ids = np.array(own.encode_ordinary(r[1]), dtype="<u4").tobytes()
        return r[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()

    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(digest, clean), key=repr)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    wide = "doc_id long, text string, lang string, source string, n_chars long, label int, key string, at int, w long, items string, __id int"
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "s", 19, 1, "k", 2, 3, "i", 4), (2, None, None, None, None, 1, "k", 2, 3, "i", 4)], wide)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.drop("__id"), str(tmp_path))
        assert out.columns == docs.columns[:-1], name
        rows = {r.doc_id: r for r in out.collect()}
        assert rows[1][:4] == (1, "the cat and the dog", "en", "s") and (2 in rows) == (name != "language")
        assert stage(spark, docs.limit(0).drop("__id"), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_share_one_kind_of_python_workers(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the cat and the dog {i}", "en", "s", 19) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    environment, refused = spark.sparkContext.environment, []
    monkeypatch.delitem(environment, "PYTHONPATH")
    seen = []
    for name in ("language", "near_copies", "tokens"):
        monkeypatch.delitem(environment, "PYTHONPATH", raising=False)
        with monkeypatch.context() as m:
            m.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: refused.append(name))
            out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
        seen.append(environment.get("PYTHONPATH"))
        assert out.count() == 20
    assert seen[0] and seen == seen[:1] * 3 and not refused


def test_python_objects_are_made_of_few_rows():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(at, at + n))}) for at, n in ((0, 1203), (1203, 0), (1203, 500))]
    out = list(in_slices(iter(batches)))
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(1703)) and max(b.num_rows for b in out) == 500
