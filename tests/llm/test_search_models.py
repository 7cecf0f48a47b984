import math
import random
import re
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from quillspark.llm import lm, neardup, queries, topk
from quillspark.llm.eliasfano import EliasFano, encode


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, universe in ((1, 1), (1, 10), (5, 7), (1000, 10**6), (20000, 25000), (5000, 10**12), (0, 5)):
        v = np.unique(rng.integers(0, universe, n))
        e = EliasFano(encode(v.astype(np.uint64), universe))
        assert (e.get(np.arange(len(v))) == v).all()
        x = rng.integers(0, universe, 2000)
        place, same = e.successor(x)
        assert (place == np.searchsorted(v, x)).all() and (same == np.isin(x, v)).all()


def test_elias_fano_takes_little_memory_beside_its_values():
    v = np.cumsum(np.random.default_rng(1).integers(0, 1 << 30, 200_001))
    tracemalloc.start()
    made = encode(v, int(v[-1]) + 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000  # all bits of all values at once: more than 80 MB
    e = EliasFano(made)
    assert e.width % 8 and (e.get(np.arange(len(v))) == v).all()
    place, same = e.successor(v[1::7] - 1)
    assert (place == np.searchsorted(v, v[1::7] - 1)).all() and (same == np.isin(v[1::7] - 1, v)).all()


def test_parts_written_in_slices_are_the_same(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.createDataFrame([(" ".join(rng.choice("abcdefghijklmnop") for _ in range(30)),) for _ in range(60)], "text string")
    files = []
    for size in (lm.SLICE, 7):
        monkeypatch.setattr(lm, "SLICE", size)
        model = lm.train(docs, part_nodes=100)
        names = sorted(p.name for p in Path(model.path.removeprefix("file://")).iterdir() if p.name.startswith(("level", "back")))
        files.append({n: {k: a.tolist() for k, a in lm.map_arrays(model.path, n).items()} for n in names})
    assert files[0] == files[1] and len(files[0]) > 10


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["<e>"]


def test_language_model_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[: rng.choice((5, 20, 60))]) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "  A b\tA é"]
    test = [*texts[:50], "w1 w2 zz w3", "qq", "", None]
    model = lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), part_nodes=200)
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(list(enumerate(test)), "doc_id long, text string"), model).collect()}
    d, c1, c2, c3 = 0.75, Counter(), Counter(), Counter()
    for t in texts:
        s = tokens(t)
        c1.update(s)
        b = ["<s>", *s]
        c2.update(zip(b, b[1:]))
        c3.update(zip(b, b[1:], b[2:]))
    n, v = sum(c1.values()), len(c1)
    heads = {**c1, "<s>": len(texts)}
    k2, k3 = ({k: x for k, x in c.items() if x >= 2} for c in (c2, c3))

    def back(kept, context, count):
        own = [x for k, x in kept.items() if k[:-1] == context]
        return 1 - (sum(own) - d * len(own)) / count

    def p1(w):
        return (c1[w] + 0.5) / (n + 0.5 * (v + 1))

    def p2(a, w):
        return p1(w) if a not in heads else max(k2.get((a, w), 0) - d, 0) / heads[a] + back(k2, (a,), heads[a]) * p1(w)

    def p3(a, b, w):
        return p2(b, w) if (a, b) not in k2 else max(k3.get((a, b, w), 0) - d, 0) / k2[a, b] + back(k3, (a, b), k2[a, b]) * p2(b, w)

    for i, t in enumerate(test):
        s = tokens(t)
        b = ["<s>", *s]
        want = sum(math.log10(p3(b[j - 2], b[j - 1], b[j]) if j > 1 else p2(b[0], b[1])) for j in range(1, len(b)))
        r = got[i]
        assert (r["n_tokens"], r["n_known"]) == (len(s), sum(w in c1 for w in s))
        assert abs(r["base_score"] - sum(math.log10(p1(w)) for w in s)) < 1e-6
        assert abs(r["score"] - want) <= 0.06 * len(s)  # quantised to one byte


def test_successors_by_pointers(spark):
    model = lm.train(spark.createDataFrame([("a b a c a b a c",)] * 2, "text string"), order=2, part_nodes=2)
    trie = lm.Trie(model)
    a, b, c, end = trie.word_ids(np.array([lm.word_hashes([x], lm.NOT_SPACE)[0][0] for x in (b"a", b"b", b"c")] + [lm.END]))
    assert set(trie.successors(2, int(a))) == {b, c}
    assert set(trie.successors(2, int(c))) == {a, end}


def test_language_model_without_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score(docs, lm.train(docs.limit(0))).collect()
    assert [(r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
    assert lm.score(docs.limit(0), lm.train(docs)).count() == 0


def near_copies():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(800)]
    docs = []
    for base in range(12):
        text = rng.choices(words, k=200)
        for copy in range(6):
            own = list(text)
            if copy:
                own[rng.randrange(200)] = "edited"
            docs.append((len(docs), " ".join(own), base))
    docs += [(len(docs) + i, " ".join(rng.choices(words, k=150)), 100 + i) for i in range(30)]
    return docs


def test_near_duplicates(spark):
    docs = near_copies()
    extra = [(500, docs[0][1].upper() + "!", 0), (501, None, -1), (502, None, -2), (503, "", -3), (504, "one two", -4), (505, "One, two", -4), (None, "unnamed text", -5)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in [*docs, *extra]], "doc_id long, text string, row string, comp int")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert len(got) == len(docs) + len(extra)
    kinds = {}
    for i, _, kind in [*docs, *extra]:
        kinds.setdefault(kind, set()).add(got[i])
    assert all(len(x) == 1 for x in kinds.values())
    assert len({min(x, key=str) for x in kinds.values()}) == len(kinds)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_pairs_that_only_a_chain_connects(spark):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(3000)]
    text = rng.choices(words, k=300)
    docs = []
    for i in range(700):  # one large bucket, each text a little further from the first
        docs.append((i, " ".join(text)))
        text = list(text)
        text[(i * 7) % 300] = f"new{i}"
    got = {r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0}


@pytest.mark.parametrize("blocks", [(4096, 256), (7, 3)])
def test_top_k_against_brute_force(spark, blocks):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 4]) for i in range(120)]
    rows += [(200, None), (250, [1.0, None, 0.0, 0.0, 0.0]), (300, [float("nan")] * 5), (350, [float("inf")] * 5), (400, [0.5] * 3), (401, [0.25] * 3), (None, [1.0] * 5), (50, [0.25] * 5)]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, score string")
    from pyspark.sql import functions as F

    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=blocks[0], query_rows=blocks[1]).collect()
    used = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (i, q) in enumerate(used):
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(used) if m != n and len(v) == len(q))
            want += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:5], 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    grouped = topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=blocks[0], query_rows=1, query_bytes=100).collect()
    assert sorted(map(tuple, grouped)) == sorted(map(tuple, got))  # several groups of queries
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_queries_have_the_contract_columns(spark):
    small = "/root/testdata/sf0.001"
    assert queries.op7_trie_scores(spark, small).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert queries.op9_topk_sorted_lists(spark, small).columns == ["query_id", "rank", "vec_id", "score"]
