"""Operators that SQL cannot express, held against plain versions of the same rule."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import html, langid, licenses, neardup, tokenstore, topk, toxicity
from quillspark.llm.queries import tokenizer_path


def shingles(text):
    words = text.lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) > 4 else Counter([tuple(words)])


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(40, 200))) for _ in range(120)]
    for base in range(40):
        for _ in range(rng.randint(1, 4)):
            own = texts[base].split()
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    texts += [texts[0]] * 50
    sets = [shingles(t) for t in texts]
    df = Counter(s for one in sets for s in one)
    scale = -math.log(neardup.RARE)
    weight = {s: 1 + min(math.log(len(texts) / n), scale) / scale for s, n in df.items()}

    def similarity(a, b):
        both = sum(weight[s] * min(n, b[s]) for s, n in a.items() if s in b)
        return both / (sum(weight[s] * n for s, n in a.items()) + sum(weight[s] * n for s, n in b.items()) - both)

    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    rows = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert len(rows) == len(texts)
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.98 * len(pairs)
    assert all(root(i) == root(c) for i, c in got.items())  # nothing joined that no chain of pairs joins


def test_chain_against_its_formula(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        docs.append((i, " ".join(rng.choices(words, k=20) + (["vile", "nasty"] if bad and rng.random() < 0.9 else [])) + (" !!! ???" if i % 3 == 0 else "")))
        labels.append((i, int(i % 3 != 0), int(bad)))
    docs += [(400, docs[0][1]), (401, None), (402, "")]
    labels += [(400, 1, 0), (400, 1, 1), (999, 0, 1), (None, 1, 1)]
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    links = toxicity.fit(frame, marks, toxicity.label_categories())
    assert links == toxicity.fit(frame.repartition(3), marks.orderBy(F.desc("doc_id")), toxicity.label_categories())
    for r in toxicity.score(frame, links).collect():
        text = (r["text"] or "").lower()
        found, earlier = toxicity.WORD.findall(text), []
        for link in links:
            s = link.blank if not text else link.bias + float(np.dot(link.measures, toxicity.measures(text, found)))
            s += sum(link.words.get(w, 0) for w in set(found)) + float(np.dot(link.earlier, earlier))
            earlier.append(1 / (1 + math.exp(-max(-40, min(40, s)))))
        assert [r["p_low_quality"], r["p_toxic"]] == pytest.approx(earlier)


def test_words_without_a_fold_ignore_its_labels(spark):
    rng = random.Random(5)
    rows = [(f % 5, int(bad), w) for f in range(400) for bad in [rng.random() < 0.4] for w in (f"a{f % 7}", "bad" if bad and rng.random() < 0.8 else "good")]
    exploded = spark.createDataFrame(rows, "fold int, c0 int, word string")
    sample = spark.createDataFrame([r[:2] for r in rows[::2]], "fold int, c0 int")
    flip = F.when(F.col("fold") == 2, 1 - F.col("c0")).otherwise(F.col("c0"))
    one = toxicity.telling_words(exploded, sample, ["c0"], 10, 5)
    two = toxicity.telling_words(exploded.withColumn("c0", flip), sample.withColumn("c0", flip), ["c0"], 10, 5)
    assert one[0][3] == two[0][3] == ["bad"] and len(one[0]) == 6


def test_language_scores_against_the_tables(spark):
    rng = random.Random(8)
    lexicon = {x: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(80)] for x, a in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "ghaei"))}
    docs = [(i, " ".join(rng.choices(lexicon[x], k=8)), x) for i in range(90) for x in [["aa", "bb", "cc"][i % 3]]]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    texts = [" ".join(rng.choices(lexicon["aa"] + lexicon["bb"], k=4) + ["".join(rng.choice("abcdefghi") for _ in range(5))]) for _ in range(40)]
    texts += ["²", "½ Ⅷ ①", "12 !?", "", None, "x² abc", "ABC abc"]
    for text, r in zip(texts, langid.predict(spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1), model).orderBy("id").collect(), strict=True):
        words = ["".join(c) for c in "".join(x if x.isalpha() else " " for x in (text or "").lower()).split()]
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = np.zeros(3)
        for w in words:
            if w in model.words:
                total += model.word_rows[model.words[w]]
                continue
            marked = f"\x02{w}\x03"
            for n in range(4, 0, -1):
                known = [model.grams[g] for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g in model.grams]
                if known:
                    total += np.mean([model.gram_rows[g] for g in known], axis=0)
                    break
        p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert r["lang_pred"] == model.languages[int(p.argmax())] and r["score"] == pytest.approx(p.max())


def test_a_large_language_keeps_no_small_one_out(spark):
    docs = [(i, f"big{chr(97 + i % 26)}{chr(97 + i // 26)} common", "xx") for i in range(300)] + [(1000 + i, "rara avis", "yy") for i in range(3)]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), max_words=5, max_grams=50)
    assert {"rara", "avis", "common"} <= set(model.words)


def naive_region(page, weights):
    """The first interval of events with the highest sum, by all intervals."""
    scores = []
    for kind, value, never, _ in html.events(page):
        if kind == "break" or never:
            scores.append(0.0)
        elif kind == "tag":
            scores.append(weights.tags.get(value, weights.tags.get(value.partition(".")[0], weights.other)))
        else:
            scores.append(weights.word * len(html.references.unescape(value).split()))
    return max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0.0), scores


def test_region_has_the_highest_sum():
    rng = random.Random(2)
    for _ in range(60):
        parts = [rng.choice(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<li>", " one two ", " three ", " four five six seven ", "<br>", " &amp; x "]) for _ in range(30)]
        page, weights = "".join(parts), html.Weights(1.0, {"b": -0.2, "/b": -0.2, "p": -0.5, "/p": -0.5}, -1.3)
        best, _ = naive_region(page, weights)
        words = sum(len(x.split()) for x in html.region(page, weights).split("\n\n"))
        assert (best > 0) == (words > 0) and words * weights.word >= best - 1e-9


@pytest.mark.parametrize(("page", "text"), [
    ("<article><p>one</p><p><a title=it's>two</a> more</p><p>three</p></article>", "one\n\ntwo more\n\nthree"),
    ('<article><p title="odd>one two</p><p>three</p></article>', "one two\n\nthree"),
    ("<article><p>a&<b>amp;</b> c</p></article>", "a&amp; c"),
    ("<article><p>x &lt;b&gt;&nbsp; &amp;amp; y</p></article>", "x <b> &amp; y"),
    ('<div class="post related"><p>one two three four five six</p></div>', "one two three four five six"),
    ('<div class="content share"><p>one two three four five six</p></div><div class="related posts"><p>no</p></div>', "one two three four five six"),
    ("<p></p>", ""), ("", ""), ("plain", "plain"),
])
def test_odd_markup(page, text):
    assert html.region(page, html.Weights()) == text


def test_extract_refuses_a_clash_and_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, "<p>a b c d</p>", "kept")] * 2 + [(2, None, None)], "page_id long, html string, text string")
    with pytest.raises(ValueError, match="exists"):
        html.extract(pages, html.Weights())
    rows = html.extract(pages, html.Weights(), name="main").orderBy("page_id").collect()
    assert [(r["page_id"], r["text"], r["main"]) for r in rows] == [(1, "kept", "a b c d")] * 2 + [(2, None, "")]


def test_licences_padded_or_whole(spark):
    padded = "\n".join(licenses.TEXTS["ISC"].replace(" ", " " + "-" * 900 + " ").split(" this "))
    whole = "MIT License\n\nCopyright (c) 2020 Ada\n\n" + licenses.WHOLE_TEXTS["MIT"].replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    got = licenses.scan(spark.createDataFrame([(1, padded.replace("\n", " this\n")), (2, whole), (None, None)], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["kind"], r["licence"]) for r in got} >= {(1, "paragraph", "ISC"), (2, "text", "MIT"), (2, "line", "MIT")}


def test_width_of_ids_is_checked(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="width"):
        tokenstore.write_store(docs, tokenizer_path(), end_id=1 << 16)


def test_sorted_lists_are_not_read_to_the_end():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(3000, 4)).round(2) * 256 // 1
    lists = topk.Lists(np.arange(3000).tobytes(), (np.arange(3000) * 2).tobytes(), m.astype(np.float64).tobytes(), 4)
    for i in range(20):
        hits, read = topk.best(lists, i, m[i], 5)
        scores = m @ m[i]
        scores[i] = -np.inf
        order = np.lexsort((np.arange(3000), -scores))[:5]
        assert hits == [(int(c), int(scores[c])) for c in order]
        assert read < 3000 * 4
        again, _ = topk.best(lists, i, m[i], 5, sure=hits[-1][1])
        assert again[: len(hits)] == hits
