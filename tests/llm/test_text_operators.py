import random

import duckdb
import pytest

from quillspark.llm import decontam, html, langid, licenses, queries, toxicity

DIR = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


def edit_distance_in(pattern, text):
    """The least edit distance of the pattern to any part of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for ch in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != ch), row[i] + 1, new[-1] + 1))
        row, best = new, min(best, new[-1])
    return best


def distances_from_start(pattern, text):
    """The pattern's edit distance to each prefix of the text, the empty one first."""
    row, out = list(range(len(pattern) + 1)), [len(pattern)]
    for ch in text:
        new = [row[0] + 1]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != ch), row[i] + 1, new[-1] + 1))
        row = new
        out.append(new[-1])
    return out


def least_over_word_runs(pattern, text, budget):
    """The least edit distance of the pattern to any run of whole words, or None beyond the budget."""
    if edit_distance_in(pattern, text) > budget:
        return None
    best = budget + 1
    for begin in (i for i in range(len(text)) if i == 0 or text[i - 1] == " "):
        rest = text[begin : begin + len(pattern) + budget]
        for end, d in enumerate(distances_from_start(pattern, rest)):
            if end and text[begin + end : begin + end + 1] in (" ", ""):
                best = min(best, d)
    return best if best <= budget else None


def test_myers_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (20, 60))
        scores = decontam.myers(decontam.bits(p), len(p), t)
        assert min(scores) == edit_distance_in(p, t) and len(scores) == len(t) + 1
        assert decontam.myers(decontam.bits(p), len(p), t, anchored=True) == distances_from_start(p, t)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(8, 25)))) for i in range(12)] + [(98, None), (99, "?!")]
    texts = []
    for i in range(60):
        body = rng.choices(words, k=40)
        if i % 2:
            piece = list(rng.choice(items[:12])[1].upper() + ".")
            for _ in range(rng.randint(0, 8)):
                piece[rng.randrange(len(piece))] = rng.choice("abcxyz")
            if i % 3 == 0:  # at the ends
                piece[0], piece[-2] = "x", "y"
            if i % 5 == 0:
                del piece[-2:]
            body.insert(20, "".join(piece))
        texts.append((i, "  ".join(body)))
    texts += [(900, None), (901, "")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.contaminated(docs, bench, block_chars=500).collect()}
    want = {}
    for i, t in texts:
        for j, item in items[:12]:
            p = decontam.normalise(item)
            if (d := least_over_word_runs(p, decontam.normalise(t), int(len(p) * 0.05))) is not None:
                want[i, j] = d
    assert got == want and len(want) > 5
    clean = decontam.without_matches(docs, bench, block_chars=500)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted({i for i, _ in texts} - {i for i, _ in want})
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0


def test_toxicity_chain(spark):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        body = rng.choices(words, k=30)
        toxic, low = i % 5 == 0, i % 3 == 0
        body += ["nasty"] * toxic + ["spam"] * low
        rows.append((i, " ".join(body), "x"))
        if i < 400:
            labels.append((i, int(not low), int(toxic)))
    labels += [(5, None, 0), (None, 1, 1), (12345, 1, 1)]
    docs = spark.createDataFrame([*rows, (1000, None, "x"), (1001, "", "x")], "doc_id long, text string, toxic string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxic_documents(docs, marks).collect()}
    assert len(got) == 602
    held = [i for i in range(400, 600)]
    assert all((got[i]["p_toxic"] >= 0.5) == (i % 5 == 0) for i in held)
    assert all((got[i]["p_low_quality"] >= 0.5) == (i % 3 == 0) for i in held)
    assert got[1000]["p_toxic"] == got[1001]["p_toxic"] < 0.5
    none = toxicity.toxic_documents(docs, marks.limit(0)).collect()
    assert len(none) == 602 and all(0 <= r["p_toxic"] <= 1 for r in none)
    assert toxicity.toxic_documents(docs.limit(0), marks).count() == 0
    with pytest.raises(ValueError, match="exist"):
        toxicity.toxic_documents(docs.withColumnRenamed("toxic", "p_toxic"), marks)


def test_toxicity_query_finds_labelled_words(spark):
    rows = {r["doc_id"]: r for r in queries.op2_toxicity_chain(spark, SMALL).collect()}
    con = duckdb.connect()
    bad = con.sql(f"SELECT doc_id FROM read_parquet('{SMALL}/documents.parquet') WHERE len(regexp_extract_all(lower(text), '(idiot|moron|scum|stupid|loser)')) >= 4").fetchall()
    clean = con.sql(f"SELECT doc_id FROM read_parquet('{SMALL}/labels.parquet') WHERE toxic = 0").fetchall()
    assert len(bad) > 20 and sum(rows[i]["toxic"] for (i,) in bad) >= 0.9 * len(bad)
    assert sum(rows[i]["toxic"] for (i,) in clean) <= 0.01 * len(clean)


def test_toxicity_chain_learns_both_categories_for_held_out_rows(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    links = toxicity.fit(docs, labels.where("doc_id % 4 <> 1"), toxicity.label_categories())
    held = labels.where("doc_id % 4 = 1").selectExpr("doc_id", "quality = 0 as low", "toxic = 1 as bad")
    rows = toxicity.score(docs.join(held, "doc_id"), links).collect()
    for label, p in (("low", "p_low_quality"), ("bad", "p_toxic")):
        hit = [r[p] >= 0.5 for r in rows if r[label]]
        miss = [r[p] >= 0.5 for r in rows if r[label] is False]
        assert sum(hit) >= 0.8 * len(hit) and sum(miss) <= 0.03 * len(miss)


def test_language_accuracy_on_held_out_rows(spark):
    got = queries.op6_language_id(spark, SMALL).collect()
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM read_parquet('{SMALL}/documents.parquet')").fetchall())
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "le chat", None)], "doc_id long, text string, lang string")
    texts = spark.createDataFrame([(1, "the dogs", "y"), (2, "die hunde", "y"), (3, None, "y"), (4, "", "y"), (5, "12 !? _", "y"), (6, "the " * 500_000, "y")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(texts, langid.fit(train)).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[6] == ("en", 1.0)
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    nothing = langid.predict(texts, langid.fit(train.limit(0))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert langid.predict(texts.limit(0), langid.fit(train)).count() == 0


def test_license_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a\nReleased under THE mit  license!\nb", "x"), (2, None, "x"), (3, "", "x"), (4, licenses.TEXTS["ISC"].replace(" this software", "\nthis software"), "x"), (1, "Licensed under CC BY-NC 4.0.", "x")], "doc_id long, text string, bigram string")
    got = sorted((r["doc_id"], r["kind"], r["segment"], r["licence"], r["dice"]) for r in licenses.scan(docs).where("dice = 1").collect())
    assert got == [(1, "line", 0, "CC-BY-NC-4.0", 1.0), (1, "line", 1, "MIT", 1.0), (4, "paragraph", 0, "ISC", 1.0)]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DIR}/documents.parquet')")
    got = queries.op4_license_scan(spark, DIR)
    columns = sorted(got.columns)
    want = con.sql(licenses.oracle_sql()).select(", ".join(columns)).fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


PAGE = '<html><head><title>t</title><style>p{}</style></head><body><div class="top-menu"><a href=/>Home</a> site</div><div id="cookie-notice">We use cookies, accept them now</div><div id="content"><h2>Title here</h2><p>First long &amp; good   paragraph with many words that go on and on.</p><div class="sidebar"><p>Buy these things now please</p></div><p>Second<br>paragraph with <b>bold</b>\nwords and more, enough to be kept.</p><form><label>Name</label></form><script>var t="</p>";</script><p>Third &#233; paragraph stays.</p></div><section class="comments"><p>a reader comment of many words one two three</p></section><footer>&copy; us</footer></body></html>'


def test_main_text(spark):
    labelled = "<html><body><nav><ul><li><a href=/a>a</a></li><li><a href=/b>b</a></li></ul></nav><article><h1>A title</h1><p>" + "word " * 50 + "</p></article><footer>foot words</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<p"), (5, "u", labelled), (5, "u", labelled)], "page_id long, url string, html string")
    weights = html.fit(pages)
    got = [(r["page_id"], r["text"]) for r in html.extract(pages, weights).collect()]
    want = "Title here\n\nFirst long & good paragraph with many words that go on and on.\n\nSecond paragraph with bold words and more, enough to be kept.\n\nThird é paragraph stays."
    article = "A title\n\n" + " ".join(["word"] * 50)
    assert sorted(got) == [(1, want), (2, ""), (3, ""), (4, ""), (5, article), (5, article)]
    assert html.fit(pages.limit(0)) == html.Weights()
    assert html.extract(pages.limit(0), weights).count() == 0
