import random

from quillspark.llm import neardup


def test_rare_shingles_keep_their_weight_in_a_large_corpus(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50_000)]
    shared, *notices = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("r", 794), ("a", 144), ("b", 144)))
    docs = [(i, f"{shared} {notice}") for i, notice in enumerate(notices)]
    for i in range(2, 20_000):
        body = " ".join(rng.choices(words, k=150))
        docs.append((i, f"{body} {notices[i % 2]}" if i % 10 < 2 else body))
    # 790 shared shingles of df 2, and on each side 140 in a tenth of all and 4 of df 1: 0.805.
    rows = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id < 2").collect()
    assert {r["class_id"] for r in rows} == {0} and all(r["linked"] for r in rows)


def test_repeats_of_a_shingle_count_as_often_as_they_occur(spark):
    docs = spark.createDataFrame([(0, "a b c d e " * 8_000), (1, "a b c d e " * 16_000)], "row long, text string")
    own = docs.withColumn("doc_id", docs["row"]).coalesce(1)
    frequencies = neardup.document_frequencies(own, 5)
    nodes = neardup.sign(own, frequencies, 5, 16, 5).select("k1", "k2", "row", "sketch")
    stored = neardup.shingles_of(own, nodes, frequencies, 5).orderBy("row").collect()
    sets = [neardup.np.frombuffer(r["elements"], dtype="<u8") for r in stored]
    assert abs(neardup.weighted_jaccard(*sets) - 0.5) < 0.001


def test_frequencies_are_exact_from_the_least_on(spark):
    docs = [("one two three four five six",)] * 3 + [("one two three four five seven",), (None,), ("",)]
    found = neardup.document_frequencies(spark.createDataFrame(docs, "text string"), 5)
    hashes, counts = neardup.word_hashes([b"one two three four five", b"two three four five six", b"not met before at all"])
    _, values, _ = neardup.shingle_sets(hashes, counts, 5)
    assert (found.n_docs, found.least) == (6, 2)
    assert found.of(values).tolist() == [4, 3, 1]
