import random
import zlib

import numpy as np
import pytest
import public_tokenizers

from quillspark.llm import encoding, packing, tokenstore
from quillspark.llm.encoding import ChunkEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [" ", "  ", "\n", " \n", "\t", "a", "b's", "é", "1", "<|endoftext|>", "!!", ",", ".", " ", "ñ", "'ll", "²", "\r\n", "　", "😀", "_"]
DOCS = [(3, "the cat sat, on <|endoftext|> the mat."), (1, None), (2, ""), (7, "word " * 3000), (2, "again"), (2, "again"), (None, "no key"), (-5, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in DOCS], "doc_id long, text string, ids string, worker int")


def whole(text):
    return ChunkEncoder(PATH)._library([text or ""])[0]


def test_chunks_encode_like_whole_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    coder = ChunkEncoder(PATH)
    assert coder.encode(texts) == coder._library(texts)
    assert coder.encode([None]) == [b""]


def test_known_words_before_any_punctuation_skip_the_library(monkeypatch):
    coder = ChunkEncoder(PATH)
    coder.encode(["a word Übung", "### ,*** -- $"])
    want = coder._library(["a word### Übung,*** word-- word$"])

    def spaced(chunks):
        raise AssertionError(chunks)

    monkeypatch.setattr(coder, "_spaced", spaced)
    assert coder.encode(["a word### Übung,*** word-- word$"]) == want


def test_batches_of_all_kinds_of_texts():
    texts = ["the cat", None, "", " ", "two  spaces ", "the cat", "<|endoftext|> the cat", "cat the\ncat", "the", " cat\n the"] * 3
    coder = ChunkEncoder(PATH)
    for some in (texts, texts[1:3], texts[4:5], texts[6:7], []):
        assert coder.encode(some) == coder._library([t or "" for t in some])


def test_packing_covers_every_id_without_gaps(docs):
    rows = packing.pack(docs, PATH, capacity=64).collect()
    want = sorted(((i, whole(t) + b"\0\0\0\0") for i, t in DOCS), key=repr)
    groups, got = {}, []
    for r in rows:
        groups.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        assert len(r["ids"]) == 4 * r["length"] and 0 <= r["offset"] and r["offset"] + r["length"] <= 64
    by_copy = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        by_copy.setdefault((r["doc_id"], r["doc_tokens"], r["start"]), []).append(r)
    for (doc, tokens), _ in groups.items():
        copies = max(len(v) for (d, t, _), v in by_copy.items() if (d, t) == (doc, tokens))
        parts = sorted({(s, v[0]["ids"]) for (d, t, s), v in by_copy.items() if (d, t) == (doc, tokens)})
        got += [(doc, b"".join(p for _, p in parts))] * copies
    assert sorted(got, key=repr) == want
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(filled) == list(range(len(filled)))
    for i, spans in filled.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 64 or i == max(filled)


def test_packing_empty_and_bad_capacity(docs):
    assert packing.pack(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(docs, PATH, capacity=1000)


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    for part in (keys[:1], keys[:2], keys):
        slots = tokenstore.mph_slots(tokenstore.build_mph(part), part, len(part))
        assert sorted(slots) == list(range(len(part)))


def test_store_round_trip(spark, docs):
    store = tokenstore.write_store(docs, PATH, end_id=2)
    rows = store.rows(spark)
    ids = tokenstore.read_ids(store, tokenstore.lookup(store, rows, copy="copy")).collect()
    end = (2).to_bytes(4, "little")
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in ids), key=repr) == sorted(((i, whole(t) + end) for i, t in DOCS), key=repr)
    at = 0
    for r in rows.orderBy("start").collect():
        assert r["start"] == at
        at += r["n"]
    keys = [r["doc_id"] for r in rows.orderBy("start").collect()]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert tokenstore.lookup(store, spark.createDataFrame([(999,)], "doc_id long")).count() == 0
    empty = tokenstore.write_store(docs.limit(0), PATH, end_id=2)
    assert tokenstore.lookup(empty, rows).count() == 0


def test_crc_of_ids(spark, docs):
    from pyspark.sql import functions as F

    r = packing.pack(docs, PATH).select("ids", F.crc32("ids").alias("c")).first()
    assert r["c"] == zlib.crc32(r["ids"])


def test_chunks_met_first_are_not_learned_again(monkeypatch):
    monkeypatch.setattr(encoding, "CACHE_CHUNKS", 20)
    monkeypatch.setattr(encoding, "RECENT_CHUNKS", 10, raising=False)
    own, words = ChunkEncoder(PATH), lambda a, b: "x " + " ".join(f"w{i}v{i}, w{i}z" for i in range(a, b))
    texts = [words(0, 30), words(30, 60), words(60, 90), words(90, 120), words(0, 30)]
    learned, library = [], own._library
    monkeypatch.setattr(own, "_library", lambda x: learned.extend(x) or library(x))
    for text in texts:
        before = len(learned)
        assert own.encode([text]) == library([text])
    assert len(learned) == before
