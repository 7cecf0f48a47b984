import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import bytebpe
from quillspark.llm.queries import op13_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
CUT = regex.compile(public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.vocabulary(PATH), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bytebpe.Encoder(PATH, bytebpe.perfect_hash(PATH))


def ids(raw):
    return np.frombuffer(raw, dtype="<i4").tolist()


def naive(ranks, word):
    """Joins the pair of least rank over the whole string, again and again."""
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_first_tier_finds_all_words_and_no_others(own):
    words = bytebpe.vocabulary(PATH)
    hit, rank = own.whole(list(words))
    assert hit.all() and rank.tolist() == list(words.values())
    others = [w + b"\x00q" for w in words][:5000] + [b""]
    assert not own.whole([w for w in others if w not in words])[0].any()


def test_second_tier_joins_as_the_naive_way_does(own):
    ranks, rng = bytebpe.vocabulary(PATH), random.Random(2)
    words = [bytes(rng.choice(b"aeinrst hglou") for _ in range(rng.randint(1, 40))) for _ in range(600)] + [b"a" * 301, bytes(range(256)), b"", b"x", "größenordnungen".encode()]
    assert [ids(x) for x in own.merged(words)] == [naive(ranks, word) for word in words]
    assert own.merged([]) == [] and own.merged([b""]) == [b""]


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(" \n\t'sTI,.　\x85\x1c")), max_size=80))
def test_any_text(own, library, text):
    got = ids(own.encode([text], CUT)[0])
    assert got == library.encode_ordinary(text)
    assert bytebpe.Decoder(PATH).decode(np.array(got)) == text.encode()


def test_long_texts_and_pre_tokens(own, library):
    texts = ["a" * 20_000, " " * 5_000 + "x", "ab" * 9_000, "😀" * 3_000, "word " * 30_000, "<|endoftext|>", "I'll've 'S"]
    assert [ids(x) for x in own.encode(texts, CUT)] == [library.encode_ordinary(x) for x in texts]


def test_forgotten_words_come_out_alike(own, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "KEPT", 3)
    texts = ["Quetzalxyz brombeerig unfassbarlich zzyzx brombeerig Quetzalxyz"] * 4 + ["zzyzx brombeerig " * 5]
    own.recent, own.older = {}, {}
    for _ in range(3):
        for text in texts:
            assert ids(own.encode([text], CUT)[0]) == library.encode_ordinary(text)
    assert len(own.recent) <= 8


def test_rows(spark, library):
    texts = [None, "", "plain words", "plain words", "tab\tand\r\nline", "日本 <|endoftext|>", "long text " * 150_000]
    rows = [(i if i != 2 else None, t, 1, b"z") for i, t in enumerate(texts)] + [(5, "again", 1, b"z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, bytes binary")
    encoded = bytebpe.encode(docs, PATH, public_tokenizers.PATTERN)
    got = bytebpe.decode(encoded, PATH).collect()
    want = sorted((repr(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows)
    assert sorted((repr(r["doc_id"]), r["ids"], bytes(r["bytes"])) for r in got) == want
    assert bytebpe.decode(bytebpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN), PATH).collect() == []


def test_odd_lists_and_files(spark, tmp_path):
    lists = spark.createDataFrame([(1, None), (2, [])], "k long, ids array<int>")
    assert [bytes(r["bytes"]) for r in bytebpe.decode(lists, PATH).collect()] == [b"", b""]
    with pytest.raises(Exception, match="99999999"):
        bytebpe.decode(spark.createDataFrame([(1, [99999999])], "k long, ids array<int>"), PATH).collect()
    with pytest.raises(ValueError, match="column ids"):
        bytebpe.decode(lists, PATH, to="ids")
    for content, why in (([b"a 0", b"a 1"], "once"), ([base64.b64encode(bytes([i])) + b" %d" % i for i in range(255)], "every single byte")):
        (tmp_path / "f").write_bytes(b"\n".join(base64.b64encode(x.split()[0]) + b" " + x.split()[1] if why == "once" else x for x in content))
        with pytest.raises(ValueError, match=why):
            bytebpe.vocabulary(str(tmp_path / "f"))


def test_the_query_has_the_librarys_digests(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        own = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = op13_byte_bpe(spark, sf).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want and len(got) == len(want)
