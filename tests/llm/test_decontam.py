"""op1's matcher against a brute-force version, and the cost of awkward items and texts."""

import random
import time

import pytest

from quillspark.llm.decontam import Matcher, contaminated, cuts, halves, normalise


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(items, text, rate):
    """Each item's closest run of whole words, and the runs counted from the left."""
    norm, out = normalise(text), []
    starts = [0] + [i + 1 for i, c in enumerate(norm) if c == " "]
    ends = [i for i, c in enumerate(norm) if c == " "] + [len(norm)]
    for item_id, item in items:
        item = normalise(item)
        errors = int(len(item) * rate)
        found = []
        for end in ends:
            near = [s for s in starts if s < end and abs(end - s - len(item)) <= errors]
            if runs := [(d, s, end) for s in near if (d := distance(item, norm[s:end])) <= errors]:
                found.append(min(runs))
        if item and found:
            count, last = 0, -1
            for _, start, end in found:
                if start > last:
                    count, last = count + 1, end
            out.append((item_id, *min(found), count))
    return sorted(out)


@pytest.mark.parametrize("words", [["ab", "cab", "the", "bad", "a", "dabba", "beta"], ["aa", "a", "aaa"]])
def test_matches_equal_brute_force(words):
    r, hits = random.Random(len(words)), 0
    for trial in range(60):
        items = [(k, " ".join(r.choice(words) for _ in range(r.randint(3, 14)))) for k in range(4)]
        items.append((9, items[0][1]))  # a repeated item
        items.append((10, " ! "))
        text = []
        for _ in range(4):
            chars = list(r.choice(items)[1])
            for _ in range(r.randint(0, 3)):
                x = r.randrange(len(chars))
                chars[x] = r.choice(["", "b", "x", " ", chars[x] + "c"])
            text += ["".join(chars), r.choice(words)]
        rate = r.choice([0.05, 0.1, 0.2])
        want = brute(items, " ".join(text), rate)
        assert sorted(Matcher(items, rate).find(" ".join(text))) == want
        hits += len(want)
    assert hits > 50


def test_shared_openings_lose_nothing():
    """Items cut anew outside their common opening are found with edits anywhere in them."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 9)))
    opening = " ".join(word() for _ in range(6))
    items = [(k, opening + " " + " ".join(word() for _ in range(18))) for k in range(30)]
    matcher = Matcher(items, 0.05)
    assert any(own[0] for own in matcher.cuts)
    for k, item in items:
        chars = list(item)
        for x in r.sample([i for i, c in enumerate(item) if c != " "], int(len(item) * 0.05)):
            chars[x] = "z"
        text = f"{word()} {''.join(chars)} {word()}"
        assert matcher.find(text) == brute([(k, item)], text, 0.05) != []
    start = time.time()
    assert matcher.find(" ".join([opening] * 400)) == []
    assert time.time() - start < 2


def test_long_items_and_texts():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    item = " ".join(r.choice(words) for _ in range(7500))[:50_000].strip()
    near = "x y " + item[:20_000] + "zz" + item[20_010:] + " q"
    start = time.time()
    ((item_id, d, begin, end, n),) = Matcher([(1, item)], 0.05).find(near)
    assert (item_id, begin, end, n) == (1, 4, len(near) - 2, 1) and 0 < d <= 12
    assert Matcher([(1, item)], 0.05).find(item[:24_000]) == []
    assert Matcher([(1, "word " * 9600)], 0.05).find("word word wird " * 3200) == []  # a piece that stands all over the item
    assert time.time() - start < 40
    short = " ".join(words[:30])
    (hit,) = Matcher([(7, short)], 0.05).find(" ".join([" ".join(words[100:2000]), short] * 20))
    assert hit[0] == 7 and hit[1] == 0 and hit[4] == 20


def test_pieces_and_their_parts():
    assert cuts(10, 2) == [0, 3, 6, 10] and cuts(4, 1, 3) == [3, 5, 7]
    assert halves(0, 1) == [] and halves(4, 5) == [(3, 5), (2, 5), (0, 5)]


def test_rows_that_are_odd(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, item, 5), (1, item, 6), (None, item.upper(), 7), (2, None, 8), (3, "", 9), (4, "one two", 9)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item, "x"), (1, item, "y"), (None, item, "z"), (5, None, ""), (6, "?!", "")], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in contaminated(docs, bench).collect()]
    assert len(got) == 9 and {r[2:] for r in got} == {(0, 0, len(item), 1)}
    assert sorted(map(str, {r[:2] for r in got})) == sorted(map(str, {(d, i) for d in (1, None) for i in (1, None)}))
