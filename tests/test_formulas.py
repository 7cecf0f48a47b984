"""Bodies of formulas, text functions, and patterns against a plain matcher."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.expressions import UnsupportedExpression, cell
from quillspark.functions.patterns import UnsupportedPattern, replacement, translated
from quillspark.sources.vault import notes_from_files

LINKS = 'table.concat((function() local t = {}; local tags_array = (getPropertyValue(file, "parts") or {}):toArray(); for i=1, #tags_array do local v = tags_array[i]; table.insert(t, "[" .. v .. "](/tags/" .. v .. ")") end; return t end)(), ", ")'
BODIES = {
    'local n = file:get("level") if n > 5 then return "high" elseif n > 2 then return "mid" else return "low" end': "high",
    'if file:get("done") then return 1 end': "nil",
    'if file:get("done") then return 1 end return 2;': "2",
    'local x = "a" if file:get("ready") then x = "b" end return x .. "!"': "b!",
    'local x if hasProperty(file, "name") then x = 3 end return x': "3",
    'local x = 1; do_ = 2': None,
    'local n = 0 for i, x in ipairs(file:get("parts")) do n = n + #x end return n': "9",
    'local s = "" for i, x in ipairs(file:get("parts")) do if s ~= "" then s = s .. "/" end s = s .. i .. x end return s': "1valve/2seal",
    'local t = {} for i, x in ipairs(file:get("parts")) do if string.find(x, "^s") then t[#t + 1] = x end end return table.concat(t, ",") .. #t': "seal1",
    'local t = {"x"} for i = 1, #file:get("parts") do table.insert(t, i .. "") table.insert(t, file:get("parts")[i]) end return table.concat(t, " ")': "x 1 valve 2 seal",
    'local t = {} for i, x in ipairs(file:get("parts")) do table.insert(t, #t .. x) end return table.concat(t, " ")': "0valve 1seal",
    'local t = {} for i, x in ipairs(file:get("parts")) do table.insert(t, x * 2) end return "never"': "",
    'local a = file:get("name") + 1 return "never"': "",
    'if file:get("name") < 3 then return 1 end return 2': "",
    'local a = 1 -- what follows is no code\n local b = a + 1 return a .. b': "12",
    'local xs = file:get("parts") return xs[1] .. xs[2] .. tostring(xs[3]) .. tostring(xs[0])': "valvesealnilnil",
    'local xs = file:get("missing") or {} return #xs': "0",
    'for i, x in ipairs(file:get("missing")) do local y = x end return 1': "",
    'local a = 1 if true then local a = 2 end return a': "1",
    'return (function() local a = 5 return a * 2 end)() + 1': "11",
    f"return {LINKS}": "[valve](/tags/valve), [seal](/tags/seal)",
    'return file:get("parts"):contains("seal") and file:get("parts"):size() or 0': "2",
    'file:get("level") * 2': "14",
    'local r = other(file) return r .. r': "77",
}
CELLS = {
    'string.rep("ab", 3)': "ababab",
    'string.rep("ab", 3, "-")': "ab-ab-ab",
    'string.rep("ab", 0)': "",
    'string.rep("ab", 1000000)': "",
    'string.sub("hello", 2, 4)': "ell",
    'string.sub("hello", -3)': "llo",
    'string.sub("hello", 2, -2)': "ell",
    'string.sub("hello", 0)': "hello",
    'string.sub("hello", 4, 2) .. "|"': "|",
    'string.sub("hello", -99, 99)': "hello",
    '("Abc"):upper() .. ("Abc"):lower():reverse()': "ABCcba",
    'string.find("a.b", ".", 1, true)': "2",
    'string.find("hello", "l+")': "3",
    'string.find("hello", "z")': "nil",
    'string.match("key = value", "(%w+) = (%w+)")': "key",
    'string.match("v12.5", "%d+%.%d")': "12.5",
    'string.match("abc", "^b")': "nil",
    'string.gsub("hello world", "o", "0")': "hell0 w0rld",
    'string.gsub("hello", "", "-")': "-h-e-l-l-o-",
    'string.gsub("a b", "(%w) (%w)", "%2 %1$5 %%")': "b a$5 %",
    'string.gsub("a1", "%a(%d)", "%10")': "10",
    'file:get("name"):gsub("^%l", "X")': "Xump",
    'file:get("missing"):gsub("a", "b")': "",
    'math.max(1, 7, 3) .. math.min(4, 2) .. math.sqrt(16) .. math.fmod(-7, 3)': "724-1",
    "math.floor(math.pi)": "3",
    "math.huge": "inf",
    LINKS: "[valve](/tags/valve), [seal](/tags/seal)",
}


@pytest.fixture(scope="module")
def note(spark):
    raw = "---\nname: pump\nlevel: 7\ndone: false\nready: true\nparts: [valve, seal]\n---\n"
    return notes_from_files(spark.createDataFrame([("n.md", raw)], "path string, raw string")).cache()


def test_bodies(note):
    held = {body: wanted for body, wanted in BODIES.items() if wanted is not None}
    got = note.select(*[cell("f(file)", {"f": body, "other": 'return file:get("level")'}).alias(f"c{i}") for i, body in enumerate(held)]).first()
    assert dict(zip(held, got, strict=True)) == held


def test_text_functions(note):
    got = note.select(*[cell(source).alias(f"c{i}") for i, source in enumerate(CELLS)]).first()
    assert dict(zip(CELLS, got, strict=True)) == CELLS


@pytest.mark.parametrize("body", [
    "local x = 1; y = 2", "while true do end", "repeat until true", "for i = 1, 10 do end", "for i = 2, #file:get('a') do end", "for k, v in pairs({}) do end", "local file = 1", "local end = 1",
    "for i, x in ipairs({}) do return 1 end", "for i, x in ipairs({}) do for j, y in ipairs({}) do end end", "return 1 return 2", "if true then return 1", "return 1 end", "os.exit()", "local f = function() end", "goto x",
    "local s = '' for i, x in ipairs({}) do s = 1 end return s", "local t = {} t[1] = 2", "table.insert(u, 1)", "local t = {} table.remove(t)", "f(file)", "return file", "return (function(a) return a end)(1)",
    "local a = 'x' " + "a = a .. a " * 30 + "return a", "if true then " * 100 + "return 1 " + "end " * 100, 'return string.match("a", file:get("p"))', 'return string.gsub("a", "a", function() end)', "return {1, 2", 'return string.match("a", "%b()")',
])
def test_other_statements_are_refused(body):
    with pytest.raises(UnsupportedExpression):
        cell("f(file)", {"f": body})


# A plain matcher: one item at a time with backtracking, as the language describes it.
KINDS = {"a": str.isalpha, "d": str.isdigit, "l": str.islower, "s": str.isspace, "u": str.isupper, "w": str.isalnum, "p": lambda c: c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"}


def fits(c, item):
    if item[0] == "%":
        kind = KINDS.get(item[1].lower())
        return ((c.isascii() and kind(c)) == item[1].islower()) if kind else c == item[1]
    if item[0] == "[":
        inside, hit = item[1:-1], False
        negated = inside.startswith("^")
        inside = inside[negated:]
        i = 0
        while i < len(inside):
            if inside[i] == "%":
                hit, i = hit or fits(c, inside[i : i + 2]), i + 2
            elif inside[i + 1 : i + 2] == "-" and i + 2 < len(inside):
                hit, i = hit or inside[i] <= c <= inside[i + 2], i + 3
            else:
                hit, i = hit or c == inside[i], i + 1
        return hit != negated
    return item == "." or c == item


def match_at(text, at, items, held):
    """The match's end and its captures, or None; held are (begin, end or None)."""
    if not items:
        return at, held
    item, *rest = items
    if item == "(":
        return match_at(text, at, rest, [*held, (at, None)])
    if item == ")":
        k = max(i for i, h in enumerate(held) if h[1] is None)
        return match_at(text, at, rest, [*held[:k], (held[k][0], at), *held[k + 1 :]])
    if item == "$":
        return (at, held) if at == len(text) else None
    single, mark = item
    most = at
    while most < len(text) and (mark in "*+-" or most == at) and fits(text[most], single):
        most += 1
    ends = {"": [at + 1] if most > at else [], "?": [at + 1, at] if most > at else [at], "*": range(most, at - 1, -1), "+": range(most, at, -1), "-": range(at, most + 1)}[mark]
    for end in ends:
        if found := match_at(text, end, rest, held):
            return found
    return None


def random_pattern(rng):
    items, open_ = [], 0
    for _ in range(rng.randint(1, 5)):
        if rng.random() < 0.2:
            items.append("(")
            open_ += 1
        items.append((rng.choice(["a", "b", "1", " ", ".", "%a", "%d", "%S", "%w", "%U", "%p", "%.", "%-", "[ab]", "[^a1]", "[a-c_]", "[%d%s]", "[^%w]", "[]b]", "é"]), rng.choice(["", "", "*", "+", "-", "?"])))
        if open_ and rng.random() < 0.5:
            items.append(")")
            open_ -= 1
    return [*items, *[")"] * open_, *(["$"] if rng.random() < 0.2 else [])], rng.random() < 0.2


def test_patterns_against_a_plain_matcher(spark):
    rng = random.Random(4)
    texts = ["", "a", "ab1 b-a.", "  b_a1!", "AbB aé1", "line\nb 1\n", "]b]a"]
    table = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    wanted, columns = [], []
    for _ in range(60):
        items, anchored = random_pattern(rng)
        while any(a == "(" and b == ")" for a, b in zip(items, items[1:])):
            items, anchored = random_pattern(rng)
        pattern = "^" * anchored + "".join(x if isinstance(x, str) else "".join(x) for x in items)
        regex, captures = translated(pattern)
        columns += [F.when(F.col("t").rlike(regex), F.regexp_extract("t", regex, min(captures, 1))), F.regexp_replace("t", F.lit(regex), F.lit(replacement("<%0>", captures)))]
        first, replaced = [], []
        for text in texts:
            found = next(((at, *m) for at in range(1 if anchored else len(text) + 1) if (m := match_at(text, at, items, []))), None)
            first.append(None if not found else text[slice(*found[2][0])] if found[2] else text[found[0] : found[1]])
            out, at = "", 0
            while at <= len(text):
                m = match_at(text, at, items, [])
                out += f"<{text[at : m[0]]}>" if m else ""
                if m and m[0] > at:
                    at = m[0]
                else:
                    out += text[at : at + 1]
                    at += 1
                if anchored:
                    break
            replaced.append(out + text[at:])
        wanted += [(pattern, first), (pattern, replaced)]
    got = table.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()
    assert [(p, [r[i] for r in got]) for i, (p, _) in enumerate(wanted)] == wanted


@pytest.mark.parametrize("bad", ["%", "(a", "a)", "()", "[a", "%b()", "%f[a]", "%1", "(%1)", "(a)%2", "%q"])
def test_patterns_without_an_equivalent_are_refused(bad):
    with pytest.raises(UnsupportedPattern):
        translated(bad)


@pytest.mark.parametrize("bad", ["%", "%2", "%a", "x%%%"])
def test_odd_replacements_are_refused(bad):
    with pytest.raises(UnsupportedPattern):
        replacement(bad, 1)
