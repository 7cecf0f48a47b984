import pytest

from quillspark.functions.expressions import UnsupportedExpression, cell, condition
from quillspark.sources.vault import notes_from_files


@pytest.fixture(scope="module")
def note(spark):
    raw = "---\nname: pump\ntwin: pump\nother: hose\nlevel: 7\nhalf: 2.5\nneg: -7\ndigits: '12'\ndone: false\nready: true\nempty: null\nparts: [valve, seal]\nday: 2024-05-01\n---\n"
    return notes_from_files(spark.createDataFrame([("n.md", raw)], "path string, raw string")).cache()


CELLS = {
    'file:get("level") + 1': "8",
    'file:get("level") / 0': "inf",
    'file:get("neg") / 0': "-inf",
    "0 / 0": "nan",
    'file:get("neg") % 3': "2",
    'file:get("level") % -3': "-2",
    "5 % 0": "nan",
    "2 ^ 3 ^ 2": "512",
    "-2 ^ 2": "-4",
    "2 ^ -1": "0.5",
    "(1 + 2) * 3 - 4 / 2": "7",
    'file:get("digits") * 2': "24",
    'file:get("name") * 2': "",
    'file:get("nothing") + 1': "",
    'file:get("nothing")': "nil",
    'file:get("empty")': "nil",
    'file:get("done")': "false",
    'file:get("parts")': "[valve, seal]",
    '#file:get("parts")': "2",
    '#"abc"': "3",
    'file:get("nothing") or "none"': "none",
    'file:get("done") or "no"': "no",
    'file:get("name") or "none"': "pump",
    'file:get("ready") and "yes" or "no"': "yes",
    'file:get("nothing") and 1': "nil",
    'getPropertyValue(file, "nothing", 4) * 2': "8",
    'getPropertyValue(file, "empty", "e") .. "!"': "e!",
    'getPropertyValue(file, "level")': "7",
    '"a" .. 1 .. "b" .. 2.5': "a1b2.5",
    '"a" .. file:get("nothing")': "",
    '"a" .. true': "",
    'string.format("%d of %s, %.2f%%", file:get("level"), file:get("name"), file:get("half"))': "7 of pump, 2.5%",
    'string.format("it\'s $%.2f", 1)': "it's $1.0",
    "string.format(\"', java_method('java.lang.System','getProperty','user.home'), '%.2f\", 1)": "', java_method('java.lang.System','getProperty','user.home'), '1.0",
    'toFixed(file:get("level") * 2, 3)': "14.0",
    'tostring(nil) .. tonumber("3")': "nil3",
    'math.floor(2.7) + math.ceil(2.1) + math.abs(-1)': "6",
    'string.upper("a") .. string.len("four")': "A4",
    'listJoined(file, "parts", "<", ">", "|")': "<valve>|<seal>",
    "'single \\'quoted\\' \\\\ \\n.'": "single 'quoted' \\ \n.",
    'double(file) .. "/" .. quad(file)': "14/28",
}
FORMULAS = {"double": 'return file:get("level") * 2;', "quad": "return double(file) * 2"}

CONDITIONS = {
    'getPropertyValue(file, "missing")': False,
    'not getPropertyValue(file, "missing")': True,
    'file:get("done")': False,
    'not file:get("done")': True,
    'file:get("level")': True,
    "0": True,
    '""': True,
    'file:get("name") == file:get("twin")': True,
    'file:get("name") == file:get("other")': False,
    'file:get("name") ~= file:get("other")': True,
    'file:get("name") ~= nil': True,
    'file:get("missing") == nil': True,
    'file:get("missing") == file:get("empty")': True,
    'file:get("level") == "7"': False,
    'file:get("level") == 7': True,
    'file:get("level") >= 7 and file:get("half") < 3': True,
    'file:get("name") < file:get("other")': False,
    'file:get("name") < 3': False,
    'not (file:get("name") < 3)': False,
    'file:get("missing") > 3 or true': False,
    'true or file:get("missing") > 3': True,
    'hasProperty(file, "empty")': False,
    'hasProperty(file, "done")': True,
    'hasPropertyValue(file, "parts", "seal")': True,
    'not hasPropertyValue(file, "parts", "sea")': True,
    'hasPropertyValue(file, "level", 7)': True,
    'hasPropertyValue(file, "level", "7")': False,
    'hasPropertyValue(file, "ready", true)': True,
    'hasPropertyValue(file, "name", file:get("twin"))': True,
}


def test_cells(note):
    got = note.select(*[cell(source, FORMULAS).alias(f"c{i}") for i, source in enumerate(CELLS)]).first()
    assert dict(zip(CELLS, got, strict=True)) == CELLS


def test_conditions(note):
    got = note.select(*[condition(source).alias(f"c{i}") for i, source in enumerate(CONDITIONS)]).first()
    assert dict(zip(CONDITIONS, got, strict=True)) == CONDITIONS


@pytest.mark.parametrize("bad", [
    'os.execute("rm")', "x = 1; y", "getPropertyValue(file, name)", 'java_method("a", "b")', "(select 1)", "1 +", "(1", "1)", "file:remove(\"x\")", "io.open(\"x\")",
    'string.format("%x", 1)', 'string.format("%d")', 'string.format(file:get("x"), 1)', 'loadstring("x")', "loop(file)", "(" * 200 + "1" + ")" * 200, "1 .. " * 3000 + "1", "", 5, "(" * 20 + 'file:get("a")' + ' and file:get("b") or file:get("c"))' * 20,
    'getPropertyValue(file, "a", 1, 2)', "`ls`", "{}", 'table.concat((function() os.exit() end)(), "")',
])
def test_other_code_is_refused(bad):
    with pytest.raises(UnsupportedExpression):
        cell(bad, {"loop": "return loop(file)"})


def test_joined_idiom(note):
    idiom = 'table.concat((function() local acc = {}; local xs = (getPropertyValue(file, "parts") or {}):toArray(); for k=1, #xs do local x = xs[k]; table.insert(acc, "<a .. b>" .. x .. "(" .. ")") end; return acc end)(), "; ")'
    assert note.select(cell(idiom).alias("c")).first()["c"] == "<a .. b>valve(); <a .. b>seal()"


def test_a_test_of_a_constant_key_reaches_the_scan(spark):
    from quillspark.sources.tables import notes

    found = notes(spark, "/root/testdata/sf0.001").where(condition('hasPropertyValue(file, "title", "cold widget")'))
    assert "EqualTo(p_name,cold widget)" in found.select("path")._jdf.queryExecution().toString()
