import difflib
import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators import code, joins, windows
from verdigris.sources.python_facts import extract_python_facts, kind

FILES = "review_id int, file_id string, path string, content string"


def facts_of(spark, *sources):
    rows = [(1, path, path, content) for path, content in sources]
    files = spark.createDataFrame(rows, FILES).withColumns({"language": F.lit("python"), "sha256": F.sha2("content", 256)})
    return files, extract_python_facts(files).cache()


def undefined(spark, content):
    _, facts = facts_of(spark, ("a.py", content))
    return sorted((row.name, row.line) for row in code.undefined_names(facts).collect())


CLEAN = [
    "try:\n    raise ValueError()\nexcept Exception as exc:\n    raise RuntimeError(str(exc)) from exc\n",
    "scale = 9 / 5\ndef converter(offset):\n    calls = 0\n    def convert(celsius):\n        nonlocal calls\n        calls += 1\n        return celsius * scale + offset\n    return convert\n",
    "import os\nwith open(os.devnull) as sink, open(os.devnull) as spare:\n    print(sink, spare, f'{sink.name:>{len(spare.name)}}')\n",
    "def shape(event):\n    match event:\n        case [first, *others]:\n            return first, others\n        case {'unit': unit, **more} if more:\n            return unit\n",
    "def drain(tank):\n    while (left := tank.level()) > 0:\n        tank.open()\n    return left\n",
    "class A:\n    size = 3\n    double = size * 2\n    def get(self):\n        return self.size\n",
    "def f():\n    global made\n    made = 1\ndef g():\n    return made\n",
    "f = lambda a, b=len: [x + a for x in b if (y := x)]\n",
    "def f[T](x: T) -> T:\n    return x\n",
]


@pytest.mark.parametrize("content", CLEAN)
def test_no_false_alarm(spark, content):
    assert undefined(spark, content) == []


def test_undefined_names_are_found(spark):
    assert undefined(spark, "def f():\n    return missing\n") == [("missing", 2)]
    assert undefined(spark, "pressure = [3, 5]\ntotal = sum(reading for reading in pressure)\nprint(presure, total)\n") == [("presure", 3)]
    assert undefined(spark, "class A:\n    size = 3\n    def get(self):\n        return size\n") == [("size", 4)]
    assert undefined(spark, "a = [i for i in range(3)]\nprint(i)\n") == [("i", 2)]
    assert undefined(spark, "a = [i for i in range(3)]\ndef f():\n    return i\n") == [("i", 3)]


def test_syntax_error_is_a_fact(spark):
    _, facts = facts_of(spark, ("a.py", "def f(:\n"), ("b.py", "x = 1\n"))
    assert [row.line for row in code.syntax_errors(facts).collect()] == [1]


def test_identical_files_are_parsed_once(spark):
    files, facts = facts_of(spark, ("a.py", "eval('1')\n"), ("b.py", "eval('1')\n"))
    assert kind(facts, "bare_call", name="name").count() == 1
    assert sorted(row.path for row in code.on_files(code.dangerous_calls(facts), files).collect()) == ["a.py", "b.py"]


GRAPH = [
    ("tank.py", "class Tank:\n    litres = 40\n\n    def drain(self, wanted):\n        taken = clamp(wanted, self.litres)\n        self.litres -= taken\n        return taken\n"),
    ("limits.py", "def clamp(amount, most):\n    return amount if amount < most else most\n"),
    ("heated.py", "class HeatedTank(Tank):\n    def drain(self, wanted):\n        return wanted / 2\n"),
]


def test_graph_context(spark):
    files, facts = facts_of(spark, *GRAPH)
    symbols = code.on_files(kind(facts, "symbol", ord="ord", name="name", qualified="detail", start_line="line"), files).select(
        "review_id", F.concat("path", F.lit(":"), "qualified").alias("symbol_id"), "name", "path", "sha256", "ord", "start_line"
    )
    calls = symbols.join(kind(facts, "call", ord="ord", callee="name"), ["sha256", "ord"]).select("review_id", "symbol_id", "callee")
    target = symbols.where("symbol_id = 'tank.py:Tank.drain'")
    found = joins.context_symbols(target, symbols, calls)
    got = {(row.symbol_id, row.reason, row["rank"]) for row in found.collect()}
    assert got == {("limits.py:clamp", "callee", 10), ("heated.py:HeatedTank.drain", "override", 5)}
    places = symbols.select("symbol_id", F.col("path").alias("file_id"), "path", "start_line")
    none = places.select(F.lit(None).cast("string").alias("target_id"), "file_id", "path", "start_line").limit(0)
    top = joins.top_refs(found.join(places, "symbol_id"), none, limit=2)
    assert [row.path for row in top.orderBy("position").collect()] == ["heated.py", "limits.py"]


def rename(spark, line, *sources):
    files, facts = facts_of(spark, *sources)
    drafts = spark.createDataFrame([("d", 1, sources[0][0], line)], "draft_id string, review_id int, file_id string, line int")
    plan = code.rename_consensus(drafts, facts, files)
    return plan.first(), (code.rename_callsites(plan, facts, files).collect() or [None])[0]


TARGET = "class CsvSource(Source):\n    kind = 'csv'\n\n    def %s(self, rowLimit):\n        return self.kind, rowLimit or 1\n\n\ndef total(source, options):\n    return len(source.%s)\n"
CONTRACT = "class Source:\n    kind = ''\n\n    def %s(self, row_limit):\n        raise NotImplementedError\n"


def test_rename_by_class_family(spark):
    verdict, sites = rename(spark, 4, ("csv_source.py", TARGET % ("_rows", "_rows(rowLimit=9)")), ("source.py", CONTRACT % "_rows"))
    assert (verdict.naming_code, verdict.old_name, verdict.new_name) == ("verified", "rowLimit", "row_limit")
    assert (sites.callsites, sites.unsafe_reasons, sites.safety) == (1, [], "safe")


def test_rename_without_contract_or_with_spread(spark):
    target = ("csv_source.py", TARGET % ("rows", "rows(**options)"))
    assert rename(spark, 4, target)[0].naming_code == "finding_not_actionable"
    verdict, sites = rename(spark, 4, target, ("source.py", CONTRACT % "rows"))
    assert verdict.naming_code == "verified" and sites.safety == "requires_review"
    assert sites.unsafe_reasons == ["dynamic_use", "public_name"]


def test_compliant_signature(spark):
    source = "def mean_speed(self, wheel_radius, ticks, per_minute=False):\n    return ticks * wheel_radius\n"
    assert rename(spark, 1, ("wheels.py", source))[0].naming_code == "already_compliant"


def test_import_plan(spark):
    files, facts = facts_of(spark, ("shop/cart.py", "price = with_tax(3)\n"), ("shop/money.py", "def with_tax(net):\n    return net + net // 5\n"))
    wanted = code.on_files(code.undefined_names(facts), files)
    exports = code.cross_file_exports(wanted, facts, files).select("file_id", "name", "path")
    similar = joins.similar_names(wanted.select("file_id", "name"), spark.createDataFrame([("shop/cart.py", "price")], "file_id string, candidate string"), ["file_id"])
    plan = joins.repair_plan(wanted, similar, exports, ["file_id"]).first()
    assert (plan.mode, plan.module) == ("import", "shop.money")


def test_counted_exports_equal_pairs(spark):
    """Names that one other file has, that several have, that the asking file has too, twice in one file, and nobody."""
    sources = [("a.py", "one()\nmany()\nown = 1\nnone()\n"), ("b.py", "one = 1\nmany = 1\nown = 2\ntwice = 1\ntwice = 2\n"), ("c.py", "many = 2\none()\ntwice()\n"), ("d.py", "many = 3\n")]
    files, facts = facts_of(spark, *sources)
    names = ["one", "many", "own", "twice", "none"]
    wanted = spark.createDataFrame([(1, path, name) for path, _ in sources for name in names], "review_id int, file_id string, name string")
    rows = code.cross_file_exports(wanted, facts, files).collect()
    found = {}
    for row in rows:
        found.setdefault((row["file_id"], row["name"]), []).append(row["path"])
    want = {key: (len(paths), paths[0] if len(paths) == 1 else None) for key, paths in found.items()}
    got = {(row["file_id"], row["name"]): (row["exports"], row["path"]) for row in code.counted_exports(wanted, facts, files).collect()}
    assert got == want and ("a.py", "one") in want and want["c.py", "twice"] == (2, None)


def test_similar_names_equal_brute_force(spark):
    names = sorted({f"{a}_{b}" for a in ("red", "blue", "small", "large", "hot", "cold") for b in ("bolt", "ring", "plate", "gear", "rod")} | {"x", "ab", "ba", "axbxcx", "abcdef"})
    wanted = spark.createDataFrame([("s", name[:-2] + name[-2:][::-1]) for name in names], "scope string, name string")
    visible = spark.createDataFrame([("s", name) for name in names], "scope string, candidate string")
    got = {}
    for row in joins.similar_names(wanted, visible, ["scope"]).collect():
        got.setdefault(row.name, []).append((-row.ratio, row.candidate))
    for (name,) in {(row.name,) for row in wanted.collect()}:
        scored = [(-difflib.SequenceMatcher(None, name, other).ratio(), other) for other in names if other != name]
        assert sorted(got.get(name, [])) == sorted(item for item in scored if -item[0] >= 0.6)[:8], name


def test_best_eight_of_many(spark):
    """Names that have eight close ones in an early round, and others that need the last."""
    visible = [f"value_{at}" for at in range(30)] + ["valve", "vale", "evalu", "xyz"]
    names = ["value_1x", "value_2", "valu", "zyxw", "xy", "", "value_"]
    frame = lambda rows, name: spark.createDataFrame([(scope, one) for scope in "st" for one in rows], f"scope string, {name} string")
    got = {}
    for row in joins.similar_names(frame(names * 2, "name"), frame(visible, "candidate"), ["scope"]).collect():
        got.setdefault((row.scope, row.name), []).append((-row.ratio, row.candidate, row.position))
    for scope in "st":
        for name in names:
            scored = sorted((-difflib.SequenceMatcher(None, name, other).ratio(), other) for other in visible if other != name)
            want = [(*item, at + 1) for at, item in enumerate(item for item in scored if -item[0] >= 0.6) if at < 8] if name else []
            assert sorted(got.get((scope, name), [])) == want, name


def test_nearest_refs_equal_all_pairs(spark):
    """One name that half of the symbols have, recursion, calls both ways, places shared by several symbols."""
    dice = random.Random(6)
    symbols = [(at % 2, at, "hot" if dice.random() < 0.5 else f"f{dice.randrange(6)}", f"p{dice.randrange(5)}", dice.randrange(6)) for at in range(80)]
    edges = [(review, one, dice.choice(["hot", "f1", "f2", "f3", name])) for review, one, name, _, _ in symbols for _ in range(dice.randrange(4))]
    frame = spark.createDataFrame(symbols, "review_id int, symbol_id int, name string, path string, start_line int").withColumn("file_id", F.col("path"))
    calls = spark.createDataFrame(edges, "review_id int, symbol_id int, callee string")
    imports = spark.createDataFrame([(at, f"p{at % 3}", f"p{at % 3}", 0) for at in range(0, 80, 7)], "target_id int, file_id string, path string, start_line int")
    places = frame.select("symbol_id", "file_id", "path", "start_line")
    for limit in (1, 3, 12):
        want = joins.top_refs(joins.context_symbols(frame, frame, calls).join(places, "symbol_id"), imports, limit).collect()
        got = joins.nearest_refs(frame, frame, calls, imports, limit).collect()
        columns = ("target_id", "file_id", "path", "start_line", "rank", "position")
        assert sorted(tuple(row[name] for name in columns) for row in got) == sorted(tuple(row[name] for name in columns) for row in want)


def test_suffixes_that_one_path_has(spark):
    dice = random.Random(12)
    paths = {(review, "".join(dice.choice(["a", "b", "/", "x.h"]) for _ in range(dice.randrange(1, 7)))) for review in (1, 2) for _ in range(60)}
    asked = {(review, path[dice.randrange(len(path)) :]) for review, path in paths} | {(1, "nothing"), (2, "h"), (1, "aab/x.h")}
    got = joins._only_path_ending(spark.createDataFrame(list(asked), "review_id int, suffix string"), spark.createDataFrame(list(paths), "review_id int, target string"))
    ending = {(review, suffix): [path for other, path in paths if other == review and path.endswith(suffix)] for review, suffix in asked}
    assert {(row["review_id"], row["suffix"]): row["target"] for row in got.collect()} == {key: found[0] for key, found in ending.items() if len(found) == 1}


def test_module_chunks(spark):
    source = "import a\nimport b\n\n@deco\ndef f():\n    pass\nx = 1\ny = 2\nclass C:\n    pass\n"
    files, facts = facts_of(spark, ("a.py", source))
    rows = code.on_files(kind(facts, "statement", ord="ord", start_line="line", end_line="end_line", detail="detail"), files)
    chunks = windows.chunk_module(rows.withColumn("is_definition", F.col("detail") == "definition"))
    got = [(row.start_line, row.end_line) for row in chunks.orderBy("chunk_index").collect()]
    assert got == [(1, 2), (4, 6), (7, 8), (9, 10)]
