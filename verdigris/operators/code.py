"""Joins over Python facts: undefined names, unused imports, dangerous calls, exports, naming families."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.intervals import enclosing_symbol
from verdigris.sources.python_facts import BUILTIN_NAMES, kind

# Calls that run text as code; names exempt from naming checks; what a good name looks like.
DANGEROUS_CALLS = ("eval", "exec")
IMPLICIT_PARAMETERS = ("self", "cls")
SNAKE_CASE = "^[a-z_][a-z0-9_]*$"
NAMING_MARKERS = ("参数命名", "parameter naming", "parameter_name")


def undefined_names(facts: DataFrame) -> DataFrame:
    """Loads of names that nothing in their scope chain binds and that are no builtins, per content hash."""
    loads = kind(facts, "load", name="name", line="line", col="col", end_col="end_col", scopes="scopes")
    # The scopes that bind a name in a file are few numbers, so each load meets them once, as one array.
    bound = kind(facts, "binding", name="name", scope="position").groupBy("sha256", "name").agg(F.collect_set("scope").alias("_bound"))
    met = loads.where(~F.col("name").isin(*BUILTIN_NAMES)).join(bound, ["sha256", "name"], "left")
    return met.where("_bound IS NULL OR NOT arrays_overlap(scopes, _bound)").select("sha256", "name", "line", "col", "end_col")


def unused_imports(facts: DataFrame) -> DataFrame:
    """Imported names never loaded in their file; of several imports of a name the last one is reported."""
    imported = kind(facts, "import", name="name", line="line", col="col", end_col="end_col")
    last = imported.groupBy("sha256", "name").agg(F.max(F.struct("line", "col", "end_col")).alias("_at"))
    loaded = kind(facts, "used", name="name")
    return last.join(loaded, ["sha256", "name"], "left_anti").select("sha256", "name", "_at.*")


def dangerous_calls(facts: DataFrame) -> DataFrame:
    calls = kind(facts, "bare_call", name="name", evidence="detail", line="line", col="col", end_col="end_col")
    banned = calls.where(F.col("name").isin(*DANGEROUS_CALLS))
    return banned.withColumn("rule_id", F.concat(F.lit("python.dangerous-"), F.col("name"))).withColumn("severity", F.lit("high"))


def syntax_errors(facts: DataFrame) -> DataFrame:
    return kind(facts, "error", message="name", line="line", col="col")


def on_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Facts back on every file with that content."""
    return files.select("review_id", "file_id", "path", "sha256").join(rows, "sha256")


def static_findings(facts: DataFrame, files: DataFrame) -> DataFrame:
    """All built-in findings in one table: undefined names, unused imports, dangerous calls, syntax errors."""

    def shape(rows: DataFrame, rule: str | None, severity: str, evidence: str) -> DataFrame:
        rule_id = F.col("rule_id") if rule is None else F.lit(rule)
        return rows.select(
            "sha256", rule_id.alias("rule_id"), F.lit(severity).alias("severity"), F.col(evidence).alias("evidence"),
            F.col("line").alias("start_line"), F.col("col").alias("start_column"),
        )

    rows = (
        shape(undefined_names(facts), "python.undefined-name", "medium", "name")
        .unionByName(shape(unused_imports(facts), "python.unused-import", "info", "name"))
        .unionByName(shape(dangerous_calls(facts), None, "high", "evidence"))
        .unionByName(shape(syntax_errors(facts), "python.syntax-error", "medium", "message"))
    )
    return on_files(rows, files)


def cross_file_exports(wanted: DataFrame, facts: DataFrame, files: DataFrame) -> DataFrame:
    """Module-level definitions of an unresolved name in other files of the same review (``exporter``, ``path``, ``line``).

    ``wanted``: (review_id, file_id, name). A row per pair, which is written as it is made: pairs are never shuffled.
    """
    exports = on_files(kind(facts, "export", name="name", line="line").distinct(), files).select(
        "review_id", F.col("file_id").alias("exporter"), "path", "name", "line"
    )
    asked = wanted.select("review_id", "file_id", "name").distinct()
    return asked.join(exports, ["review_id", "name"]).where("file_id <> exporter")


def counted_exports(wanted: DataFrame, facts: DataFrame, files: DataFrame) -> DataFrame:
    """How often other files of the review define an unresolved name (``exports``), and where (``path``), if just one does so once.

    What ``repair_plan`` needs of ``cross_file_exports``, without a row per pair: definitions are counted per name, a file's own
    are subtracted, and when one is left, it is the first or the last of the name.
    """
    name = ["review_id", "name"]
    rows = on_files(kind(facts, "export", name="name", line="line").distinct(), files).select(*name, "file_id", "path")
    by_file = rows.groupBy(*name, "file_id").agg(F.count(F.lit(1)).alias("_own"), F.min("path").alias("path"))
    place = F.struct("path", "file_id")
    by_name = by_file.groupBy(*name).agg(F.sum("_own").alias("_all"), F.min(place).alias("_first"), F.max(place).alias("_last"))
    asked = wanted.select("review_id", "file_id", "name").distinct()
    counted = asked.join(by_name, name).join(by_file.drop("path"), [*name, "file_id"], "left")
    left = F.col("_all") - F.coalesce("_own", F.lit(0))
    other = F.when(F.col("_first.file_id") == F.col("file_id"), F.col("_last.path")).otherwise(F.col("_first.path"))
    return counted.where(left > 0).select("review_id", "file_id", "name", left.alias("exports"), F.when(left == 1, other).alias("path"))


def import_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(review_id, file_id, path, module) rows for ``resolve_imports``."""
    modules = kind(facts, "module", module="name").where("module IS NOT NULL").distinct()
    return on_files(modules, files).select("review_id", "file_id", F.col("path").alias("source"), "module")


def rename_consensus(drafts: DataFrame, facts: DataFrame, files: DataFrame) -> DataFrame:
    """Verdict on each parameter-naming draft, with the rename its class family agrees on.

    The draft's line picks the innermost function. Its first parameter that is not snake case is compared with
    the same position of the method of that name in related classes (bases of its class, or classes based on
    it). Exactly one distinct snake-case name there makes a rename. ``drafts``: draft_id, review_id, file_id, line.
    """
    symbols = kind(
        facts, "symbol", symbol="ord", name="name", qualified="detail", start_line="line", end_line="end_line", scopes="scopes"
    ).withColumn("is_class", F.col("scopes")[0] == 1).drop("scopes")
    functions = symbols.where("NOT is_class")
    params = kind(facts, "param", symbol="ord", parameter="name", position="position")
    hashes = files.select("review_id", "file_id", "path", "sha256")
    placed = drafts.join(hashes, ["review_id", "file_id"])
    spans = functions.select(F.col("sha256").alias("file_id"), "symbol", F.col("symbol").alias("ord"), "start_line", "end_line")
    inner = enclosing_symbol(placed.select(F.col("sha256").alias("file_id"), "line"), spans).withColumnRenamed("file_id", "sha256")
    odd = (
        params.where(~F.col("parameter").isin(*IMPLICIT_PARAMETERS) & ~F.col("parameter").rlike(SNAKE_CASE))
        .groupBy("sha256", "symbol")
        .agg(F.min(F.struct("position", "parameter")).alias("_odd"))
        .select("sha256", "symbol", F.col("_odd.position").alias("position"), F.col("_odd.parameter").alias("old_name"))
    )
    targets = (
        placed.join(inner, ["sha256", "line"], "left")
        .join(functions.select("sha256", "symbol", "name", "qualified", F.col("start_line").alias("def_line"), F.col("end_line").alias("def_end")), ["sha256", "symbol"], "left")
        .join(odd, ["sha256", "symbol"], "left")
    )
    methods = _methods(symbols, facts).join(params, ["sha256", "symbol"])
    family = hashes.join(methods, "sha256").select(
        "review_id", F.col("file_id").alias("_file"), "class_name", F.col("name"), F.col("def_line").alias("_line"), "position", "parameter", "bases"
    )
    with_class = targets.join(
        _methods(symbols, facts).select("sha256", "symbol", F.col("class_name").alias("_class"), F.col("bases").alias("_bases")), ["sha256", "symbol"], "left"
    )
    asked = with_class.where("old_name IS NOT NULL AND _class IS NOT NULL").select("review_id", "file_id", "name", "def_line", "position", "_class", "_bases").distinct()
    key = ["review_id", "file_id", "name", "def_line"]
    by_base = asked.withColumn("class_name", F.explode("_bases")).join(_named_by(family, "class_name"), ["review_id", "class_name", "name", "position"])
    by_child = asked.join(
        _named_by(family.withColumn("_class", F.explode("bases")), "_class"), ["review_id", "_class", "name", "position"]
    )
    own = F.struct(F.col("file_id").alias("_file"), F.col("def_line").alias("_line"))
    votes = (
        by_base.select(*key, "parameter", "_low", "_high")
        .unionByName(by_child.select(*key, "parameter", "_low", "_high"))
        .where((F.col("_low") != own) | (F.col("_high") != own))
        .groupBy(*key)
        .agg(F.min("parameter").alias("_low"), F.max("parameter").alias("_high"))
    )
    judged = with_class.join(votes, key, "left")
    agreed = F.col("_low").isNotNull() & (F.col("_low") == F.col("_high"))
    code = (
        F.when(F.col("symbol").isNull(), "finding_not_actionable")
        .when(F.col("old_name").isNull(), "already_compliant")
        .when(~F.coalesce(agreed, F.lit(False)), "finding_not_actionable")
        .otherwise("verified")
    )
    return judged.withColumn("naming_code", code).select(
        "draft_id", "review_id", "file_id", "path", "sha256", "symbol", "name", "qualified", "def_line", "def_end", "naming_code", "old_name",
        F.when(F.col("naming_code") == "verified", F.col("_low")).alias("new_name"),
    )


def semantic_inputs(drafts: DataFrame, facts: DataFrame, files: DataFrame) -> DataFrame:
    """Adds what ``gate_drafts_semantic`` judges by: ``file``, ``naming_code``, ``has_bool_fallback``, ``has_root_cause``, ``affected_path``.

    ``drafts``: draft_id, review_id, file_id, start_line, title, category, rule_id and ``root_cause``, a struct with
    ``affected_path``, or null. Drafts about parameter naming get the verdict of ``rename_consensus``; the fallback is a
    ``return bool(...)`` in the innermost function around the draft's line. A file that doesn't parse has no functions.
    """
    places = drafts.join(files.select("review_id", "file_id", "sha256", F.col("path").alias("file")), ["review_id", "file_id"], "left")
    functions = kind(facts, "symbol", symbol="ord", start_line="line", end_line="end_line", scopes="scopes").where(F.col("scopes")[0] == 0)
    spans = functions.select(F.col("sha256").alias("file_id"), "symbol", F.col("symbol").alias("ord"), "start_line", "end_line")
    points = places.where("sha256 IS NOT NULL").select(F.col("sha256").alias("file_id"), F.col("start_line").alias("line"))
    inner = enclosing_symbol(points, spans).withColumnRenamed("file_id", "sha256")
    fallbacks = kind(facts, "bool_return", symbol="ord").select("sha256", "symbol").distinct()
    falling = inner.join(fallbacks, ["sha256", "symbol"], "left_semi").select("sha256", F.col("line").alias("start_line"), F.lit(True).alias("_falls"))
    claim = F.lower(F.concat_ws(" ", "title", "category", "rule_id"))
    naming = reduce(or_, [claim.contains(marker) for marker in NAMING_MARKERS])
    asked = drafts.where(naming).select("draft_id", "review_id", "file_id", F.col("start_line").alias("line"))
    judged = rename_consensus(asked, facts, files).select("draft_id", "naming_code")
    return (
        places.join(falling, ["sha256", "start_line"], "left").join(judged, "draft_id", "left")
        .withColumns({
            "has_bool_fallback": F.coalesce("_falls", F.lit(False)),
            "has_root_cause": F.col("root_cause").isNotNull(),
            "affected_path": F.col("root_cause")["affected_path"],
        })
        .select(*drafts.columns, "file", "naming_code", "has_bool_fallback", "has_root_cause", "affected_path")
    )


def _named_by(family: DataFrame, class_column: str) -> DataFrame:
    """Snake-case names per class, method and position, each once, with the first and last place that uses it.

    Two places are enough to tell whether anything but the asking method itself uses the name.
    """
    place = F.struct("_file", "_line")
    return (
        family.where(F.col("parameter").rlike(SNAKE_CASE))
        .groupBy("review_id", class_column, "name", "position", "parameter")
        .agg(F.min(place).alias("_low"), F.max(place).alias("_high"))
    )


def _methods(symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """Functions directly inside a class, with the class's name and bases."""
    classes = symbols.where("is_class").select(
        "sha256", F.col("symbol").alias("_class"), F.col("name").alias("class_name"), F.col("start_line").alias("_from"), F.col("end_line").alias("_to")
    )
    bases = kind(facts, "base", _class="ord", base="name").groupBy("sha256", "_class").agg(F.collect_set("base").alias("bases"))
    inside = symbols.where("NOT is_class AND qualified <> name").withColumn(
        "class_name", F.regexp_replace("qualified", r"\.[^.]*$", "")
    )
    owned = inside.join(classes, ["sha256", "class_name"]).where((F.col("start_line") >= F.col("_from")) & (F.col("end_line") <= F.col("_to")))
    nearest = owned.groupBy("sha256", "symbol", "name", "class_name", F.col("start_line").alias("def_line")).agg(
        F.max_by("_class", "_from").alias("_class")
    )
    return nearest.join(bases, ["sha256", "_class"], "left").withColumn("bases", F.coalesce("bases", F.array().cast("array<string>"))).drop("_class")


def rename_callsites(plans: DataFrame, facts: DataFrame, files: DataFrame) -> DataFrame:
    """Keyword call sites of each planned rename and whether applying it is safe.

    ``plans``: verified rows of ``rename_consensus``. Unsafe: use in a nested scope, ``**`` or reflection or an
    unparsable file in the review, call sites in other files, or a name that may be public.
    """
    wanted = plans.where("naming_code = 'verified'").select("draft_id", "review_id", "file_id", "sha256", "symbol", "name", "old_name", "new_name")
    hashes = files.select("review_id", F.col("file_id").alias("_file"), "sha256")
    keywords = hashes.join(kind(facts, "keyword", name="name", keyword="detail", line="line"), "sha256").drop("sha256")
    passed = (
        keywords.where("keyword <> '**'")
        .groupBy("review_id", "name", F.col("keyword").alias("old_name"))
        .agg(F.count(F.lit(1)).alias("callsites"), F.min("_file").alias("_first"), F.max("_file").alias("_last"))
    )
    spread = keywords.where("keyword = '**'").select("review_id", "name", F.lit(True).alias("_spread")).distinct()
    elsewhere = (F.col("_first") != F.col("file_id")) | (F.col("_last") != F.col("file_id"))
    sites = (
        wanted.join(passed, ["review_id", "name", "old_name"], "left")
        .join(spread, ["review_id", "name"], "left")
        .select("draft_id", "callsites", "_spread", elsewhere.alias("_elsewhere"))
    )
    reflected = hashes.join(kind(facts, "reflection", text="name"), "sha256").select("review_id", "text").distinct()
    either = wanted.select("draft_id", "review_id", F.explode(F.array("name", "old_name")).alias("text"))
    by_text = either.join(reflected, ["review_id", "text"]).select("draft_id", F.lit(True).alias("_reflected")).distinct()
    broken = hashes.join(kind(facts, "error", _error="name"), "sha256").select("review_id", F.lit(True).alias("_unparsed")).distinct()
    nested = kind(facts, "nested_use", symbol="ord", old_name="name").withColumn("_nested", F.lit(True)).distinct()
    flags = ["_spread", "_elsewhere", "_reflected", "_unparsed", "_nested"]
    joined = (
        wanted.join(sites, "draft_id", "left")
        .join(by_text, "draft_id", "left")
        .join(broken, "review_id", "left")
        .join(nested, ["sha256", "symbol", "old_name"], "left")
        .fillna(False, flags)
        .fillna(0, ["callsites"])
    )
    public = ~F.col("name").startswith("_")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_nested"), F.lit("nested_scope")),
            F.when(F.col("_spread") | F.col("_reflected") | F.col("_unparsed"), F.lit("dynamic_use")),
            F.when(F.col("_elsewhere"), F.lit("other_files")),
            F.when(public, F.lit("public_name")),
        )
    )
    return joined.withColumn("unsafe_reasons", reasons).select(
        "draft_id", "old_name", "new_name", "callsites", "unsafe_reasons",
        F.when(F.size("unsafe_reasons") == 0, "safe").otherwise("requires_review").alias("safety"),
    )
