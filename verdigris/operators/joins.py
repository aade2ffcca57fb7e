"""Equi, semi and anti joins between findings, files, decisions, policies and sessions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.arrow import most_similar, similarity
from verdigris.functions.text import glob_to_regex, normalize_evidence
from verdigris.operators.running import earliest, first_n
from verdigris.session import settle

# Thresholds of the name repair, ranks of context references, include syntax.
MIN_SIMILARITY = 0.6
RENAME_SIMILARITY = 0.84
MAX_SIMILAR = 8
# Ratios that are asked for first; a name with eight of them needs no others.
SIMILARITY_ROUNDS = (0.9, 0.75)
CONTEXT_RANKS = {"callee": 10, "caller": 20, "override": 5}
#: Pairs of names of a scope that are compared within one row; scopes with more meet by joins.
SCOPE_PAIRS = 1 << 22
#: Rows of similar names that a task holds before it hands them on.
SIMILAR_ROWS = 10_000
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate"
INCLUDE = r'(?m)^\s*#\s*include\s*"([^"]+)"'


def context_symbols(targets: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Symbols worth showing next to a target: what it calls, who calls it, and its namesakes.

    ``targets`` and ``symbols``: (review_id, symbol_id, name); ``calls``: (review_id, symbol_id, callee).
    A symbol that qualifies twice counts as callee before caller before override.
    """
    edges = calls.select("review_id", "symbol_id", "callee").distinct()
    wanted = targets.select("review_id", F.col("symbol_id").alias("target_id"), F.col("name").alias("target_name"))
    named = symbols.select("review_id", "symbol_id", "name")

    def branch(df: DataFrame, order: int, reason: str) -> DataFrame:
        return df.select("review_id", "target_id", "symbol_id", F.lit(order).alias("branch"), F.lit(reason).alias("reason"))

    of_target = edges.select("review_id", F.col("symbol_id").alias("target_id"), F.col("callee").alias("name"))
    callees = of_target.join(wanted, ["review_id", "target_id"], "left_semi").join(named, ["review_id", "name"])
    callers = edges.withColumnRenamed("callee", "target_name").join(wanted, ["review_id", "target_name"])
    namesakes = wanted.withColumnRenamed("target_name", "name").join(named, ["review_id", "name"])
    found = reduce(
        DataFrame.unionByName,
        [branch(callees, 1, "callee"), branch(callers, 2, "caller"), branch(namesakes, 3, "override")],
    ).where("target_id <> symbol_id")
    rank = F.try_element_at(F.create_map(*[F.lit(item) for pair in CONTEXT_RANKS.items() for item in pair]), F.col("reason"))
    return (
        found.groupBy("review_id", "target_id", "symbol_id")
        .agg(F.min_by("reason", "branch").alias("reason"))
        .withColumn("rank", rank)
    )


def top_refs(refs: DataFrame, imports: DataFrame, limit: int = 12) -> DataFrame:
    """The first references of each target by (rank, path, line); its own imports always come first.

    Both inputs: (target_id, file_id, path, start_line, rank). A place named twice is kept once, at its best rank.
    """
    once = earliest(
        imports.select("target_id", "file_id", "path", "start_line", F.lit(0).alias("rank")).unionByName(
            refs.select("target_id", "file_id", "path", "start_line", "rank")
        ),
        ["target_id", "file_id", "start_line"],
        ["rank", "path"],
    )
    order = Window.partitionBy("target_id").orderBy("rank", "path", "start_line")
    return once.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def nearest_refs(targets: DataFrame, symbols: DataFrame, calls: DataFrame, imports: DataFrame, limit: int = 12) -> DataFrame:
    """``top_refs`` of ``context_symbols``, from lists that are cut before they meet.

    ``symbols``: (review_id, symbol_id, name, file_id, path, start_line); a symbol id stands for one symbol of all reviews.
    Each name keeps only the first places of its symbols and of its callers, so a target meets a few rows per name however
    many symbols share it. A list is long enough when one more place than asked for is in it (the target's own may fall
    out), and that of the callers when as many more are as may be callees at the same time.
    """
    place = ["file_id", "path", "start_line"]
    wanted = targets.select("review_id", F.col("symbol_id").alias("target_id"), "name")
    # Calls of names that neither a symbol nor a target has lead nowhere; they go before calls are made distinct.
    known = symbols.select("review_id", "name").unionByName(wanted.select("review_id", "name")).distinct().withColumnRenamed("name", "callee")
    named = calls.select("review_id", "symbol_id", "callee").join(known, ["review_id", "callee"], "left_semi")
    edges = settle(named.select("review_id", "symbol_id", "callee").distinct(), "named-calls")
    # Two ids per place: if one is the target itself, the other still holds the place.
    held = [F.min("symbol_id").alias("low"), F.max("symbol_id").alias("high")]

    def first_places(rows: DataFrame, by: str, most: int) -> DataFrame:
        places = rows.groupBy("review_id", by, *place).agg(*held)
        return settle(first_n(places, ["review_id", by], [F.col("path"), F.col("start_line"), F.col("file_id")], most).drop("rank"), "name-places")

    by_symbol = symbols.select("review_id", "symbol_id", "name", *place)
    own_calls = edges.withColumnRenamed("callee", "name")
    recursive = by_symbol.select("review_id", "symbol_id", "name").join(own_calls, ["review_id", "symbol_id", "name"], "left_semi")
    namesakes = first_places(by_symbol, "name", limit + 1)
    # A namesake that calls its own name is a caller, and of a target that does so all namesakes are callees.
    plain = first_places(by_symbol.join(recursive, ["review_id", "symbol_id", "name"], "left_anti"), "name", limit + 1)
    callers = first_places(edges.join(by_symbol.drop("name"), ["review_id", "symbol_id"]), "callee", 2 * limit + 1)

    callees = (
        own_calls.withColumnRenamed("symbol_id", "target_id").join(wanted.select("review_id", "target_id").distinct(), ["review_id", "target_id"], "left_semi")
        .join(namesakes, ["review_id", "name"]).withColumn("rank", F.lit(CONTEXT_RANKS["callee"]))
    )
    calling = wanted.join(callers.withColumnRenamed("callee", "name"), ["review_id", "name"]).withColumn("rank", F.lit(CONTEXT_RANKS["caller"]))
    selfish = recursive.withColumnRenamed("symbol_id", "target_id").select("review_id", "target_id", "name")
    overrides = (
        wanted.join(selfish, ["review_id", "target_id", "name"], "left_anti").join(plain, ["review_id", "name"])
        .withColumn("rank", F.lit(CONTEXT_RANKS["override"]))
    )
    columns = ["target_id", *place, "rank"]
    found = reduce(DataFrame.unionByName, [df.select(*columns, "low", "high") for df in (callees, calling, overrides)])
    alone = (F.col("low") == F.col("high")) & (F.col("low") == F.col("target_id"))
    return top_refs(found.where(~alone).select(columns), imports, limit)


def normal_path(path: Column) -> Column:
    """Path with ``.`` and ``..`` resolved; a leading climb stays."""

    def step(kept: Column, part: Column) -> Column:
        climbs = (F.size(kept) > 0) & (F.coalesce(F.element_at(kept, -1), F.lit("..")) != "..")
        return (
            F.when((part == "") | (part == "."), kept)
            .when((part == "..") & climbs, F.slice(kept, F.lit(1), F.size(kept) - 1))
            .otherwise(F.array_append(kept, part))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _only_path_ending(asked: DataFrame, paths: DataFrame) -> DataFrame:
    """``review_id``, ``suffix``, ``target``: suffixes that exactly one path of the review ends with.

    Paths and suffixes are read backwards and sorted together: the paths that end with a suffix stand right behind it. So each
    suffix only looks at the next two paths, and there is one row per path and per suffix. All that can match end in the
    same character, by which each review is dealt.
    """
    key = ["review_id", "_last"]
    backwards = lambda name: {"_back": F.reverse(name), "_last": F.right(F.col(name), F.lit(1))}
    placed = paths.where(F.col("target") != "").withColumns(backwards("target"))
    after = F.lead("target").over(Window.partitionBy(*key).orderBy("_back"))
    there = placed.select(*key, "_back", F.lit(1).alias("_path"), F.lit(None).cast("string").alias("suffix"), F.struct("target", after.alias("after")).alias("_here"))
    wanted = asked.withColumns(backwards("suffix")).select(*key, "_back", F.lit(0).alias("_path"), "suffix", F.lit(None).cast("struct<target:string,after:string>").alias("_here"))
    behind = Window.partitionBy(*key).orderBy(F.desc("_back"), F.desc("_path")).rowsBetween(Window.unboundedPreceding, -1)
    found = there.unionByName(wanted).withColumn("_next", F.last("_here", ignorenulls=True).over(behind)).where("_path = 0")
    one = F.col("_next.target").endswith(F.col("suffix")) & ~F.coalesce(F.col("_next.after").endswith(F.col("suffix")), F.lit(False))
    return found.where(one).select("review_id", "suffix", F.col("_next.target").alias("target"))


def resolve_includes(files: DataFrame) -> DataFrame:
    """``#include "..."`` of each file → the project file it means: relative path first, else a unique suffix.

    ``files``: (review_id, path, content).
    """
    includes = files.select(
        "review_id", F.col("path").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(INCLUDE), F.lit(1)))).alias("include")
    ).distinct()
    folder = F.regexp_replace("source", "[^/]*$", "")
    wanted = includes.withColumns(
        {
            "candidate": normal_path(F.concat(folder, F.col("include"))),
            "suffix": F.regexp_replace("include", r"^[./]+", ""),
        }
    )
    paths = files.select("review_id", F.col("path").alias("target")).distinct()
    exact = wanted.join(paths.withColumn("candidate", F.col("target")), ["review_id", "candidate"], "left")
    hits = exact.where(F.col("target").isNotNull()).select("review_id", "source", "include", "target", F.lit(0).alias("rank"))
    rest = exact.where(F.col("target").isNull() & (F.col("suffix") != "")).drop("target")
    unique = _only_path_ending(rest.select("review_id", "suffix").distinct(), paths)
    by_suffix = rest.join(unique, ["review_id", "suffix"]).select(
        "review_id", "source", "include", "target", F.lit(10).alias("rank")
    )
    return hits.unionByName(by_suffix).where("source <> target")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Module name → ``a/b.py`` if it exists, else ``a/b/__init__.py``. Unresolved imports are dropped."""
    base = F.replace("module", F.lit("."), F.lit("/"))
    paths = files.select("review_id", "path").distinct()
    as_file = paths.withColumn("_file", F.col("path")).withColumnRenamed("path", "_as_file")
    as_package = paths.withColumn("_package", F.col("path")).withColumnRenamed("path", "_as_package")
    candidates = imports.withColumns({"_file": F.concat(base, F.lit(".py")), "_package": F.concat(base, F.lit("/__init__.py"))})
    joined = candidates.join(as_file, ["review_id", "_file"], "left").join(as_package, ["review_id", "_package"], "left")
    resolved = joined.withColumn("path", F.coalesce("_as_file", "_as_package"))
    return resolved.where(F.col("path").isNotNull()).select(*imports.columns, "path")


def module_name(path: str | Column) -> Column:
    """Project path → importable module name."""
    value = F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/"))
    trimmed = F.regexp_replace(value, r"(/__init__\.py|\.py)$", "")
    return F.replace(F.trim(trimmed, F.lit("/")), F.lit("/"), F.lit("."))


def _marked(df: DataFrame, scope: list[str], name: str) -> DataFrame:
    """Distinct names with their characters as tokens (character and occurrence), rare letters first."""
    ranked = F.translate(F.col(name), RARE_FIRST, "".join(sorted(RARE_FIRST)))
    chars = F.filter(F.split(ranked, ""), lambda char: char != "")
    earlier = lambda char, at: F.size(F.filter(F.slice(chars, F.lit(1), at + 1), lambda other: other == char))
    tokens = F.sort_array(F.transform(chars, lambda char, at: F.concat(char, earlier(char, at).cast("string"))))
    return df.select(*scope, name).distinct().withColumn("_tokens", tokens).where(F.size("_tokens") > 0)


def character_pairs(wanted: DataFrame, visible: DataFrame, scope: list[str], minimum: float) -> DataFrame:
    """Pairs of different names whose shared characters, counted with multiplicity, allow a ratio of ``minimum``: ``shared``.

    The ratio 2M/T cannot exceed 2 * shared / total. Names that reach it share one of their first few tokens in one order.
    A pair is made at the least token of both only, so no pair is made twice and none has to be made distinct; the
    lengths, and the tokens that are left from there on, sort out pairs before their tokens are compared.
    """
    share = minimum / (2 - minimum)

    def listed(df: DataFrame, side: str) -> DataFrame:
        n = F.size("_tokens")
        prefix = F.slice("_tokens", F.lit(1), n - F.ceil(n * share - 1e-9).cast("int") + 1)
        rows = df.withColumns({f"_n{side}": n, f"_head{side}": prefix}).withColumnRenamed("_tokens", f"_tokens{side}")
        return rows.select("*", F.posexplode(f"_head{side}").alias(f"_at{side}", "_token"))

    left, right = listed(_marked(wanted, scope, "name"), "1"), listed(_marked(visible, scope, "candidate"), "2")
    total = F.col("_n1") + F.col("_n2")
    enough = lambda most: 2 * most >= minimum * total - 1e-9
    return (
        left.join(right, [*scope, "_token"])
        .where((F.col("name") != F.col("candidate")) & enough(F.least("_n1", "_n2")) & enough(F.least(F.col("_n1") - F.col("_at1"), F.col("_n2") - F.col("_at2"))))
        .where(F.array_min(F.array_intersect("_head1", "_head2")) == F.col("_token"))
        .withColumn("shared", F.size(F.array_intersect("_tokens1", "_tokens2")))
        .where(enough(F.col("shared")))
        .select(*scope, "name", "candidate", "shared")
    )


def similar_names(wanted: DataFrame, visible: DataFrame, scope: list[str], minimum: float = MIN_SIMILARITY) -> DataFrame:
    """Visible names similar to an unresolved one, best eight per name.

    A scope of few pairs, as a file is, is compared as a whole within one row. The names of larger ones meet by joins.
    """
    names, candidates = [*scope, "name"], [*scope, "candidate"]
    wanted = settle(wanted.select(names).where("name <> ''").distinct(), "wanted-names")
    visible = settle(visible.select(candidates).where("candidate <> ''").distinct(), "visible-names")
    size = lambda df, side: df.groupBy(*scope).agg(F.count(F.lit(1)).alias(side))
    pairs = F.col("_names").cast("double") * F.col("_candidates")
    large = settle(size(wanted, "_names").join(size(visible, "_candidates"), scope).where(pairs > SCOPE_PAIRS).select(scope), "large-scopes")
    if large.isEmpty():
        return _similar_in_scopes(wanted, visible, scope, minimum)
    few = _similar_in_scopes(wanted.join(large, scope, "left_anti"), visible.join(large, scope, "left_anti"), scope, minimum)
    many = _similar_by_rounds(wanted.join(large, scope, "left_semi"), visible.join(large, scope, "left_semi"), scope, minimum)
    return few.unionByName(many.select(few.columns))


def _similar_in_scopes(wanted: DataFrame, visible: DataFrame, scope: list[str], minimum: float) -> DataFrame:
    """``similar_names`` of distinct names, where those of a scope fit in a row."""
    listed = wanted.groupBy(*scope).agg(F.collect_list("name").alias("_names"))
    held = listed.join(visible.groupBy(*scope).agg(F.collect_list("candidate").alias("_candidates")), scope)
    held = held.select(*scope, "_names", "_candidates")
    kinds = T.StructType([held.schema[name] for name in scope])
    schema = kinds.add("name", T.StringType()).add("candidate", T.StringType()).add("ratio", T.DoubleType()).add("position", T.IntegerType())
    return held.mapInArrow(partial(_similar_of_batches, minimum=minimum, most=MAX_SIMILAR), schema)


def _similar_of_batches(batches: Iterator[pa.RecordBatch], minimum: float, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *keys, names, candidates = batch.columns
        begin = 0
        while begin < batch.num_rows:
            rows, of = [], []
            while begin < batch.num_rows and len(rows) < SIMILAR_ROWS:
                found = list(most_similar(names[begin].as_py(), candidates[begin].as_py(), minimum, most))
                rows.extend(found)
                of.extend([begin] * len(found))
                begin += 1
            if rows:
                values = [pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.string(), pa.string(), pa.float64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(key.take(pa.array(of)) for key in keys), *values], [*batch.schema.names[:-2], "name", "candidate", "ratio", "position"])


def _similar_by_rounds(wanted: DataFrame, visible: DataFrame, scope: list[str], minimum: float) -> DataFrame:
    """``similar_names`` of distinct names by joins.

    A top-k join with a falling threshold: all pairs of a high ratio are found first, and a name that has eight of them is
    done, since none of the others can be among its best. The next round asks for less, but only for the names still open.
    """
    names = [*scope, "name"]
    open_names = settle(wanted, "open-names")
    order = Window.partitionBy(*names).orderBy(F.desc("ratio"), "candidate")
    found = None
    for least in (*(one for one in SIMILARITY_ROUNDS if one > minimum), minimum):
        pairs = character_pairs(open_names, visible, scope, least).drop("shared")
        scored = pairs.withColumn("ratio", similarity("name", "candidate")).where(F.col("ratio") >= least)
        best = scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= MAX_SIMILAR)
        if least > minimum:
            best = settle(best, "similar-names")
            full = best.where(F.col("position") == MAX_SIMILAR).select(names)
            best, open_names = best.join(full, names, "left_semi"), settle(open_names.join(full, names, "left_anti"), "open-names")
        found = best if found is None else found.unionByName(best.select(found.columns))
    return found


def repair_plan(wanted: DataFrame, similar: DataFrame, exports: DataFrame, scope: list[str]) -> DataFrame:
    """What can be done about an unresolved name: rename, import, or ask.

    ``exports``: scope columns, name, path of project files that define the name at module level, a row each; or counted, with
    a column ``exports``, and the path where there is just one.
    """
    close = (
        similar.where(F.col("ratio") >= RENAME_SIMILARITY)
        .groupBy(*scope, "name")
        .agg(F.count(F.lit(1)).alias("_close"), F.min("candidate").alias("_replacement"))
    )
    if "exports" in exports.columns:
        exported = exports.select(*scope, "name", F.col("exports").alias("_exports"), F.col("path").alias("_path"))
    else:
        exported = exports.groupBy(*scope, "name").agg(F.count(F.lit(1)).alias("_exports"), F.min("path").alias("_path"))
    joined = wanted.select(*scope, "name").distinct().join(close, [*scope, "name"], "left").join(exported, [*scope, "name"], "left")
    mode = (
        F.when(F.col("_close") == 1, "rename")
        .when(F.col("_close").isNull() & (F.col("_exports") == 1), "import")
        .otherwise("needs_intent")
    )
    return joined.withColumn("mode", mode).select(
        *scope,
        "name",
        "mode",
        F.when(F.col("mode") == "rename", F.col("_replacement")).alias("replacement"),
        F.when(F.col("mode") == "import", module_name("_path")).alias("module"),
    )


def policy_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Policy rules in their order, globs compiled to patterns. The policy is configuration, a few rows."""
    rows = [
        (
            at,
            rule["rule_id"],
            rule.get("enabled", True),
            rule.get("severity"),
            [glob_to_regex(glob) for glob in rule.get("include_paths", ["**"])],
            [glob_to_regex(glob) for glob in rule.get("exclude_paths", [])],
            rule.get("allowed_fix_safety", ["safe", "requires_review"]),
        )
        for at, rule in enumerate(rules)
    ]
    return spark.createDataFrame(
        rows,
        "ord int, rule_id string, enabled boolean, new_severity string, include array<string>, exclude array<string>, allowed_fix_safety array<string>",
    )


def apply_policy(findings: DataFrame, policy: DataFrame) -> DataFrame:
    """Hide, re-rate or hold back findings by the first policy rule for their rule id."""
    rules = earliest(policy, ["rule_id"], ["ord"]).drop("ord")
    joined = findings.join(rules, "rule_id", "left")
    matches = lambda patterns: F.exists(patterns, lambda pattern: F.rlike(F.col("path"), pattern))
    in_scope = matches("include") & ~matches("exclude")
    untouched = F.col("enabled").isNull()
    allowed = F.array_contains("allowed_fix_safety", F.col("fix_safety"))
    return (
        joined.where(untouched | (F.col("enabled") & in_scope))
        .withColumns(
            {
                "applicability": F.when(untouched | allowed, F.col("applicability")).otherwise("requires_review"),
                "severity": F.coalesce("new_severity", "severity"),
            }
        )
        .select(*findings.columns)
    )


def diff_bundle(revisions: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: the text before its first active revision against the current text; equal ones are left out."""
    first = (
        revisions.where(F.col("undone_at").isNull())
        .groupBy("review_id", "file_id")
        .agg(F.min_by("before_content", F.struct("created_at", "revision_id")).alias("before_content"))
    )
    current = files.select("review_id", "file_id", F.col("content").alias("after_content"))
    return first.join(current, ["review_id", "file_id"]).where(F.col("before_content") != F.col("after_content"))


def static_identity(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.select(*keys, "rule_id", normalize_evidence("evidence").alias("identity_evidence"))


def introduced_findings(base: DataFrame, candidate: DataFrame, keys: list[str], include_syntax: bool = False) -> DataFrame:
    """Findings of the candidate that the base does not have, by (rule, evidence)."""
    identity = [*keys, "rule_id", "identity_evidence"]
    rows = candidate.withColumn("identity_evidence", normalize_evidence("evidence"))
    fresh = rows.join(static_identity(base, keys).distinct(), identity, "left_anti").drop("identity_evidence")
    return fresh if include_syntax else fresh.where("rule_id <> 'python.syntax-error'")


def still_present(targets: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Targets whose problem the candidate still has; a syntax error counts whatever its evidence is."""
    any_evidence = F.when(F.col("rule_id") == "python.syntax-error", "").otherwise(normalize_evidence("evidence"))
    identity = [*keys, "rule_id", "_evidence"]
    there = candidate.select(*keys, "rule_id", any_evidence.alias("_evidence")).distinct()
    return targets.withColumn("_evidence", any_evidence).join(there, identity, "left_semi").drop("_evidence")


def _seen_by(anchors: DataFrame, flags: dict[str, Column], within: tuple[str, ...]) -> DataFrame:
    """Anchors with whether one of the same review and fingerprint has each flag."""
    same = Window.partitionBy(*within, "review_id", "fingerprint")
    known = F.col("review_id").isNotNull() & F.col("fingerprint").isNotNull()
    return anchors.withColumns({name: known & F.max(F.coalesce(flag, F.lit(False))).over(same) for name, flag in flags.items()})


def suppress_ignored(findings: DataFrame, anchors: DataFrame, ignored: DataFrame | Column, within: tuple[str, ...] = ()) -> DataFrame:
    """Findings none of whose identity hashes is ignored in their review.

    ``ignored`` may be a condition, where the ignored hashes are some of the anchors. ``within`` are then columns that are
    equal wherever the hashes of a review are: anchors that lie together by them are not shuffled.
    """
    if isinstance(ignored, Column):
        hidden = _seen_by(anchors, {"_hidden": ignored}, within).where("_hidden")
    else:
        hidden = anchors.join(ignored.select("review_id", "fingerprint").distinct(), ["review_id", "fingerprint"], "left_semi")
    return findings.join(hidden.select("finding_id").distinct(), "finding_id", "left_anti")


def reopen_fixed(fixed: DataFrame, current: DataFrame | Column, within: tuple[str, ...] = ()) -> DataFrame:
    """States after a recheck, as (review_id, finding_id, state).

    Both inputs: (review_id, finding_id, fingerprint), several rows per finding. A fixed finding seen again
    is reopened, otherwise verified; a current finding that matches a fixed one is reopened, otherwise active.
    ``current`` may be a condition, where one table has both; for ``within`` see ``suppress_ignored``.
    """
    columns = [*within, "review_id", "finding_id", "fingerprint"]
    if isinstance(current, Column):
        anchors = fixed.select(*columns, F.coalesce(current, F.lit(False)).alias("_is_current"))
    else:
        sides = [rows.select(*columns, F.lit(which).alias("_is_current")) for rows, which in ((fixed, False), (current, True))]
        anchors = sides[0].unionByName(sides[1])
    is_current = F.col("_is_current")
    seen = _seen_by(anchors, {"_in_current": is_current, "_in_fixed": ~is_current}, within)
    again = F.when(is_current, F.col("_in_fixed")).otherwise(F.col("_in_current"))
    judged = seen.groupBy("review_id", "finding_id", "_is_current").agg(F.max(again).alias("_again"))
    otherwise = F.when(is_current, "active").otherwise("fixed_verified")
    return judged.select("review_id", "finding_id", F.when(F.col("_again"), "reopened").otherwise(otherwise).alias("state"))


def valid_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions that are not expired and whose user is active."""
    active = users.where("is_active").select("user_id")
    return sessions.where(F.col("expires_at") > now).join(active, "user_id", "left_semi")


def merge_attachments(current: DataFrame, added: DataFrame, keys: list[str], replace_source: str | None = None) -> DataFrame:
    """Added files win over current ones of the same path; one source may be replaced as a whole."""
    kept = current if replace_source is None else current.where(~F.col("source").eqNullSafe(F.lit(replace_source)))
    return kept.join(added.select(*keys).distinct(), keys, "left_anti").unionByName(added)


def forget_paths(origin: DataFrame, removed: DataFrame, map_columns: list[str]) -> DataFrame:
    """Drop removed paths from the per-path maps (ranges, hashes) of each review."""
    gone = removed.groupBy("review_id").agg(F.collect_set("path").alias("_gone"))
    joined = origin.join(gone, "review_id", "left")
    cleared = {
        name: F.when(F.col("_gone").isNull(), F.col(name)).otherwise(
            F.map_filter(name, lambda path, _: ~F.array_contains("_gone", path))
        )
        for name in map_columns
    }
    return joined.withColumns(cleared).drop("_gone")
