"""The dependency graph as views: who imports whom, what a module, namespace or route resolves to, and how much is resolved.

Nothing resolved is stored: an ambiguous or vanished target is simply no row of the view.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors_of, unit_of, url_segments

# Node's own modules; those that exist with the node: prefix only; kinds that resolve to nothing by design.
NODE = [
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net",
    "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
]
NODE_PREFIX_ONLY = ["test", "sqlite", "sea"]
DECLINED_KINDS = ["using_static", "global_using_static"]
JS = ["javascript", "typescript", "tsx"]
PYTHON_ENDINGS = [".py", "/__init__.py", ".pyi"]
JS_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
BARRELS = ["__init__.py", "index.ts", "index.tsx", "index.js", "index.jsx", "index.mjs", "index.cjs"]


def is_barrel(path: Column | str) -> Column:
    """Whether a file only hands on what others define: importers of it may mean any of them."""
    return F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1).isin(BARRELS)


#: Rows of either side of a join that meet in one tile, and pairs that a task is made for.
TILE, TASK_PAIRS, MOST_TASKS = 4_000, 20_000_000, 10_000


def pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The equi-join of two frames whose keys may be few and pairs many: the work is dealt out by pairs, not by rows.

    The rows of a key with more than a tile's on a side are cut into blocks, and each block meets each of the other side in
    a task of its own. Keys of that size are few, and are broadcast. The join is by sorting: of two small sides Spark would
    broadcast one, and leave the other, and all pairs, to a few tasks."""
    a, b = (x.groupBy(*on).agg(F.count(F.lit(1)).alias(n)) for x, n in ((left, "_a"), (right, "_b")))
    both = a.join(b, on)
    n = both.agg(F.sum(F.col("_a").cast("double") * F.col("_b"))).first()[0] or 0.0
    tasks = int(min(max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), n / TASK_PAIRS), MOST_TASKS))
    blocks = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    large = F.broadcast(both.where(F.greatest("_a", "_b") > TILE).select(*on, blocks("_a").alias("_x"), blocks("_b").alias("_y")))
    one = F.lit(1)

    def dealt(rows: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        at = F.pmod(F.xxhash64(*rows.columns), F.coalesce(own, one)).cast("int")
        out = rows.dropna(subset=on).join(large, on, "left").withColumn(mine, at).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1)))
        # one key, exactly what is dealt by: of several, constant ones fall out of the join, and all would be dealt again
        return out.withColumn("_t", F.to_json(F.struct(*on, "_i", "_j"))).drop("_x", "_y", "_i", "_j").repartition(tasks, "_t")

    return dealt(left, "_x", "_y", "_i", "_j").join(dealt(right, "_y", "_x", "_j", "_i").drop(*on).hint("merge"), "_t").drop("_t")


def dependents(imports: DataFrame, files: DataFrame, declarations: DataFrame | None = None) -> DataFrame:
    """target_root, target_path, root_label, rel_path, language: importers by path, and by a namespace declared in the same unit."""
    own = imports.join(files.select("root_label", "rel_path", "language"), ["root_label", "rel_path"])
    by_path = own.where("resolved_path is not null").select(F.col("root_label").alias("target_root"), F.col("resolved_path").alias("target_path"), "root_label", "rel_path", "language")
    if declarations is None:
        return by_path.distinct()
    # each pair once without a shuffle of all pairs: under the least name that both files share, unless it is one by path
    several = lambda c, n: F.when(F.size(c) > n, F.col(c)).alias(c)
    who = own.groupBy("root_label", "rel_path", "language").agg(F.collect_set("module").alias("_m"), F.collect_set("resolved_path").alias("_p"))
    who = who.select("root_label", unit_of("rel_path").alias("unit"), F.explode("_m").alias("module"), "rel_path", "language", several("_m", 1), several("_p", 0))
    what = declarations.groupBy("root_label", F.col("rel_path").alias("target_path")).agg(F.collect_set("symbol").alias("_s"))
    what = what.select("root_label", unit_of("target_path").alias("unit"), F.explode("_s").alias("module"), "target_path", several("_s", 1))
    first = F.col("_m").isNull() | F.col("_s").isNull() | (F.col("module") == F.array_min(F.array_intersect("_m", "_s")))
    new = first & (F.col("_p").isNull() | ~F.array_contains("_p", F.col("target_path")))
    by_name = pairs(who, what, ["root_label", "unit", "module"]).where(new).select(F.col("root_label").alias("target_root"), "target_path", "root_label", "rel_path", "language")
    return by_path.distinct().unionByName(by_name)


def dependencies(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with their target file, unresolved ones kept with a null."""
    target = files.select("root_label", F.col("rel_path").alias("resolved_path"), F.col("doc_type").alias("target_type"))
    return imports.join(target, ["root_label", "resolved_path"], "left")


def by_suffix(edges: DataFrame, files: DataFrame, *, edge: str = "edge_id") -> DataFrame:
    """Absolute dotted modules: edge and the one file of the unit whose path ends in the module's, none if several do.

    Every file is entered under each suffix of its path, so that ends-with is an equi-join."""
    stem = F.regexp_replace(F.regexp_replace("rel_path", r"\.py$", ""), r"/__init__$", "")
    parts = F.split(stem, "/")
    entered = files.select("root_label", unit_of("rel_path").alias("unit"), "rel_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    wanted = edges.select(edge, "root_label", unit_of("rel_path").alias("unit"), F.replace("module", F.lit("."), F.lit("/")).alias("suffix"))
    found = wanted.join(entered, ["root_label", "unit", "suffix"]).groupBy(edge).agg(F.count_distinct("rel_path").alias("n"), F.min("rel_path").alias("resolved_path"))
    return found.where("n = 1").select(edge, "resolved_path")


def declaration_overlap(chunks: DataFrame, declarations: DataFrame, *, by: list[str], chunk: str, declaration: str) -> DataFrame:
    """Each chunk (start_line, end_line) with the declaration of its file that shares most lines with it, the narrower of equals."""
    d = declarations.select(*by, F.col(declaration).alias("_d"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    both = chunks.join(d, by).where((F.col("start_line") <= F.col("_b")) & (F.col("_a") <= F.col("end_line")))
    shared = F.least("end_line", "_b") - F.greatest("start_line", "_a")
    return both.groupBy(chunk).agg(F.max_by("_d", F.struct(shared, F.col("_a") - F.col("_b"), -F.col("_d"))).alias(declaration))


def normalised(path: Column) -> Column:
    """A path without . and .. segments; null if it leaves the root."""
    keep = F.aggregate(
        F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ".")), F.array().cast("array<string>"),
        lambda a, s: F.when(s != "..", F.concat(a, F.array(s))).when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.lit(None).cast("array<string>")),
    )
    return F.array_join(keep, "/")


def candidates(importer: Column, module: Column, language: Column) -> Column:
    """Paths a relative module may stand for, in order of preference."""
    here = F.regexp_replace(importer, r"/?[^/]*$", "")
    dots = F.length(F.regexp_extract(module, r"^(\.+)", 1))
    up = F.concat(here, F.repeat(F.lit("/.."), dots - 1))
    base = normalised(F.concat(up, F.lit("/"), F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))))
    python = F.array(*[F.concat(base, F.lit(e)) for e in PYTHON_ENDINGS])
    target = normalised(F.concat(here, F.lit("/"), module))
    rewritten = F.array(*[F.regexp_replace(target, r"\.(m|c)?js(x?)$", e) for e in (".$1ts$2", ".tsx")])
    js = F.concat(F.array(target), F.filter(rewritten, lambda p: p != target), *[F.array(F.concat(target, F.lit(e))) for e in JS_EXTENSIONS], *[F.array(F.concat(target, F.lit("/index" + e))) for e in JS_EXTENSIONS])
    return F.when(language == "python", python).otherwise(js)


def by_relative(edges: DataFrame, files: DataFrame, *, edge: str = "edge_id") -> DataFrame:
    """Relative modules: edge and the first candidate that is a file."""
    tried = edges.select(edge, "root_label", F.posexplode(candidates(F.col("rel_path"), F.col("module"), F.col("language"))).alias("at", "resolved_path"))
    held = tried.join(files.select("root_label", F.col("rel_path").alias("resolved_path")).distinct(), ["root_label", "resolved_path"])
    return held.groupBy(edge).agg(F.min_by("resolved_path", "at").alias("resolved_path"))


def longest_prefix(paths: DataFrame, roots: DataFrame, *, path: str = "rel_path", root: str = "root") -> DataFrame:
    """Each path with the deepest root above it: an equi-join of its directories with the roots."""
    up = paths.select(path, F.explode(ancestors_of(path)).alias(root)).distinct()
    best = up.join(roots.select(root).distinct(), root).groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
    return paths.join(best, path, "left")


def _literals(segments: Column, n: Column) -> Column:
    """Places, from 0, of the literal ones among the first n segments of a template."""
    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i < n) & ~F.get(segments, i).startswith("{"))


def _at(segments: Column, places: Column) -> Column:
    return F.array_join(F.transform(places, lambda i: F.get(segments, i)), "/")


def match_routes(calls: DataFrame, declarations: DataFrame, *, call: str = "call_id", base: str | None = "api") -> DataFrame:
    """Calls (call_id, template, exact) with the one file whose route they fit (null if none or several).

    Exact calls fit segment by segment ({x} is any segment, {*x} the rest); others as a known beginning. A call that fits
    nothing as written is tried again without the base path.

    A template's shape is how many segments are compared and which of them are literal. Templates are entered under their
    shape and literal segments; a call looks itself up once for each shape of its length, so a fit is an equi-join with no
    pair that doesn't fit, however many routes begin alike."""
    routes = declarations.select(url_segments("template").alias("route"), F.col("rel_path").alias("target")).distinct()
    size = F.size("route")
    catch = F.coalesce(F.get("route", size - 1).startswith("{*"), F.lit(False))
    whole = routes.select("route", "target", F.when(catch, "rest").otherwise("all").alias("how"), F.when(catch, size - 1).otherwise(size).alias("n"))
    begun = routes.where(size > 1).select("route", "target", F.lit("begin").alias("how"), F.explode(F.sequence(F.lit(1), size - 1)).alias("n"))
    entered = whole.unionByName(begun).withColumn("places", F.when(F.col("n") == 0, F.array().cast("array<int>")).otherwise(_literals(F.col("route"), F.col("n"))))
    entered = entered.select("target", "how", "n", "places", _at(F.col("route"), F.col("places")).alias("key"))
    shapes = entered.select("how", "n", "places").distinct()

    def resolve(rows: DataFrame) -> DataFrame:
        n = F.size("segments")
        exact = F.concat(F.array(F.struct(F.lit("all").alias("how"), n.alias("n"))), F.transform(F.sequence(F.lit(0), n), lambda m: F.struct(F.lit("rest").alias("how"), m.alias("n"))))
        asked = rows.withColumn("_s", F.explode(F.when(F.col("exact"), exact).otherwise(F.array(F.struct(F.lit("begin").alias("how"), n.alias("n")))))).select("*", "_s.*")
        keyed = asked.join(shapes, ["how", "n"]).select(call, "how", "n", "places", _at(F.col("segments"), F.col("places")).alias("key"))
        found = keyed.join(entered, ["how", "n", "places", "key"]).groupBy(call).agg(F.count_distinct("target").alias("hits"), F.min("target").alias("target"))
        return found.select(call, F.when(F.col("hits") == 1, F.col("target")).alias("resolved_path"), F.lit(True).alias("hit"))

    own = calls.select(call, "exact", url_segments("template").alias("segments")).where(F.size("segments") > 0)
    first = resolve(own)
    out = calls.join(first, call, "left")
    if base:
        again = own.join(first, call, "left_anti").where(F.get("segments", F.lit(0)) == base)
        second = resolve(again.withColumn("segments", F.slice("segments", F.lit(2), F.size("segments"))).where(F.size("segments") > 0))
        out = out.join(second.select(call, F.col("resolved_path").alias("second")), call, "left").withColumn("resolved_path", F.coalesce("resolved_path", "second")).drop("second")
    return out.drop("hit")


def is_framework(module: Column, language: Column) -> Column:
    head = F.split_part(module, F.lit("."), F.lit(1))
    bare = F.regexp_replace(module, "^node:", "")
    root = F.split_part(bare, F.lit("/"), F.lit(1))
    node = F.when(module.startswith("node:"), True).otherwise(root.isin(NODE))
    return F.when(language == "python", head.isin(sorted(sys.stdlib_module_names))).when(language == "csharp", (module == "System") | module.startswith("System.")).when(language.isin(JS), node).otherwise(False)


def is_declared(module: Column, declared: Column, language: Column) -> Column:
    """Named by a manifest: the module itself or something beneath it."""
    below = lambda d: module.startswith(F.concat(d, F.lit("/"))) | (~language.isin(JS) & module.startswith(F.concat(d, F.lit("."))))
    return F.exists(declared, lambda d: (module == d) | below(d))


def origin(resolved: Column, relative: Column, declared: Column, framework: Column) -> Column:
    return F.when(resolved.isNotNull() | relative, "first_party").when(declared, "declared_dependency").when(framework, "framework").otherwise("unclassified")


def import_coverage(files: DataFrame, imports: DataFrame, by: str = "language") -> DataFrame:
    """For each language: files, and files with an import."""
    n = imports.groupBy("root_label", "rel_path").agg(F.count(F.lit(1)).alias("edges"))
    return files.join(n, ["root_label", "rel_path"], "left").groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("edges") > 0).alias("with_imports"))


def first_party_gate(resolved: Column, total: Column) -> Column:
    """Percent, 100 only if complete; null without first-party imports."""
    return F.when(total == 0, None).when(resolved == total, 100).otherwise(F.least(F.lit(99), F.floor(resolved * 100 / F.nullif(total, F.lit(0))).cast("int")))


def keep_rank(doc_type: Column) -> Column:
    """Order in which dependents are kept when not all fit."""
    return F.when(doc_type == "implementation", 0).when(doc_type == "test", 1).when(doc_type == "reference", 2).when(doc_type == "generated", 4).otherwise(3)


def namespace_targets(imports: DataFrame, declarations: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Imports with every file of their root and unit that declares the namespace (none: no row). `also`: further columns of
    the declarations to hand on."""
    d = declarations.select("root_label", unit_of("rel_path").alias("unit"), F.col("symbol").alias("module"), F.col("rel_path").alias("target_path"), *also)
    return pairs(imports.withColumn("unit", unit_of("rel_path")), d, ["root_label", "unit", "module"]).drop("unit")


def resolution_coverage(imports: DataFrame, by: str) -> DataFrame:
    """For each language: edges that could resolve, and those that do; kinds declined by design don't count."""
    own = imports.where(~F.col("kind").isin(DECLINED_KINDS))
    return own.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count("resolved_path").alias("resolved"))


def route_callers(calls: DataFrame, files: DataFrame) -> DataFrame:
    """Calls with the file that their route leads to, also in another root; calls that lead nowhere are kept."""
    target = files.select(F.col("root_label").alias("resolved_root"), F.col("rel_path").alias("resolved_path"), F.col("language").alias("target_language"))
    return calls.join(target, ["resolved_root", "resolved_path"], "left")


def route_coverage(calls: DataFrame, by: str = "kind") -> DataFrame:
    """For each kind: total, resolved, and the share of calls known exactly."""
    return calls.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count("resolved_path").alias("resolved"), F.round(F.avg(F.col("exact").cast("double")), 6).alias("precision"))


def work_queue(imports: DataFrame, files: DataFrame, only_root: str | None = None) -> DataFrame:
    """Distinct unresolved modules of files that still exist, optionally of one root."""
    own = imports.where("resolved_path is null").join(files.select("root_label", "rel_path").distinct(), ["root_label", "rel_path"], "left_semi")
    own = own if only_root is None else own.where(F.col("root_label") == only_root)
    return own.select("root_label", "rel_path", "module").distinct()


#: What to tell about unresolved edges, by origin; null is an origin not yet known.
UNRESOLVED = {"declared_dependency": "external package", "framework": "standard library", "first_party": "unresolved first-party", "unclassified": "unclassified"}


def unresolved_notes(edges: DataFrame) -> DataFrame:
    """Unresolved edges counted by what to tell about them."""
    note = F.lit("unclassified")
    for origin_, text in UNRESOLVED.items():
        note = F.when(F.col("origin") == origin_, text).otherwise(note)
    return edges.where("resolved_path is null").groupBy(note.alias("note")).agg(F.count(F.lit(1)).alias("n"))


def stale_graph(files: DataFrame, languages: list[str], version: int) -> DataFrame:
    """Files whose edges an older scanner found; they are scanned again without being embedded."""
    return files.where(F.col("language").isin(languages) & (F.coalesce("graph_version", F.lit(0)) < version))


def overlay(hits: DataFrame, diverged: DataFrame, worktree: str) -> DataFrame:
    """Hits with diverged, and the path in the worktree for files that differ there."""
    own = diverged.select("rel_path", F.lit(True).alias("_d")).distinct()
    out = hits.join(own, "rel_path", "left").withColumn("diverged", F.coalesce("_d", F.lit(False)))
    return out.withColumn("shown_path", F.when(F.col("diverged"), F.concat(F.lit(worktree.rstrip("/") + "/"), F.col("rel_path"))).otherwise(F.col("rel_path"))).drop("_d")
