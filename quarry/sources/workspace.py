"""Files of a workspace as tables: walking folders, ignore rules, reading, imports, namespaces and routes, commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.text import ancestors_of, glob_regex, unit_of
from ..operators.graph import longest_prefix


_LISTED = "path string, is_dir boolean, size long, mtime timestamp, content binary"


def _listing(root: str, content: bool, max_bytes: int):
    """Lists directories (rows: path below the root) in tasks, so that nothing of the tree comes to the driver."""

    def run(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        types = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC")), ("content", pa.binary())])
        base = base.rstrip("/")
        local = isinstance(store, fs.LocalFileSystem)
        for batch in batches:
            rows, held = [], 0
            for folder in batch.column(0).to_pylist():
                for x in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)):
                    rel = x.path[len(base) :].lstrip("/")
                    is_dir = x.type == fs.FileType.Directory
                    if local and os.path.islink(x.path) or is_dir and local and os.path.isfile(f"{x.path}/.git"):
                        continue  # links and linked worktrees lead elsewhere
                    body = None
                    if content and not is_dir and x.size is not None and x.size <= max_bytes:
                        with store.open_input_stream(x.path) as stream:
                            body = stream.read()
                    rows.append({"path": rel, "is_dir": is_dir, "size": None if is_dir else x.size, "mtime": x.mtime, "content": body})
                    held += len(body or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=types)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=types)

    return run


def walk(spark: SparkSession, root: str, label: str, *, content: bool = False, max_bytes: int = 1 << 20, prune: list[str] = ()) -> DataFrame:
    """Every file below a folder, hidden and empty ones too: root_label, rel_path, size, mtime (and content up to max_bytes).

    Level by level, each directory listed in a task; .git, links, linked worktrees and directories that a glob of `prune`
    fits are not entered. A folder that isn't there gives no rows (observable() tells it from an empty one)."""
    level = spark.createDataFrame([("",)], "path string")
    levels = []
    while True:
        found = level.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(_listing(root, content, max_bytes), _LISTED).persist()
        levels.append(found.where("not is_dir"))
        into = found.where(F.col("is_dir") & (F.substring_index("path", "/", -1) != ".git"))
        for pattern in prune:
            into = into.where(~F.concat(F.lit("/"), F.col("path"), F.lit("/")).rlike(glob_regex(pattern)))
        level = into.select("path")
        if level.isEmpty():
            break
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select(F.lit(label).alias("root_label"), F.col("path").alias("rel_path"), "size", "mtime", *(["content"] if content else []))


def observable(spark: SparkSession, roots: dict[str, str]) -> dict[str, bool]:
    """For each label whether its folder is there: files of one that isn't are unseen, not gone."""
    out = {}
    for label, root in roots.items():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out[label] = fs.exists(path) and fs.getFileStatus(path).isDirectory()
    return out


def candidates(files: DataFrame, *, max_bytes: int = 1 << 20, excluded: list[str] = ()) -> DataFrame:
    """With kind, language, unit and skip_reason (null for files to be read)."""
    kind = classify.classify_file("rel_path")
    out = files.withColumn("_k", kind).withColumn("unit", unit_of("rel_path"))
    return out.withColumn("kind", F.col("_k.kind")).withColumn("language", F.col("_k.language")).withColumn("skip_reason", classify.skip_reason("rel_path", "size", max_bytes, list(excluded))).drop("_k")


def tallies(judged: DataFrame) -> DataFrame:
    return judged.where("skip_reason is not null").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


def ignore_rules(files: DataFrame) -> DataFrame:
    """Rules of ignore files (rel_path, content): dir, ord, regex over paths below dir, negated, dir_only."""
    lines = files.where(F.substring_index("rel_path", "/", -1) == ".gitignore").select(F.regexp_replace("rel_path", r"/?[^/]*$", "").alias("dir"), F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("ord", "line"))
    rule = F.regexp_replace("line", r"(?<!\\)[ \t]+$", "")
    own = lines.withColumn("rule", rule).where((F.col("rule") != "") & ~F.col("rule").startswith("#"))
    own = own.withColumn("negated", F.col("rule").startswith("!")).withColumn("rule", F.regexp_replace("rule", r"^[!\\]", ""))
    own = own.withColumn("dir_only", F.col("rule").endswith("/")).withColumn("rule", F.regexp_replace("rule", "/+$", ""))
    anchored = F.regexp_replace("rule", "^/", "").alias("body")
    own = own.withColumn("free", ~F.col("rule").contains("/")).withColumn("body", anchored)
    escaped = F.regexp_replace("body", r"([.^$+{}()|\\])", r"\\$1")
    starred = F.replace(F.replace(F.replace(escaped, F.lit("**/"), F.lit("\x01")), F.lit("/**"), F.lit("\x02")), F.lit("*"), F.lit("[^/]*"))
    body = F.replace(F.replace(F.replace(starred, F.lit("?"), F.lit("[^/]")), F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit("/.*"))
    return own.select("dir", "ord", "negated", "dir_only", F.concat(F.when(F.col("free"), F.lit("^(?:.*/)?")).otherwise(F.lit("^")), body, F.lit("$")).alias("regex"))


def ignored(files: DataFrame, rules: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """rel_path of files that the last rule to fit them, or a directory above them, ignores; tracked files are kept.

    Each file and each directory above it meets the rules of the directories above that: an equi-join on dir."""
    up = files.select("rel_path", F.explode(F.concat(ancestors_of("rel_path"), F.array("rel_path"))).alias("at"))
    up = up.withColumn("is_dir", F.col("at") != F.col("rel_path"))
    near = up.withColumn("dir", F.explode(F.concat(F.array(F.lit("")), ancestors_of("at"))))
    fits = near.join(rules, "dir").where((F.col("is_dir") | ~F.col("dir_only")) & F.expr("rlike(if(dir = '', at, substring(at, length(dir) + 2)), regex)"))
    last = fits.groupBy("rel_path", "at").agg(F.max_by("negated", F.struct(F.length("dir"), "ord")).alias("negated"))
    out = last.where(~F.col("negated")).select("rel_path").distinct()
    return out if tracked is None else out.join(tracked.select("rel_path"), "rel_path", "left_anti")


def attribute(files: DataFrame, repos: DataFrame, *, root: str = "root") -> DataFrame:
    """Each file with the deepest repository above it."""
    return longest_prefix(files, repos, root=root)


def read_text(files: DataFrame) -> DataFrame:
    """content as text (a byte-order mark aside), sha256, and kind opaque for content with a NUL in its first 8 KiB or that
    isn't UTF-8. Line ends stay as they are."""
    raw = F.col("content")
    bare = F.when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", F.substring(raw, 4, 1 << 30)).otherwise(raw)
    nul = F.instr(F.decode(F.substring(raw, 1, 8192), "ISO-8859-1"), "\0") > 0
    ok = ~nul & F.is_valid_utf8(bare.cast("string"))
    out = files.withColumn("sha256", F.sha2(raw, 256)).withColumn("text", F.when(ok, bare.cast("string")))
    return out.withColumn("kind", F.when(ok, F.col("kind")).otherwise("opaque")).withColumn("language", F.when(ok, F.col("language"))).drop("content")


_IMPORTS = {
    "python": [(r"^\s*from\s+(\.+[\w.]*|[\w.]+)\s+import\b", "import"), (r"^\s*import\s+([\w.]+)", "import")],
    "javascript": [(r"""^\s*import\b[^'"]*['"]([^'"]+)['"]""", "import"), (r"""^\s*export\b[^'"]*\bfrom\s*['"]([^'"]+)['"]""", "re_export"), (r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""", "require")],
    "csharp": [(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", "using")],
}
_IMPORTS |= {"typescript": _IMPORTS["javascript"], "tsx": _IMPORTS["javascript"]}


def _lines(files: DataFrame) -> DataFrame:
    return files.select("root_label", "rel_path", "language", F.posexplode(F.split("text", "\r\n|\n|\r", -1)).alias("line", "code")).withColumn("line", F.col("line") + 1)


def csharp_kind(code: Column) -> Column:
    world, static = code.rlike(r"^\s*global\s"), code.rlike(r"\busing\s+static\b")
    return F.when(world & static, "global_using_static").when(world, "global_using").when(static, "using_static").otherwise("using")


def imports(files: DataFrame) -> DataFrame:
    """root_label, rel_path, module, line, kind, is_relative of every import, one line at a time."""
    lines = _lines(files)
    found = None
    for language, rules in _IMPORTS.items():
        own = lines.where(F.col("language") == language)
        parts = None
        for pattern, kind in rules:
            hit = own.where(F.col("code").rlike(pattern)).select("root_label", "rel_path", "language", "line", F.regexp_extract("code", pattern, 1).alias("module"), (csharp_kind(F.col("code")) if language == "csharp" else F.lit(kind)).alias("kind"))
            parts = hit if parts is None else parts.unionByName(hit)
        found = parts if found is None else found.unionByName(parts)
    return found.where("module <> ''").withColumn("is_relative", F.col("module").startswith(".")).distinct()


def namespaces(files: DataFrame) -> DataFrame:
    """Declared C# namespaces: root_label, rel_path, symbol, line, kind. A block inside a block is Outer.Inner: brace depth is a
    running sum over the lines of a file."""
    from pyspark.sql import Window

    lines = _lines(files.where("language = 'csharp'"))
    w = Window.partitionBy("root_label", "rel_path").orderBy("line")
    opened = F.regexp_count("code", F.lit(r"\{")) - F.regexp_count("code", F.lit(r"\}"))
    deep = lines.withColumn("depth", F.coalesce(F.sum(opened).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pattern = r"^\s*namespace\s+([\w.]+)\s*(;)?"
    own = deep.where(F.col("code").rlike(pattern)).select("root_label", "rel_path", "line", "depth", F.regexp_extract("code", pattern, 1).alias("name"), F.when(F.regexp_extract("code", pattern, 2) == ";", "file").otherwise("block").alias("kind"))
    above = own.select("root_label", "rel_path", F.col("line").alias("l2"), F.col("depth").alias("d2"), F.col("name").alias("n2"))
    outer = own.join(above, ["root_label", "rel_path"]).where("l2 < line and d2 < depth").groupBy("root_label", "rel_path", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d2", "n2"))), lambda x: x["n2"]), ".").alias("outer"))
    return own.join(outer, ["root_label", "rel_path", "line"], "left").select("root_label", "rel_path", F.concat_ws(".", "outer", "name").alias("symbol"), "line", "kind")


def route_calls(files: DataFrame, clients: list[str] = ("fetch", "axios", "http")) -> DataFrame:
    """Calls of HTTP clients: template, exact (a literal) or its known beginning (a template literal), line."""
    names = "|".join(clients)
    literal = rf"""\b(?:{names})(?:\.\w+)?\(\s*(['"])([^'"]+)\1"""
    pattern = rf"\b(?:{names})(?:\.\w+)?\(\s*`([^`$]*)(\$\{{)?"
    lines = _lines(files)
    a = lines.where(F.col("code").rlike(literal)).select("root_label", "rel_path", "line", F.regexp_extract("code", literal, 2).alias("template"), F.lit(True).alias("exact"))
    b = lines.where(F.col("code").rlike(pattern)).select("root_label", "rel_path", "line", F.regexp_extract("code", pattern, 1).alias("template"), (F.regexp_extract("code", pattern, 2) == "").alias("exact"))
    return a.unionByName(b).where("template <> ''")


def route_declarations(files: DataFrame) -> DataFrame:
    """Routes declared by minimal APIs (groups of the file included), attributes of controllers, and pages."""
    from pyspark.sql import Window

    from ..functions.text import expand_controller, join_route, page_route

    lines = _lines(files)
    w = Window.partitionBy("root_label", "rel_path").orderBy("line")
    mapped = r"""\.Map(Get|Post|Put|Delete|Patch)\(\s*"([^"]*)"|^\s*\[Http(Get|Post|Put|Delete|Patch)(?:\(\s*"([^"]*)"\s*\))?\]"""
    group = F.regexp_extract("code", r"""\.MapGroup\(\s*"([^"]*)"\s*\)""", 1)
    route = F.regexp_extract("code", r"""^\s*\[Route\(\s*"([^"]*)"\s*\)\]""", 1)
    named = F.regexp_extract("code", r"\bclass\s+(\w+)", 1)
    carry = lambda c: F.last(F.nullif(c, F.lit("")), True).over(w)
    own = lines.where("language = 'csharp'").withColumn("group", carry(group)).withColumn("route", carry(route)).withColumn("class", carry(named))
    own = own.where(F.col("code").rlike(mapped))
    minimal = F.col("code").contains(".Map")
    action = F.when(minimal, F.regexp_extract("code", mapped, 2)).otherwise(F.regexp_extract("code", mapped, 4))
    template = F.when(minimal, join_route(F.coalesce("group", F.lit("")), action)).otherwise(join_route(expand_controller(F.coalesce("route", F.lit("")), F.coalesce("class", F.lit(""))), action))
    pages = files.where(F.col("text").rlike(r"(?m)^@page\b")).select("root_label", "rel_path", F.lit(1).alias("line"), F.coalesce(F.nullif(F.regexp_extract("text", r"""(?m)^@page\s+"([^"]*)\"""", 1), F.lit("")), page_route("rel_path")).alias("template"))
    return own.select("root_label", "rel_path", "line", template.alias("template")).unionByName(pages).where("template is not null")


def excluded(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out
