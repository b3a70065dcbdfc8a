"""Keyed reads of the ledger and the graph: edges of a file, declarations, spaces, counts, documents, what a store can be asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unit_of

#: Fields that a search may filter on.
FILTERABLE = [
    "workspace", "root_label", "unit", "rel_path", "ancestors", "ext", "kind", "language", "repo_name", "repo_branch", "symbol_kind", "doc_type", "content_sha", "space_slug",
]


def _of_file(rows: DataFrame, root: str, path: str) -> DataFrame:
    return rows.where((F.col("root_label") == F.lit(root)) & (F.col("rel_path") == F.lit(path)))


def imports_of(imports: DataFrame, root: str, path: str) -> DataFrame:
    """Edges of one file by line."""
    return _of_file(imports, root, path).orderBy("line", "module")


def importers_of(imports: DataFrame, module: str) -> DataFrame:
    """Edges that name exactly this module, of all roots."""
    return imports.where(F.col("module") == F.lit(module)).orderBy("root_label", "rel_path", "line")


def namespaces_of(declarations: DataFrame, root: str, path: str) -> DataFrame:
    """Namespaces that one file declares, by line and name."""
    return _of_file(declarations, root, path).orderBy("line", "symbol")


def route_rows(declarations: DataFrame, calls: DataFrame) -> DataFrame:
    """Declared routes and calls as rows of one table, told apart by role; a declaration is exact and leads nowhere."""
    a = declarations.withColumn("role", F.lit("declaration")).withColumn("exact", F.lit(True)).withColumn("resolved_path", F.lit(None).cast("string"))
    b = calls.withColumn("role", F.lit("call"))
    names = ["role", "root_label", "rel_path", "line", "template", "exact", "resolved_path"]
    return a.select(*names).unionByName(b.select(*[F.col(n) if n in b.columns else F.lit(None).cast("string").alias(n) for n in names]))


def route_targets(rows: DataFrame) -> DataFrame:
    return rows.where("role = 'declaration'").select("root_label", "rel_path", "line", "template")


def unresolved_calls(rows: DataFrame) -> DataFrame:
    return rows.where("role = 'call' and resolved_path is null")


def namespace_resolved_imports(imports: DataFrame, declarations: DataFrame) -> DataFrame:
    """Distinct (root_label, rel_path, module) that a namespace of the same root and unit answers."""
    d = declarations.select("root_label", unit_of("rel_path").alias("_unit"), F.col("symbol").alias("module")).distinct()
    own = imports.select("root_label", "rel_path", "module", unit_of("rel_path").alias("_unit"))
    return own.join(d, ["root_label", "_unit", "module"], "left_semi").select("root_label", "rel_path", "module").distinct()


def indexed_documents(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Every recorded file with its absolute path. roots: root_label, base."""
    return files.join(roots, "root_label").select(F.concat(F.rtrim("base", F.lit("/")), F.lit("/"), "rel_path").alias("abs_path"), "rel_path", "doc_type")


def chunk_ids_for(chunks: DataFrame, root: str, path: str) -> DataFrame:
    return _of_file(chunks, root, path).select("chunk_id")


def get_file(files: DataFrame, root: str, path: str) -> DataFrame:
    """The record of one file: a row or none."""
    return _of_file(files, root, path).limit(1)


def spaces(rows: DataFrame) -> DataFrame:
    """The names of the spaces that hold anything, in order."""
    return rows.select("space_slug").where("space_slug is not null").distinct().orderBy("space_slug")


def counts_by_root(files: DataFrame, chunks: DataFrame, root: str = "root_label") -> DataFrame:
    """For each root: files, their bytes, chunks. A root whose files have no chunks counts none."""
    a = files.groupBy(root).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
    b = chunks.groupBy(root).agg(F.count(F.lit(1)).alias("chunks"))
    return a.join(b, root, "left").select(root, "files", "bytes", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def totals(files: DataFrame, chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: files, chunks, and tokens embedded in all runs (0 without any)."""
    a, b = files.agg(F.count(F.lit(1)).alias("files")), chunks.agg(F.count(F.lit(1)).alias("chunks"))
    return a.crossJoin(b).crossJoin(runs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens_embedded")))


def files_by_unit(files: DataFrame) -> DataFrame:
    """Files of each root and top-level directory."""
    return files.groupBy("root_label", unit_of("rel_path").alias("unit")).agg(F.count(F.lit(1)).alias("files"))


def recent(rows: DataFrame, at: str, tie: str, n: int = 20) -> DataFrame:
    """The n newest rows, newest first."""
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(n)


def unfiltered_files(files: DataFrame, excluded: list[str]) -> DataFrame:
    """Files in no repository, counted by root and unit: where nothing says what to leave out. Empty once patterns do."""
    own = files.where(F.lit(not excluded) & F.col("root").isNull())
    return own.groupBy("root_label", unit_of("rel_path").alias("unit")).agg(F.count(F.lit(1)).alias("files"))


def describe_vectors(points: DataFrame) -> DataFrame:
    """Vector columns of a store: name, kind, width, points that have one, and whether they can be searched."""
    dense = [f.name for f in points.schema.fields if f.dataType.simpleString() in ("array<float>", "array<double>", "array<tinyint>")]
    counted = points.agg(*[x for c in dense for x in (F.max(F.size(F.when(F.col(c).isNotNull(), F.col(c)))).alias(f"w_{c}"), F.count(c).alias(f"n_{c}"))], F.count(F.lit(1)).alias("_n"))
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.lit("dense").alias("kind"), F.col(f"w_{c}").cast("int").alias("width"), F.col(f"n_{c}").alias("points"), (F.col(f"n_{c}") > 0).alias("searchable")) for c in dense])
    return counted.select(F.explode(rows).alias("x")).select("x.*") if dense else points.sparkSession.createDataFrame([], "name string, kind string, width int, points long, searchable boolean")


def check_filters(names: list[str], schema: list[str]) -> None:
    """Raises for a filter on a field that isn't filterable, or that the store lacks: it would silently match nothing."""
    wrong = sorted(n for n in names if n not in FILTERABLE or n not in schema)
    if wrong:
        raise ValueError(f"cannot filter on {', '.join(wrong)}; fields are {', '.join(n for n in FILTERABLE if n in schema)}")


def pick(found: DataFrame, needle: str) -> tuple[DataFrame, DataFrame]:
    """Of files found by a path: the one that it names, and the candidates where it names none of several for certain.

    An exact path counts before others that end in it; two files of that path in different roots are ambiguous."""
    exact = F.col("rel_path") == F.lit(needle)
    n = found.agg(F.count_if(exact).alias("_exact"), F.count(F.lit(1)).alias("_all"))
    both = found.crossJoin(F.broadcast(n))  # one row
    sure: Column = (F.col("_exact") == 1) & exact | (F.col("_exact") != 1) & (F.col("_all") == 1)
    one = both.where(sure).drop("_exact", "_all")
    return one, both.where((F.col("_exact") != 1) & (F.col("_all") > 1)).drop("_exact", "_all")
