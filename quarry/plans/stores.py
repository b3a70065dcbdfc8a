"""Stores of points: payloads, copies between stores, and cutting vectors to a narrower space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import lookups
from ..operators.retrieval import Filters, facet
from ..sources.tables import Table


def payload(chunks: DataFrame, *, space: str) -> DataFrame:
    """What a point carries beside its vectors. The header is kept apart from the source text, so neither is stored twice."""
    has = set(chunks.columns)
    opt = lambda c, kind="string": F.col(c) if c in has else F.lit(None).cast(kind)
    return chunks.select(
        "chunk_id", opt("workspace").alias("workspace"), "root_label", text.unit_of("rel_path").alias("unit"), "rel_path", opt("abs_path").alias("abs_path"),
        text.file_name("rel_path").alias("file_name"), text.extension("rel_path").alias("ext"), text.ancestors_of("rel_path").alias("ancestors"), opt("kind").alias("kind"), opt("language").alias("language"),
        opt("repo_name").isNotNull().alias("is_repo"), opt("repo_name").alias("repo_name"), opt("repo_remote").alias("repo_remote"), opt("repo_branch").alias("repo_branch"), opt("repo_head_sha").alias("repo_head_sha"),
        opt("symbol_path").alias("symbol_path"), opt("symbol_kind").alias("symbol_kind"), opt("symbol_name").alias("symbol_name"), opt("start_line", "int").alias("start_line"), opt("end_line", "int").alias("end_line"),
        "source_text", (text.header_of("embed_text", "source_text") if "embed_text" in has else F.lit("")).alias("context_header"), opt("token_count", "int").alias("token_count"), text.sha256_text("source_text").alias("content_sha"),
        opt("chunk_index", "int").alias("chunk_index"), opt("chunk_total", "int").alias("chunk_total"), opt("chunker").alias("chunker"), opt("chunker_version", "int").alias("chunker_version"),
        F.coalesce(opt("doc_type"), F.lit("unknown")).alias("doc_type"), opt("doc_confidence", "double").alias("doc_confidence"), opt("classifier_version", "int").alias("classifier_version"),
        F.coalesce(opt("parse_degraded", "boolean"), F.lit(False)).alias("parse_degraded"), F.lit(space).alias("space_slug"), *([c for c in ("dense",) if c in has]),
    )


def embedded_text(points: DataFrame) -> Column:
    """The text that was embedded: header and source, put together again."""
    header = F.coalesce(F.col("context_header"), F.lit(""))
    return F.when(header == "", F.col("source_text")).otherwise(F.concat(header, F.lit("\n"), F.col("source_text")))


def mirrored(points: DataFrame, *, vector: str = "dense") -> tuple[DataFrame, DataFrame]:
    """Points as they go to another store, and one row that counts copied and skipped ones: without a vector none is copied."""
    counted = points.agg(F.count(vector).alias("copied"), F.count_if(F.col(vector).isNull()).alias("skipped"))
    return points.where(F.col(vector).isNotNull()), counted


def mirror(source: Table, target: Table, *, key: str = "chunk_id", vector: str = "dense") -> dict[str, int]:
    """Copies every point untouched; a second time changes nothing. Points that the target has besides stay."""
    moved, counted = mirrored(source.read(), vector=vector)
    target.upsert(moved, [key])
    return counted.first().asDict()


def reprojected(points: DataFrame, width: int, *, model: str, held: int, vector: str = "dense") -> DataFrame:
    """The points in a narrower space: the same ids and texts, vectors cut to their first values and scaled to length 1.

    Widening, or a stored vector of another width than `held`, is an error: nothing could be put where values are missing."""
    if width >= held:
        raise ValueError(f"{held} dimensions can be cut to fewer only, not to {width}")
    slug = text.space_slug(F.lit(model), F.lit(width), F.lit(held))
    wrong = F.raise_error(F.concat(F.lit("a vector of "), F.size(vector).cast("string"), F.lit(f" values where the space has {held}")))
    cut_ = F.when(F.col(vector).isNull() | (F.size(vector) == held), vectors.float32(vectors.truncate(vector, width))).otherwise(wrong.cast("array<float>"))
    return points.withColumn(vector, cut_).withColumn("space_slug", slug)


class VectorStore:
    """Collections of points as tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder_ = spark, folder.rstrip("/")

    def collection(self, name: str) -> Table:
        return Table(self.spark, f"{self.folder_}/{name}")

    def collection_names(self) -> list[str]:
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder_)
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(fs_path)] if fs.exists(fs_path) else []
        return sorted(n for n in names if self.collection(n).exists())

    def ensure(self, name: str, empty: DataFrame, *, width: int) -> bool:
        """Makes a collection if it isn't there; one of another width is an error. Whether it was made."""
        own = self.collection(name)
        if own.exists():
            row = self.describe(name).where("points > 0").first()
            if row and row["width"] != width:
                raise ValueError(f"{name} holds vectors of {row['width']} values, not {width}")
            return False
        own.replace(empty.limit(0))
        return True

    def upsert(self, name: str, points: DataFrame) -> None:
        self.collection(name).upsert(points, ["chunk_id"])

    def delete_ids(self, name: str, ids: DataFrame) -> None:
        self.collection(name).delete(ids, ["chunk_id"])

    def delete_path(self, name: str, root: str, path: str) -> None:
        self.collection(name).delete_where((F.col("root_label") == F.lit(root)) & (F.col("rel_path") == F.lit(path)))

    def drop(self, name: str) -> None:
        self.collection(name).drop()

    def scroll(self, name: str, filters: Filters = Filters()) -> DataFrame:
        points = self.collection(name).read()
        lookups.check_filters([k for k, v in filters.equals.items() if v not in (None, "")], points.columns)
        return points.where(filters.column())

    def count(self, name: str, filters: Filters = Filters()) -> int:
        return self.scroll(name, filters).count()

    def facet(self, name: str, key: str, filters: Filters = Filters(), limit: int = 32) -> DataFrame:
        lookups.check_filters([key], self.collection(name).read().columns)
        return facet(self.scroll(name, filters), key, limit)

    def describe(self, name: str) -> DataFrame:
        return lookups.describe_vectors(self.collection(name).read())

    def chunks_for_path(self, name: str, path: str) -> DataFrame:
        from ..operators.ledger import exact_else_suffix

        return exact_else_suffix(self.collection(name).read(), path)
