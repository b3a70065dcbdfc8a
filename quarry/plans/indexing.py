"""One run over a workspace: walk, decide, read, chunk, embed what changed, then record. Nothing is recorded before its vectors
are stored, so a run that stops anywhere is simply run again."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, secrets, text, vectors
from ..operators import chunking, embedding, graph, ledger
from ..sources import workspace as ws
from ..sources.tables import Table, shared_folder
from . import settings
from .stores import VectorStore, payload

KEYS = ["root_label", "rel_path"]
CHUNKER_VERSION, GRAPH_VERSION, CLASSIFIER_VERSION = 1, 1, 1
FILE = "root_label string, rel_path string, size long, mtime long, sha256 string, kind string, language string, doc_type string, chunk_count long, chunker_version int, graph_version int"
SPACE = "root_label string, rel_path string, space_slug string, chunk_count long"
EDGE = "root_label string, rel_path string, module string, line int, kind string, is_relative boolean"
ROUTE = "role string, root_label string, rel_path string, line int, template string, exact boolean"
NAME = "root_label string, rel_path string, symbol string, line int, kind string"
RUN = "run_id string, event string, at timestamp, decision string, files long, tokens long"


def run_stats(decided: DataFrame) -> DataFrame:
    """Files by decision: what a run did with each of them."""
    return decided.groupBy("decision").agg(F.count(F.lit(1)).alias("files"))


@dataclass
class Report:
    run_id: str
    decisions: dict[str, int]
    skipped: dict[str, int]
    upserted: int
    deleted: int
    withheld: int
    orphans: int
    orphans_kept: list[str]
    unobservable: list[str]


class Indexer:
    """The ledger of a workspace (tables files, spaces, imports, namespaces, routes, runs) and its collection of points."""

    def __init__(self, spark: SparkSession, workspace: settings.Workspace, folder: str, *, backend: embedding.Backend | None = None):
        self.spark, self.workspace, self.folder = spark, workspace, folder.rstrip("/")
        own, self.width = settings.backend(workspace.index.embedding_model)
        self.backend = backend or own
        self.slug = f"{workspace.index.embedding_model.replace(':', '_')}_{self.width}"
        self.store = VectorStore(spark, f"{self.folder}/points")
        self._written: list[str] = []

    def table(self, name: str, schema: str) -> Table:
        own = Table(self.spark, f"{self.folder}/{name}")
        if not own.exists():
            own.replace(self.spark.createDataFrame([], schema))
        return own

    def _walked(self, labels: list[str]) -> DataFrame:
        found = None
        for label in labels:
            root = self.workspace.roots[label]
            own = ws.walk(self.spark, root, label, content=True, max_bytes=self.workspace.index.max_file_bytes)
            gone = ws.ignored(own, ws.ignore_rules(own))
            own = own.join(gone, "rel_path", "left_anti")
            found = own if found is None else found.unionByName(own)
        return found.withColumn("mtime", F.unix_micros(F.col("mtime").cast("timestamp")))

    def _cut(self, df: DataFrame) -> DataFrame:
        """The frame, written for the length of a run."""
        path = f"{shared_folder(self.spark)}/run-{uuid.uuid4().hex}"
        self._written.append(path)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def _clear(self) -> None:
        for path in self._written:
            Table(self.spark, path).drop()
        self._written.clear()

    def run(self, *, force: bool = False, delete_anyway: bool = False) -> Report:
        """Brings the index up to date. Roots that can't be seen are left as they are: their files are not gone."""
        try:
            return self._run(force, delete_anyway)
        finally:
            self._clear()

    def _run(self, force: bool, delete_anyway: bool) -> Report:
        index, run_id = self.workspace.index, uuid.uuid4().hex
        seen = ws.observable(self.spark, self.workspace.roots)
        roots = [r for r, there in seen.items() if there]
        files, spaces = self.table("files", FILE), self.table("spaces", SPACE)
        runs = self.table("runs", RUN)
        event = lambda name, decision=None, n=None, tokens=None: self.spark.createDataFrame([(run_id, name, decision, n, tokens)], "run_id string, event string, decision string, files long, tokens long").withColumn("at", F.current_timestamp()).select("run_id", "event", "at", "decision", "files", "tokens")
        runs.append(event("start"))

        # 1. what is there, and what is to be done with it by stat alone
        judged = self._cut(ws.candidates(self._walked(roots), max_bytes=index.max_file_bytes, excluded=index.all_excludes)) if roots else None
        if judged is None:
            runs.append(event("finish", "NONE", 0, 0))
            return Report(run_id, {}, {}, 0, 0, 0, 0, [], sorted(set(seen) - set(roots)))
        skipped = {r[0]: r[1] for r in ws.tallies(judged).collect()}
        held = files.read()
        candidates = judged.where("skip_reason is null").withColumn("chunker_version", F.lit(CHUNKER_VERSION))
        decided = ledger.decide(candidates, held, spaces.read().where(F.col("space_slug") == self.slug), KEYS, force=force)

        # 2. read, and skip what holds the same after all
        changed = ws.read_text(decided.where("decision <> 'SKIP_UNCHANGED'"))
        changed = self._cut(secrets.withhold(ledger.decide_by_hash(changed, held, KEYS), allow=index.secrets_allow))
        same = changed.where("decision = 'SKIP_SAME_CONTENT'")
        todo = changed.where("decision <> 'SKIP_SAME_CONTENT' and not coalesce(withheld, false)")
        withheld = changed.where("withheld")
        decisions = {r[0]: r[1] for r in run_stats(decided.where("decision = 'SKIP_UNCHANGED'").select("decision").unionByName(changed.select("decision"))).collect()}

        # 3. chunks, and which of them are new
        typed = todo.withColumn("doc_type", classify.document_type("rel_path", "text", F.col("kind"))["doc_type"])
        cut_ = chunking.chunk(typed, keys=[*KEYS, "doc_type"], kind="kind", language="language", text="text")
        repo = F.coalesce(*[F.when(F.col("root_label") == k, F.lit(v)) for k, v in self.workspace.repositories.items()], F.lit(None).cast("string"))
        header = text.context_header(repo, F.lit(None).cast("string"), "rel_path", None, "doc_type", "symbol_kind", "symbol_path")
        sha = text.sha256_text("source_text")
        chunks = cut_.withColumn("chunk_id", text.chunk_id("root_label", "rel_path", "symbol_path", "chunk_index", sha)).withColumn("embed_text", F.concat_ws("\n", F.when(header != "", header), F.col("source_text")))
        chunks = self._cut(chunks.dropDuplicates(["chunk_id"]))
        self.store.ensure(self.slug, payload(chunks, space=self.slug).withColumn("dense", F.lit(None).cast("array<float>")), width=self.width)
        points = self.store.collection(self.slug)
        owned = points.read().join(todo.select(*KEYS), KEYS, "left_semi")
        delta = self._cut(ledger.chunk_delta(chunks, owned))
        fresh = chunks.join(delta.where("action = 'upsert'").select("chunk_id"), "chunk_id", "left_semi")

        # 4. vectors of the new ones only, then the points, then the ledger
        embedded = embedding.embed(fresh, self.backend, text="embed_text", width=self.width)
        rows = self._cut(payload(embedded, space=self.slug))
        lost = ledger.orphans(held.where(F.col("root_label").isin(roots)), judged, KEYS)
        brake = self._brake(held, lost, roots, delete_anyway)
        gone_files = self._cut(lost.where(~F.col("root_label").isin(brake)).select(*KEYS).unionByName(withheld.select(*KEYS)).distinct())
        gone_points = self._cut(delta.where("action = 'delete'").select("chunk_id").unionByName(points.read().join(gone_files, KEYS, "left_semi").select("chunk_id")).distinct())
        n_new, n_gone = rows.count(), gone_points.count()
        if n_new or n_gone:
            points.replace(ledger.upsert(points.read().join(gone_points, "chunk_id", "left_anti"), rows, ["chunk_id"]))
        self._record(files, spaces, typed, same, chunks, gone_files)
        tokens = rows.agg(F.coalesce(F.sum("token_count"), F.lit(0)).cast("long")).first()[0]
        runs.append(event("finish", "DONE", sum(decisions.values()), tokens))
        return Report(run_id, decisions, skipped, n_new, n_gone, withheld.count(), lost.count(), brake, sorted(set(seen) - set(roots)))

    def _brake(self, held: DataFrame, lost: DataFrame, roots: list[str], anyway: bool) -> list[str]:
        if anyway or lost.isEmpty():
            return []
        return sorted(r[0] for r in ledger.deletion_brake(held.where(F.col("root_label").isin(roots)), lost, "root_label").where("withheld").select("root_label").collect())  # a few roots

    def _record(self, files: Table, spaces: Table, typed: DataFrame, same: DataFrame, chunks: DataFrame, gone: DataFrame) -> None:
        if typed.isEmpty() and same.isEmpty() and gone.isEmpty():
            return
        counts = ledger.complete_spaces(typed, chunks, KEYS)
        new = typed.join(counts, KEYS).select(*KEYS, "size", "mtime", "sha256", "kind", "language", "doc_type", "chunk_count", F.lit(CHUNKER_VERSION).alias("chunker_version"), F.lit(GRAPH_VERSION).alias("graph_version"))
        touched = files.read().drop("size", "mtime").join(same.select(*KEYS, "size", "mtime"), KEYS).select(*new.columns)
        scanned = typed.select(*KEYS, "language", "text")
        owners = self._cut(typed.select(*KEYS).unionByName(gone.select(*KEYS)).distinct())
        routes = ws.route_declarations(scanned).select(F.lit("declaration").alias("role"), *KEYS, "line", "template", F.lit(True).alias("exact")).unionByName(ws.route_calls(scanned).select(F.lit("call").alias("role"), *KEYS, "line", "template", "exact"))
        for name, schema, found in (("imports", EDGE, ws.imports(scanned).select(*KEYS, "module", "line", "kind", "is_relative")), ("namespaces", NAME, ws.namespaces(scanned)), ("routes", ROUTE, routes)):
            own = self.table(name, schema)
            own.replace(ledger.replace_owned(own.read(), found, owners, KEYS))
        done = counts.select(*KEYS, F.lit(self.slug).alias("space_slug"), "chunk_count")
        spaces.replace(ledger.upsert(spaces.read().join(gone, KEYS, "left_anti"), done, [*KEYS, "space_slug"]))
        files.replace(ledger.upsert(files.read().join(gone, KEYS, "left_anti"), new.unionByName(touched), KEYS))

    def resolved(self) -> DataFrame:
        """The import edges with what they resolve to: relative ones by candidates, absolute ones by suffix; others stay null."""
        edges = self.table("imports", EDGE).read().withColumn("edge_id", F.xxhash64(*KEYS, "module", "line"))
        files = self.table("files", FILE).read()
        own = edges.join(files.select(*KEYS, "language"), KEYS)
        relative = graph.by_relative(own.where("is_relative"), files)
        absolute = graph.by_suffix(own.where("not is_relative and language = 'python'"), files.where("language = 'python'"))
        return own.join(relative.unionByName(absolute), "edge_id", "left").drop("edge_id")

    def rescan(self, version: int = GRAPH_VERSION) -> int:
        """Scans files again whose edges an older scanner found, without embedding anything. How many there were."""
        files = self.table("files", FILE)
        roots = [r for r, there in ws.observable(self.spark, self.workspace.roots).items() if there]
        old = self._cut(graph.stale_graph(files.read(), ["python", "javascript", "typescript", "tsx", "csharp"], version).where(F.col("root_label").isin(roots)))
        n = old.count()
        if n:
            walked = ws.read_text(ws.candidates(self._walked(roots)).join(old.select(*KEYS), KEYS, "left_semi")).select(*KEYS, "language", "text")
            own = self.table("imports", EDGE)
            own.replace(ledger.replace_owned(own.read(), ws.imports(walked).select(*KEYS, "module", "line", "kind", "is_relative"), old, KEYS))
            files.replace(ledger.upsert(files.read(), old.withColumn("graph_version", F.lit(version)), KEYS))
        self._clear()
        return n

    def status(self) -> DataFrame:
        """The spaces of the ledger against those of the store."""
        recorded = self.table("spaces", SPACE).read().groupBy("space_slug").agg(F.sum("chunk_count").alias("n"))
        names = self.store.collection_names()
        stored = self.spark.createDataFrame([(n, self.store.collection(n).read().count()) for n in names], "space_slug string, n long")
        return ledger.consistency(recorded, stored, "space_slug")


def watch(spark: SparkSession, root: str, action: Callable[[list, int], None], checkpoint: str, *, label: str, ignored: list[str] = (), once: bool = False):
    """Calls the action for roots in which files have appeared or grown new: a file stream over the folder, ignored paths dropped.

    The stream sees visible files as Spark's file source lists them; a periodic full run sees deletions and the rest."""
    from ..streaming import changes

    seen = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(root)
    own = changes.kept_changes(seen.select(F.lit(label).alias("root"), "path", F.col("modificationTime").alias("at")), list(ignored))
    return changes.run_on_changes(own, action, checkpoint, once=once)


def watched_folders(files: DataFrame) -> DataFrame:
    """The directories that hold recorded files or lead to one: what a watcher has to look at, and nothing else."""
    return files.select("root_label", F.explode(text.ancestors_of("rel_path")).alias("dir")).distinct()


__all__ = ["Indexer", "Report", "run_stats", "vectors", "watch", "watched_folders"]
