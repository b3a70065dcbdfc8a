"""The searches and reports that a user calls, composed of the operators.

What can't be answered is an error that says what could be (UnknownName), never an empty result: an unknown type, an unknown
repository, a field that can't be filtered on.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import DOC_TYPES
from ..operators import budget, graph, grounding, ledger, lookups, retrieval
from ..operators.retrieval import Filters
from .settings import UnknownName, document_type

# Hits by default and at most, dependents by default, tokens of a response, types of code searches and of guidance.
LIMIT, FILE_LIMIT, MOST, IMPACT_LIMIT, RESPONSE_TOKENS = 8, 20, 200, 25, 6000
CODE_EXCLUDES, GUIDANCE = ("test", "generated"), ("normative", "design", "guide")
SCANNED = ["csharp", "javascript", "python", "tsx", "typescript"]


@dataclass
class RerankStats:
    calls: int = 0
    degraded: int = 0


@dataclass
class Response:
    """Hits within the budget, and what became of the others."""

    query: str
    applied_filters: dict[str, str]
    results: DataFrame
    total_matches: int
    returned: int
    dropped_for_budget: int
    note: str | None = None


def _limit(n: int, most: int = MOST) -> int:
    if not 1 <= n <= most:
        raise ValueError(f"a limit is from 1 to {most}, not {n}")
    return n


def applied(filters: Filters) -> dict[str, str]:
    """The filters that are set."""
    out = {k: str(v) for k, v in sorted(filters.equals.items()) if v not in (None, "")}
    out |= {k: ", ".join(v) for k, v in (("doc_types", filters.doc_types), ("exclude_doc_types", filters.exclude_doc_types)) if v}
    return out | ({"path_prefix": filters.path_prefix} if filters.path_prefix else {})


class Index:
    """A chunk table (chunk_id, root_label, rel_path, doc_type, ancestors, source_text, token_count, dense) and its postings.

    files (root_label, rel_path, text): the present texts, for telling hits that no longer stand there. scorer: orders the best
    hits anew; if it fails, the order stays (on_error degrade) or the search does (fail). sink: gets a row for each call."""

    def __init__(self, chunks: DataFrame, vectors: DataFrame | None = None, *, files: DataFrame | None = None, folder: str | None = None, scorer: Callable[[Column, Column], Column] = retrieval.lexical_score, on_error: str = "degrade", sink: Callable[[dict], None] | None = None):
        self.chunks, self.vectors, self.files, self.scorer, self.on_error, self.sink = chunks, vectors, files, scorer, on_error, sink
        self.folder = folder
        self.stats = RerankStats()

    @cached_property
    def postings(self) -> DataFrame | retrieval.StoredIndex:
        """Looked up, and built if need be, when words are first searched for: other calls don't need it."""
        if self.folder:
            return retrieval.StoredIndex.of(self.chunks, row="chunk_id", text="source_text", folder=self.folder)
        return retrieval.postings(self.chunks, row="chunk_id", text="source_text")

    def search(self, queries: DataFrame, *, filters: Filters = Filters(), k: int = 10, mode: str = "hybrid", rerank: bool = False) -> DataFrame:
        """Hits of each query (query_id, text and, for dense branches, vector) with their rank; only the branches asked for run."""
        lookups.check_filters([n for n, v in filters.equals.items() if v not in (None, "")], self.chunks.columns)
        allowed = None if filters.is_empty() else self.chunks.where(filters.column()).select("chunk_id")
        depth = max(k, retrieval.PREFETCH) if rerank else k
        if mode == "sparse":
            hits = retrieval.top(retrieval.bm25(self.postings, queries, query="query_id", text="text", allowed=allowed), depth)
        else:
            if self.vectors is None:
                raise ValueError("this index has no vectors")
            own = self.vectors if allowed is None else self.vectors.join(allowed, "chunk_id", "left_semi")
            if mode == "dense":
                hits = retrieval.dense_top(own, queries, depth, row="chunk_id", vector="dense", query="query_id", query_vector="vector")
            elif mode == "hybrid":
                hits = retrieval.hybrid(self.postings, self.vectors, queries, query="query_id", text="text", query_vector="vector", row="chunk_id", vector="dense", k=depth, allowed=allowed)
            else:
                raise UnknownName("mode", mode, ["dense", "hybrid", "sparse"])
        full = retrieval.beside(hits.withColumnRenamed("row", "chunk_id"), self.chunks, "chunk_id", queries.count() * depth)
        if rerank:
            full = self._reranked(full, queries, k)
        if self.files is not None:
            full = retrieval.flag_stale(full, self.files, on=["root_label", "rel_path"])
        return full

    def _reranked(self, hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        self.stats.calls += 1
        try:
            q = queries.select("query_id", F.col("text").alias("_q"))
            score = self.scorer(F.col("_q"), F.col("source_text"))
            return retrieval.rerank(hits.join(q, "query_id"), score, n=k).drop("_q", "rank").withColumnRenamed("rerank_rank", "rank")
        except Exception as e:
            if self.on_error == "fail":
                raise
            self.stats.degraded += 1
            logging.getLogger("quarry").warning("hits stay in their fused order: %s", e)
            return hits.where(F.col("rank") <= k)

    def pack(self, hits: DataFrame, tokens: int = 4000) -> tuple[DataFrame, DataFrame]:
        """Hits within a budget of tokens, and the envelope that says how many didn't fit."""
        kept = budget.pack(hits, group="query_id", rank="rank", cost="token_count", budget=tokens)
        return budget.clip_hits(kept, "source_text"), budget.envelope(hits, kept, "query_id")

    def search_code(self, queries: DataFrame, *, include_tests: bool = False, filters: Filters = Filters(), k: int = LIMIT, **how) -> DataFrame:
        """Code: without tests and generated files unless asked for."""
        return self.search(queries, filters=filters if include_tests else replace(filters, exclude_doc_types=CODE_EXCLUDES), k=_limit(k), **how)

    def find_guidance(self, queries: DataFrame, doc_type: str | None = None, filters: Filters = Filters(), *, k: int = LIMIT, **how) -> DataFrame:
        """Documents that say how things should be; one type by its name or an alias."""
        return self.search(queries, filters=replace(filters, doc_types=(document_type(doc_type),) if doc_type else GUIDANCE), k=_limit(k), **how)

    def respond(self, tool: str, query: str, hits: DataFrame, filters: Filters, *, empty: str, tokens: int = RESPONSE_TOKENS, with_text: bool = True) -> Response:
        """The response to one query. Bodies are left out where only locations are asked for, and the note says so."""
        cost = hits.withColumn("token_count", F.coalesce(F.nullif("token_count", F.lit(0)), F.greatest(F.lit(1), F.floor(F.length("source_text") / 4).cast("int")))) if with_text else hits.withColumn("token_count", budget.anchor_tokens(hits))
        if with_text:
            kept = budget.clip_hits(budget.pack(cost, group="query_id", rank="rank", cost="token_count", budget=tokens), "source_text")
        else:
            kept = budget.pack_locations(cost, group="query_id", rank="rank", cost="token_count", budget=tokens).withColumn("source_text", F.lit(""))
        total, n = hits.count(), kept.count()
        notes = []
        if not total:
            notes = [empty]
        elif n < total:
            notes.append(f"{total - n} more hits did not fit into {tokens} tokens; ask for fewer or narrower ones.")
        if total and not with_text:
            notes.append("Texts are left out as asked: each hit has its file and lines.")
        out = Response(query, applied(filters), kept, total, n, total - n, " ".join(notes) or None)
        if self.sink:
            self.sink({"tool": tool, "query": query, "params": json.dumps(out.applied_filters, sort_keys=True), "returned": n, "dropped": total - n})
        return out

    def code(self, query: str, *, vector: list[float] | None = None, k: int = LIMIT, include_tests: bool = False, filters: Filters = Filters(), locations_only: bool = False, mode: str = "sparse", rerank: bool = False) -> Response:
        own = filters if include_tests else replace(filters, exclude_doc_types=CODE_EXCLUDES)
        empty = "Nothing matched. A broader query or fewer filters may." if include_tests else "Nothing matched outside tests and generated files; include_tests looks there too."
        return self.respond("search_code", query, self.search_code(self._one(query, vector), include_tests=include_tests, filters=filters, k=k, mode=mode, rerank=rerank), own, empty=empty, with_text=not locations_only)

    def guidance(self, query: str, doc_type: str | None = None, *, vector: list[float] | None = None, k: int = LIMIT, filters: Filters = Filters(), locations_only: bool = False, mode: str = "sparse", rerank: bool = False) -> Response:
        types = (document_type(doc_type),) if doc_type else GUIDANCE
        empty = f"No document of type {' or '.join(types)} matched; list the types to see whether there are any."
        return self.respond("find_guidance", query, self.find_guidance(self._one(query, vector), doc_type, filters, k=k, mode=mode, rerank=rerank), replace(filters, doc_types=types), empty=empty, with_text=not locations_only)

    def _one(self, query: str, vector: list[float] | None) -> DataFrame:
        return self.chunks.sparkSession.createDataFrame([(0, query, vector)], "query_id int, text string, vector array<double>")

    def file_context(self, path: str) -> DataFrame:
        """The chunks of a file, in its order; of a name, those of the files that end in it."""
        return ledger.exact_else_suffix(self.chunks, path).orderBy("rel_path", "start_line")

    def context(self, path: str, *, k: int = FILE_LIMIT, tokens: int = RESPONSE_TOKENS) -> Response:
        """The first k chunks of a file, within the budget."""
        from pyspark.sql import Window

        order = Window.partitionBy("query_id").orderBy("rel_path", "start_line", "chunk_id")
        hits = self.file_context(path).withColumn("query_id", F.lit(0)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= _limit(k))
        if self.files is not None:
            hits = retrieval.flag_stale(hits, self.files, on=["root_label", "rel_path"])
        out = self.respond("get_file_context", path, hits, Filters(), tokens=tokens, empty=f"No chunks of {path!r}: paths are matched whole or from a directory on; the file may be left out of the index.")
        return replace_filters(out, {"rel_path": path})

    def document_types(self, taxonomy: DataFrame | None = None) -> DataFrame:
        """Every type with its number of chunks, 0 where there are none, and samples of paths."""
        if taxonomy is None:
            taxonomy = self.chunks.sparkSession.createDataFrame([(x,) for x in DOC_TYPES], "value string")
        counted = retrieval.facet(self.chunks, "doc_type")
        samples = retrieval.sample_paths(self.chunks, "doc_type", "rel_path").groupBy(F.col("doc_type").alias("value")).agg(F.array_sort(F.collect_list("rel_path")).alias("samples"))
        return retrieval.fill_taxonomy(taxonomy, counted).join(samples, "value", "left")


def replace_filters(response: Response, filters: dict[str, str]) -> Response:
    return replace(response, applied_filters=filters)


def impact_of(imports: DataFrame, files: DataFrame, declarations: DataFrame | None, needle: str, k: int = IMPACT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Dependents of the file that a path names, most relevant first, and how many there are of each type. Empty if the
    path names no file or several (impact() tells these apart)."""
    one, _ = lookups.pick(ledger.find_paths(files, needle), needle)
    own = one.select(F.col("root_label").alias("target_root"), F.col("rel_path").alias("target_path"))
    who = graph.dependents(imports, files, declarations).join(own, ["target_root", "target_path"], "left_semi").join(files.select("root_label", "rel_path", "doc_type"), ["root_label", "rel_path"])
    return who.orderBy(graph.keep_rank(F.col("doc_type")), "rel_path").limit(_limit(k)), who.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "doc_type")


@dataclass
class Impact:
    rel_path: str | None
    root_label: str | None
    language: str | None
    used_by: DataFrame | None = None
    depends_on: DataFrame | None = None
    called_by: DataFrame | None = None
    used_by_type: dict[str, int] = field(default_factory=dict)
    candidates: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def impact(imports: DataFrame, files: DataFrame, needle: str, *, declarations: DataFrame | None = None, calls: DataFrame | None = None, k: int = IMPACT_LIMIT) -> Impact:
    """What depends on the one file that a path names, what it depends on, who calls its routes; or the candidates."""
    found = ledger.find_paths(files, needle).collect()  # eight at most
    exact = [r for r in found if r["rel_path"] == needle]
    one = exact[0] if len(exact) == 1 else found[0] if len(found) == 1 else None
    if one is None:
        note = f"No file is or ends in {needle!r}." if not found else f"{len(found)} files end in {needle!r}; ask for one of them."
        return Impact(None, None, None, candidates=[r["rel_path"] for r in found], notes=[note])
    used_by, by_type = impact_of(imports, files, declarations, one["rel_path"], k)
    mine = (F.col("root_label") == F.lit(one["root_label"])) & (F.col("rel_path") == F.lit(one["rel_path"]))
    edges = graph.dependencies(imports.where(mine), files)
    types = {r[0]: r[1] for r in by_type.collect()}
    out = Impact(one["rel_path"], one["root_label"], one["language"], used_by, edges.orderBy("line").limit(k), None, types)
    if one["language"] not in SCANNED:
        out.notes.append(f"Imports of {one['language'] or 'this kind of file'} are not scanned, so no edges says nothing; scanned are {', '.join(SCANNED)}.")
    elif not types:
        out.notes.append("No file's import resolves to this one; packages and aliases are recorded but lead to no file.")
    barrels = [r[0] for r in used_by.where(graph.is_barrel("rel_path")).select("rel_path").distinct().collect()]
    if barrels:
        out.notes.append(f"{len(barrels)} importers only hand on what others define ({', '.join(sorted(barrels))}): whoever imports from them is not counted.")
    if "origin" in imports.columns:
        out.notes += [f"{r['n']} unresolved: {r['note']}" for r in graph.unresolved_notes(edges).orderBy("note").collect()]
    if calls is not None:
        own = calls.where((F.col("resolved_root") == F.lit(one["root_label"])) & (F.col("resolved_path") == F.lit(one["rel_path"])))
        out.called_by = own.limit(k)
        if (n := own.count()):
            out.notes.append(f"{n} calls reach this file over HTTP; no compiler warns of a change.")
    if (n := sum(types.values())) > k:
        out.notes.append(f"{n - k} more files depend on it; tests were left out before code.")
    return out


def grounding_report(commits: DataFrame, files: DataFrame, *, repo: str, subject: str = "subject", body: str = "body", only: str | None = None) -> DataFrame:
    """For each repository, or the one named, the strength of its history, of its documents, and the stronger of both; most code first."""
    s = grounding.signals(commits, repo, subject, body)
    f = files.groupBy(repo).agg(F.count_if(F.col("doc_type").isin("normative", "design")).alias("documents"), F.count_if(F.col("doc_type") == "implementation").alias("code_files"))
    both = f.join(s, repo, "full_outer").fillna(0, ["documents", "code_files", "commits", "with_rationale"])
    if only is not None:
        names = sorted(r[0] for r in both.select(repo).where(f"{repo} is not null").distinct().collect())  # the repositories of a workspace
        if only not in names:
            raise UnknownName("repository", only, names)
        both = both.where(F.col(repo) == F.lit(only))
    history, papers = grounding.by_share(F.col("with_rationale"), F.col("commits")), grounding.by_density(F.col("documents"), F.col("code_files"))
    out = both.withColumn("history", history).withColumn("documents_strength", papers).withColumn("verdict", grounding.verdict([F.col("history"), F.col("documents_strength")]))
    return out.orderBy(F.desc("code_files"), repo)


# Notes by the weakest verdict of the repositories reported.
_NOTES = {
    "ABSENT": "No recorded reasons were found: an empty search for guidance means that none were written down. Read the implementation.",
    "THIN": "Reasons are sparse: an empty search says little. Prefer the implementation to a confident answer.",
    "PRESENT": "Reasons are well recorded: an empty search suggests that this one was not.",
}


def grounding_note(report: DataFrame) -> str:
    low = report.agg(F.min(grounding.strength_rank(F.col("verdict")))).first()[0]
    return "Nothing is indexed yet." if low is None else _NOTES[grounding.STRENGTHS[int(low)]]
