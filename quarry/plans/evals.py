"""Evaluation runs: cases searched in one job, judged, timed, recorded as JSON, compared with the last comparable run."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_matches
from ..operators import evaluation

CASE = "case_id string, query string, expected array<string>"
RECORD = "recorded_at string, label string, config_hash string, cases long, recall_at_k double, mrr_at_k double, misses long, k int, seconds double, first_hits map<string,int>"


def cases(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Cases of a dataset: id, query, and parts of the paths that should be found. A case that expects nothing is an error."""
    wrong = [str(r.get("id")) for r in rows if not r.get("query") or not r.get("expected")]
    if wrong or len({r["id"] for r in rows}) < len(rows):
        raise ValueError(f"cases need a query and expected paths, and ids of their own: {', '.join(wrong) or 'an id stands twice'}")
    return spark.createDataFrame([(str(r["id"]), r["query"], list(r["expected"])) for r in rows], CASE)


def evaluate(search: Callable[[DataFrame], DataFrame], own: DataFrame, *, k: int, label: str, config_hash: str) -> tuple[dict, DataFrame]:
    """The record of a run, and each case's recall and first hit. search: (query_id, text) to hits (query_id, rel_path, rank).

    All cases are one job; seconds are the job's. A hit satisfies an expectation that its path contains."""
    began = time.monotonic()
    hits = search(own.select(F.col("case_id").alias("query_id"), F.col("query").alias("text"))).where(F.col("rank") <= k).select("query_id", "rel_path", "rank").toArrow()  # k a case
    seconds = time.monotonic() - began
    found = own.sparkSession.createDataFrame(hits)
    wanted = own.select("case_id", F.explode("expected").alias("part"))
    fits = wanted.join(found, wanted["case_id"] == found["query_id"]).where(path_matches("rel_path", F.col("part"))).select("case_id", F.col("part").alias("row"), "rank")
    judged = evaluation.judge(wanted, fits, case="case_id", expected="part")
    row = evaluation.report(judged).first().asDict()
    first = {r["case_id"]: r["first_hit"] for r in judged.where("first_hit is not null").collect()}
    return {"recorded_at": datetime.now(UTC).isoformat(), "label": label, "config_hash": config_hash, **row, "k": k, "seconds": round(seconds, 3), "first_hits": first}, judged


def save(spark: SparkSession, record: dict, folder: str) -> str:
    """Writes a record to a file of its own, keys sorted."""
    path = f"{folder.rstrip('/')}/{record['recorded_at'].replace(':', '-')}-{record['label']}.json"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
    out.write(bytearray(json.dumps(record, sort_keys=True, indent=1).encode()))
    out.close()
    return path


def history(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a folder, oldest first; files that can't be read as one are left out."""
    rows = spark.read.schema(RECORD + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder)
    return rows.where("_bad is null and recorded_at is not null").drop("_bad").orderBy("recorded_at")


def delta(records: DataFrame) -> DataFrame:
    """Each run with how far recall and reciprocal rank moved since the last run of the same configuration, label and k."""
    own = records.withColumn("at", F.to_timestamp("recorded_at")).withColumn("this", F.struct("recall_at_k", "mrr_at_k"))
    last = evaluation.latest_comparable(own, "at", "this", ["config_hash", "label", "k"])
    return last.select("recorded_at", "label", "config_hash", F.round(F.col("recall_at_k") - F.col("previous.recall_at_k"), 6).alias("recall_moved"), F.round(F.col("mrr_at_k") - F.col("previous.mrr_at_k"), 6).alias("mrr_moved"))


def table(records: DataFrame) -> str:
    """The records as a markdown table, newest first."""
    rows = records.orderBy(F.desc("recorded_at")).collect()  # a history of runs
    lines = ["| recorded | label | config | cases | recall@k | MRR@k | misses | seconds |", "|---|---|---|---|---|---|---|---|"]
    lines += [f"| {r['recorded_at'][:19]} | {r['label']} | {r['config_hash']} | {r['cases']} | {r['recall_at_k']:.3f} | {r['mrr_at_k']:.3f} | {r['misses']} | {r['seconds']:.2f} |" for r in rows]
    return "\n".join(lines)
