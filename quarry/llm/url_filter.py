"""URL rules: a trie over reversed host labels and path segments, broadcast, with longest-match precedence.

A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with the rule's path. Of the rules
that fit, the one with the longest host (in labels), then the longest path wins; of equal rules block wins.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or
the end; without ``://`` (or null) both are empty and no rule fits. No rule: `default`. Rule hosts are lower-cased; rules
with a null host or path count these as empty; a rule with an empty host fits every URL with ``://``.

Rules are broadcast only up to MAX_RULES rules and MAX_RULE_BYTES characters, counted first. Beyond, each distinct URL is
expanded to its (host suffix, leading path segments) keys, whose number its own length bounds; these are joined with the
rules, and one aggregate takes the best.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import fresh, opened, share, table

MAX_RULES, MAX_RULE_BYTES = 500_000, 64 << 20
#: The rules of the query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


class Trie:
    """Node: {"next": {label: node}, "path": {segment: node}, "rules": [(rest of path, rule, verdict)]}."""

    def __init__(self, rules):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("next", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault("path", {}).setdefault(segment, {})
            node.setdefault("rules", []).append((rest, host + path, verdict))
        self._order(self.root)

    def _order(self, node: dict) -> None:
        todo = [node]
        while todo:
            node = todo.pop()
            if "rules" in node:
                node["rules"].sort(key=lambda x: (-len(x[0]), x[2] != "block"))
            for k in ("next", "path"):
                todo.extend(node.get(k, {}).values())
            if "paths" in node:
                todo.append(node["paths"])

    def find(self, host: str, path: str):
        """(rule, verdict) of the longest match, or None."""
        node, hosts = self.root, []
        if "paths" in node:
            hosts.append(node["paths"])
        for label in reversed(host.split(".")):
            node = node.get("next", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                hosts.append(node["paths"])
        segments = path.split("/")
        for node in reversed(hosts):
            best = None
            for k, segment in enumerate(segments):
                for rest, rule, verdict in node.get("rules", ()):
                    if segment.startswith(rest):
                        best = rule, verdict
                        break
                node = node.get("path", {}).get(segment) if k < len(segments) - 1 else None
                if node is None:
                    break
            if best:
                return best
        return None


def split_url(url: str | None) -> tuple[str, str] | None:
    """Host and path; None without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return None
    rest = url[at + 3 :]
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    host = rest[: end if slash < 0 else slash]
    return host.translate(_LOWER), "" if slash < 0 else rest[slash:end]


_LOWER = {c: c + 32 for c in range(65, 91)}


def _clean(rules: DataFrame) -> DataFrame:
    return rules.select(F.lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()


def judge(urls: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", max_rules: int = MAX_RULES, max_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """The rows with host, path, rule (null if none) and verdict. New names get an underscore where the rows have them."""
    names = [fresh(urls, n) for n in ("host", "path", "rule", "verdict")]
    rules = _clean(rules)
    n, size = rules.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0))).first()
    if n > max_rules or size > max_bytes:
        return _joined(urls, rules, url, default, names)
    trie = share(urls.sparkSession, Trie([tuple(r) for r in rules.collect()]))
    schema = StructType([*urls.schema.fields, *(StructField(x, StringType()) for x in names)])

    def run(batches):
        rules = opened(trie)
        for batch in batches:
            new = [[], [], [], []]
            for x in batch.column(batch.schema.names.index(url)).to_pylist():
                parts = split_url(x)
                found = rules.find(*parts) if parts else None
                for column, value in zip(new, (*(parts or ("", "")), *(found or (None, default))), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in new)], names=[*batch.schema.names, *names])

    return urls.mapInArrow(run, schema)


def _joined(urls: DataFrame, rules: DataFrame, url: str, default: str, names: list[str]) -> DataFrame:
    """The same for more rules than can be broadcast: distinct URLs' keys joined with the rules' keys."""
    key = F.struct(
        F.when(F.col("u").contains("://"), F.translate(F.regexp_extract("u", r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("host"),
        F.when(F.col("u").contains("://"), F.regexp_extract("u", r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1)).alias("path"),
    )
    own = urls.select(F.col(url).alias("u")).where(F.col("u").contains("://")).distinct().select("u", key.alias("k")).select("u", "k.*")
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    own = own.withColumn("labels", labels).withColumn("segments", segments)
    suffixes = F.concat(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), ".")), F.array(F.lit("")))
    keys = own.select("u", "segments", F.explode(F.array_distinct(suffixes)).alias("host")).select("u", "host", F.posexplode(F.col("segments")).alias("k", "segment"), F.col("segments"))
    keys = keys.select("u", "host", F.array_join(F.slice("segments", F.lit(1), F.col("k")), "/").alias("whole"), "k", "segment")
    parts = F.split("path", "/")
    rules = rules.select("host", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("whole"), (F.size(parts) - 1).alias("k"), F.element_at(parts, -1).alias("rest"), F.concat("host", "path").alias("rule"), "verdict")
    fits = keys.join(rules, ["host", "whole", "k"]).where(F.col("segment").startswith(F.col("rest")))
    depth = F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\.")))
    best = fits.groupBy("u").agg(F.max(F.struct(depth.alias("d"), F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("best"))
    u, b = fresh(urls, "url_key"), fresh(urls, "url_best")
    best = best.select(F.col("u").alias(u), F.col("best").alias(b))
    out = urls.join(best, urls[url] == best[u], "left")
    here = F.col(url).contains("://")
    return out.select(
        *urls.columns,
        F.when(here, F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("").alias(names[0]),
        F.when(here, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1)).otherwise("").alias(names[1]),
        F.col(b)["rule"].alias(names[2]), F.coalesce(F.col(b)["verdict"], F.lit(default)).alias(names[3]),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_FITS = "\n".join(f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for h, p, _ in sorted(RULES, key=lambda r: (-len(r[0].split(".")), -len(r[1]))))
_BLOCKS = ", ".join(f"'{h + p}'" for h, p, v in RULES if v == "block")
SQL = rf"""
WITH split AS (
  SELECT page_id, coalesce(url, '') AS url, contains(coalesce(url, ''), '://') AS whole FROM pages
), parts AS (
  SELECT page_id,
    CASE WHEN whole THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN whole THEN regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)?', 1) ELSE '' END AS path
  FROM split
), judged AS (
  SELECT page_id, host, path, CASE
{_FITS}
    ELSE NULL END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({_BLOCKS}) THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""
