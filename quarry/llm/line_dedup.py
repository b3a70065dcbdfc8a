"""Line dedup: repeated runs of lines by a suffix array over line ids, built by distributed prefix doubling.

1. Lines are named by 128-bit hashes. Those that occur once can be in no repeated run; the others get ids (in hash order)
   and form, text by text, stretches of adjacent repeated lines. Stretches too small for a run (weight, below) end here.
2. Prefix doubling: rank j orders the suffixes of all stretches by their first 2**j lines. Rank j + 1 sorts the pairs
   (rank j here, rank j of the suffix 2**j lines on); suffixes that no longer reach so far have none. Each round is one
   sort of the distinct pairs, so a pair that fills a third of the rows is one row there.
3. Any run of L lines, 2**j <= L < 2**(j+1), is named by L and the ranks j of its first and of its last 2**j lines. The
   suffixes that agree in that name are an interval of the suffix array whose longest common prefix is L or more.
   For each line the shortest run from it on, and the shortest run up to it, of `least` characters are looked up: a maximal
   repeated run is the union of these. Doubling stops where they are all named (runs of `least` characters are short).
4. An interval's first suffix (least document id, then line) stays. All lines of the later ones are deleted.

A line's weight is its characters plus one for its end. DataFrame and SQL functions only; each round's ranks are written
to the shared checkpoint folder. Joins that carry a hot line or run are plain equi-joins, which adaptive execution splits.

Defined results: null text stays null; an empty text is one empty line; a text that loses every line becomes the empty
text (whole_copy true); rows of equal id and text count as one text, rows of equal id and other text as several; a null
id sorts first; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, table

#: Weight of the shortest repeated run that is deleted.
LEAST = 40
#: Names of runs, counted, up to which their first places are broadcast (some 15 MB).
LOCAL_RUNS = 200_000


def _rows(docs: DataFrame, row: str, text: str) -> DataFrame:
    """Of each text: row and mark (together its key), and text."""
    return docs.select(F.coalesce(F.col(row).cast("long"), F.lit(-(1 << 63))).alias("row"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))


def stretches(docs: DataFrame, row: str, text: str, least: int) -> DataFrame:
    """Adjacent lines that all occur more than once: row, mark, stretch, pos, weight, id. Only stretches of `least` weight."""
    lines = _rows(docs, row, text).select("row", "mark", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("row", "mark", "pos", (F.length("line") + 1).alias("weight"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))
    often = lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g")
    ids = cut(often.orderBy("h", "g").select("h", "g", F.monotonically_increasing_id().alias("id")))
    kept = lines.join(ids, ["h", "g"]).select("row", "mark", "pos", "weight", "id").distinct()
    text_ = Window.partitionBy("row", "mark")
    kept = kept.withColumn("stretch", F.col("pos") - F.row_number().over(text_.orderBy("pos")))
    whole = Window.partitionBy("row", "mark", "stretch")
    return cut(kept.withColumn("total", F.sum("weight").over(whole)).where(F.col("total") >= least))


def runs(lines: DataFrame, least: int) -> DataFrame:
    """For each line of a stretch the shortest runs of `least` weight from it and up to it: row, mark, stretch, start, n."""
    by = Window.partitionBy("row", "mark", "stretch")
    up = lines.withColumn("upto", F.sum("weight").over(by.orderBy("pos")))
    up = up.withColumn("after", F.col("upto") - F.col("weight"))
    ahead = by.orderBy("after").rangeBetween(0, least - 1)
    behind = by.orderBy("upto").rangeBetween(1 - least, 0)
    both = up.select(
        "row", "mark", "stretch", "pos",
        F.when(F.col("total") - F.col("after") >= least, F.count(F.lit(1)).over(ahead)).alias("ahead"),
        F.when(F.col("upto") >= least, F.count(F.lit(1)).over(behind)).alias("behind"),
    )
    from_here = F.when(F.col("ahead").isNotNull(), F.struct(F.col("pos").alias("start"), F.col("ahead").cast("int").alias("n")))
    up_to_here = F.when(F.col("behind").isNotNull(), F.struct((F.col("pos") - F.col("behind").cast("int") + 1).alias("start"), F.col("behind").cast("int").alias("n")))
    found = both.select("row", "mark", "stretch", F.explode(F.array_compact(F.array(from_here, up_to_here))).alias("run"))
    return found.select("row", "mark", "stretch", "run.start", "run.n").distinct()


def doubled(ranked: DataFrame, reach: int) -> DataFrame:
    """Ranks by the first 2 * reach lines of ranks by the first reach lines (row, mark, stretch, pos, rank)."""
    by = Window.partitionBy("row", "mark", "stretch").orderBy("pos")
    pairs = ranked.withColumn("next", F.lead("rank", reach).over(by)).where("next is not null")
    order = cut(pairs.select("rank", "next").distinct().orderBy("rank", "next").withColumn("new", F.monotonically_increasing_id()))
    return cut(pairs.join(order, ["rank", "next"]).select("row", "mark", "stretch", "pos", F.col("new").alias("rank")))


def later_copies(docs: DataFrame, *, row: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Runs of lines (row, mark, start, n) that a text earlier in the order of ids, or an earlier line, holds too."""
    lines = stretches(docs, row, text, least)
    wanted = cut(runs(lines, least))
    longest = wanted.agg(F.max("n")).first()[0] or 0
    ranked, reach, copies = lines.select("row", "mark", "stretch", "pos", F.col("id").alias("rank")), 1, None
    while reach <= longest:
        own = wanted.where((F.col("n") >= reach) & (F.col("n") < 2 * reach))
        first = ranked.select("row", "mark", "stretch", F.col("pos").alias("start"), F.col("rank").alias("a"))
        last = ranked.select("row", "mark", "stretch", F.col("pos").alias("tail"), F.col("rank").alias("b"))
        named = own.join(first, ["row", "mark", "stretch", "start"])
        if reach == 1:
            named = named.withColumn("b", F.col("a"))
        else:
            named = named.withColumn("tail", F.col("start") + F.col("n") - reach).join(last, ["row", "mark", "stretch", "tail"])
        named = named.select("row", "mark", "start", "n", "a", "b")
        interval = named.groupBy("n", "a", "b").agg(F.min(F.struct("row", "mark", "start")).alias("first"), F.count(F.lit(1)).alias("all")).where("`all` > 1").drop("all")
        # written first, one row a name: a hot run's rows are then split by adaptive execution, or stay where they are
        interval = cut(interval)
        found = named.join(F.broadcast(interval) if interval.count() <= LOCAL_RUNS else interval, ["n", "a", "b"]).where("row <> first.row or mark <> first.mark or start <> first.start").select("row", "mark", "start", "n")
        copies = found if copies is None else copies.union(found)
        reach *= 2
        if reach <= longest:
            ranked = doubled(ranked, reach // 2)
    return copies if copies is not None else wanted.select("row", "mark", "start", "n").limit(0)


def dedup(docs: DataFrame, *, row: str = "doc_id", text: str = "text", least: int = LEAST, gone: str = "n_deleted") -> DataFrame:
    """The documents, their texts without later copies of repeated runs, and how many lines went (in a new column)."""
    a, b, c = (fresh(docs, x) for x in ("row_key", "row_mark", gone))
    spans = later_copies(docs, row=row, text=text, least=least)
    lost = spans.select("row", "mark", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    # a bit string would do for short texts; a sorted list of positions is bounded by the text's own length
    lost = lost.groupBy("row", "mark").agg(F.array_sort(F.collect_list("pos")).alias("lost")).toDF(a, b, c)
    joined = docs.join(lost, (F.coalesce(docs[row].cast("long"), F.lit(-(1 << 63))) == lost[a]) & (F.xxhash64(docs[text]) == lost[b]), "left")
    # one pass over the positions: lines before, between and after the deleted ones
    d = fresh(joined, "lines")
    joined, lines = joined.withColumn(d, F.split(F.col(text), "\n", -1)), F.col(d)
    ends = F.concat(F.array(F.lit(-1)), F.col(c), F.array(F.size(lines)))
    parts = F.zip_with(F.slice(ends, 1, F.size(F.col(c)) + 1), F.slice(ends, 2, F.size(F.col(c)) + 1), lambda x, y: F.slice(lines, x + 2, y - x - 1))
    kept = F.when(F.col(c).isNull(), F.col(text)).otherwise(F.array_join(F.flatten(parts), "\n"))
    return joined.select(*[kept.alias(x) if x == text else F.col(f"`{x}`") for x in docs.columns], F.coalesce(F.size(c), F.lit(0)).alias(c), (F.col(c).isNotNull() & (F.size(c) == F.size(lines))).alias(fresh(docs, "whole_copy")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
