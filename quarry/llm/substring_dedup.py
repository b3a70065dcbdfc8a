"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A text's UTF-8 bytes are cut where the gear hash of the last bytes has six middle bits zero, at least MIN_BYTES and at most
MAX_BYTES after the last cut (a cut never splits a character). What decides a cut is the bytes just before it, so chunks
fall alike in two texts again soon after an insertion. Bit i of the hash depends on the last i + 1 bytes: the lowest
bits would see too few, so that plain texts would go without a cut. Sixteen bits are kept, computed for all positions at once
by doubling: h over 2n bytes is h over n bytes plus the earlier n shifted by n.

A chunk's first copy (least document id, then row order by position) stays. A later copy goes if it belongs to a run of
adjacent repeated chunks of at least `min_run` bytes, by default the least chunk, or the run is the whole text, however short:
only a text's last piece, where it is shorter than a chunk and the one before it is no copy, stays.

A text *has repeats* if it holds a run of adjacent chunks, of `report` bytes or more or all of the text, each of which
another text holds too, be it the first copy or a later one. What is repeated inside one text only is told apart (within).

Copies are found by one aggregate over digests (with map-side combining, so a hot chunk is one row a task), and a join of
the chunks with the repeated digests, whose skew adaptive execution splits. Runs are islands in a window over each text's
repeated chunks, one sorted pass however long the text is; no group is collected but the spans of a text.

Defined results: null text stays null with no chunks; an empty text has none; rows with equal id and equal text count as
one, rows with equal ids and other texts as several; a null id sorts first; other columns pass through unchanged.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from .common import fresh, released, slices, table, utf8

MIN_BYTES, MAX_BYTES, MASK_BITS, MIN_RUN, REPORT = 24, 256, 6, 24, 96
_GEAR = np.array([int.from_bytes(blake2b(bytes([b]), digest_size=4, person=b"gear").digest(), "little") for b in range(256)], np.uint32)
#: The lowest bit of the hash that decides.
_LOW = 6


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash (h = 2 h + gear[byte], 16 bits that count) after each byte, started at 0."""
    h = _GEAR[data]
    for n in (1, 2, 4, 8):
        h[n:] += h[:-n] << np.uint32(n)
    return h


def chunk_ends(data: np.ndarray, mask_bits: int = MASK_BITS, least: int = MIN_BYTES, most: int = MAX_BYTES) -> list[int]:
    """Where the chunks of one text end. Every byte belongs to one chunk."""
    n = len(data)
    if not n:
        return []
    able = (gear_hashes(data) & np.uint32(((1 << mask_bits) - 1) << _LOW)) == 0
    inner = np.flatnonzero(able) + 1
    head = (data & 0xC0) != 0x80  # a cut before a byte that goes on with a character would split it
    ends, last = [], 0
    inner = inner[inner < n]
    for e in inner[head[inner]].tolist():
        while e - last > most:
            c = last + most
            while not head[c] and c > last + 1:
                c -= 1
            ends.append(c)
            last = c
        if e - last >= least:
            ends.append(e)
            last = e
    while n - last > most:
        c = last + most
        while not head[c] and c > last + 1:
            c -= 1
        ends.append(c)
        last = c
    ends.append(n)
    return ends


_CHUNKS = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("row", LongType()), StructField("mark", LongType()), StructField("at", IntegerType()), StructField("size", IntegerType()), StructField("last", BooleanType())])


def chunks(docs: DataFrame, row: str, text: str, **how) -> DataFrame:
    """A row for each chunk: its digest (128 bits, two longs), the text's row, and its place in bytes."""

    def run(batches):
        for batch in batches:
            rows, marks = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in (0, 1))
            data, offsets = utf8(batch.column(2))
            for i, j in slices(offsets):
                digests, owner, at, size, end = [], [], [], [], []
                for r in range(i, j):
                    own, last = data[offsets[r] : offsets[r + 1]], 0
                    whole = own.tobytes()
                    ends = chunk_ends(own, **how)
                    for e in ends:
                        digests.append(blake2b(whole[last:e], digest_size=16).digest())
                        at.append(last)
                        size.append(e - last)
                        end.append(e == len(own))
                        last = e
                    owner.append((r, len(ends)))
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                of = np.repeat(np.array([x for x, _ in owner], np.int64), [n for _, n in owner])
                for k in range(0, len(of), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[k : k + 100_000])) for x in (both[:, 0], both[:, 1], rows[of], marks[of])] + [pa.array(x[k : k + 100_000], pa.int32()) for x in (at, size)] + [pa.array(end[k : k + 100_000], pa.bool_())], names=_CHUNKS.names)

    return docs.select(F.col(row).alias("row"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).mapInArrow(lambda batches: released(run(batches)), _CHUNKS)


def repeated_spans(docs: DataFrame, *, row: str = "doc_id", text: str = "text", min_run: int = MIN_RUN, report: int = REPORT, **how) -> DataFrame:
    """For each text (row, mark) with any repeated chunk: spans (start and size in bytes, n chunks, in order) of later copies,
    has_repeats (a run that another text holds too), and within (a chunk that this text holds twice)."""
    held = docs.select(F.coalesce(F.col(row).cast("long"), F.lit(-(1 << 63))).alias("row"), F.col(text).alias("text"))
    every = chunks(held, "row", "text", **how)
    seen = every.groupBy("a", "b").agg(F.min(F.struct("row", "mark", "at")).alias("first"), F.max(F.struct("row", "mark", "at")).alias("final")).where("first <> final")
    found = every.join(seen, ["a", "b"]).select(
        "row", "mark", "at", "size", "last",
        F.expr("first.row <> row or first.mark <> mark or first.at <> at").alias("later"),
        F.expr("first.row <> final.row or first.mark <> final.mark").alias("common"),
        F.expr("first.row = row and first.mark = mark and first.at <> at").alias("twice"),
    )
    # islands of adjacent chunks, of later copies and of common ones; a row that stands twice counts once
    by = Window.partitionBy("row", "mark").orderBy("at")
    one = found.withColumn("again", F.lag("at").over(by)).where("again is null or again <> at").drop("again")
    one = one.withColumn("touches", F.coalesce(F.lag(F.col("at") + F.col("size")).over(by) == F.col("at"), F.lit(False)))
    for kind in ("later", "common"):
        one = one.withColumn(f"new_{kind}", F.col(kind) & ~(F.col("touches") & F.coalesce(F.lag(kind).over(by), F.lit(False))))
    for kind in ("later", "common"):
        one = one.withColumn(f"{kind}_run", F.sum(F.col(f"new_{kind}").cast("int")).over(by))
    for kind in ("later", "common"):
        of = Window.partitionBy("row", "mark", f"{kind}_run")
        total = F.sum(F.when(F.col(kind), F.col("size"))).over(of)
        # a run that goes from the text's start to its end is the whole text
        full = F.max(F.col(kind) & (F.col("at") == 0)).over(of) & F.max(F.col(kind) & F.col("last")).over(of)
        one = one.withColumns({f"{kind}_size": total, f"{kind}_n": F.sum(F.col(kind).cast("int")).over(of), f"{kind}_long": (total >= (min_run if kind == "later" else report)) | full})
    span = F.struct(F.col("at").alias("start"), F.col("later_size").cast("int").alias("size"), F.col("later_n").cast("int").alias("n"))
    return one.groupBy("row", "mark").agg(
        F.array_sort(F.collect_list(F.when(F.col("new_later") & F.col("later_long"), span))).alias("spans"),
        F.max(F.col("common") & F.col("common_long")).alias("has_repeats"), F.max("twice").alias("within"),
    )


def _without(batches, at: int, spans: int):
    for batch in batches:
        texts, gone = batch.column(at), batch.column(spans).to_pylist()
        if any(gone):
            kept = []
            for text, own in zip(texts.to_pylist(), gone, strict=True):
                if own and text is not None:
                    raw, out, last = text.encode(), [], 0
                    for s in own:
                        out.append(raw[last : s["start"]])
                        last = s["start"] + s["size"]
                    text = b"".join([*out, raw[last:]]).decode()
                kept.append(text)
            texts = pa.array(kept, texts.type)
        yield pa.RecordBatch.from_arrays([texts if c == at else x for c, x in enumerate(batch.columns)], names=batch.schema.names)


def dedup(docs: DataFrame, *, row: str = "doc_id", text: str = "text", flags: bool = False, **how) -> DataFrame:
    """The documents, their texts without later copies, with the spans that went (null if none) and, if asked, has_repeats and
    within. New names get an underscore where docs has them."""
    a, b, c, d, e = (fresh(docs, x) for x in ("row_key", "row_mark", "spans", "has_repeats", "within"))
    found = repeated_spans(docs, row=row, text=text, **how).withColumn("spans", F.when(F.size("spans") > 0, F.col("spans"))).toDF(a, b, c, d, e)
    joined = docs.join(found, (F.coalesce(docs[row].cast("long"), F.lit(-(1 << 63))) == found[a]) & (F.xxhash64(docs[text]) == found[b]), "left").drop(a, b)
    joined = joined.withColumns({x: F.coalesce(x, F.lit(False)) for x in (d, e)}) if flags else joined.drop(d, e)
    at, of = docs.columns.index(text), len(docs.columns)
    return joined.mapInArrow(lambda batches: released(_without(batches, at, of)), joined.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), flags=True)
    gone = F.coalesce(F.aggregate("spans", F.lit(0), lambda a, x: a + x["size"]), F.lit(0)).cast("long")
    return out.select("doc_id", "text", "has_repeats", gone.alias("removed_bytes"), F.coalesce("spans", F.array()).alias("removed_spans"), F.col("within").alias("repeats_within"))
