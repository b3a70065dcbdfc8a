"""Byte-level BPE: ranked merges folded over the byte pieces of distinct words; decoding concatenates binary pieces.

A text is split by the tokenizer's pattern; each distinct match is encoded by itself: its bytes, one piece each, are folded,
the adjacent pair of the lowest rank (the leftmost of equals) merging first, until no pair has a rank; a match that is a
token whole is that token. Ids are the pieces' ranks. The rank file is a parameter and is read on the driver.

The main path folds in Arrow batches with the rank map broadcast (a vocabulary file is of bounded size, checked against
MAX_RANKS), each distinct word once per worker while a bounded memo holds it. encode_words() is the same fold by Spark's
higher-order functions over a literal rank map; the README has the figures for which it isn't the main path.

Defined results: null is the empty text; an empty text has no ids; any text, however long, is encoded whole (a single match
of n bytes takes n log n steps); rows may repeat; other columns pass through.
"""

from __future__ import annotations

import base64
import heapq
import json
import sys
from array import array
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import fresh, opened, released, share, table

MAX_RANKS = 2_000_000
#: Distinct words of one generation that a worker remembers (about 200 bytes each), and the longest of them in characters.
MEMO, MEMO_BYTES = 120_000, 64
_NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 piece and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by ranked merges. A byte without a rank raises KeyError."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > 128:
        return _fold_long(word, ranks)
    get, parts = ranks.get, [word[i : i + 1] for i in range(len(word))]
    pair = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pair:
        best = min(pair)
        if best == _NONE:
            break
        i = pair.index(best)
        merged = parts[i] + parts.pop(i + 1)
        parts[i] = merged
        del pair[i]
        if i:
            pair[i - 1] = get(parts[i - 1] + merged, _NONE)
        if i < len(pair):
            pair[i] = get(merged + parts[i + 1], _NONE)
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, for long words."""
    n = len(word)
    end, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if gone[i] or j >= n or end[j] != stop:
            continue
        gone[j], end[i] = 1, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Coder:
    """Encodes and decodes; sent to executors once, its memo shared by the tasks of a worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if len(ranks) > MAX_RANKS:
            raise ValueError(f"{len(ranks)} ranks; at most {MAX_RANKS} can be broadcast")
        import regex

        self.ranks, self.pattern = ranks, pattern
        self.key = sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
        self.split = regex.compile(pattern)

    def __getstate__(self):
        return self.ranks, self.pattern, self.key

    def __setstate__(self, state):
        import regex

        self.ranks, self.pattern, self.key = state
        self.split = regex.compile(self.pattern)

    def memo(self) -> list[dict[str, bytes]]:
        """Two generations of words: what both have not, was not met lately."""
        held = sys.__dict__.setdefault("_quarry_words", {})
        if self.key not in held:
            held.clear()
            held[self.key] = [{}, {}]
        return held[self.key]

    def encode(self, text: str, memo: list[dict[str, bytes]]) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = self.split.findall(text)
        young, old = memo
        for word in {*words}:
            if word in young:
                continue
            if (known := old.get(word)) is None:
                ids = array("I", fold(word.encode(), self.ranks))
                if sys.byteorder == "big":
                    ids.byteswap()
                known = ids.tobytes()
            young[word] = known
        out = b"".join([young[w] for w in words])
        if words and len(max(words, key=len)) > MEMO_BYTES:
            for w in {w for w in words if len(w) > MEMO_BYTES}:
                young.pop(w, None)
        if len(young) > MEMO:
            memo[:] = [{}, young]
        return out

    def pieces(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for piece, rank in self.ranks.items():
            out[rank] = piece
        return out


def _ids(raw: bytes) -> array:
    ids = array("I")
    ids.frombytes(raw)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text: str = "text", name: str = "ids") -> DataFrame:
    """The documents with their ids, an array of int, in a new column."""
    schema = StructType([*docs.schema.fields, StructField(fresh(docs, name), ArrayType(IntegerType(), False))])
    coder, names = share(docs.sparkSession, Coder(ranks, pattern)), schema.names

    def run(batches):
        own = opened(coder)
        memo = own.memo()
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text))
            for i in range(0, len(texts), 256):
                ids = [pa.array(_ids(own.encode(t.as_py() or "", memo)), pa.int32()) for t in texts[i : i + 256]]
                ends = [0]
                for x in ids:
                    ends.append(ends[-1] + len(x))
                part = batch.slice(i, len(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(ids))], names=names)

    return docs.mapInArrow(lambda batches: released(run(batches)), schema)


def decode(rows: DataFrame, ranks: dict[bytes, int], *, ids: str = "ids", name: str = "bytes") -> DataFrame:
    """The rows with the bytes that their ids stand for. Null ids: null; an unknown id raises."""
    schema = StructType([*rows.schema.fields, StructField(fresh(rows, name), BinaryType())])
    coder, names = share(rows.sparkSession, Coder(ranks, "")), schema.names

    def run(batches):
        pieces = opened(coder).pieces()
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids))
            out = [None if (x := c.as_py()) is None else b"".join([pieces[i] for i in x]) for c in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=names)

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, row: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Of each text: row, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, keeping only digests (and ids, if asked)."""
    coder = share(docs.sparkSession, Coder(ranks, pattern))
    names = ["row", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + ids]

    def run(batches):
        own = opened(coder)
        memo, pieces = own.memo(), own.pieces()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch, out = whole.slice(start, 256), [[], [], []]
                held = []
                for t in batch.column(1):
                    raw = own.encode(t.as_py() or "", memo)
                    own_ids = _ids(raw)
                    back = b"".join([pieces[i] for i in own_ids])
                    for column, x in zip(out, (len(raw) // 4, sha256(raw).hexdigest(), sha256(back).hexdigest()), strict=True):
                        column.append(x)
                    if ids:
                        held.append(pa.array(np.frombuffer(own_ids, np.uint32).astype(np.int32)))
                columns = [batch.column(0), pa.array(out[0], pa.int64()), *(pa.array(x, pa.string()) for x in out[1:])]
                if ids:
                    ends = np.cumsum([0, *out[0]]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(held)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[row].dataType.simpleString()
    return docs.select(F.col(row).alias("row"), F.col(text).alias("text")).mapInArrow(lambda batches: released(run(batches)), f"row {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids).withColumnRenamed("row", row)


# --- by higher-order functions


def encode_words(words: DataFrame, ranks: dict[bytes, int], *, word: str = "word", name: str = "ids", buckets: int = 8192) -> DataFrame:
    """Ids of distinct words by Spark's higher-order functions: a fold whose state is the word's pieces, and a literal rank
    map (an array of small maps, found by hash: a map's own lookup is a scan). Bytes stand as Latin-1 characters."""
    spark = words.sparkSession
    rows = spark.createDataFrame([(p.decode("latin-1"), r) for p, r in ranks.items()], "piece string, rank int")
    dealt: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, rank, at in rows.withColumn("at", F.pmod(F.hash("piece"), F.lit(buckets))).collect():
        dealt[at][piece] = rank
    literal = F.from_json(F.lit(json.dumps(dealt)), "array<map<string,int>>")
    rank = lambda p: F.try_element_at(F.get(literal, F.pmod(F.hash(p), F.lit(buckets))), p)
    text = F.decode(F.encode(F.col(word), "UTF-8"), "ISO-8859-1")
    pair = lambda acc: F.zip_with(F.slice(acc, 1, F.size(acc) - 1), F.slice(acc, 2, F.size(acc) - 1), lambda a, b: rank(F.concat(a, b)))

    def step(state, _):
        acc, best = state["acc"], F.array_min(state["pairs"])
        i = F.array_position(state["pairs"], best).cast("int")
        merged = F.concat(F.slice(acc, 1, i - 1), F.array(F.concat(F.get(acc, i - 1), F.get(acc, i))), F.slice(acc, i + 2, F.size(acc)))
        return F.when(best.isNull(), state).otherwise(F.struct(merged.alias("acc"), pair(merged).alias("pairs")))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    start = F.struct(chars.alias("acc"), pair(chars).alias("pairs"))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), start, step, lambda s: F.transform(s["acc"], rank))
    return words.withColumn(fresh(words, name), F.when(F.length(text) == 0, F.array().cast("array<int>")).when(rank(text).isNotNull(), F.array(rank(text))).otherwise(folded))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
