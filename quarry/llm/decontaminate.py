"""Benchmark decontamination: suffix arrays over shards of the training texts, searched for every test suffix.

Words are the runs of bytes outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. A test suffix counts
with its first `window` words; an item of fewer words, but not none, counts whole. Each slice of an Arrow batch of
documents is one shard: its suffix array holds the suffixes that can match at all (a bitmap of the test suffixes' first
words, which has no false negatives, leaves the others out), sorted by their first `window` words, and every test suffix
is found by binary search. Matching suffixes that follow each other on one diagonal make one longest verbatim match.

Nothing is shuffled. The test set is passed in blocks of at most BLOCK_WORDS words (or one longer item), each a pass over
the documents. Between blocks the result is written to the shared checkpoint folder and the block's broadcast is dropped, so
what a task, an executor and the driver hold is bounded however large the test set is.

Defined results: null or wordless texts have no words and no matches; null or wordless items, and items without an id,
match nothing; equal items are all reported; documents may repeat, each row is judged alone; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import byte_values, cut, fresh, mix, opened, released, share, slices, table, utf8, word_hashes

WINDOW = 10
#: Words of test items that one pass over the documents takes.
BLOCK_WORDS = 500_000
#: Bytes of documents in one shard.
SHARD_BYTES = 1 << 20
_VALUES = byte_values(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), lower=True)
_VALUES[65:91] = _VALUES[97:123]
_BITS = 22
_SPAN = StructType([StructField("start", IntegerType()), StructField("length", IntegerType())])
_MATCH = StructType([StructField("item_id", LongType()), StructField("item_start", IntegerType()), StructField("start", IntegerType()), StructField("length", IntegerType())])


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the first n words of each suffix that has them."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x100000001B3) + words[k : k + m]
    return mix(out)


class TestSet:
    """Test suffixes of a block of items: distinct windows, where they stand, and what tells whether a suffix can match."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window = window
        ids: dict[str, list[int]] = {}
        for item_id, text in items:
            if item_id is not None and text:
                ids.setdefault(text, []).append(item_id)
        data, offsets = utf8(pa.array(list(ids), pa.large_string()))
        hashes, _, _, first = word_hashes(data, offsets, _VALUES)
        size = np.diff(first)
        # a window starts at each word with `window` words from it on; a shorter text's first word starts one
        count = np.where(size >= window, size - window + 1, np.minimum(size, 1))
        owner = np.repeat(np.arange(len(size)), count)
        self.count = len(owner)
        if not self.count:
            return
        place = np.arange(self.count) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(size, window)[owner]
        padded = np.concatenate([hashes, np.zeros(window, np.uint64)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, window)[first[owner] + place]
        rows = np.where(np.arange(window) < length[:, None], rows, np.uint64(0))
        order = np.lexsort([*rows.T[::-1], length])
        rows, length = rows[order], length[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1) | (length[1:] != length[:-1])])
        at = np.flatnonzero(new)
        self.lengths, self.rows = length[at].astype(np.int64), np.ascontiguousarray(rows[at])
        #: Of each distinct window its places: of window w those from first[w] up to first[w + 1].
        self.first = np.append(at, self.count)
        self.owner, self.place = owner[order], place[order]
        self.ids = list(ids.values())
        self.maps = {}
        for n in (1, 2, 3):
            own = self.rows[(self.lengths == n) if n < 3 else (self.lengths >= 3)]
            if len(own):
                bits = np.zeros(1 << _BITS, bool)
                gram = np.zeros(len(own), np.uint64)
                for k in range(n):
                    gram = gram * np.uint64(0x100000001B3) + own[:, k]
                bits[mix(gram) >> np.uint64(64 - _BITS)] = True
                self.maps[n] = bits

    def places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of windows found: all their places, as indexes of which, texts and words."""
        n = self.first[which + 1] - self.first[which]
        of = np.repeat(np.arange(len(which)), n)
        at = self.first[which][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return of, self.owner[at], self.place[at]

    def items(self, which: np.ndarray) -> set[int]:
        return {i for t in np.unique(self.places(np.unique(which))[1]).tolist() for i in self.ids[t]}

    def find(self, words: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the shard at which a window occurs, and which. last: for each word the end of its text."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.count or not len(words):
            return none
        can = np.zeros(len(words), bool)
        for n, bits in self.maps.items():
            g = _grams(words, n)
            can[: len(g)] |= bits[g >> np.uint64(64 - _BITS)]
        suffixes = np.flatnonzero(can)
        if not len(suffixes):
            return none
        at = suffixes[:, None] + np.arange(self.window)
        inside = at < last[suffixes][:, None]
        keys = np.where(inside, words[np.minimum(at, len(words) - 1)], np.uint64(0))
        order = np.lexsort(keys.T[::-1])
        array, keys = suffixes[order], keys[order]  # the shard's suffix array
        # windows whose first word begins no suffix here (a bitmap without false negatives) need no search
        begun = np.zeros(1 << 16, bool)
        begun[keys[:, 0] >> np.uint64(48)] = True
        asked = np.flatnonzero(begun[self.rows[:, 0] >> np.uint64(48)])
        low, high = self._search(keys, asked, False), self._search(keys, asked, True)
        n = high - low
        of = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        found, which = array[low[of] + inner], asked[of]
        whole = found + self.lengths[which] <= last[found]
        return found[whole], which[whole]

    def _search(self, keys: np.ndarray, asked: np.ndarray, right: bool) -> np.ndarray:
        """For each test window asked for the first suffix not below it (right: the first above), by binary search on its own length."""
        rows = self.rows[asked]
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(keys), np.int64)
        cols = np.arange(self.window)[None, :] < self.lengths[asked][:, None]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            a, b = keys[mid], rows[open_]
            differs = (a != b) & cols[open_]
            at = differs.argmax(axis=1)
            row = np.arange(len(mid))
            below = np.where(differs[row, at], a[row, at] < b[row, at], right)
            low[open_[below]] = mid[below] + 1
            high[open_[~below]] = mid[~below]
        return low


def _judge(tests: TestSet, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, list]]:
    """For each text: words, and for those with matches the positions and windows found."""
    data, offsets = utf8(texts)
    for i, j in slices(offsets, SHARD_BYTES):
        words, _, _, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _VALUES)
        n = np.diff(first)
        found, which = tests.find(words, np.repeat(first[1:], n))
        order = np.lexsort((which, found))
        found, which = found[order], which[order]
        cut = np.searchsorted(found, first)
        for t in range(j - i):
            yield int(n[t]), found[cut[t] : cut[t + 1]] - first[t], which[cut[t] : cut[t + 1]]


def _spans(start: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, n in zip(start.tolist(), length.tolist(), strict=True):
        if out and s <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n - out[-1][0])
        else:
            out.append([s, n])
    return [tuple(x) for x in out]


def _matches(tests: TestSet, start: np.ndarray, which: np.ndarray) -> list[dict]:
    """Longest verbatim matches: windows on one diagonal of a document and an item, each a word after the last."""
    out: dict[tuple, list[list[int]]] = {}
    for k, t, place in zip(*(x.tolist() for x in tests.places(which)), strict=True):
        s, n = int(start[k]), int(tests.lengths[which[k]])
        runs = out.setdefault((t, s - place), [])
        if runs and runs[-1][1] + 1 == s:
            runs[-1][1:] = [s, s + n - runs[-1][0]]
        else:
            runs.append([s, s, n])
    found = sorted((i, r[0], r[0] - d, r[2]) for (t, d), runs in out.items() for i in tests.ids[t] for r in runs)
    return [{"item_id": i, "item_start": at, "start": s, "length": n} for i, s, at, n in found]


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[int, str]]]:
    block, words = [], 0
    for row in benchmark.select(F.col(item).cast("long"), F.col(text)).toLocalIterator():
        block.append((row[0], row[1]))
        words += len(row[1] or "") // 2 + 1  # at least its number of words
        if words >= most:
            yield block
            block, words = [], 0
    if block:
        yield block


def find_matches(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with n_words, spans (word ranges inside windows, merged), items (ids of items with a window here,
    sorted) and matches (longest verbatim matches with their places). The names get an underscore where docs has them."""
    names = [fresh(docs, n) for n in ("n_words", "spans", "items", "matches")]
    schema = StructType([*docs.schema.fields, StructField(names[0], LongType()), StructField(names[1], ArrayType(_SPAN)), StructField(names[2], ArrayType(LongType())), StructField(names[3], ArrayType(_MATCH))])
    held, types = len(docs.columns), to_arrow_schema(schema)

    def judged(first):
        def run(batches, tests):
            for batch in batches:
                new = [[], [], [], []]
                earlier = None if first else [batch.column(held + c).to_pylist() for c in range(1, 4)]
                for t, (n, start, which) in enumerate(_judge(tests, batch.column(batch.schema.names.index(text)))):
                    spans, items, matches = [], set(), []
                    if len(start):
                        spans = _spans(start, tests.lengths[which])
                        items = tests.items(which)
                        matches = _matches(tests, start, which)
                    if earlier:
                        both = sorted([*spans, *((x["start"], x["length"]) for x in earlier[0][t])])
                        spans = _spans(*np.array(both, np.int64).reshape(-1, 2).T)
                        items, matches = items | set(earlier[1][t]), earlier[2][t] + matches
                    for column, x in zip(new, (n, [{"start": s, "length": m} for s, m in spans], sorted(items), matches), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([*batch.columns[:held], *(pa.array(x, types.field(held + c).type) for c, x in enumerate(new))], schema=pa.schema([*list(batch.schema)[:held], *list(types)[held:]]))

        return run

    return _passed(docs, _blocks(benchmark, item, item_text, block_words), window, lambda k: judged(k == 0), schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without a word in any occurrence of a test window; columns as they were."""

    def run(batches, tests):
        for batch in batches:
            yield batch.filter(pa.array([not len(start) for _, start, _ in _judge(tests, batch.column(batch.schema.names.index(text)))], pa.bool_()))

    return _passed(docs, _blocks(benchmark, item, item_text, block_words), window, lambda k: run, docs.schema)


def _passed(docs: DataFrame, blocks: Iterator[list[tuple[int, str]]], window: int, run, schema: StructType) -> DataFrame:
    """The documents after one pass for each block (one for none). Before a further block the last one's result is written."""
    out, block, k = docs, next(blocks, []), 0
    while block is not None:
        tests = share(docs.sparkSession, TestSet(block, window))

        def step(batches, run=run(k), tests=tests):
            return released(run(batches, opened(tests)))

        out, block, k = out.mapInArrow(step, schema), next(blocks, None), k + 1
        if block is not None:
            out = cut(out)
            tests.destroy()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"].cast("long"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)),
hits AS (SELECT doc_id, k, n, item_id FROM places JOIN windows USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
