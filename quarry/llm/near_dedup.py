"""Near-duplicate documents by Order MinHash, candidates verified by banded alignment.

Words are runs of bytes other than ASCII white space, A-Z taken as a-z. A text's k-mers are its runs of k words (a shorter
text is one k-mer), each labelled with how often it has occurred before. A sketch holds, for each of several random orders,
the few least labelled k-mers *in the order of the text*, hashed to one key: two texts share a key only if they share those
k-mers in that order, so texts whose parts were moved agree less, as their edit similarity does. Sketches are of runs of
five words, and of three, of which scattered edits break fewer. Equal texts have one representative (their least id) from
the start. Representatives that share a key form a bucket. A bucket of n gives n - 1 candidate pairs, its hub with each
other member, never all pairs. A candidate is a link if the edit distance over words, by a bit-parallel alignment inside
the band that the similarity allows, gives 0.8 or more; pairs that bags of words rule out are not aligned. Each text meets
the hub it shares most sketches with first, and other hubs only where these links leave the two in different components.

What hubs can't tell goes to an exact join over words: texts of a bucket whose members are still in different components,
of which neither is its hub, and texts of SHORT words at most, in which edits may leave no run whole. Texts of n words at
most that are similar share n - floor(0.2 n) labelled words or more. Under any one order of words, the first floor(0.2 m) + 1 words of
each (m its own length) then have one in common. The order is by rarity (counted over all texts of this join; it decides the work, never the
result), so what many texts quote comes last and joins nobody. Where the first words of two texts of different components
meet, lengths and small bags of words are compared at once, so that only what may be similar is dealt out and aligned, and
a pair with many such words in common comes once. No bucket, member or candidate is capped or dropped.
Classes are the components of the links: one task joins them up to LOCAL_EDGES edges, alternating star contraction beyond.

So a link is missed only if two longer texts share none of 64 sketches: at 0.80 one in some hundred, from 0.85 on none was
seen (tests/llm/test_dedup.py measures it).

Defined results: null is taken as the empty text; equal texts are one class; a class's id is its least document id; rows
without an id are in no class and dedup() keeps them; of rows with equal id and text dedup() keeps one; other columns pass.
"""

from __future__ import annotations

from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import byte_values, cut, fresh, mix, parts, released, slices, swept, table, utf8, word_hashes

KMER, SIMILARITY = 5, 0.8
#: Sketches, their picks, and the words of their k-mers. The second level's shorter k-mers outlive scattered edits.
LEVELS = ((16, 3, KMER), (48, 2, 3))
#: Texts of so many words at most are compared by their words, since few k-mers outlive edits in them.
SHORT = 48
#: Words that the first words of two similar texts have in common at least.
SHARED = 1
#: Places of a text's small bag, and how many of its first words, the most frequent, its rows in the exact join carry beside.
PLACES, LEADERS = 512, 16
#: Counters of words for their order.
COUNTERS = 1 << 20
#: Edges, counted, up to which one task finds components (about 100 MB).
LOCAL_EDGES = 500_000
#: Bytes of texts, summed, up to which those of one side of the pairs are broadcast instead of dealt out.
LOCAL_BYTES = 32 << 20
#: Bytes of bags, about, in a block of them where pairs meet block by block, and blocks at least.
BLOCK_BYTES, LEAST_BLOCKS = 8 << 20, 8
#: Ids, counted, up to which a set of them is broadcast to pick rows before these are dealt out (some tens of MB).
LOCAL_IDS = 1_000_000
_VALUES = byte_values(b"\t\n\x0b\x0c\r ", lower=True)
#: Labelled k-mers of one text handled at a time: bounds the sketch matrix of a very long text.
_STRETCH = 4_096
_NO_WORD = np.int32(2**31 - 1)
_rng = np.random.RandomState(20240229)
_MULTIPLY = (_rng.randint(0, 1 << 62, 512, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.randint(0, 1 << 62, 512, dtype=np.int64).astype(np.uint64)


def kmers(words: np.ndarray, k: int = KMER) -> np.ndarray:
    """Hashes of a text's k-mers, each labelled with its number of earlier occurrences."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        out = out * np.uint64(0x100000001B3) + words[i : i + n]
    out = mix(out)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not new.all():
        at = np.arange(n)
        label = np.empty(n, np.uint64)
        label[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        out = mix(out + label * np.uint64(0x9E3779B97F4A7C15))
    return out


def sketch(labelled: np.ndarray, sketches: int = LEVELS[0][0], picks: int = LEVELS[0][1]) -> np.ndarray:
    """One key for each random order: the least k-mers, in the order of the text. No k-mers, no keys."""
    if not len(labelled):
        return labelled
    a, b = _MULTIPLY[:sketches, None], _ADD[:sketches, None]
    row = np.arange(sketches)
    best = at = None
    for i in range(0, len(labelled), _STRETCH):
        some = labelled[i : i + _STRETCH]
        h = (some[None, :] ^ b) * a
        h ^= h >> np.uint64(29)
        where = np.arange(i, i + len(some))
        if best is not None:
            h, where = np.concatenate([best, h], 1), np.concatenate([at, np.broadcast_to(where, (sketches, len(some)))], 1)
        n = min(picks, h.shape[1])
        best, near = np.empty((sketches, n), np.uint64), np.empty((sketches, n), np.int64)
        for k in range(n):
            near[:, k] = h.argmin(1)
            best[:, k] = h[row, near[:, k]]
            h[row, near[:, k]] = ~np.uint64(0)
        at = where[near] if where.ndim == 1 else np.take_along_axis(where, near, 1)
    best = np.take_along_axis(best, np.argsort(at, axis=1), 1)
    key = np.arange(1, sketches + 1, dtype=np.uint64)
    for i in range(best.shape[1]):
        key = mix(key * np.uint64(0x100000001B3) + best[:, i])
    return key


def rarity(texts: DataFrame) -> np.ndarray:
    """For each counter of labelled words a logarithm of its count over all the texts (one byte each)."""

    def run(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in slices(offsets):
                words, _, _, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _VALUES)
                own = [kmers(words[first[t] : first[t + 1]], 1) for t in range(j - i)]
                counts += np.bincount(_counter(np.concatenate(own)), minlength=COUNTERS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["at", "n"])

    found = texts.select("text").mapInArrow(lambda batches: released(run(batches)), "at int, n long").groupBy("at").agg(F.round(F.log2(F.sum("n") + 1) * 4).cast("int").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.uint8)  # as many rows as counters at most
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def _counter(labelled: np.ndarray) -> np.ndarray:
    return (labelled & np.uint64(COUNTERS - 1)).astype(np.int64)


def first_words(words: np.ndarray, order: np.ndarray, least: float = SIMILARITY, shared: int = SHARED) -> np.ndarray:
    """The labelled words (32 bits of them) of a text that come first in the order, as many as a similar text must meet."""
    own = kmers(words, 1)
    n = int(len(own) * (1 - least) + 1e-9) + shared
    return own[np.lexsort((own, order[_counter(own)]))[:n]].astype(np.uint32).view(np.int32)


def leading(first: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of the first words the most frequent, as many as there are leaders: two texts that meet have these in common rather than
    words that only few texts hold."""
    return first[np.lexsort((first, -order[_counter(first.view(np.uint32).astype(np.uint64))].astype(np.int16)))[:LEADERS]]


def bag(words: np.ndarray) -> bytes:
    """How many words fall into each of as many places as the largest power of two up to their number (255 at most in one)."""
    places = 1 << max(0, len(words).bit_length() - 1)
    return np.minimum(np.bincount((words & np.uint64(places - 1)).astype(np.int64), minlength=places), 255).astype(np.uint8).tobytes()


def signature(words: np.ndarray, first: np.ndarray) -> bytes:
    """A small bag (counts of words by place, 15 at most, two in a byte) and the least of the first words, padded with the largest."""
    counts = np.minimum(np.bincount((words & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES), 15).astype(np.uint8)
    least = np.full(LEADERS, _NO_WORD, np.int32)
    own = np.sort(first)[:LEADERS]
    least[: len(own)] = own
    return (counts[::2] | counts[1::2] << 4).tobytes() + least.tobytes()


def _signatures(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(held), np.uint8).reshape(len(held), PLACES // 2 + 4 * LEADERS)
    both = raw[:, : PLACES // 2]
    bags = np.empty((len(held), PLACES), np.int8)
    bags[:, ::2], bags[:, 1::2] = both & 15, both >> 4
    return bags, np.ascontiguousarray(raw[:, PLACES // 2 :]).view(np.int32)


def apart(a: bytes, b: bytes, n: int | None = None, m: int | None = None) -> int:
    """Words, at least, that one of two texts (of n and m words) has and the other lacks, by their bags: never more than their
    edit distance. Words that full places don't count meet none of the other text's unless a place is full in both."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int32) for v in (a, b))
    places = min(len(x), len(y))
    x, y = (np.minimum(v.reshape(-1, places).sum(0), 255) for v in (x, y))  # counts of joined places end at 255 too
    more = x - y
    up, down = int(more[more > 0].sum()), -int(more[more < 0].sum())
    if n is not None and m is not None:
        over, under = n - int(x.sum()), m - int(y.sum())
        if over or under:
            meet = bool(((x == 255) & (y == 255)).any())
            up, down = up + max(0, over - under * meet), down + max(0, under - over * meet)
    return max(up, down)


_SKETCHED = StructType([StructField("id", LongType()), StructField("a", LongType()), StructField("b", LongType()), StructField("n", IntegerType()), StructField("keys", ArrayType(LongType())), StructField("bag", BinaryType())])
_DRESSED = StructType([StructField("id", LongType()), StructField("n", IntegerType()), StructField("words", ArrayType(IntegerType())), StructField("sign", BinaryType())])


def _lists(rows: list, kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows), kind))


def _words_of(batches):
    """Of batches (id, text): rows of a slice, its text bytes with their offsets, and the word hashes of each text."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for i, j in slices(offsets):
            words, _, _, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _VALUES)
            yield batch.column(0)[i:j], data, offsets[i : j + 1], [words[first[t] : first[t + 1]] for t in range(j - i)]


def _sketched(docs: DataFrame, levels: tuple) -> DataFrame:
    """Of (id, text): id, a 128-bit digest of the text, its number of words, sketch keys, bag."""

    def run(batches):
        for ids, data, offsets, own in _words_of(batches):
            keys = [np.concatenate([mix(sketch(kmers(x, k), m, p) + np.uint64(level)) for level, (m, p, k) in enumerate(levels)]).view(np.int64) for x in own]
            digests = np.frombuffer(b"".join(blake2b(data[p:q].tobytes(), digest_size=16).digest() for p, q in zip(offsets[:-1], offsets[1:], strict=True)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.ascontiguousarray(digests[:, 0])), pa.array(np.ascontiguousarray(digests[:, 1])), pa.array([len(x) for x in own], pa.int32()), _lists(keys, pa.int64()), pa.array([bag(x) for x in own], pa.binary())], names=_SKETCHED.names)

    return docs.mapInArrow(lambda batches: released(run(batches)), _SKETCHED)


def _dressed(docs: DataFrame, order: np.ndarray, least: float) -> DataFrame:
    """Of (id, text): what the exact join needs: id, number of words, first words, signature."""

    def run(batches):
        for ids, _, _, own in _words_of(batches):
            begin = [first_words(x, order, least) for x in own]
            signs = [signature(x, leading(f, order)) for x, f in zip(own, begin, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in own], pa.int32()), _lists(begin, pa.int32()), pa.array(signs, pa.binary())], names=_DRESSED.names)

    return docs.mapInArrow(lambda batches: released(run(batches)), _DRESSED)


def distance_within(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences, or most + 1 if it is more. Bit-parallel, in a band of 2 most + 1 diagonals."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    if not m:
        return n
    most = min(most, n)
    # Column j holds rows j - most .. j + most of the band; bit t of a vector is row j - most + t.
    width = 2 * most + 1
    full = (1 << width) - 1
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << (i + most)  # shifted, so that rows before the first have room
    up, down = (full >> most) << most, 0  # in column 0, row r costs r; the rows before the first don't count
    score = most  # value at the band's last row (row most of column 0)
    low = 1 << (width - 1)
    for j, y in enumerate(b):
        match = (where.get(y, 0) >> j) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right = (down | ~(diagonal | up)) & full
        left = diagonal & up
        # the band's last row moves down one row a column: along the diagonal
        score += 0 if diagonal & low else 1
        up = (left | ~((diagonal >> 1) | right)) & full
        down = (diagonal >> 1) & right
    # now at column m: the last row of the band is m + most (rows past n included); walk up to row n
    row = m + most
    t = width - 1
    while row > n:
        t -= 1
        score -= (up >> t & 1) - (down >> t & 1)
        row -= 1
    return score if score <= most else most + 1


def similar(a: str | None, b: str | None, least: float = SIMILARITY) -> bool:
    """Whether the edit similarity of the texts' words, 1 - distance / longer length, is at least `least`."""
    x, y = _words(a), _words(b)
    n = max(len(x), len(y))
    most = int(n * (1 - least) + 1e-9)
    if n - (Counter(x) & Counter(y)).total() > most:  # each word of the longer text without a partner costs one
        return False
    return distance_within(x, y, most) <= most


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _union_find(batches):
    """Node and label of the components of all edges in these batches."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "label"])


def components(edges: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """Of edges (a, b): node and label, the least node of its component. Nodes without an edge have no row.

    Up to `most` edges, counted first, one task joins them; more are contracted by alternating stars, each a few shuffles."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= most:
        return cut(now.coalesce(1).mapInArrow(_union_find, "node long, label long"))
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = cut(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.sum(F.xxhash64("b", "a") % 998_244_353)).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of these ids (distinct, counted): picked by broadcast ids as long as LOCAL_IDS allows, before a join deals the rows out."""
    return rows.join(F.broadcast(ids) if ids.count() <= LOCAL_IDS else ids, "id", "left_semi")


def _sides(pairs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (id, ...) of the first and of the second text of the pairs (a, b)."""
    return tuple(_among(rows, cut(pairs.select(F.col(x).alias("id")).distinct())) for x in "ab")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts are similar."""
    left, right = _sides(pairs, texts)
    left, right = left.select(F.col("id").alias("a"), F.col("text").alias("x")), right.select(F.col("id").alias("b"), F.col("text").alias("y"))
    # the pairs with one text each aren't dealt out again where the other side's texts are few
    few = left.agg(F.coalesce(F.sum(F.octet_length("x")), F.lit(0))).first()[0] <= LOCAL_BYTES
    whole = pairs.join(right, "b").join(F.broadcast(left) if few else left, "a").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            kept = [similar(x.as_py(), y.as_py(), least) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return whole.mapInArrow(lambda batches: released(run(batches)), "a long, b long")


def _tested(members: DataFrame) -> DataFrame:
    """Of (id, key): each bucket's hub, its least id, with its other members: key, size, a (the hub), b."""
    # written first, a row a bucket: adaptive execution can then split the members of a hot one
    hubs = swept(members.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    return members.join(hubs, "key").where("hub <> id").select("key", "size", F.col("hub").alias("a"), F.col("id").alias("b"))


def _small_apart(bags: np.ndarray, over: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """As apart(), of pairs of rows by their small bags; over: words of each row that its full places don't count."""
    more = bags[left] - bags[right]
    up = np.maximum(more, 0).sum(1, dtype=np.int32)
    down = up - more.sum(1, dtype=np.int32)
    full = np.flatnonzero((over[left] > 0) | (over[right] > 0))
    if len(full):
        x, y = left[full], right[full]
        meet = ((bags[x] == 15) & (bags[y] == 15)).any(1)
        up[full] += np.maximum(0, over[x] - over[y] * meet)
        down[full] += np.maximum(0, over[y] - over[x] * meet)
    return np.maximum(up, down)


def _across(batches, least: float):
    """Of rows (key, label, id, n and, if they have it, sign) in the order of key and label: pairs (a, b, must) of a key with
    different labels that their lengths and small bags allow. A pair whose leaders meet comes under the least of these keys
    only, another under each common key. What is held at a time is a batch and the rows of its last key."""
    rest = None

    def pairs(key, label, node, n, bags=None, leaders=None):
        size = len(key)
        over = None if bags is None else n - bags.sum(1, dtype=np.int32)
        new_key = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        new_label = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (label[1:] != label[:-1])]))
        at = np.arange(size)
        begin = np.append(new_label, size)[np.searchsorted(new_label, at, "right")]  # where the row's label ends
        count = np.append(new_key, size)[np.searchsorted(new_key, at, "right")] - begin
        total, i = np.concatenate([[0], np.cumsum(count)]), 0
        while i < size:
            j = max(i + 1, int(np.searchsorted(total, total[i] + 8_000, "right")) - 1)
            left = np.repeat(at[i:j], count[i:j])
            right = np.arange(len(left)) - np.repeat(total[i:j] - total[i], count[i:j]) + np.repeat(begin[i:j], count[i:j])
            i = j
            longer = np.maximum(n[left], n[right])
            most = (longer * (1 - least) + 1e-9).astype(np.int32)
            able = np.flatnonzero(np.minimum(n[left], n[right]) >= longer - most)
            if bags is not None and len(able):
                able = able[_small_apart(bags, over, left[able], right[able]) <= most[able]]
                x, y = leaders[left[able]], leaders[right[able]]
                common = np.where((x[:, :, None] == y[:, None, :]).any(2), x, _NO_WORD).min(1)
                able = able[(common == _NO_WORD) | (common == key[left[able]])]
            if len(able):
                x, y = node[left[able]], node[right[able]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array((longer - most)[able], pa.int32())], names=["a", "b", "must"])

    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "label", "id", "n")]
        if "sign" in batch.schema.names:
            rows += _signatures(batch.column(batch.schema.names.index("sign")).to_pylist())
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
        if not len(rows[0]):
            continue
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        rest = [x[last:] for x in rows]
        if last:
            yield from pairs(*(x[:last] for x in rows))
    if rest is not None:
        yield from pairs(*rest)


def _rest(texts: DataFrame, least: float) -> DataFrame:
    """Of (id, n, label, words, sign): all pairs (a, b) with different labels that may be similar by their first words, lengths and small bags."""
    # every row is dealt out, a fifth of a text's words and one, so that their number doesn't depend on how many texts share a
    # word; to few tasks, since a text's rows of one task are written as little more than one
    rows = texts.select(F.explode("words").alias("key"), "label", "id", "n", "sign").repartition(max(12, parts(texts) // 4), "key").sortWithinPartitions("key", "label")
    return rows.mapInArrow(lambda batches: released(_across(batches, least)), "a long, b long, must int").select("a", "b").distinct()


def _near(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, both) whose lengths and bags (id, n, bag) allow that they are similar: only their texts are dealt out."""
    left, right = _sides(pairs, bags)
    left, right = left.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("bag").alias("x")), right.select(F.col("id").alias("b"), F.col("n").alias("o"), F.col("bag").alias("y"))
    whole = pairs.join(right, "b").join(left, "a").where(F.least("o", "m") >= F.greatest("o", "m") * least - 1).select("a", "b", "both", "m", "o", "x", "y")

    def run(batches):
        for batch in batches:
            kept = [apart(x, y, n, m) <= int(max(n, m) * (1 - least) + 1e-9) for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:3], names=["a", "b", "both"]).filter(pa.array(kept, pa.bool_()))

    return whole.mapInArrow(lambda batches: released(run(batches)), "a long, b long, both long")


def _weighed(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose bags (id, n, bag) allow that they are similar, where few texts make many pairs.

    A bag isn't dealt out with each of its pairs: ids fall into blocks of about BLOCK_BYTES, a pair into the cell of its two
    blocks, and a bag goes once to each cell that holds a pair of it. A task holds the bags of one cell at a time."""
    held = cut(_among(bags, cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())))
    blocks = max(LEAST_BLOCKS, -(-held.agg(F.coalesce(F.sum(F.octet_length("bag")), F.lit(0))).first()[0] // BLOCK_BYTES))
    at = pairs.select(*(F.pmod(F.xxhash64(x), F.lit(blocks)).alias(f"of_{x}") for x in "ab"), "a", "b")
    needed = at.select("of_a", "of_b", F.explode(F.array("a", "b")).alias("id")).distinct().join(held, "id")
    rows = needed.select("of_a", "of_b", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "n", "bag")
    rows = rows.unionByName(at, allowMissingColumns=True).repartition("of_a", "of_b").sortWithinPartitions("of_a", "of_b", F.col("b").asc_nulls_first())

    def run(batches):
        cell, own = None, {}
        for batch in batches:
            left, right = [], []
            for i, j, a, b, n, bag in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if cell != (i, j):
                    cell, own = (i, j), {}
                if b is None:
                    own[a] = bag, n
                else:
                    (x, n), (y, m) = own[a], own[b]
                    if apart(x, y, n, m) <= int(max(n, m) * (1 - least) + 1e-9):
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(lambda batches: released(run(batches)), "a long, b long")


def _labelled(ids: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Of (id, ...): with label, the least id of its component so far."""
    if labels is None:
        return ids.withColumn("label", F.col("id"))
    return ids.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))


def _apart_yet(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs (a, b) that no links found so far join."""
    if labels is None:
        return pairs
    left, right = (labels.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}")) for x in "ab")
    both = pairs.join(left, "a", "left").join(right, "b", "left")
    return both.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def links_and_members(docs: DataFrame, *, row: str = "doc_id", text: str = "text", levels: tuple = LEVELS, least: float = SIMILARITY, short: int = SHORT) -> tuple[DataFrame, DataFrame | None]:
    """Members (id, rep) and labels (node, label) of the representatives that have links (None if there are none)."""
    texts = docs.select(F.col(row).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id is not null")
    sketched = cut(_sketched(texts, levels))
    reps = cut(sketched.groupBy("a", "b").agg(F.min("id").alias("rep")))  # written, so that a hot text's rows can be split
    members = cut(sketched.select("id", "a", "b").join(reps, ["a", "b"]).select("id", "rep"))
    own = cut(members.where("id = rep").select("id").distinct())
    bags = sketched.select("id", "n", "bag")
    found, labels = None, None

    def linked(pairs):
        nonlocal found, labels
        new = swept(_verified(pairs, texts, least))
        if not new.isEmpty():
            found = new if found is None else found.union(new)
            labels = components(found)

    # a text's best hub, by the sketches that they share, first: in a large class nearly all links are among these
    buckets = swept(_tested(_among(sketched.select("id", "keys"), own).select("id", F.explode("keys").alias("key"))))
    pairs = swept(_near(swept(buckets.groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))), bags, least))
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("both", -F.col("a"))).alias("a")).select("a", "b")
    linked(cut(best))
    linked(cut(_apart_yet(pairs.select("a", "b"), labels).join(best, ["a", "b"], "left_anti")))
    # what hubs can't tell: members of one bucket, still in different components, of which neither is the hub
    rest = _labelled(buckets.where("size > 2").select("key", F.col("b").alias("id")), labels)
    mixed = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    rest = rest.join(mixed, "key", "left_semi").select("id").distinct()
    rest = cut(rest.union(sketched.where(F.col("n") <= short).select("id").join(own, "id", "left_semi")).distinct())
    joining = _among(texts, rest)
    labelled = cut(_labelled(_dressed(joining, rarity(joining), least), labels))
    # pairs of this join can grow with the square of a group of like texts: they meet as bags before texts are dealt out
    linked(swept(_weighed(swept(_rest(labelled, least).join(pairs.select("a", "b"), ["a", "b"], "left_anti")), bags, least)))
    return members, labels


def _found(docs: DataFrame, row: str, text: str, **how) -> DataFrame:
    """Of rows with an id: id, mark (a hash of the text where one id has several texts, else null), class_id, and whether the
    text is the one of its class that stays."""
    own = docs.select(F.col(row).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id is not null")
    several = own.groupBy("id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high")).where("low <> high")
    if several.isEmpty():
        members, labels = links_and_members(own, row="id", text="text", **how)
        found = _labelled(members.select("id", F.col("rep").alias("_r")).withColumnsRenamed({"id": "of", "_r": "id"}), labels)
        return found.select(F.col("of").alias("id"), F.lit(None).cast("long").alias("mark"), F.col("label").alias("class_id"), (F.col("of") == F.col("label")).alias("stays"))
    # ids that stand for several texts: each distinct row gets a number of its own
    keyed = cut(own.distinct().withColumn("node", F.monotonically_increasing_id()))
    members, labels = links_and_members(keyed.select("node", "text"), row="node", text="text", **how)
    found = _labelled(members.withColumnsRenamed({"id": "node", "rep": "id"}), labels).join(keyed.select("node", F.col("id").alias("of"), F.xxhash64("text").alias("mark")), "node")
    first = found.groupBy("label").agg(F.min(F.struct("of", "mark")).alias("first"))
    return found.join(first, "label").select(F.col("of").alias("id"), "mark", F.col("first.of").alias("class_id"), (F.struct("of", "mark") == F.col("first")).alias("stays"))


def classes(docs: DataFrame, *, row: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """For each row with an id: id and class_id, the least id of its class (for equal rows of one id where it has several texts, once)."""
    return _found(docs, row, text, **how).select("id", "class_id")


def dedup(docs: DataFrame, *, row: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents without those that aren't their class's first; columns as they were."""
    found = cut(_found(docs, row, text, **how))
    a, b = fresh(docs, "gone"), fresh(docs, "gone_mark")
    gone = found.where("not stays").select(F.col("id").alias(a), F.col("mark").alias(b)).distinct()
    same = (docs[row].cast("long") == gone[a]) & (gone[b].isNull() | (gone[b] == F.xxhash64(F.coalesce(docs[text], F.lit("")))))
    out = docs.join(gone, same, "left_anti")
    # rows that stand more than once: in the list of members, or as equal rows of an id with several texts
    if not found.groupBy("id").count().where("count > 1").isEmpty():
        c, d = fresh(out, "text_key"), fresh(out, "no_id")
        own = out.withColumns({c: F.coalesce(F.col(text), F.lit("")), d: F.when(F.col(row).isNull(), F.monotonically_increasing_id())})
        out = own.dropDuplicates([row, c, d]).drop(c, d)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("id").alias("doc_id"), "class_id", (F.col("id") != F.col("class_id")).alias("is_copy"))
