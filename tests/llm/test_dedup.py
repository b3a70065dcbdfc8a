"""Substring, near-duplicate and line dedup against brute force."""

import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quarry.llm import line_dedup, near_dedup, substring_dedup
from quarry.llm.common import swept

TEXT = "doc_id long, text string"


def prose(rng, n):
    return " ".join("".join(rng.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é")) for _ in range(rng.randint(1, 4))) for _ in range(n))


# --- substring


def test_gear_hash_equals_its_recurrence():
    data = np.frombuffer(random.Random(1).randbytes(500), np.uint8)
    h, want = 0, []
    for b in data:
        h = (2 * h + int(substring_dedup._GEAR[b])) % (1 << 16)
        want.append(h)
    assert (substring_dedup.gear_hashes(data) & 0xFFFF).tolist() == want


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(2)
    text = prose(rng, 400).encode()

    def cut(t):
        ends = substring_dedup.chunk_ends(np.frombuffer(t, np.uint8))
        return [t[a:b] for a, b in zip([0, *ends], ends)]

    chunks = cut(text)
    assert b"".join(chunks) == text and all(24 <= len(c) <= 256 for c in chunks[:-1])
    assert all(c.decode() for c in chunks)
    moved = cut(b"something new " + text)
    assert len(set(chunks) - set(moved)) <= 3
    assert cut(b"") == [] and b"".join(cut(b"a" * 1000)) == b"a" * 1000
    assert b"".join(cut("é".encode() * 1000)).decode() and all(c.decode() for c in cut("é".encode() * 1000))


def slow_cuts(raw):
    """The cuts from the recurrence, byte by byte: bits 6 to 11 zero, 24 to 256 bytes, never inside a character."""
    h, last, out = 0, 0, []
    begins = lambda at: at == len(raw) or raw[at] & 0xC0 != 0x80
    for at, byte in enumerate(raw[:-1], 1):
        h = (2 * h + int(substring_dedup._GEAR[byte])) % (1 << 16)
        while at - last > 256:
            cut = last + 256
            while not begins(cut):
                cut -= 1
            out.append(cut)
            last = cut
        if h & 0b111111000000 == 0 and at - last >= 24 and begins(at):
            out.append(at)
            last = at
    while len(raw) - last > 256:
        cut = last + 256
        while not begins(cut):
            cut -= 1
        out.append(cut)
        last = cut
    return out + [len(raw)] * bool(raw)


def test_cuts_equal_the_recurrence():
    rng = random.Random(12)
    for text in [prose(rng, n) for n in (0, 1, 9, 400, 3000)] + ["é" * 900, "a" * 700, "日本語" * 500 + prose(rng, 50), "\x00" * 300, "the the " * 300]:
        raw = text.encode()
        assert substring_dedup.chunk_ends(np.frombuffer(raw, np.uint8)) == slow_cuts(raw)


def brute_flags(rows):
    """has_repeats and within of each text, by comparing chunks of all texts."""
    texts = sorted({((-(1 << 63) if i is None else i), t) for i, t in rows if t is not None})
    cut = {k: [k[1].encode()[a:b] for a, b in zip([0, *slow_cuts(k[1].encode())], slow_cuts(k[1].encode()))] for k in texts}
    holders = {}
    for k, own in cut.items():
        for c in own:
            holders.setdefault(c, set()).add(k)
    out = {}
    for k, own in cut.items():
        best = run = 0
        for c in own:
            run = run + len(c) if len(holders[c]) > 1 else 0
            best = max(best, run)
        out[k] = (bool(own) and (best >= 96 or best == len(k[1].encode())), len(set(own)) < len(own))
    return out


def test_flags_equal_brute_force(spark, tmp_path):
    rng = random.Random(13)
    shared = [prose(rng, 70) for _ in range(3)]
    rows = [(i, " ".join([prose(rng, rng.randint(0, 80)), *([rng.choice(shared)] if i % 3 == 0 else []), prose(rng, rng.randint(0, 80))])) for i in range(40)]
    own = prose(rng, 60)
    rows += [(50, None), (51, ""), (52, rows[0][1]), (53, f"{own} {own}"), (54, "x" * 20000), (55, "tiny"), (56, "tiny"), (57, "lone"), (None, shared[1]), (52, rows[0][1]), (52, rows[9][1])]
    spark.createDataFrame(rows, TEXT).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_flags(rows)
    got = substring_dedup.query(spark, str(tmp_path)).select("doc_id", "has_repeats", "repeats_within").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *(want[-(1 << 63) if i is None else i, t] if t is not None else (False, False)))) for i, t in rows)
    assert sum(r[1] for r in got) > 15 and {r[0] for r in got if r[2]} == {53, 54}


def test_query_flags_equal_brute_force_on_a_table(spark):
    import duckdb

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    want = brute_flags(rows)
    got = {r[0]: (r[1], r[2]) for r in substring_dedup.query(spark, "/root/testdata/sf0.001").select("doc_id", "has_repeats", "repeats_within").collect()}
    assert got == {i: want.get((i, t), (False, False)) for i, t in rows}


def brute_substring(rows):
    first, out = {}, {}
    for key in sorted({((-(1 << 63) if i is None else i), t) for i, t in rows if t is not None}, key=lambda x: (x[0],)):
        raw, at = key[1].encode(), 0
        for e in substring_dedup.chunk_ends(np.frombuffer(raw, np.uint8)):
            first.setdefault(raw[at:e], (key, at))
            at = e
    for i, t in rows:
        if t is None:
            out[i, t] = None
            continue
        key, raw, at, runs = ((-(1 << 63) if i is None else i), t), t.encode(), 0, []
        for e in substring_dedup.chunk_ends(np.frombuffer(raw, np.uint8)):
            if first[raw[at:e]] != (key, at):
                if runs and runs[-1][1] == at:
                    runs[-1][1] = e
                else:
                    runs.append([at, e])
            at = e
        kept, last = b"", 0
        for a, b in runs:
            if b - a >= substring_dedup.MIN_RUN:
                kept += raw[last:a]
                last = b
        out[i, t] = (kept + raw[last:]).decode()
    return out


def test_substring_equals_brute_force(spark):
    rng = random.Random(3)
    shared = [prose(rng, 70) for _ in range(3)]
    rows = [(i, " ".join([prose(rng, rng.randint(0, 80)), rng.choice(shared), prose(rng, rng.randint(0, 80)), *([rng.choice(shared)] if i % 3 else [])])) for i in range(40)]
    rows += [(50, None), (51, ""), (52, rows[0][1]), (None, prose(rng, 100)), (53, rows[0][1]), (53, rows[0][1]), (54, "x" * 20000)]
    got = substring_dedup.dedup(spark.createDataFrame([(*r, "s") for r in rows], TEXT + ", SPANS string"))
    assert got.columns == ["doc_id", "text", "SPANS", "spans_"]
    want = brute_substring(rows)
    assert sorted((str(r[0]), str(r[1])) for r in got.collect()) == sorted((str(i), str(want[i, t])) for i, t in rows)
    text = {r[0]: r[1] for r in got.collect()}
    assert text[52] == text[53] == "" and text[0] == rows[0][1]


@pytest.mark.parametrize("run", [lambda d: substring_dedup.dedup(d), lambda d: line_dedup.dedup(d), lambda d: near_dedup.dedup(d), lambda d: near_dedup.classes(d)])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], TEXT)).count() == 0


def test_short_copies_go(spark):
    """Copies of whole texts under a chunk's size, and one copied chunk between texts of their own."""
    rng = random.Random(11)
    rows = [(0, "short"), (1, "short"), (2, "é" * 30), (3, "é" * 30), (4, "shorter")]
    piece = next(c for c in (prose(rng, 60).encode() for _ in iter(int, 1)) if len(substring_dedup.chunk_ends(np.frombuffer(c, np.uint8))) > 4)
    ends = substring_dedup.chunk_ends(np.frombuffer(piece, np.uint8))
    # a chunk under 96 bytes, found by what comes just before its ends, in a text with another start and another end
    k = next(k for k in range(1, len(ends) - 1) if 24 <= ends[k] - ends[k - 1] < 96)
    chunk = piece[ends[k - 1] - 16 : ends[k]]
    rows += [(5, piece.decode()), (6, "Q" * 40 + chunk.decode(errors="ignore") + "Z" * 30)]
    got = {r[0]: r for r in substring_dedup.dedup(spark.createDataFrame(rows, TEXT)).collect()}
    assert [got[i]["text"] for i in range(5)] == ["short", "", "é" * 30, "", "shorter"]
    assert got[5]["spans"] is None and piece[ends[k - 1] : ends[k]].decode(errors="ignore") not in got[6]["text"] and got[6]["text"].startswith("Q" * 40) and got[6]["text"].endswith("Z" * 30)


# --- lines


def brute_lines(rows, least):
    """Every line inside a run of at least `least` weight whose lines, in that order, begin at an earlier place too."""
    texts = sorted({((-(1 << 63) if i is None else i), t) for i, t in rows if t is not None})
    at, lines = {}, {}
    places = []
    for k, (i, t) in enumerate(texts):
        lines[k] = t.split("\n")
        places += [(k, p) for p in range(len(lines[k]))]
    gone = set()
    for n, (k, p) in enumerate(places):
        for j, q in places[:n]:
            m = 0
            while p + m < len(lines[k]) and q + m < len(lines[j]) and lines[k][p + m] == lines[j][q + m]:
                m += 1
            if sum(len(x) + 1 for x in lines[k][p : p + m]) >= least:
                gone.update((k, x) for x in range(p, p + m))
    out = {key: "\n".join(x for p, x in enumerate(lines[k]) if (k, p) not in gone) for k, key in enumerate(texts)}
    return [None if t is None else out[(-(1 << 63) if i is None else i), t] for i, t in rows]


@pytest.mark.parametrize("seed", range(3))
def test_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [prose(rng, rng.choice([0, 1, 1, 2, 3, 9])) for _ in range(14)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.85 else prose(rng, 5) for _ in range(rng.randint(0, 14)))) for i in range(25)]
    block = "\n".join(rng.choice(pool) for _ in range(9))
    rows += [(30, block), (31, "x\n" + block), (32, block + "\n" + block), (33, None), (34, ""), (35, "a\n" * 60), (None, block), (36, "solo"), (31, "x\n" + block)]
    df = spark.createDataFrame([(*r, 1) for r in rows], TEXT + ", n_deleted int")
    got = line_dedup.dedup(df)
    assert got.columns == ["doc_id", "text", "n_deleted", "n_deleted_", "whole_copy"]
    # rows of one id and another text have no order of their own in the brute force: there are none here
    assert sorted((str(r[0]), str(r[1])) for r in got.collect()) == sorted((str(i), str(t)) for (i, _), t in zip(rows, brute_lines(rows, line_dedup.LEAST)))


# --- near duplicates


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_banded_distance():
    for seed in range(3000):
        rng = random.Random(seed)
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 14))]
        b = list(a) if seed % 2 else [rng.randint(0, 4) for _ in range(rng.randint(0, 14))]
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.randint(0, 4)) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        most = rng.randint(0, 8)
        assert near_dedup.distance_within(a, b, most) == min(table_distance(a, b), most + 1)


def test_sketch_depends_on_order_and_stretches(monkeypatch):
    rng = random.Random(4)
    words = np.array([rng.getrandbits(63) for _ in range(300)], np.uint64)
    whole = near_dedup.sketch(near_dedup.kmers(words))
    moved = near_dedup.sketch(near_dedup.kmers(np.concatenate([words[150:], words[:150]])))
    assert (whole == moved).sum() < 25 and len(whole) == near_dedup.LEVELS[0][0]
    monkeypatch.setattr(near_dedup, "_STRETCH", 7)
    assert (near_dedup.sketch(near_dedup.kmers(words)) == whole).all()


def near_rows(rng):
    rows = []
    for _ in range(25):
        base = prose(rng, rng.randint(60, 200)).split()
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 50))):
                copy[rng.randrange(len(copy))] = prose(rng, 1) + "x"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_classes_equal_brute_force(spark):
    rng = random.Random(6)
    rows = near_rows(rng) + [(900, None), (901, ""), (902, "one two"), (903, "one two"), (None, "one two"), (904, " ".join(["same"] * 500)), (905, " ".join(["same"] * 505))]
    known = [r for r in rows if r[0] is not None]
    root = {i: i for i, _ in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(known):
        for j, b in known[:n]:
            x, y = near_dedup._words(a), near_dedup._words(b)
            if (a or "") == (b or "") or x and y and 1 - table_distance(x, y) / max(len(x), len(y)) >= 0.8:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    want = {i: find(i) for i, _ in known}
    df = spark.createDataFrame([(*r, 2) for r in rows], TEXT + ", gone int")
    assert {r[0]: r[1] for r in near_dedup.classes(df).collect()} == want
    kept = near_dedup.dedup(df)
    assert kept.columns == df.columns
    assert sorted(str(r[0]) for r in kept.collect()) == sorted([str(i) for i in want if want[i] == i] + ["None"])


def test_repeated_rows_and_shared_passages(spark):
    """Thousands of texts that share a passage only are no links; a row that stands twice stays once."""
    rng = random.Random(7)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 60) + " " + passage) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 300, 7)] + [(5, rows[5][1])]
    df = spark.createDataFrame(rows, TEXT)
    got = {r[0]: r[1] for r in near_dedup.classes(df).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert near_dedup.dedup(df).count() == 300


def test_one_id_with_several_texts(spark):
    """Only the text that is a copy goes, not the other one of its id; of equal rows one stays."""
    rng = random.Random(15)
    base, other, third = (prose(rng, 60) for _ in range(3))
    rows = [(1, base), (5, base + " more"), (5, other), (5, other), (7, other + " and"), (8, third), (9, None), (9, ""), (None, "a"), (None, "a")]
    df = spark.createDataFrame(rows, TEXT)
    kept = sorted((r[0] or -1, r[1] or "") for r in near_dedup.dedup(df).collect())
    assert kept == sorted([(1, base), (5, other), (8, third), (9, ""), (-1, "a"), (-1, "a")])
    assert sorted(map(tuple, near_dedup.classes(df).distinct().collect())) == [(1, 1), (5, 1), (5, 5), (7, 5), (8, 8), (9, 9)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 200), (300, 100)]
    for most in (10**6, 0):
        got = {r[0]: r[1] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long"), most).collect()}
        assert got == {**{i: 0 for i in range(41)}, **{i: 90 for i in (90, 95, 100, 300)}}


def pairs_found(spark, pairs):
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = {r[0]: r[1] for r in near_dedup.classes(spark.createDataFrame(rows, TEXT)).collect()}
    return [got[2 * i] == got[2 * i + 1] for i in range(len(pairs))]


def test_scattered_edits_down_to_the_threshold(spark):
    """Copies at edit similarity 0.80 to 0.90, each edit breaking five k-mers: all are found, and none just below 0.8."""
    rng = random.Random(8)
    pairs, wanted = [], []
    for i in range(120):
        words = prose(rng, 200).split()
        edits = rng.choice((20, 25, 30, 35, 40, 42))
        copy = list(words)
        for at in rng.sample(range(200), edits):
            copy[at] = f"new{i}x{at}"
        pairs.append((" ".join(words), " ".join(copy)))
        wanted.append(edits <= 40)
    assert pairs_found(spark, pairs) == wanted
    assert pairs_found(spark, [("a b c d e", "a b x d e"), ("a1 b1 c1 d1", "a1 b1 x1 d1"), ("p q", "p q"), ("z", "y")]) == [True, False, True, False]


def edited(rng, words, edits, mark):
    """A copy at exactly this edit distance: substitutions, deletions and insertions in equal measure, by words of its own."""
    copy = list(words)
    for k, at in enumerate(sorted(rng.sample(range(len(words)), edits), reverse=True)):
        if k % 3 == 0:
            copy[at] = f"{mark}x{at}"
        elif k % 3 == 1:
            del copy[at]
        else:
            copy.insert(at, f"{mark}y{at}")
    return copy


def test_recall_from_the_threshold_on(spark):
    """Edit similarity 0.80 to 0.95 and texts from 3 to 400 words, the exact join for short texts included."""
    rng = random.Random(14)
    for percent, least in ((20, 0.95), (15, 0.98), (10, 1.0), (5, 1.0)):
        pairs = []
        for i in range(200):
            words = [f"w{i}_{k}_{rng.randint(0, 10**6)}" for k in range(rng.choice((5, 12, 30, 60, 100, 200, 400)))]
            copy = edited(rng, words, int(len(words) * percent / 100 * 0.98), f"new{i}")
            assert near_dedup.similar(" ".join(words), " ".join(copy))
            pairs.append((" ".join(words), " ".join(copy)))
        assert np.mean(pairs_found(spark, pairs)) >= least, percent


def test_classes_equal_all_pairs_of_a_table(spark):
    """All pairs of the smallest table, by the plain alignment where lengths and words allow one."""
    import duckdb
    from collections import Counter

    rows = duckdb.sql("select doc_id, coalesce(text, '') from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    words = {i: near_dedup._words(t) for i, t in rows}
    held = {i: Counter(w) for i, w in words.items()}
    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            x, y = words[i], words[j]
            long = max(len(x), len(y))
            if a == b or long and (held[i] & held[j]).total() >= long * 0.8 - 1e-9 and 1 - near_dedup.distance_within(x, y, long) / long >= 0.8:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: find(i) for i, _ in rows} and len(set(got.values())) < len(got)


def test_small_bags_never_exceed_the_distance():
    for seed in range(300):
        rng = random.Random(seed)
        a = [rng.getrandbits(60) for _ in range(rng.randint(1, 90))]
        b = [rng.getrandbits(60) if rng.random() < 0.3 else x for x in a][: rng.randint(1, 90)]
        (x, y), least = near_dedup._signatures([near_dedup.signature(np.array(v, np.uint64), np.array(v[:20], np.uint64).astype(np.int32)) for v in (a, b)])
        x, y = x.astype(int), y.astype(int)
        assert max(np.maximum(x - y, 0).sum(), np.maximum(y - x, 0).sum()) <= table_distance(a, b)
        assert sorted(np.array(a[:20], np.uint64).astype(np.int32))[: near_dedup.LEADERS] == [v for v in least[0] if v != 2**31 - 1]


def test_words_beyond_full_places_count():
    """Texts of one word over and over fill a place of their bags: what is beyond counts as long as no place is full in both."""
    rng = np.random.RandomState(3)
    for n, m in ((600, 610), (1752, 1760), (9000, 8000)):
        a, b = np.full(n, 7, np.uint64), np.full(m, 8, np.uint64)
        assert near_dedup.apart(near_dedup.bag(a), near_dedup.bag(b), n, m) == max(n, m)
        rows = [(5, t, t, len(x), near_dedup.signature(x, np.array([5], np.int32))) for t, x in enumerate((a, b))]
        batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["key", "label", "id", "n", "sign"])
        assert not sum(out.num_rows for out in near_dedup._across([batch], 0.8))
    for _ in range(300):  # never more than what one text has and the other lacks
        a, b = (np.concatenate([np.repeat(rng.randint(0, 1 << 40, 3), rng.randint(1, 900, 3)), rng.randint(0, 40, rng.randint(1, 60))]).astype(np.uint64) for _ in "ab")
        if rng.rand() < 0.5:
            b = np.concatenate([a[: rng.randint(1, len(a) + 1)], b[: rng.randint(0, 99)]])
        most = max((Counter(a.tolist()) - Counter(b.tolist())).total(), (Counter(b.tolist()) - Counter(a.tolist())).total())
        assert near_dedup.apart(near_dedup.bag(a), near_dedup.bag(b), len(a), len(b)) <= most
        signs = near_dedup._signatures([near_dedup.signature(x, np.array([5], np.int32)) for x in (a, b)])[0]
        over = np.array([len(a), len(b)], np.int32) - signs.sum(1, dtype=np.int32)
        assert near_dedup._small_apart(signs, over, np.array([0]), np.array([1]))[0] <= most


def test_rarity_counts_every_text(spark):
    """A word of n texts has the count n, wherever these stand: nothing is sampled."""
    rows = [(i, "everywhere" + " once%d" % i + " rare" * (i == 77)) for i in range(200)]
    order = near_dedup.rarity(spark.createDataFrame(rows, "id long, text string"))
    for word, n in (("everywhere", 200), ("rare", 1), *((f"once{i}", 1) for i in range(0, 200, 20))):
        (_, _, _, (words,)), = near_dedup._words_of([pa.RecordBatch.from_arrays([pa.array([0]), pa.array([word])], names=["id", "text"])])
        assert order[near_dedup._counter(near_dedup.kmers(words, 1))[0]] == round(np.log2(n + 1) * 4)


def test_shuffle_files_go_as_soon_as_a_step_is_written(spark):
    """Of steps that are written one after the other, only the last one's shuffle files are still held."""
    jsc = spark.sparkContext._jsc.sc()
    held = lambda: sum(f.stat().st_size for d in jsc.env().blockManager().diskBlockManager().localDirsString() for f in Path(d).rglob("shuffle_*.data"))
    swept(spark.range(1))
    time.sleep(1)
    before, now = held(), spark.range(200_000)
    for step in range(4):
        now = swept(now.repartition(4, F.col("id") + step))
    time.sleep(2)  # Spark's cleaner has a thread of its own
    assert held() - before < 2 * 200_000 * 8


def test_pairs_of_a_group_meet_as_bags(spark, monkeypatch):
    """Many pairs of few long texts are weighed by their bags, block by block: the pairs of each size that bags allow, no others."""
    rng = np.random.RandomState(4)
    base = rng.randint(0, 1 << 40, 900)
    own = {i: np.concatenate([base[: 900 - 12 * i], rng.randint(0, 1 << 40, 12 * i)]).astype(np.uint64) for i in range(40)}
    bags = spark.createDataFrame([(i, len(x), bytearray(near_dedup.bag(x))) for i, x in own.items()], "id long, n int, bag binary")
    pairs = [(i, j) for i in own for j in own if i < j]
    want = {(i, j) for i, j in pairs if near_dedup.apart(*(near_dedup.bag(own[x]) for x in (i, j)), 900, 900) <= 180}
    assert 0 < len(want) < len(pairs)
    for block in (near_dedup.BLOCK_BYTES, 700):  # 8 blocks, and about one a bag
        monkeypatch.setattr(near_dedup, "BLOCK_BYTES", block)
        got = sorted(map(tuple, near_dedup._weighed(spark.createDataFrame(pairs, "a long, b long"), bags, 0.8).collect()))
        assert got == sorted(want)


def test_pairs_with_leaders_come_once():
    """With signatures every pair still comes, and one whose leaders meet comes once."""
    rng = np.random.RandomState(5)
    words = [rng.randint(0, 60, 20).astype(np.int32) for _ in range(40)]
    rows = sorted((int(k), i % 7, i, 10, near_dedup.signature(np.arange(10, dtype=np.uint64), np.unique(w))) for i, w in enumerate(words) for k in np.unique(w))
    batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["key", "label", "id", "n", "sign"])
    got = [(a, b) for out in near_dedup._across([batch], 0.8) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if i % 7 != j % 7 and set(words[i]) & set(words[j])}
    assert set(got) == want
    least = [set(np.unique(w)[: near_dedup.LEADERS]) for w in words]
    once = [p for p in want if least[p[0]] & least[p[1]]]
    assert once and all(got.count(p) == 1 for p in once)


def test_pairs_of_a_like_group_seldom_come_twice(spark):
    """Texts that share frequent words next to rarer ones of chance meet under one key, and every pair that meets is kept."""
    rng = random.Random(11)
    texts = [(i, " ".join([f"c{j}" for j in range(170)] + [f"g{j}" for j in rng.sample(range(40), 15)] + [f"r{j}" for j in rng.sample(range(300), 30)])) for i in range(40)]
    df = spark.createDataFrame(texts, "id long, text string")
    dressed = near_dedup._dressed(df, near_dedup.rarity(df), 0.8).collect()
    rows = sorted((k, r["id"], r["id"], r["n"], bytes(r["sign"])) for r in dressed for k in r["words"])
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=["key", "label", "id", "n", "sign"])
    got = [(a, b) for out in near_dedup._across([batch], 0.8) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    words = {r["id"]: set(r["words"]) for r in dressed}
    near = {(a, b) for a in words for b in words if a < b and words[a] & words[b] and near_dedup.similar(texts[a][1], texts[b][1])}
    assert near and near <= set(got) and len(got) < 1.3 * len(set(got))


def test_similar_texts_whose_buckets_have_other_hubs(spark):
    """All texts quote one passage of 120 words, so hubs are dissimilar to most members; every copy is found even so."""
    rng = random.Random(9)
    passage = prose(rng, 120)
    pairs = []
    for i in range(150):
        own = prose(rng, 80).split()
        copy = list(own)
        for at in rng.sample(range(80), rng.choice((10, 20, 24, 38))):
            copy[at] = f"new{i}x{at}"
        pairs.append((f"{' '.join(own)} {passage}", f"{' '.join(copy)} {passage}"))
    assert all(pairs_found(spark, pairs))


def test_rows_of_the_exact_join_grow_with_its_texts(spark, monkeypatch):
    """A text deals out its first words, no matter how many of them other texts hold too."""

    def dealt(batches, least):
        for batch in batches:
            key, node = (batch.column(c).cast("int64") for c in ("key", "id"))
            yield pa.RecordBatch.from_arrays([key, node, pa.nulls(len(key), pa.int32())], names=["a", "b", "must"])

    monkeypatch.setattr(near_dedup, "_across", dealt)
    rng = np.random.RandomState(5)
    rows = [(i, 100, i, rng.choice(4_000, 21, replace=False).tolist(), bytearray(8)) for i in range(200)]
    few, many = (near_dedup._rest(spark.createDataFrame(rows[:n], "id long, n int, label long, words array<int>, sign binary"), 0.8).count() for n in (40, 200))
    assert (few, many) == (40 * 21, 200 * 21)


def test_pairs_of_a_key_across_batches():
    rng = np.random.RandomState(3)
    rows = sorted((int(k), int(v), i, 10) for i, (k, v) in enumerate(zip(rng.randint(0, 9, 200), rng.randint(0, 4, 200))))
    cols = [np.array(x) for x in zip(*rows)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 7]) for c in cols], names=["key", "label", "id", "n"]) for i in range(0, 200, 7)]
    got = sorted((a, b) for out in near_dedup._across(batches, 0.8) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    assert got == sorted((min(x[2], y[2]), max(x[2], y[2])) for i, x in enumerate(rows) for y in rows[:i] if x[0] == y[0] and x[1] != y[1])


def test_bags_never_exceed_the_distance():
    for seed in range(500):
        rng = random.Random(seed)
        a = [rng.randint(0, 9) for _ in range(rng.randint(1, 40))]
        b = [rng.randint(0, 9) if rng.random() < 0.3 else x for x in a][: rng.randint(1, 40)] or [1]
        assert near_dedup.apart(*(near_dedup.bag(np.array(x, np.uint64)) for x in (a, b))) <= table_distance(a, b)
    assert near_dedup.apart(near_dedup.bag(np.zeros(900, np.uint64)), near_dedup.bag(np.ones(900, np.uint64))) == 255
