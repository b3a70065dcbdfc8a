"""Very long texts, rows of one id with several texts, and clashing columns, for operators whose other tests hold short ones."""

import random

from quarry.llm import common, decontaminate, line_dedup, near_dedup, substring_dedup, toxicity, url_filter

TEXT = "doc_id long, text string"


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_near_duplicates_of_a_very_long_text(spark):
    rng = random.Random(1)
    long = words(rng, 60_000)
    copy = list(long)
    for at in rng.sample(range(len(copy)), 3000):
        copy[at] = f"x{at}"
    other = words(rng, 60_000)
    df = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(copy)), (3, " ".join(other))], TEXT)
    assert dict(map(tuple, near_dedup.classes(df).collect())) == {1: 1, 2: 1, 3: 3}


def test_lines_of_a_long_text_and_of_one_id(spark):
    rng = random.Random(2)
    block = [" ".join(words(rng, 6)) for _ in range(5000)]
    first, second = "\n".join(block), "\n".join(["head of its own, long enough", *block[1000:4000], "tail of its own, long enough"])
    df = spark.createDataFrame([(1, first), (1, second), (2, "only " + block[7])], TEXT)
    got = sorted((r[0], r[1]) for r in line_dedup.dedup(df).collect())
    kept = sorted([first, second], key=len)
    # one of the two texts of id 1 is the first; the other loses the lines that both hold
    assert [r[0] for r in got] == [1, 1, 2] and got[2][1] == "only " + block[7]
    texts = sorted((t for i, t in got if i == 1), key=len)
    either = (["head of its own, long enough\ntail of its own, long enough", first], ["\n".join(block[:1000] + block[4000:]), second])
    assert texts in [sorted(x, key=len) for x in either] and len(kept) == 2


def test_substrings_of_a_long_text(spark):
    rng = random.Random(3)
    shared = " ".join(words(rng, 40_000))
    df = spark.createDataFrame([(1, shared), (2, "mine " + shared + " too"), (3, " ".join(words(rng, 50)))], TEXT)
    got = {r["doc_id"]: r for r in substring_dedup.dedup(df, flags=True).collect()}
    assert got[1]["text"] == shared and len(got[2]["text"]) < 600 and [got[i]["has_repeats"] for i in (1, 2, 3)] == [True, True, False]


def test_matches_beyond_a_shard(spark):
    rng = random.Random(4)
    item = words(rng, 12)
    long = words(rng, common.SLICE_BYTES // 4) + item + ["end"]
    assert len(" ".join(long)) > 2 * common.SLICE_BYTES
    df = spark.createDataFrame([(1, " ".join(long)), (2, "q" * (3 * common.SLICE_BYTES)), (3, "short " + " ".join(item))], TEXT)
    got = {r["doc_id"]: r for r in decontaminate.find_matches(df, spark.createDataFrame([(7, " ".join(item)), (8, "é " * 9)], "item_id long, text string")).collect()}
    assert got[1]["n_words"] == len(long) and [tuple(m) for m in got[1]["matches"]] == [(7, 0, len(long) - 13, 12)]
    assert got[2]["n_words"] == 1 and not got[2]["items"] and got[3]["items"] == [7]


def test_windows_shared_by_items_are_all_told(spark):
    """Two items that share a passage, and one that repeats it: each has its own longest match."""
    rng = random.Random(5)
    p, a, b = words(rng, 15), words(rng, 6), words(rng, 6)
    items = spark.createDataFrame([(1, " ".join(a + p)), (2, " ".join(p + b)), (3, " ".join(p + ["between"] + p))], "item_id long, text string")
    row = decontaminate.find_matches(spark.createDataFrame([(1, "x " + " ".join(p + b))], TEXT), items).first()
    assert row["items"] == [1, 2, 3] and sorted(map(tuple, row["matches"])) == [(1, 6, 1, 15), (2, 0, 1, 21), (3, 0, 1, 15), (3, 16, 1, 15)]


def test_word_hashes_in_blocks_equal_those_of_one():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    texts = ["".join(rng.choice("abc ,é") for _ in range(rng.randrange(400))) for _ in range(50)] + ["z" * 3000, "", "one two"]
    values = common.byte_values(b" ,", lower=True)
    data, offsets = common.utf8(pa.array(texts, pa.large_string()))
    whole = common.word_hashes(data, offsets, values)
    held, common.SLICE_BYTES = common.SLICE_BYTES, 257
    try:
        parts = common.word_hashes(data, offsets, values)
    finally:
        common.SLICE_BYTES = held
    assert all(np.array_equal(x, y) for x, y in zip(whole, parts, strict=True))
    split = [w for t in texts for w in t.replace(",", " ").split(" ") if w]
    assert len(whole[0]) == len(split) and len(set(whole[0].tolist())) == len(set(split))


def test_a_very_long_url(spark):
    long = "http://www.Example.com/en/" + "a/" * 200_000 + "x?q"
    df = spark.createDataFrame([(1, long, "own"), (2, None, "own"), (3, "http://" + "a." * 2000 + "net/es/", "own")], "page_id long, url string, HOST string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    want = {1: ("www.example.com/en/", "allow"), 2: (None, "allow"), 3: ("net/es/", "block")}
    rows = {r["page_id"]: r for r in url_filter.judge(df, rules).collect()}
    assert {i: (r["rule"], r["verdict"]) for i, r in rows.items()} == want and rows[1]["HOST"] == "own" and len(rows[1]["path"]) == 400_005


def test_labels_with_columns_of_the_documents(spark):
    docs = spark.createDataFrame([(i, "grumbo a" if i % 2 else "b c", 0.5) for i in range(200)], "doc_id long, text string, SCORE double")
    labels = spark.createDataFrame([(i, "other", 1 - i % 2, i % 2, 9.0) for i in range(200)], "doc_id long, text string, quality int, toxic int, score double")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert all((r["score_"] >= 0.5) == bool(r["doc_id"] % 2) and r["SCORE"] == 0.5 for r in out)
