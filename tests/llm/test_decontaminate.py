import hashlib
import random
import re

import duckdb
from quarry.llm import decontaminate as d

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


def as_query(found):
    from pyspark.sql import functions as F

    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"].cast("long"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return [tuple(r) for r in found.select("doc_id", "n_words", n_hit, F.size("items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256), n_hit > 0).collect()]


def test_query_equals_brute_force(spark):
    got = sorted(tuple(r)[:6] for r in d.query(spark, SF).collect())
    read = lambda t, k: duckdb.sql(f"select {k}, text from '{SF}/{t}.parquet'").fetchall()
    want = sorted(brute(read("documents", "doc_id"), read("benchmark", "item_id")))
    assert got == want and any(r[5] for r in want)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert sorted(con.sql(d.SQL).fetchall()) == want


def test_random_texts_in_blocks(spark):
    rng = random.Random(5)
    text = lambda n, k=3: " ".join(rng.choice("ab Ä9"[:k] or "a") or "x" for _ in range(n))
    docs = [(i, text(rng.randint(0, 60), rng.choice([1, 2, 5]))) for i in range(60)] + [(60, None), (61, ""), (61, "a b a b a b a b a b a b"), (62, "Ünder x" * 3)]
    items = [(i, text(rng.randint(0, 14), rng.choice([1, 2, 5]))) for i in range(20)] + [(20, None), (21, "a"), (None, "b"), (22, "a")]
    docs_df, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, [x for x in items if x[0] is not None]))
    for most in (2_000_000, 30):
        assert sorted(as_query(d.find_matches(docs_df, items_df, block_words=most))) == want
    clean = {r[0:2] for r in docs if not brute([r], [x for x in items if x[0] is not None])[0][5]}
    assert {tuple(r) for r in d.remove_contaminated(docs_df, items_df, block_words=30).collect()} == clean


def test_edges(spark):
    docs = spark.createDataFrame([(1, "one two three", "kept")], "doc_id long, text string, N_WORDS string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = d.find_matches(docs, none).first()
    assert row["N_WORDS"] == "kept" and row["n_words_"] == 3 and row["items"] == []
    item = spark.createDataFrame([(7, "TWO three")], "item_id long, text string")
    row = d.find_matches(docs, item).first()
    assert [m.asDict() for m in row["matches"]] == [{"item_id": 7, "item_start": 0, "start": 1, "length": 2}]
    empty = docs.limit(0)
    assert d.find_matches(empty, item).count() == 0 and d.remove_contaminated(empty, item).columns == docs.columns


def test_longest_match_and_place(spark):
    rng = random.Random(1)
    w = [f"w{rng.randint(0, 10**9)}" for _ in range(50)]
    docs = spark.createDataFrame([(1, "x y " + " ".join(w[5:40]) + " z")], "doc_id long, text string")
    found = d.find_matches(docs, spark.createDataFrame([(3, " ".join(w))], "item_id long, text string")).first()["matches"]
    assert [m.asDict() for m in found] == [{"item_id": 3, "item_start": 5, "start": 2, "length": 35}]
