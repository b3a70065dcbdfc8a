"""The pipeline's stages against brute force on planted documents, each on its own input."""

import random

import corpus_pipeline
from quarry.llm import line_dedup

from .test_dedup import brute_lines, prose


def corpus(rng):
    rows = [prose(rng, rng.randint(60, 120)) + "\n" + prose(rng, 30) for _ in range(40)]
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(rows)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_order_and_names():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]


def test_line_stage(spark):
    rng = random.Random(1)
    rows = corpus(rng)
    passage = prose(rng, 60)
    rows += [(100, rows[0][1], "en", "s", 1), (101, passage + "\nown " + prose(rng, 9), "en", "s", 1), (102, prose(rng, 9) + "\n" + passage, "en", "s", 1), (103, None, "en", "s", None), (104, "", "en", "s", 0)]
    out = {r["doc_id"]: r for r in stage("line_dedup")(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    want = brute_lines([r[:2] for r in rows], line_dedup.LEAST)
    assert set(out) == {r[0] for r in rows} - {100}
    for r, text in zip(rows, want):
        if r[0] != 100:
            assert out[r[0]]["text"] == text and (text == r[1] or out[r[0]]["n_chars"] == len(text))


def test_near_stage(spark):
    rng = random.Random(2)
    rows = corpus(rng)
    for k in range(6):
        words = rows[3][1].split(" ")
        words[k * 7] = "changed"
        rows.append((200 + k, " ".join(words), "en", "s", 1))
    kept = {r["doc_id"] for r in stage("near_dedup")(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert kept == set(range(40))


def test_filters_and_tokens(spark, tmp_path):
    rng = random.Random(3)
    rows = corpus(rng)
    item = prose(rng, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows.append((300, prose(rng, 20) + " " + item + " " + prose(rng, 20), "en", "s", 1))
    docs = spark.createDataFrame(rows, DOCS)
    kept = stage("decontamination")(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(40))
    tokens = stage("byte_bpe")(spark, docs, str(tmp_path)).collect()
    assert len(tokens) == len(rows) and all(r["n_tokens"] == len(r["ids"]) for r in tokens)


def test_toxicity_stage(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, prose(rng, 50) + (" grumbo" if i % 4 == 0 else "") + " " + prose(rng, 9), "en", "s", 1) for i in range(400)]
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, DOCS)
    out = stage("toxicity")(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {i for i in range(400) if i % 4}


def plant(spark, tmp_path, rows, schema=DOCS):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")


ITEM = prose(random.Random(9), 30)


def test_run_on_planted_documents(spark, tmp_path):
    """Nulls, empty texts, rows that stand twice, copies, a benchmark passage and a column of a name that operators use."""
    rng = random.Random(6)
    rows = [(*r, "x") for r in corpus(rng)]
    rows += [(100, rows[0][1].replace(" ", "  ", 1) + " more", "en", "s", 1, "x"), (101, "before " + ITEM + " after", "en", "s", 1, "x"), (102, None, None, None, None, None), (103, "", "", "", 0, ""), (None, prose(rng, 70), "en", "s", 1, "x"), rows[5], rows[5]]
    plant(spark, tmp_path, rows, DOCS + ", gone string")
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = [r["doc_id"] for r in out.collect()]
    assert {100, 101} & set(ids) == set() and set(range(40)) <= set(ids) and None in ids and ids.count(5) == 1
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "gone"]


def test_run_on_an_empty_table(spark, tmp_path):
    plant(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
