"""Operators on small frames: chunking, sources, ledger, graph, tables, service and streams."""

import random
import time

from pyspark.sql import functions as F
from quarry.functions.text import ancestors_of
from quarry.operators import budget, chunking, evaluation, graph, ledger, retrieval
from quarry.plans import service
from quarry.sources import tables, workspace
from quarry.streaming import changes

MARKDOWN = "intro\n\n# One\ntext\n```sh\n# no heading\n```\n## Two\nmore\n#### Deep\nstays\n# Three\n"


def test_markdown_sections():
    got = [(c["symbol_path"], c["start_line"], c["end_line"], c["source_text"]) for c in chunking.markdown_chunks(MARKDOWN)]
    assert got == [(None, 1, 1, "intro"), ("One", 3, 7, "# One\ntext\n```sh\n# no heading\n```"), ("One > Two", 8, 11, "## Two\nmore\n#### Deep\nstays"), ("Three", 12, 12, "# Three")]
    assert chunking.markdown_chunks("\n\n") == [] and chunking.markdown_chunks("") == []


def test_packing_keeps_every_line_and_the_budget():
    rng = random.Random(1)
    text = "\n".join(rng.choice(["", "", "word " * rng.randint(1, 30), "```", "  indented", "key: value"]) for _ in range(400))
    lines = chunking.lines_of(text)
    for fences in (False, True):
        f = chunking._File(text, "text")
        blocks = f.blocks(1, len(lines), fences=fences)
        covered = {n for b in blocks for n in range(b.first, b.last + 1)}
        assert covered >= {n for n, x in enumerate(lines, 1) if x.strip()}
        groups = f.pack(blocks, 60)
        assert {n for b in groups for n in range(b.first, b.last + 1)} >= covered
        assert all(f.tokens(g) <= 75 or g.first == g.last or any(b.atomic and g.first <= b.first and b.last <= g.last for b in blocks) for g in groups)
        assert all(a.first < b.first for a, b in zip(groups, groups[1:]))
    over = f.pack(f.blocks(1, len(lines)), 60, overlap=1)
    assert any(b.first <= a.last for a, b in zip(over, over[1:]))


def test_code_and_pages():
    code = "import a\n" + "\n".join(f"def f{i}(x):\n    return " + "x + " * 40 + "1\n" for i in range(3))
    assert [c["symbol_name"] for c in chunking.code_chunks(code, "python")] == ["f0", "f1", "f2"]
    assert all(c["parse_degraded"] for c in chunking.code_chunks("x = 1\n" * 50, "python"))
    pages = chunking.page_chunks(["a short page that is long enough", "x", "line of text here\n\n" * 400])
    assert pages[0]["symbol_path"] == "page 1" and pages[1]["symbol_path"].startswith("page 3 (1/") and pages[1]["start_line"] == 3


def test_chunk_table(spark):
    df = spark.createDataFrame([("a", "x.md", "markdown", None, MARKDOWN), ("a", "n", "text", None, None), ("a", "b", "opaque", None, "x"), ("a", "t", "text", "yaml", "a: 1\nb: 2")], "root_label string, rel_path string, kind string, language string, text string")
    got = chunking.chunk(df, keys=["root_label", "rel_path"])
    assert got.groupBy("rel_path").count().orderBy("rel_path").collect() == [("t", 1), ("x.md", 4)] and chunking.chunk(df.limit(0), keys=["rel_path"]).count() == 0


def test_workspace(spark, tmp_path):
    for name, body in {"src/a.py": b"import os\nfrom . import b\n", "src/b.py": b"\xef\xbb\xbfx = 1\n", "bin.txt": b"a\0b", "build/out.py": b"x", ".git/config": b"x", ".gitignore": b"build/\n*.tmp\n!keep.tmp\n", "x.tmp": b"x", "keep.tmp": b"x", "src/.gitignore": b"/gen.py\n", "src/gen.py": b"x", "gen.py": b"y", "empty.txt": b""}.items():
        p = tmp_path / "ws" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    files = workspace.walk(spark, str(tmp_path / "ws"), "ws", content=True).cache()
    assert files.count() == 11
    gone = {r[0] for r in workspace.ignored(files, workspace.ignore_rules(files)).collect()}
    assert gone == {"build/out.py", "x.tmp", "src/gen.py"}
    kept = workspace.ignored(files, workspace.ignore_rules(files), spark.createDataFrame([("x.tmp",)], "rel_path string"))
    assert "x.tmp" not in {r[0] for r in kept.collect()}
    judged = workspace.candidates(files)
    assert {r["rel_path"]: r["skip_reason"] for r in judged.collect()}["empty.txt"] == "empty" and workspace.tallies(judged).collect() == [("empty", 1)]
    read = {r["rel_path"]: r for r in workspace.read_text(judged).collect()}
    assert read["src/b.py"]["text"] == "x = 1\n" and read["bin.txt"]["kind"] == "opaque" and read["bin.txt"]["text"] is None
    found = {tuple(r) for r in workspace.imports(workspace.read_text(judged)).select("rel_path", "module", "line", "is_relative").collect()}
    assert found == {("src/a.py", "os", 1, False), ("src/a.py", ".", 2, True)}


def test_scanners(spark):
    cs = 'global using static A.B;\nusing X = C.D;\nnamespace Outer\n{\n namespace Inner { }\n}\n[Route("api/[controller]")]\nclass ShopController {\n[HttpGet("{id}")]\n}\nvar g = app.MapGroup("/v1");\ng.MapGet("/items/{id}", f);\n'
    js = "import x from './a.js'\nexport { y } from 'pkg/z'\nconst q = require(\"fs\")\nfetch(`/api/items/${id}`)\naxios.get('/v1/items/3')\n"
    df = spark.createDataFrame([("r", "u/a.cs", "csharp", cs), ("r", "u/b.ts", "typescript", js), ("r", "u/Pages/Shop/Index.cshtml", "razor", "@page\n<p>")], "root_label string, rel_path string, language string, text string")
    assert {(r["module"], r["kind"]) for r in workspace.imports(df).collect()} == {("A.B", "global_using_static"), ("C.D", "using"), ("./a.js", "import"), ("pkg/z", "re_export"), ("fs", "require")}
    assert {(r["symbol"], r["kind"]) for r in workspace.namespaces(df).collect()} == {("Outer", "block"), ("Outer.Inner", "block")}
    assert {(r["template"], r["exact"]) for r in workspace.route_calls(df).collect()} == {("/api/items/", False), ("/v1/items/3", True)}
    routes = workspace.route_declarations(df)
    assert {r["template"] for r in routes.collect()} == {"api/Shop/{id}", "v1/items/{id}", "Shop"}
    calls = workspace.route_calls(df).withColumn("call_id", F.col("line"))
    assert {r["call_id"]: r["resolved_path"] for r in graph.match_routes(calls, routes).collect()} == {4: None, 5: "u/a.cs"}


def test_relative_imports(spark):
    files = spark.createDataFrame([("r", p) for p in ("p/a.py", "p/q/__init__.py", "p/q/c.py", "w/x.ts", "w/lib/index.ts", "w/y.tsx")], "root_label string, rel_path string")
    edges = spark.createDataFrame([(1, "r", "p/q/c.py", "..a", "python"), (2, "r", "p/a.py", ".q", "python"), (3, "r", "w/x.ts", "./lib", "typescript"), (4, "r", "w/x.ts", "./y.js", "typescript"), (5, "r", "w/x.ts", "../../no", "typescript"), (6, "r", "w/x.ts", "./gone", "typescript")], "edge_id int, root_label string, rel_path string, module string, language string")
    assert dict(map(tuple, graph.by_relative(edges, files).collect())) == {1: "p/a.py", 2: "p/q/__init__.py", 3: "w/lib/index.ts", 4: "w/y.tsx"}


def test_origins(spark):
    df = spark.createDataFrame([("os.path", "python", None, False), ("fs/promises", "typescript", None, False), ("node:test", "typescript", None, False), ("test", "typescript", None, False), ("System.IO", "csharp", None, False), ("pkg/x", "typescript", None, False), (".a", "python", None, True)], "module string, language string, resolved string, rel boolean")
    m, lang = F.col("module"), F.col("language")
    got = df.select(graph.origin(F.col("resolved"), F.col("rel"), graph.is_declared(m, F.array(F.lit("pkg")), lang), graph.is_framework(m, lang))).collect()
    assert [r[0] for r in got] == ["framework", "framework", "framework", "unclassified", "framework", "declared_dependency", "first_party"]


def test_ledger_edges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, n int")
    assert sorted(map(tuple, ledger.upsert(old, new, ["id"], "n").select("id", "v").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, ledger.replace_owned(old, old.limit(0), spark.createDataFrame([(1,)], "id int"), ["id"]).collect())) == [(2, "b")]
    paths = spark.createDataFrame([("a/x.py",), ("x.py",), ("b/X.py",)], "rel_path string")
    assert [r[0] for r in ledger.exact_else_suffix(paths, "x.py").collect()] == ["x.py"] and [r[0] for r in ledger.exact_else_suffix(paths.where("rel_path <> 'x.py'"), "x.py").collect()] == ["a/x.py"]
    hits = spark.createDataFrame([("q", 1, 500), ("q", 2, 10)], "g string, rank int, cost int")
    assert [(r["rank"], r["granted"], r["truncated"]) for r in budget.pack(hits, group="g", rank="rank", cost="cost", budget=100).collect()] == [(1, 100, True)]
    assert evaluation.report(evaluation.judge(spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "c int, e int"), spark.createDataFrame([(1, 6, 2)], "c int, row int, rank int"), case="c", expected="e")).first().asDict() == {"cases": 2, "recall_at_k": 0.25, "mrr_at_k": 0.25, "misses": 2}


def test_table(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t"))
    assert not t.exists()
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), ["id"])
    t.upsert(spark.createDataFrame([(2, "c")], "id int, v string"), ["id"])
    t.delete(spark.createDataFrame([(1,)], "id int"), ["id"])
    t.replace(spark.createDataFrame([(9, "z")], "id int, v string"), token="b1")
    t.replace(spark.createDataFrame([(8, "y")], "id int, v string"), token="b1")
    t.vacuum()
    assert [tuple(r) for r in t.read().collect()] == [(9, "z")]
    t.drop()
    assert not t.exists()


def test_service(spark):
    rows = [(f"c{i}", "r", f"src/a{i}.py", "test" if i == 2 else None if i == 3 else "implementation", f"alpha {chr(97 + i) * 4} " + "beta " * i, 10, [1.0, float(i)]) for i in range(6)]
    chunks = spark.createDataFrame(rows, "chunk_id string, root_label string, rel_path string, doc_type string, source_text string, token_count int, dense array<double>").withColumn("ancestors", ancestors_of("rel_path")).withColumn("start_line", F.lit(1))
    index = service.Index(chunks, chunks.select("chunk_id", "dense"))
    q = spark.createDataFrame([(1, "beta cccc dddd", [1.0, 5.0])], "query_id int, text string, vector array<double>")
    ids = lambda df: {r["chunk_id"] for r in df.collect()}
    assert {"c2", "c3"} <= ids(index.search(q, mode="sparse")) and "c0" not in ids(index.search(q, mode="sparse"))
    code = ids(index.search_code(q, mode="hybrid"))
    assert "c2" not in code and "c3" in code
    top = [r["chunk_id"] for r in index.search(q, mode="hybrid", rerank=True, k=2).orderBy("rank").collect()]
    assert set(top) == {"c2", "c3"}
    kept, envelope = index.pack(index.search(q, mode="dense"), 25)
    assert kept.count() == 1 and envelope.first()["dropped_for_budget"] == 5
    stale = retrieval.flag_stale(chunks.select("rel_path", "source_text"), spark.createDataFrame([("src/a1.py", "alpha bbbb beta ")], "rel_path string, text string"), on=["rel_path"])
    assert {r["rel_path"] for r in stale.where("not stale").collect()} == {"src/a1.py"}


def test_streams_equal_batches(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("returned", F.floor("value") % 10)
    src.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = changes.tool_windows(stream, at="ts", tool="event_type", returned="returned").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.table("windows")) == key(changes.tool_windows(src, at="ts", tool="event_type", returned="returned"))
    path = str(tmp_path / "latest")
    changes.upsert_stream(stream.select("user_id", "event_id"), path, ["user_id"], str(tmp_path / "c2"), order="event_id").awaitTermination(60)
    assert key(tables.Table(spark, path).read()) == key(src.groupBy("user_id").agg(F.max("event_id").alias("event_id")).select("user_id", "event_id"))
    calls = []
    bursts = stream.select(F.col("event_type").alias("root"))
    changes.run_on_changes(bursts, lambda roots, n: calls.append(roots), str(tmp_path / "c3"), once=True).awaitTermination(60)
    assert calls and calls[0] == sorted({r[0] for r in src.select("event_type").distinct().collect()})
    assert time.time() > 0


def test_more_queries_than_a_broadcast_holds(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_QUERIES", 3)
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, v array<double>")
    queries = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(11)], "q long, w array<double>")
    got = retrieval.dense(vectors, queries, row="id", vector="v", query="q", query_vector="w").collect()
    want = {(q, i): round((q + i) / ((q * q + 1) * (i * i + 1)) ** 0.5, 6) for q in range(11) for i in range(5)}
    assert len(got) == 55 and {(r[0], r[1]): r[2] for r in got} == want


def test_more_unwatched_directories_than_ten_thousand(spark):
    own = spark.createDataFrame([(f"a/d{i}/x/f.py",) for i in range(12_000)] + [("a/kept/f.py",), ("d7",)], "path string")
    dirs = spark.createDataFrame([(f"a/d{i}",) for i in range(12_000)] + [("b",)], "dir string")
    assert sorted(r[0] for r in changes.kept_changes(own, [], unwatched=dirs).collect()) == ["a/kept/f.py", "d7"]


def test_stored_index_reads_terms_only(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha {'beta ' * (i % 4)} w{i % 7} Ünder {chr(97 + i % 5) * 3}") for i in range(60)] + [(99, None), (98, "")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    index = retrieval.StoredIndex.of(docs, row="doc_id", text="text", folder=str(tmp_path / "index"))
    again = retrieval.StoredIndex.of(docs, row="doc_id", text="text", folder=str(tmp_path / "index"))
    assert again.path == index.path and index.n == 60
    queries = spark.createDataFrame([(1, "beta aaa ünder"), (2, "nothing"), (3, "ccc ccc alpha")], "q long, text string")
    score = lambda own: sorted(map(tuple, retrieval.bm25(own, queries, query="q", text="text").collect()))
    want = score(retrieval.postings(docs, row="doc_id", text="text"))
    assert score(index) == want and want
    plan = retrieval.bm25(index, queries, query="q", text="text")._jdf.queryExecution().toString()
    assert str(tmp_path / "documents") not in plan and "PartitionFilters: [" in plan
    monkeypatch.setattr(retrieval, "LITERAL_TERMS", 2)
    assert score(index) == want
    passages = spark.createDataFrame([(1, "lpha beta beta  w"), (2, "w3"), (3, "no such words here"), (4, "")], "q long, passage string")
    got = {(r[0], r[1]) for r in retrieval.quoted(index, passages, docs, query="q", passage="passage", row="doc_id", text="text").collect()}
    texts = [(r[0], r[1]) for r in docs.collect() if r[1] is not None]
    assert got == {(q, i) for q, p in ((1, "lpha beta beta  w"), (2, "w3"), (3, "no such words here"), (4, "")) for i, t in texts if p in t}


def test_stored_index_scores_before_it_shuffles(spark, tmp_path):
    texts = [(i, f"alpha {'beta ' * (i % 4)} w{i % 7}") for i in range(40)] + [(3, "alpha beta omega"), (3, None), (5, ""), (None, "alpha")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    index = retrieval.StoredIndex.of(docs, row="doc_id", text="text", folder=str(tmp_path / "index"))
    one = {}
    for i, x in texts:
        one[i] = f"{one.get(i, '')} {x or ''}"
    apart = spark.createDataFrame(list(one.items()), "doc_id long, text string")  # several texts of an id count as one
    queries = spark.createDataFrame([(1, "beta w3"), (2, "omega"), (3, "alpha")], "q long, text string")
    score = lambda own: sorted(map(str, retrieval.bm25(own, queries, query="q", text="text").collect()))
    assert score(index) == score(retrieval.postings(apart, row="doc_id", text="text")) and index.n == 41
    found = retrieval.bm25(index, queries, query="q", text="text").where("row >= 0")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.lower() and not any("Exchange hashpartitioning(query_id" in x and "row" in x for x in plan.split("\n"))
    texts = spark.range(60_000).select(F.col("id").alias("row"), F.lit("x").alias("text"))
    assert "BroadcastHashJoin" in retrieval.beside(found, texts, "row", 10)._jdf.queryExecution().executedPlan().toString()


def test_best_vectors_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_QUERIES", 7)
    monkeypatch.setattr(retrieval, "TILE_ROWS", 16)
    monkeypatch.setattr(retrieval, "TILE_QUERIES", 3)
    rng = random.Random(3)
    some = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(60)]
    odd = [[0.0] * 4, [float("nan"), 1.0, 0.0, 0.0], None, [1.0, None, 0.0, 0.0], [1.0, 2.0], [2.0, 1.0], [], [float("inf"), 1.0, 1.0, 1.0], [-0.5, 0.5, 0.0, 0.0]]
    vectors = spark.createDataFrame([(f"é{i}", v) for i, v in enumerate(some * 3 + [[round(x) / 2 for x in v] for v in some] + odd)], "id string, v array<double>")
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(some[:15] + odd)], "q long, w array<double>")
    how = dict(row="id", vector="v", query="q", query_vector="w")
    for k in (1, 5, 300):
        found = retrieval.dense_top(vectors, queries, k, **how)
        assert sorted(map(str, found.collect())) == sorted(map(str, retrieval.top(retrieval.dense(vectors, queries, **how), k).collect()))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "Cartesian" not in plan
    assert retrieval.dense_top(vectors, queries.limit(0), 3, **how).count() == 0


def test_pairs_are_dealt_out_whole_and_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "TILE", 7)
    monkeypatch.setattr(graph, "TASK_PAIRS", 50)
    rng = random.Random(5)
    left = [(rng.choice(["a", "a", "a", "b", "c", None]), i) for i in range(90)] + [("a", 1)] * 3
    right = [(rng.choice(["a", "a", "b", "d", None]), i) for i in range(60)]
    found = graph.pairs(spark.createDataFrame(left, "k string, x int"), spark.createDataFrame(right, "k string, y int"), ["k"])
    want = sorted((k, x, y) for k, x in left for j, y in right if k == j and k)
    assert sorted(map(tuple, found.collect())) == want and found.rdd.getNumPartitions() >= len(want) // 50
    assert max(found.rdd.glom().map(len).collect()) < len(want) / 4


def test_dependents_by_several_names_come_once(spark):
    rng = random.Random(6)
    files = [("r", f"u{i % 3}/f{i}.cs", rng.choice(["csharp", None])) for i in range(30)]
    imports = [("r", f[1], rng.choice(["A", "B", "C", None]), rng.choice([None, None, files[rng.randrange(30)][1]])) for f in files for _ in range(3)]
    symbols = [("r", f[1], rng.choice(["A", "B", "C", "D"])) for f in files for _ in range(2)]
    frame = spark.createDataFrame
    found = graph.dependents(frame(imports, "root_label string, rel_path string, module string, resolved_path string"), frame(files, "root_label string, rel_path string, language string"), frame(symbols, "root_label string, rel_path string, symbol string"))
    speaks = {f[1]: f[2] for f in files}
    want = {("r", p, "r", f, speaks[f]) for _, f, _, p in imports if p} | {("r", g, "r", f, speaks[f]) for _, f, m, _ in imports for _, g, s in symbols if m == s and f[:2] == g[:2]}
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan.split("\n")[0]  # no pass over all pairs above the join
