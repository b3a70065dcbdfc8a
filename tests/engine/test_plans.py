"""The indexing run, stores, embedding seam, settings, version control and the rules of the service."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F
from quarry.functions.text import ancestors_of
from quarry.operators import embedding, lookups, retrieval
from quarry.plans import evals, indexing, service, settings, stores
from quarry.sources import tables, versions, workspace

CODE = "import os\nfrom . import b\n\n\ndef alpha(x):\n    return [x + i for i in range(10)]  # alpha adds a range of numbers to x, one by one\n\n\ndef beta(y):\n    return {y: y * 2, 'beta': 'doubles what it is given and keeps it under its key'}\n"


def put(root, **files):
    for name, body in files.items():
        p = root / name.replace("__", "/").replace("_dot_", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)


@pytest.fixture
def space(tmp_path):
    root = tmp_path / "ws"
    put(root, src__a_dot_py=CODE, src__b_dot_py="def b():\n    return 'a function that is long enough to make a chunk of its own, with words in it and more words'\n", docs__adr__1_dot_md="# Why\nWe chose tables because files can be replaced whole.\n", logs__x_dot_txt="no", src__key_dot_py="pass" + "word = '24be64439e3e49cf46b2d7c90f3602a3'\n")
    return settings.Workspace("w", {"r": str(root)}, settings.IndexConfig()), root


def test_indexing_twice_writes_nothing(spark, space, tmp_path):
    own, root = space
    indexer = indexing.Indexer(spark, own, str(tmp_path / "index"))
    first = indexer.run()
    assert first.decisions == {"NEW": 4} and first.upserted > 3 and first.deleted == 0 and first.withheld == 1 and first.skipped == {"excluded": 1}
    points = indexer.store.collection(indexer.slug)
    version = points.folder()
    second = indexer.run()
    assert second.decisions == {"SKIP_UNCHANGED": 3, "NEW": 1} and second.upserted == second.deleted == 0 and points.folder() == version
    # a changed file: only its chunks move; a touched one with equal content is known by its hash; a lost one goes
    put(root, src__a_dot_py=CODE.replace("y * 2", "y * 3"))
    (root / "src/b.py").touch()
    (root / "docs/adr/1.md").unlink()
    third = indexer.run()
    assert third.decisions == {"REINDEX": 1, "SKIP_SAME_CONTENT": 1, "NEW": 1} and third.upserted == 1 and third.orphans == 1
    rows = points.read()
    assert not rows.where("rel_path = 'docs/adr/1.md'").count() and rows.where("dense is null").count() == 0
    assert {r["state"] for r in indexer.status().collect()} == {"ok"}
    assert {(r["module"], r["resolved_path"]) for r in indexer.resolved().collect()} == {("os", None), (".", None)}
    assert indexer.rescan(2) == 2 and indexer.rescan(2) == 0
    assert lookups.totals(indexer.table("files", indexing.FILE).read(), rows, indexer.table("runs", indexing.RUN).read()).first()["files"] == 2


def test_nothing_is_recorded_before_its_vectors(spark, space, tmp_path):
    own, _ = space

    def broken(texts):
        raise ValueError("no service")

    indexer = indexing.Indexer(spark, own, str(tmp_path / "index"), backend=broken)
    with pytest.raises(Exception, match="no service"):
        indexer.run()
    assert indexer.table("files", indexing.FILE).read().count() == 0
    again = indexing.Indexer(spark, own, str(tmp_path / "index"))
    assert again.run().decisions == {"NEW": 4}


def test_many_lost_files_are_kept_until_asked(spark, tmp_path):
    root = tmp_path / "ws"
    put(root, **{f"a{i}_dot_md": f"# Title {i}\nText of file {i} that says something.\n" for i in range(12)})
    indexer = indexing.Indexer(spark, settings.Workspace("w", {"r": str(root)}), str(tmp_path / "index"))
    indexer.run()
    for i in range(11):
        (root / f"a{i}.md").unlink()
    kept = indexer.run()
    assert kept.orphans == 11 and kept.orphans_kept == ["r"] and kept.deleted == 0
    assert indexer.run(delete_anyway=True).deleted == 11
    gone = indexing.Indexer(spark, settings.Workspace("w", {"r": str(root / "missing")}), str(tmp_path / "index")).run()
    assert gone.unobservable == ["r"] and gone.deleted == 0


def test_a_crash_between_the_steps_leaves_the_old_table(spark, tmp_path, monkeypatch):
    t = tables.Table(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([(1,)], "id int")
    t.replace(one)
    monkeypatch.setattr(tables.Table, "_point", lambda self, name, line: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        t.replace(spark.createDataFrame([(2,)], "id int"))
    assert [r[0] for r in t.read().collect()] == [1]
    monkeypatch.undo()
    (tmp_path / "t" / "_at-000000000005").write_text("v-half")  # a pointer whose writer died
    assert [r[0] for r in t.read().collect()] == [1]
    t.replace(spark.createDataFrame([(3,)], "id int"))
    t.vacuum()
    assert [r[0] for r in t.read().collect()] == [3] and len(list((tmp_path / "t").glob("v-*"))) == 1


def test_mirror_and_reproject(spark, tmp_path):
    rows = [(f"c{i}", "t", [3.0, 4.0, float(i)] if i % 3 else None) for i in range(9)]
    points = spark.createDataFrame(rows, "chunk_id string, source_text string, dense array<float>")
    a, b = tables.Table(spark, str(tmp_path / "a")), tables.Table(spark, str(tmp_path / "b"))
    a.replace(points)
    assert stores.mirror(a, b) == {"copied": 6, "skipped": 3} and stores.mirror(a, b)["copied"] == 6
    assert sorted(map(str, b.read().collect())) == sorted(map(str, points.where("dense is not null").collect()))
    cut = {r["chunk_id"]: r for r in stores.reprojected(b.read(), 2, model="m:x", held=3).collect()}
    assert [round(x, 6) for x in cut["c1"]["dense"]] == [0.6, 0.8] and cut["c1"]["space_slug"] == "m_x_2_from_3"
    with pytest.raises(ValueError, match="fewer"):
        stores.reprojected(points, 4, model="m", held=3)
    with pytest.raises(Exception, match="where the space has 5"):
        stores.reprojected(b.read(), 2, model="m", held=5).collect()


def test_store(spark, tmp_path):
    store = stores.VectorStore(spark, str(tmp_path))
    chunks = spark.createDataFrame([("c1", "r", "a/b.PY", "x", "# h\nx", [1.0, 0.0]), ("c2", "r", "c.md", "y", "y", [0.0, 1.0])], "chunk_id string, root_label string, rel_path string, source_text string, embed_text string, dense array<float>")
    points = stores.payload(chunks, space="s")
    assert store.ensure("s", points, width=2) and not store.ensure("s", points, width=2)
    store.upsert("s", points)
    assert store.collection_names() == ["s"] and store.count("s") == 2 and store.describe("s").first()["width"] == 2
    with pytest.raises(ValueError, match="not 3"):
        store.ensure("s", points, width=3)
    row = store.scroll("s", retrieval.Filters(equals={"ext": ".py"})).first()
    assert (row["context_header"], row["file_name"], row["ancestors"], row["doc_type"], row["unit"]) == ("# h", "b.PY", ["a"], "unknown", "a")
    assert store.collection("s").read().select(stores.embedded_text(points)).distinct().count() == 2
    with pytest.raises(ValueError, match="cannot filter on start_line"):
        store.scroll("s", retrieval.Filters(equals={"start_line": 1}))
    assert [tuple(r) for r in store.facet("s", "ext").collect()] == [(".md", 1), (".py", 1)]
    store.delete_path("s", "r", "c.md")
    store.delete_ids("s", spark.createDataFrame([("c1",)], "chunk_id string"))
    assert store.count("s") == 0 and store.chunks_for_path("s", "b.PY").count() == 0
    store.drop("s")
    assert store.collection_names() == []


def test_embedding_seam(spark):
    assert [len(b) for b in embedding.batches(["x"] * 130)] == [64, 64, 2]
    assert [len(b) for b in embedding.batches(["x" * 3300] * 5 + ["y" * 10**6], most_tokens=2000)] == [2, 2, 1, 1]
    df = spark.createDataFrame([(i, f"text {i}" if i else None) for i in range(150)], "id int, source_text string")
    out = embedding.embed(df, embedding.hashing_backend(8), width=8).collect()
    assert len(out) == 150 and all(len(r["dense"]) == 8 for r in out) and out[0]["dense"] == [0.0] * 8
    for wrong, what in ((lambda t: [[0.0] * 8] * (len(t) - 1), "vectors for"), (lambda t: [[0.0] * 7] * len(t), "where the space has 8")):
        with pytest.raises(Exception, match=what):
            embedding.embed(df, wrong, width=8).collect()
    slept, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return [1]

    retry = embedding.Retry(sleep=slept.append)
    assert retry.call(flaky) == [1] and len(slept) == 2 and 1 <= slept[0] <= 1.25 and 2 <= slept[1] <= 2.5
    assert retry.delay(9) >= 60 and retry.delay(1, "7") == 7 and retry.delay(1, "900") == 60 and 1 <= retry.delay(1, "Fri, 1 Jan") <= 1.25
    with pytest.raises(KeyError):
        retry.call(lambda: {}["no"])
    assert df.where("id = 3").select(embedding.sparse("source_text")).first()[0][0]["term"] == "text"


def test_settings(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"name": "a", "roots": {"r": "/x"}, "index": {"exclude": ["*.tmp"]}}))
    (own,) = settings.load(p)
    assert own.index.all_excludes[-1] == "*.tmp" and "**/.git/**" in own.index.all_excludes and len(settings.fingerprint(own)) == 16
    other = settings.Workspace("a", {"r": "/x"}, settings.IndexConfig(exclude=["*.tmp"], rerank_enabled=True))
    assert settings.fingerprint(own) == settings.fingerprint(other) != settings.fingerprint(settings.Workspace("a", {"r": "/y"}))
    watched = settings.Reloading(p)
    for wrong in ('{"name": "a", "name": "b", "roots": {}}', '{"name": "a", "roots": {"r": "/x"}, "nope": 1}', '{"name": "a", "roots": []}', "{", '{"name": "a", "roots": {"r": "/x"}, "index": {"dimensions": "9"}}', '{"name": "a", "roots": {"r": "/x"}, "index": {"on_error": "x"}}'):
        p.write_text(wrong)
        with pytest.raises(settings.ConfigError):
            settings.load(p)
        assert watched.current() == [own]
    p.write_text(json.dumps({"workspaces": [{"name": n, "roots": {"r": "/x"}} for n in "ab"]}))
    both = watched.current()
    assert settings.select(both, "b").name == "b"
    for name in (None, "c"):
        with pytest.raises(settings.UnknownName, match="a, b"):
            settings.select(both, name)
    assert settings.document_type("ADR") == "normative" and settings.document_type(" Design") == "design"
    with pytest.raises(settings.UnknownName, match="normative"):
        settings.document_type("poem")
    assert settings.reranker(own.index) is None
    with pytest.raises(settings.UnknownName):
        settings.reranker(settings.IndexConfig(rerank_enabled=True, rerank_model="x:y"))
    with pytest.raises(settings.UnknownName):
        settings.backend("other:9")


def test_yaml_refuses_a_key_that_stands_twice(tmp_path):
    pytest.importorskip("yaml")
    p = tmp_path / "c.yaml"
    p.write_text("name: a\nroots:\n  r: /x\n")
    assert settings.load(p)[0].roots == {"r": "/x"}
    p.write_text("name: a\nroots:\n  r: /x\n  r: /y\n")
    with pytest.raises(settings.ConfigError, match="twice"):
        settings.load(p)


def test_cost_display(spark):
    df = spark.createDataFrame([(0.5, 0, False), (0.5, 0, True), (0.0, 3, False)], "cost double, unpriced int, estimated boolean")
    assert [r[0] for r in df.select(settings.cost_display("cost", "unpriced", "estimated")).collect()] == ["$0.5000", "~$0.5000", "unpriced (3)"]


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    git = lambda *a, at=root: subprocess.run(["git", "-C", str(at), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    put(root, a_dot_py="x = 1\n", ä_dot_md="t\n")
    git("add", "-A")
    git("commit", "-q", "-m", "First\n\nbecause it was needed")
    git("worktree", "add", "-q", str(tmp_path / "wt"), "-b", "side")
    return root, tmp_path / "wt"


def test_version_control(spark, repo):
    root, other = repo
    row = versions.repositories(spark, [str(root), str(root.parent)]).collect()
    assert len(row) == 1 and (row[0]["name"], row[0]["branch"], row[0]["is_worktree"], len(row[0]["head_sha"])) == ("repo", "main", False, 40)
    assert {r[0] for r in versions.tracked(spark, str(root)).collect()} == {"a.py", "ä.md"}
    commit = versions.commits(spark, str(root)).first()
    assert (commit["subject"], commit["body"]) == ("First", "because it was needed") and commit["at"] is not None
    assert versions.is_linked_worktree(str(other)) and not versions.is_linked_worktree(str(root))
    put(other, a_dot_py="x = 2\n", new_dot_py="y\n")
    registry = versions.WorktreeRegistry([str(root)])
    (one,) = registry.linked
    assert {r[0] for r in versions.diverged(spark, one).collect()} == {"a.py", "new.py"}
    assert versions.scope(registry, "none") is None and versions.scope(registry, "side") == one == versions.scope(registry, str(other)) == versions.scope(registry, "wt")
    for given in (None, "what"):
        with pytest.raises(settings.UnknownName):
            versions.scope(registry, given)
    assert versions.scope(versions.WorktreeRegistry([]), None) is None
    assert versions.commits(spark, str(root.parent)).count() == 0 and versions.path_text(b"a\xff") == "a\\xff"


def test_walk_prunes(spark, repo, tmp_path):
    root, other = repo
    put(root, deep__er__x_dot_py="x", node_modules__y_dot_js="y", _dot_hidden__z="z", empty="")
    (root / "link").symlink_to(root / "deep")
    other.rename(root / "wt")
    got = {r["rel_path"] for r in workspace.walk(spark, str(root), "r", prune=["**/node_modules/**"]).collect()}
    assert got == {"a.py", "ä.md", "deep/er/x.py", ".hidden/z", "empty"}
    assert workspace.observable(spark, {"a": str(root), "b": str(root / "no"), "c": str(root / "a.py")}) == {"a": True, "b": False, "c": False}
    assert workspace.walk(spark, str(root / "no"), "r").count() == 0


@pytest.fixture
def index(spark):
    rows = [(f"c{i}", "r", f"src/{'bc'[i % 2]}/a{i}.py", ["implementation", "test", "normative", None][i % 4], f"alpha {chr(97 + i) * 4} " + "beta " * (i + 1), 10, 1 + i) for i in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_id string, root_label string, rel_path string, doc_type string, source_text string, token_count int, start_line int").withColumn("ancestors", ancestors_of("rel_path"))
    return service.Index(chunks, files=chunks.where("start_line <> 3").select("root_label", "rel_path", F.when(F.col("start_line") == 5, "other").otherwise(F.col("source_text")).alias("text")))


def test_service_rules(index):
    calls = []
    index.sink = calls.append
    got = index.code("beta")
    ids = {r["chunk_id"]: r["stale"] for r in got.results.collect()}
    assert not {"c1", "c5", "c9"} & set(ids) and {"c3", "c7"} <= set(ids) and got.applied_filters == {"exclude_doc_types": "test, generated"} and got.note is None and got.total_matches <= 8
    assert ids["c2"] and ids["c4"] and not ids["c6"]
    assert "c1" in {r["chunk_id"] for r in index.code("beta", include_tests=True, k=12).results.collect()}
    few = index.respond("t", "beta", index.search_code(index._one("beta", None), mode="sparse"), retrieval.Filters(), empty="", tokens=30)
    assert few.returned < few.total_matches and few.dropped_for_budget == few.total_matches - few.returned and "did not fit" in few.note
    bare = index.code("beta", locations_only=True)
    assert {r["source_text"] for r in bare.results.collect()} == {""} and "left out" in bare.note
    none = index.code("zzz")
    assert none.returned == 0 and "include_tests" in none.note
    assert {r["doc_type"] for r in index.guidance("beta", "ADR").results.collect()} == {"normative"} == {r["doc_type"] for r in index.guidance("beta").results.collect()}
    with pytest.raises(settings.UnknownName, match="known: normative"):
        index.guidance("beta", "poem")
    for k in (0, 201):
        with pytest.raises(ValueError, match="from 1 to 200"):
            index.code("beta", k=k)
    with pytest.raises(ValueError, match="cannot filter on token_count"):
        index.code("beta", filters=retrieval.Filters(equals={"token_count": 10}))
    assert {r["rel_path"] for r in index.code("beta", filters=retrieval.Filters(path_prefix="src/b"), k=20).results.collect()} == {f"src/b/a{i}.py" for i in (0, 2, 4, 6, 8, 10)}
    one = index.context("src/b/a4.py")
    assert [r["chunk_id"] for r in one.results.collect()] == ["c4"] and one.applied_filters == {"rel_path": "src/b/a4.py"} and index.context("no.py").note.startswith("No chunks")
    assert calls[0]["tool"] == "search_code" and calls[0]["returned"] == got.returned
    types = {r["value"]: (r["n"], r["samples"]) for r in index.document_types().collect()}
    assert types["test"] == (3, ["src/c/a1.py", "src/c/a5.py", "src/c/a9.py"]) and types["record"] == (0, None)


def test_rerank_degrades_or_fails(index):
    def broken(q, text):
        raise RuntimeError("no scorer")

    index.scorer = broken
    got = index.search_code(index._one("beta", None), mode="sparse", rerank=True, k=3)
    assert got.count() == 3 and (index.stats.calls, index.stats.degraded) == (1, 1)
    index.on_error = "fail"
    with pytest.raises(RuntimeError):
        index.search_code(index._one("beta", None), mode="sparse", rerank=True)


def test_impact(spark):
    files = spark.createDataFrame([("r", "a\\b.py", "python", "implementation"), ("r", "x/u.py", "python", "implementation"), ("r", "y/u.py", "python", "test"), ("r", "i/index.ts", "typescript", "implementation"), ("r", "n.sql", "sql", "implementation")], "root_label string, rel_path string, language string, doc_type string")
    imports = spark.createDataFrame([("r", "x/u.py", "m", 1, "a\\b.py", "first_party"), ("r", "y/u.py", "m", 1, "a\\b.py", "first_party"), ("r", "i/index.ts", "u", 2, "x/u.py", "first_party"), ("r", "x/u.py", "os", 3, None, "framework")], "root_label string, rel_path string, module string, line int, resolved_path string, origin string")
    calls = spark.createDataFrame([("r", "y/u.py", "r", "x/u.py")], "root_label string, rel_path string, resolved_root string, resolved_path string")
    one = service.impact(imports, files, "a\\b.py")
    assert [r["rel_path"] for r in one.used_by.collect()] == ["x/u.py", "y/u.py"] and one.used_by_type == {"implementation": 1, "test": 1}
    two = service.impact(imports, files, "u.py")
    assert two.rel_path is None and sorted(two.candidates) == ["x/u.py", "y/u.py"] and "2 files" in two.notes[0]
    assert service.impact(imports, files, "gone.py").candidates == []
    three = service.impact(imports, files, "x/u.py", calls=calls)
    assert any("index.ts" in n for n in three.notes) and any("HTTP" in n for n in three.notes) and any("standard library" in n for n in three.notes)
    assert "not scanned" in service.impact(imports, files, "n.sql").notes[0] and len(service.impact(imports, files, "a\\b.py", k=1).used_by.collect()) == 1
    assert [r["rel_path"] for r in service.impact_of(imports, files, None, "b.py")[0].collect()] == []


def test_grounding(spark):
    commits = spark.createDataFrame([("r", f"s{i}", "because of x" if i % 2 else "") for i in range(30)] + [("q", "Merge branch x", "because")], "repo string, subject string, body string")
    files = spark.createDataFrame([("r", "normative"), ("r", "implementation"), ("q", "implementation"), ("q", "implementation")], "repo string, doc_type string")
    got = service.grounding_report(commits, files, repo="repo").collect()
    assert [(r["repo"], r["history"], r["documents_strength"], r["verdict"]) for r in got] == [("q", "ABSENT", "ABSENT", "ABSENT"), ("r", "PRESENT", "PRESENT", "PRESENT")]
    assert "Read the implementation" in service.grounding_note(service.grounding_report(commits, files, repo="repo"))
    with pytest.raises(settings.UnknownName, match="q, r"):
        service.grounding_report(commits, files, repo="repo", only="z")
    assert service.grounding_report(commits, files, repo="repo", only="r").count() == 1


def test_evaluation_runs(spark, tmp_path, index):
    own = evals.cases(spark, [{"id": "a", "query": "beta", "expected": ["a10.py", "a8"]}, {"id": "b", "query": "gggg", "expected": ["src/b/a6"]}, {"id": "c", "query": "zzz", "expected": ["a1.py"]}])
    for wrong in ([{"id": 1, "query": "x", "expected": []}], [{"id": 1, "query": "x", "expected": ["y"]}] * 2):
        with pytest.raises(ValueError):
            evals.cases(spark, wrong)
    search = lambda q: index.search(q.withColumn("vector", F.lit(None).cast("array<double>")), mode="sparse", k=12)
    record, judged = evals.evaluate(search, own, k=10, label="plain", config_hash="c0")
    rows = {r["case_id"]: (r["recall"], r["first_hit"]) for r in judged.collect()}
    assert rows["a"][0] == 1.0 and rows["b"] == (1.0, 1) and rows["c"] == (0.0, None) and record["misses"] == 1 and record["cases"] == 3 and record["seconds"] > 0
    (tmp_path / "runs").mkdir()
    evals.save(spark, record | {"recorded_at": "2026-01-01T00:00:00+00:00", "recall_at_k": 0.5}, str(tmp_path / "runs"))
    evals.save(spark, record, str(tmp_path / "runs"))
    (tmp_path / "runs" / "broken.json").write_text("{no")
    held = evals.history(spark, str(tmp_path / "runs"))
    assert [r["recorded_at"][:4] for r in held.collect()] == ["2026", record["recorded_at"][:4]]
    moved = evals.delta(held).orderBy("recorded_at").collect()
    assert moved[0]["recall_moved"] is None and moved[1]["recall_moved"] == round(record["recall_at_k"] - 0.5, 6)
    assert evals.table(held).splitlines()[2].startswith(f"| {record['recorded_at'][:19]} | plain | c0 | 3 |")


def test_only_searches_for_words_build_the_index(spark, tmp_path):
    rows = [(i, "r", f"src/a{i}.py", ["test", "design"][i % 2], f"alpha {chr(97 + i) * 2}", 1) for i in range(8)]
    spark.createDataFrame(rows, "chunk_id long, root_label string, rel_path string, doc_type string, source_text string, start_line int").write.parquet(str(tmp_path / "chunks"))
    own = service.Index(spark.read.parquet(str(tmp_path / "chunks")), folder=str(tmp_path / "held"))
    assert own.file_context("a3.py").count() == 1 and {r["value"]: r["n"] for r in own.document_types().collect()}["test"] == 4
    assert not (tmp_path / "held").exists()
    assert own.search(spark.createDataFrame([(1, "ff")], "query_id long, text string"), mode="sparse").first()["chunk_id"] == 5 and list((tmp_path / "held").glob("index-*"))
