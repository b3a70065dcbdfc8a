"""Scalar functions against plain Python, nulls and edges included."""

import math
import uuid
from fnmatch import fnmatchcase

from pyspark.sql import functions as F
from quarry.functions import classify, secrets, text, vectors


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int' if isinstance(v, int) else 'array<float>'}" for k, v in values.items()))
    return row.select(column).first()[0]


def rows(spark, values, *columns):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_paths(spark):
    got = rows(spark, ["a/b/c.TS", "x.py", ".env", "d/.gitignore", "", None], text.unit_of("x"), text.ancestors_of("x"), text.file_name("x"), text.extension("x"))
    assert got[:4] == [("a", ["a", "a/b"], "c.TS", ".ts"), ("", [], "x.py", ".py"), ("", [], ".env", ""), ("d", ["d"], ".gitignore", "")]
    assert got[4][:2] == ("", [])


def test_chunk_ids_are_uuid5(spark):
    space = uuid.UUID("b4f1c0de-0000-4000-8000-646972696e64")
    for root, path, symbol, sha in [("r", "ä/b.py", "A.b", "00"), ("", "x", None, "ff" * 32)]:
        got = spark.range(1).select(text.chunk_id(F.lit(root), F.lit(path), F.lit(symbol).cast("string"), F.lit(3), F.lit(sha))).first()[0]
        assert got == str(uuid.uuid5(space, f"{root}\0{path}\0{symbol or ''}\0{3}\0{sha}"))


def test_token_estimates(spark):
    values = ["x" * n for n in range(0, 60)] + ["é" * 9]
    for kind, rate in (("code", 3.3), ("markdown", 4.0), ("other", 3.7)):
        want = [0 if not v else max(1, round(len(v.encode()) / rate)) for v in values]
        assert [r[0] for r in rows(spark, values, text.estimate_tokens("x", kind))] == want


def test_globs(spark):
    paths = ["/tests/a.py", "/src/tests/x/b.py", "/docs/adr/1.md", "/README.md", "/a/README", "/x/test_a.py", "/specs/CHANGELOG.md", "/.claude/x"]
    for pattern in ["**/tests/**", "**/adr/**", "**/README*", "**/test_*.*", "*.md", "/[ds]*/*", "**/.claude/**"]:
        got = [r[0] for r in rows(spark, paths, text.glob_match("x", pattern))]
        assert got == [fnmatchcase(p, pattern) or fnmatchcase(p, pattern.replace("**/", "/", 1)) for p in paths]


def test_routes(spark):
    assert rows(spark, ["https://h.x/A/b?q#f", "/a//b/", "a", ""], text.url_segments("x")) == [(["a", "b"],), (["a", "b"],), (["a"],), ([],)]
    assert rows(spark, ["src/Pages/Shop/Index.cshtml", "Pages/A.cshtml", "x/y.cs"], text.page_route("x")) == [("Shop",), ("A",), (None,)]
    assert one(spark, text.join_route("a", "b"), a="/api/", b="/x") == "api/x" and one(spark, text.expand_controller("a", "b"), a="api/[controller]", b="ShopController") == "api/Shop"


def test_headers(spark):
    h = text.context_header(F.lit("r"), F.lit("main"), F.lit("a.py"), F.lit("python"), F.lit(None).cast("string"), F.lit("function"), F.lit("f"))
    assert spark.range(1).select(h).first()[0] == "# repo: r (main)\n# file: a.py\n# language: python\n# function: f"
    assert one(spark, text.header_of("a", "b"), a="head\n\nbody", b="body") == "head"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0, 9.0], [0.0, 0.0, 1.0]), ([0.0, 0.0, 5.0], [1.0, 1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(vectors.truncate("a", 2), vectors.cosine("a", "b"), vectors.int8("b")).collect()
    assert got[0][0] == [0.6, 0.8] and got[1][0] == [0.0, 0.0] and math.isclose(got[0][1], 9 / math.sqrt(106)) and got[1][2] == [127, 127, 127]
    assert df.select(vectors.cosine("a", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))).first()[0] is None


def test_file_kinds(spark):
    names = {"a/x.PY": ("code", "python"), "README.md": ("markdown", "markdown"), "x.json.example": ("text", None), "Makefile": ("code", "make"), "a.png": ("image", None), "b.zip": ("opaque", None), "noext": ("text", None), "y.pdf": ("pdf", None)}
    got = rows(spark, names, classify.classify_file("x")["kind"], classify.classify_file("x")["language"])
    assert got == list(names.values())
    assert rows(spark, ["package-lock.json", "a.lock", "a.py"], classify.is_lockfile("x")) == [(True,), (True,), (False,)]


def test_document_types(spark):
    cases = [("tests/README.md", "", "test"), ("docs/adr/1.md", "", "normative"), ("a/CHANGELOG.md", "", "record"), ("x.md", "---\ntype: ADR\n---\nbody", "normative"), ("y.md", "---\nkind: other\n---\n", "unknown"), ("z.md", "You MUST do it. " * 40, "normative"), ("z.md", "You MUST do it.", "unknown"), ("q.md", None, "unknown")]
    df = spark.createDataFrame(cases, "path string, text string, want string")
    for r in df.withColumn("got", classify.document_type("path", "text", F.lit("markdown"))).collect():
        assert r["got"]["doc_type"] == r["want"], r
    assert one(spark, classify.document_type("p", "t", F.lit("code"))["doc_type"], p="src/a.py", t="x") == "implementation"


def test_secrets(spark):
    key = "".join(["AK", "IA", "ABCDEFGH12345678"])
    texts = ["tok" + 'en = "' + "24be64439e3e49cf46b2d7c90f3602a3" + '"', key, "password = '" + "a" * 30 + "'", 'token = "${EXAMPLE_VALUE_FROM_ENV}"', "plain", None]
    assert [r[0] for r in rows(spark, texts, secrets.findings("x"))] == [1, 1, 0, 0, 0, 0]
    df = spark.createDataFrame([("a/b.py", key), ("fixtures/b.py", key)], "rel_path string, text string")
    assert [r["withheld"] for r in secrets.withhold(df, allow=["**/fixtures/**"]).collect()] == [True, False]
    assert one(spark, F.round(text.shannon_entropy("a"), 6), a="aabb") == 1.0
