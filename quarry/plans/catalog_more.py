"""More of the engine's queries: sources, scanners, chunking, lookups, stores, the rules of the service, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import classify, secrets, text, vectors
from ..operators import chunking, embedding, graph, grounding, ledger, lookups, retrieval
from ..sources import workspace
from ..sources.tables import Table, shared_folder
from ..streaming import changes
from . import indexing, service, settings, stores
from .catalog import BM25, EDGES, FILES, PASSAGES, _edges, _graph, _ranked, files, passages, query, t

s_ = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
case = lambda n, *values: F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))
sql_case = lambda n, *values: "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][({n}) % {len(values)} + 1]"


def parts(spark, sf):
    return t(spark, sf, "part").withColumnRenamed("p_partkey", "k")


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


# --- scalars


@query("token_bytes", "SELECT k, greatest(1, floor(k * 3.3::DOUBLE)::INT) AS code, greatest(1, k * 4)::INT AS text FROM (SELECT p_partkey - 1 AS k FROM part)")
def token_bytes(spark, sf):
    own = parts(spark, sf).select((F.col("k") - 1).alias("k"))
    return own.select("k", text.tokens_to_bytes("k", "code").alias("code"), text.tokens_to_bytes("k", "text").alias("text"))


_HEADER = "'# repo: ' || source || CASE WHEN doc_id % 2 = 0 THEN ' (main)' ELSE '' END || chr(10) || '# file: ' || rel_path || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '# type: guide' ELSE '' END"


@query("context_headers", f"WITH {FILES.replace('SELECT doc_id,', 'SELECT doc_id, source,')}, h AS (SELECT doc_id, {_HEADER} AS header FROM files) SELECT doc_id, header, header AS back, greatest(1, round_even((strlen(header) + strlen(chr(10) || '# function: Some.Reasonably.Long.Symbol.Path')) / 3.3::DOUBLE, 0)::INT) AS cost FROM h")
def context_headers(spark, sf):
    own = files(spark, sf).withColumn("branch", F.expr("if(doc_id % 2 = 0, 'main', null)")).withColumn("doc_type", F.expr("if(doc_id % 3 = 0, 'guide', null)"))
    header = text.context_header("unit", "branch", "rel_path", None, "doc_type")
    embedded = F.concat(header, F.lit("\n"), F.col("text"))
    return own.select("doc_id", header.alias("header"), text.header_of(embedded, "text").alias("back"), text.header_token_cost("unit", "branch", "rel_path", None, "doc_type").alias("cost"))


@query("space_slugs", "SELECT k, 'vendor_m-' || k || '_' || w AS slug, 'vendor_m-' || k || '_' || w || CASE WHEN k % 2 = 0 THEN '_from_1024' ELSE '' END AS cut, 'a/b.py:' || k || '-' || w AS place FROM (SELECT p_partkey AS k, p_size AS w FROM part)")
def space_slugs(spark, sf):
    model = cat("vendor/m.", s_("k"))
    full = F.expr("if(k % 2 = 0, 1024, null)")
    return parts(spark, sf).select("k", text.space_slug(model, "p_size").alias("slug"), text.space_slug(model, "p_size", full).alias("cut"), text.location(F.lit("a/b.py"), "k", "p_size").alias("place")).withColumn("slug", F.replace("slug", F.lit("__"), F.lit("_"))).withColumn("cut", F.replace("cut", F.lit("__"), F.lit("_")))


@query("path_search", f"WITH {FILES} SELECT doc_id FROM files WHERE contains(lower(rel_path), 'rc1/en')")
def path_search(spark, sf):
    return files(spark, sf).where(text.path_matches("rel_path", F.lit("RC1/eN"))).select("doc_id")


@query("clipped_texts", r"SELECT doc_id, regexp_replace(left(text, 120), '\n[^\n]*$', '') AS clipped FROM documents")
def clipped_texts(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.clip("text", F.lit(30)).alias("clipped"))


@query("prices", "SELECT k, CASE WHEN k % 3 = 0 THEN NULL ELSE round(k / 1e6 * 0.18, 9) END AS price, CASE WHEN k % 5 = 0 THEN 'unpriced (' || (k + 1) || ')' WHEN k % 2 = 0 THEN '~$' || printf('%.4f', w / 8.0::DOUBLE) ELSE '$' || printf('%.4f', w / 8.0::DOUBLE) END AS shown FROM (SELECT p_partkey AS k, p_size AS w FROM part)")
def prices(spark, sf):
    own = parts(spark, sf)
    unpriced = F.expr("if(k % 5 = 0, k + 1, 0)")
    return own.select("k", F.round(text.price("k", F.expr("if(k % 3 = 0, null, 0.18D)")), 9).alias("price"), settings.cost_display(F.col("p_size") / 8, unpriced, F.col("k") % 2 == 0).alias("shown"))


@query("described_filters", "SELECT doc_id, 'lang=' || lang || CASE WHEN doc_id % 2 = 0 THEN ',source=' || source ELSE '' END AS filters FROM documents")
def described_filters(spark, sf):
    own = text.describe_filters(lang=F.col("lang"), source=F.expr("if(doc_id % 2 = 0, source, '')"), unit=F.lit(None).cast("string"))
    return t(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries(own), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("filters"))


@query("entropy", "SELECT p_partkey AS k, round(list_sum(list_transform(list_distinct(string_split(p_name, '')), lambda c: -((length(p_name) - length(replace(p_name, c, ''))) / length(p_name)) * log2((length(p_name) - length(replace(p_name, c, ''))) / length(p_name)))), 6) + 0.0 AS bits FROM part")
def entropy(spark, sf):
    return parts(spark, sf).select("k", F.round(text.shannon_entropy("p_name"), 6).alias("bits"))


@query("params_round_trip", "SELECT event_id, (props->>'k')::INT AS k, '{\"k\":' || ((props->>'k')::INT) || ',\"tool\":\"' || event_type || '\"}' AS params FROM events")
def params_round_trip(spark, sf):
    own = t(spark, sf, "events").withColumn("k", F.from_json("props", "k int")["k"])
    params = F.to_json(F.struct("k", F.col("event_type").alias("tool")))
    return own.withColumn("params", params).select("event_id", F.from_json("params", "k int, tool string")["k"].alias("k"), "params")


@query("config_fingerprints", "SELECT user_id, left(sha256('{\"dimensions\":' || (user_id % 4) || ',\"model\":\"m\"}'), 16) AS config_hash, count(*) AS n FROM events GROUP BY 1, 2")
def config_fingerprints(spark, sf):
    own = t(spark, sf, "events").select("user_id", settings.fingerprint_column(F.struct((F.col("user_id") % 4).alias("dimensions"), F.lit("m").alias("model"))).alias("config_hash"))
    return own.groupBy("user_id", "config_hash").agg(F.count(F.lit(1)).alias("n"))


@query("fitted_vectors", "WITH h AS (SELECT vec_id, embedding[1:8]::DOUBLE[] AS h FROM embeddings) SELECT vec_id, list_transform(h, lambda x: round(x / sqrt(list_inner_product(h, h)), 5)) AS cut FROM h")
def fitted_vectors(spark, sf):
    width = len(embedding.hashing_backend(64)(["x"])[0])
    return t(spark, sf, "embeddings").select("vec_id", F.transform(vectors.fit("embedding", width, 8), lambda x: vectors.rounded(x, 5)).alias("cut"))


# --- sources


_NAMES = ["a.py", "package-lock.json", "b.md", "Makefile", "c.png", "d.yaml.example", "e.zip", "README", "f.cs", "g.lock"]
_KINDS = ["code", "text", "markdown", "code", "image", "text", "opaque", "text", "code", "text"]
_LANGUAGES = ["python", None, "markdown", "make", None, None, None, None, "csharp", None]


def _named(spark, sf):
    return parts(spark, sf).select("k", cat("d", s_(F.col("k") % 3), "/", s_("k"), "/", case(F.col("k"), *_NAMES)).alias("rel_path"), (F.col("p_size") - 1).cast("long").alias("size"), F.lit("r").alias("root_label"))


@query(
    "file_candidates",
    f"""WITH f AS (SELECT p_partkey AS k, p_partkey % 3 AS d, {sql_case('p_partkey', *_NAMES)} AS name, p_size - 1 AS size, {sql_case('p_partkey', *_KINDS)} AS kind, {sql_case('p_partkey', *_LANGUAGES)} AS language FROM part)
SELECT k, kind, language, 'd' || d AS unit, CASE WHEN d = 2 THEN 'excluded' WHEN name IN ('package-lock.json', 'g.lock') THEN 'lockfile' WHEN size = 0 THEN 'empty' WHEN size > 40 THEN 'too_large' END AS skip_reason FROM f""",
)
def file_candidates(spark, sf):
    return workspace.candidates(_named(spark, sf), max_bytes=40, excluded=["d2/*"]).select("k", "kind", "language", "unit", "skip_reason")


@query("skip_tallies", f"WITH f AS (SELECT {sql_case('p_partkey', *_NAMES)} AS name, p_size - 1 AS size FROM part) SELECT * FROM (SELECT CASE WHEN name IN ('package-lock.json', 'g.lock') THEN 'lockfile' WHEN size = 0 THEN 'empty' WHEN size > 40 THEN 'too_large' END AS skip_reason, count(*) AS n FROM f GROUP BY 1) WHERE skip_reason IS NOT NULL")
def skip_tallies(spark, sf):
    return workspace.tallies(workspace.candidates(_named(spark, sf), max_bytes=40))


@query("ignored_files", f"WITH {FILES} SELECT rel_path FROM files WHERE (rel_path LIKE '%/en/%' OR regexp_matches(rel_path, '/doc_1[^/]*[.]md$') AND NOT rel_path LIKE '%/doc_11.md') AND doc_id % 10 <> 3")
def ignored_files(spark, sf):
    own = files(spark, sf)
    rules = workspace.ignore_rules(spark.createDataFrame([(".gitignore", "# kept out\nen/\ndoc_1*.md\n!doc_11.md\n")], "rel_path string, content string"))
    return workspace.ignored(own, rules, own.where("doc_id % 10 = 3"))


@query("read_texts", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'opaque' ELSE 'text' END AS kind, CASE WHEN doc_id % 7 <> 0 THEN text END AS text, CASE WHEN doc_id % 7 = 0 THEN sha256(chr(0) || text) WHEN doc_id % 3 = 0 THEN sha256(unhex('EFBBBF') || encode(text)) ELSE sha256(text) END AS sha256 FROM documents")
def read_texts(spark, sf):
    raw = F.when(F.col("doc_id") % 7 == 0, F.concat(F.unhex(F.lit("00")), F.encode("text", "UTF-8"))).when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    own = t(spark, sf, "documents").select("doc_id", raw.alias("content"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("language"))
    return workspace.read_text(own).select("doc_id", "kind", "text", "sha256")


_CODE = {
    "python": ("import os\nfrom .m{k} import x\n", [("os", 1, "import"), (".m{k}", 2, "import")]),
    "typescript": ("import a from './m{k}'\nexport { b } from 'pkg'\nconst c = require(\"fs\")\n", [("./m{k}", 1, "import"), ("pkg", 2, "re_export"), ("fs", 3, "require")]),
    "csharp": ("using M{k};\nglobal using static A.B;\nusing X = C.D;\n", [("M{k}", 1, "using"), ("A.B", 2, "global_using_static"), ("C.D", 3, "using")]),
}


def _coded(spark, sf):
    code = lambda c: F.replace(F.lit(c), F.lit("{k}"), s_("k"))
    languages = list(_CODE)
    body = F.when(F.col("k") % 3 == 0, code(_CODE[languages[0]][0])).when(F.col("k") % 3 == 1, code(_CODE[languages[1]][0])).otherwise(code(_CODE[languages[2]][0]))
    return parts(spark, sf).select("k", F.lit("r").alias("root_label"), cat("u/", s_("k")).alias("rel_path"), case(F.col("k"), *languages).alias("language"), body.alias("text"))


_EXPECTED = ", ".join(f"({i}, '{m}', {line}, '{kind}')" for i, (_, found) in enumerate(_CODE.values()) for m, line, kind in found)


@query("scanned_imports", f"SELECT p_partkey AS k, replace(m, '{{k}}', p_partkey::VARCHAR) AS module, line, kind, starts_with(m, '.') AS is_relative FROM part JOIN (VALUES {_EXPECTED}) v(i, m, line, kind) ON p_partkey % 3 = i")
def scanned_imports(spark, sf):
    return workspace.imports(_coded(spark, sf)).select(F.substring_index("rel_path", "/", -1).cast("long").alias("k"), "module", "line", "kind", "is_relative")


@query("scanned_namespaces", "SELECT p_partkey AS k, symbol, line, kind FROM part, (VALUES (0, 'A', 1, 'block'), (0, 'A.B', 3, 'block'), (1, 'F', 1, 'file')) v(i, symbol, line, kind) WHERE p_partkey % 2 = i")
def scanned_namespaces(spark, sf):
    own = parts(spark, sf).select(F.lit("r").alias("root_label"), s_("k").alias("rel_path"), F.lit("csharp").alias("language"), F.expr("if(k % 2 = 0, 'namespace A\\n{\\n namespace B { }\\n}\\n', 'namespace F;\\nclass C { }\\n')").alias("text"))
    return workspace.namespaces(own).select(F.col("rel_path").cast("long").alias("k"), "symbol", "line", "kind")


@query("scanned_route_calls", "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN '/api/p/' || p_partkey ELSE '/api/q/' END AS template, p_partkey % 2 = 0 AS exact, 2 AS line FROM part")
def scanned_route_calls(spark, sf):
    code = F.when(F.col("k") % 2 == 0, cat("// x\nfetch('/api/p/", s_("k"), "')\n")).otherwise(cat("// x\nfetch(`/api/q/${", s_("k"), "}`)\n"))
    own = parts(spark, sf).select(F.lit("r").alias("root_label"), s_("k").alias("rel_path"), F.lit("typescript").alias("language"), code.alias("text"))
    return workspace.route_calls(own).select(F.col("rel_path").cast("long").alias("k"), "template", "exact", "line")


@query("scanned_routes", "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'v1/items/{id}' WHEN 1 THEN 'api/Shop/{id}' ELSE 'S' || p_partkey END AS template FROM part")
def scanned_routes(spark, sf):
    k = F.col("k")
    code = F.when(k % 3 == 0, 'var g = app.MapGroup("/v1");\ng.MapGet("/items/{id}", f);\n').when(k % 3 == 1, '[Route("api/[controller]")]\nclass ShopController {\n[HttpGet("{id}")]\n}\n').otherwise("@page\n<p>")
    own = parts(spark, sf).select(F.lit("r").alias("root_label"), cat("x/Pages/S", s_("k"), "/Index.cshtml").alias("rel_path"), F.expr("if(k % 3 = 2, 'razor', 'csharp')").alias("language"), code.alias("text"))
    return workspace.route_declarations(own).select(F.regexp_extract("rel_path", r"S(\d+)", 1).cast("long").alias("k"), "template")


@query("page_routes", "SELECT p_partkey AS k, replace(p_name, ' ', '/') AS route, 'api/' || p_size AS joined, 'api/Shop' || p_size AS expanded FROM part")
def page_routes(spark, sf):
    return parts(spark, sf).select(
        "k", text.page_route(cat("app/Pages/", F.replace("p_name", F.lit(" "), F.lit("/")), "/Index.cshtml")).alias("route"),
        text.join_route(F.lit("/api/"), cat("/", s_("p_size"), "/")).alias("joined"), text.expand_controller(F.lit("api/[controller]"), cat("Shop", s_("p_size"), "Controller")).alias("expanded"),
    )


_ENTROPY = "list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -((length(v) - length(replace(v, c, ''))) / length(v)) * log2((length(v) - length(replace(v, c, ''))) / length(v))))"
_SHAPE_COUNT = " + ".join(f"len(regexp_extract_all(text, '{x}'))" for x in secrets.SHAPES)
_PLACEHOLDER = r"^(\$\{|<|\{\{|%)|(?i:example|placeholder|changeme|your[_-])"


@query("secret_withheld", f"""WITH f AS (SELECT doc_id, {_SHAPE_COUNT} AS shapes, list_filter(regexp_extract_all(text, '{secrets._VALUE.replace("'", "''")}', 1), lambda v: {_ENTROPY} >= 3.0 AND NOT regexp_matches(v, '{_PLACEHOLDER}')) AS found FROM documents)
SELECT doc_id, shapes + len(found) AS findings FROM f WHERE shapes + len(found) > 0""")
def secret_withheld(spark, sf):
    own = secrets.withhold(files(spark, sf), allow=["**/nowhere/**"]).where("withheld")
    return own.select("doc_id", secrets.findings("text").cast("long").alias("findings"))


@query("unfiltered_files", f"WITH {FILES} SELECT root_label, unit, count(*) AS files FROM files WHERE unit <> 'src1' GROUP BY 1, 2")
def unfiltered_files(spark, sf):
    own = files(spark, sf).drop("root")
    roots = spark.createDataFrame([("src1",)], "root string")
    return lookups.unfiltered_files(graph.longest_prefix(own.select("root_label", "rel_path"), roots), [])


# --- chunking


_WORDS = r"trim(regexp_replace(text, '[^\x21-\x{10FFFF}]+|[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"


def _one_line(column):
    return F.trim(F.regexp_replace(column, r"[^\x21-\x{10FFFF}]+|[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


@query(
    "markdown_sections",
    f"""WITH d AS (SELECT doc_id, lang, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, v.* FROM d, LATERAL (VALUES (NULL, 1, 1, 'intro ' || w), ('A', 3, 4, '# A' || chr(10) || 'x ' || w), ('A > B', 5, 8, '## B' || chr(10) || '```' || chr(10) || '# ' || lang || chr(10) || '```'), ('C', 9, 10, '# C' || chr(10) || 'end')) v(symbol_path, start_line, end_line, body)),
p AS (SELECT *, symbol_path = 'A' AND round_even(strlen(body) / 4.0::DOUBLE, 0) > 512 AS split FROM s),
c AS (SELECT doc_id, symbol_path, start_line, end_line, body FROM p WHERE split IS NOT TRUE UNION ALL SELECT doc_id, symbol_path, 3, 3, '# A' FROM p WHERE split UNION ALL SELECT doc_id, symbol_path, 4, 4, body[5:] FROM p WHERE split)
SELECT doc_id, symbol_path, start_line, end_line, greatest(1, round_even(strlen(body) / 4.0::DOUBLE, 0)::INT) AS token_count, sha256(body) AS sha FROM c""",
)
def markdown_sections(spark, sf):
    w = _one_line("text")
    body = cat("intro ", w, "\n\n# A\nx ", w, "\n## B\n```\n# ", F.col("lang"), "\n```\n# C\nend\n")
    own = t(spark, sf, "documents").select("doc_id", F.lit("markdown").alias("kind"), F.lit(None).cast("string").alias("language"), body.alias("text"))
    return chunking.chunk(own, keys=["doc_id"]).select("doc_id", "symbol_path", "start_line", "end_line", "token_count", text.sha256_text("source_text").alias("sha"))


@query(
    "line_cut",
    """WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(text, '[\\r\\v\\f\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]', '_', 'g') AS text FROM documents WHERE text <> ''), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d),
o AS (SELECT *, (CASE WHEN trim(line) = '' THEN 0 ELSE strlen(line) END) + 1 AS size FROM l WHERE NOT (line = '' AND n = (SELECT max(n) FROM l m WHERE m.doc_id = l.doc_id))),
r AS (SELECT doc_id, n, size AS held, 1 AS part FROM o WHERE n = 1 UNION ALL SELECT o.doc_id, o.n, CASE WHEN r.held + o.size > 256 THEN o.size ELSE r.held + o.size END, CASE WHEN r.held + o.size > 256 THEN r.part + 1 ELSE r.part END FROM r JOIN o ON o.doc_id = r.doc_id AND o.n = r.n + 1),
g AS (SELECT doc_id, part, min(n) AS start_line, max(n) AS end_line, bool_or(trim(line) <> '') AS kept FROM r JOIN o USING (doc_id, n) GROUP BY 1, 2)
SELECT doc_id, start_line::INT AS start_line, end_line::INT AS end_line FROM g WHERE kept OR (SELECT count(*) FROM g h WHERE h.doc_id = g.doc_id AND h.kept) = 0 AND part = 1""",
)
def line_cut(spark, sf):
    """Line ends other than a newline stand as underscores, since SQL splits at newlines only."""
    own = t(spark, sf, "documents").withColumn("text", F.regexp_replace("text", r"[\r\x0B\f\x1c-\x1e\x{85}\x{2028}\x{2029}]", "_"))
    own = own.select("doc_id", F.lit("text").alias("kind"), F.lit(None).cast("string").alias("language"), "text")
    return chunking.chunk(own, keys=["doc_id"], chunker=lambda kind, language, body: chunking.line_chunks(body, budget=64)).select("doc_id", "start_line", "end_line")


@query(
    "text_pack",
    f"""WITH RECURSIVE b AS (SELECT doc_id, n, greatest(1, round_even(strlen(w) / 4.0::DOUBLE, 0)::INT) AS cost FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split({_WORDS}, '. '), lambda x: trim(x)), lambda x: x <> '')) AS w, generate_subscripts(list_filter(list_transform(string_split({_WORDS}, '. '), lambda x: trim(x)), lambda x: x <> ''), 1) AS n FROM documents)),
r AS (SELECT doc_id, n, cost AS held, 1 AS part FROM b WHERE n = 1 UNION ALL SELECT b.doc_id, b.n, CASE WHEN r.held + b.cost > 128 THEN b.cost ELSE r.held + b.cost END, CASE WHEN r.held + b.cost > 128 THEN r.part + 1 ELSE r.part END FROM r JOIN b ON b.doc_id = r.doc_id AND b.n = r.n + 1)
SELECT doc_id, (part - 1)::INT AS chunk_index, (max(part) OVER (PARTITION BY doc_id))::INT AS chunk_total, (min(n) * 2 - 1)::INT AS start_line, (max(n) * 2 - 1)::INT AS end_line FROM r GROUP BY doc_id, part""",
)
def text_pack(spark, sf):
    """Sentences as paragraphs, packed: each is atomic here, so a group's blank lines don't divide it again."""
    sentences = F.filter(F.transform(F.split(_one_line("text"), r"\. "), lambda x: F.trim(x)), lambda x: x != "")  # trim itself would take the place as what to cut
    own = t(spark, sf, "documents").select("doc_id", F.lit("text").alias("kind"), F.lit(None).cast("string").alias("language"), F.array_join(sentences, "\n\n").alias("text"))
    return chunking.chunk(own, keys=["doc_id"], chunker=lambda kind, language, body: chunking.packed_paragraphs(body, budget=128)).select("doc_id", "chunk_index", "chunk_total", "start_line", "end_line")


@query(
    "code_symbols",
    "SELECT p_partkey AS k, name AS symbol_name, a AS start_line, b AS end_line, i AS chunk_index, 2 AS chunk_total, false AS parse_degraded FROM part, (VALUES ('f', 2, 4, 0), ('G', 5, 6, 1)) v(name, a, b, i)",
)
def code_symbols(spark, sf):
    long = " + ".join(["value"] * 30)
    body = cat("import a\n", f"def f(x):\n    return {long}\n    # ", F.col("p_name"), "\n", f"class G:\n    y = {long}\n")
    own = parts(spark, sf).select("k", F.lit("code").alias("kind"), F.lit("python").alias("language"), body.alias("text"))
    return chunking.chunk(own, keys=["k"]).select("k", "symbol_name", "start_line", "end_line", "chunk_index", "chunk_total", "parse_degraded")


@query("chunker_routes", "SELECT doc_id, sha256(w) AS sha, CASE WHEN doc_id % 4 = 1 THEN true ELSE false END AS parse_degraded FROM (SELECT doc_id, " + _WORDS + " AS w FROM documents) WHERE doc_id % 4 <> 3 AND w <> ''")
def chunker_routes(spark, sf):
    """By kind: markdown without a heading, code of an unknown language, and text are one chunk here; opaque files have none."""
    own = t(spark, sf, "documents").select("doc_id", case(F.col("doc_id"), "markdown", "code", "text", "opaque").alias("kind"), F.lit("sql").alias("language"), _one_line("text").alias("text"))
    found = chunking.chunk(own, keys=["doc_id"])
    return found.select("doc_id", text.sha256_text("source_text").alias("sha"), "parse_degraded")


@query("declared_spans", "SELECT p_partkey AS k, 'alpha' AS name, 1 AS start_line, 3 AS end_line FROM part UNION ALL SELECT p_partkey, 'Beta' || p_size, 4, 4 FROM part")
def declared_spans(spark, sf):
    body = cat("const alpha = async () => {\n  x\n}\nexport class Beta", s_("p_size"), " { }\n")
    own = parts(spark, sf).select("k", F.lit("typescript").alias("language"), body.alias("text"))
    return chunking.declarations(own, keys=["k"]).select("k", "name", "start_line", "end_line")


@query("document_pages", "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'page 1' ELSE 'page 2' END AS symbol_path, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS start_line FROM part")
def document_pages(spark, sf):
    pages = F.when(F.col("k") % 2 == 0, F.array(cat("a page that is long enough: ", F.col("p_name")), F.lit("short"))).otherwise(F.array(F.lit("short"), cat("a page that is long enough: ", F.col("p_name"))))
    own = parts(spark, sf).select("k", pages.alias("pages"))
    return chunking.chunk_pages(own, keys=["k"], pages="pages").select("k", "symbol_path", "start_line")


# --- classification, graph


_DECLARED = ["ADR", "rfc", "howto", "api", "postmortem", "notes"]


@query("front_matter_types", f"SELECT doc_id, {sql_case('doc_id', 'normative', 'design', 'guide', 'reference', 'record', 'record')} AS doc_type, 'frontmatter: frontmatter declares type: ' || {sql_case('doc_id', *_DECLARED)} AS reason FROM documents")
def front_matter_types(spark, sf):
    body = cat("---\ntitle: x\ntype: ", case(F.col("doc_id"), *_DECLARED), "\n---\n", F.col("text"))
    found = classify.document_type(cat("notes/", s_("doc_id"), ".md"), body, F.lit("markdown"))
    return t(spark, sf, "documents").select("doc_id", found["doc_type"].alias("doc_type"), found["reason"].alias("reason"))


@query("modal_rule", r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND 160000.0 / (120 + len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) >= 12 THEN 'normative' ELSE 'unknown' END AS doc_type FROM documents")
def modal_rule(spark, sf):
    """Texts without modal words of their own, and with forty sentences of them before every second one."""
    bare = F.regexp_replace(F.col("text"), r"(?iU)\b(must|shall|never|always|should|required)\b", "x")
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.repeat(F.lit("You MUST do. "), 40), bare)).otherwise(bare)
    return t(spark, sf, "documents").select("doc_id", classify.document_type(cat("x", s_("doc_id"), ".txt"), body, F.lit("text"))["doc_type"].alias("doc_type"))


_MODULES = [("os.path", "python"), ("fs/promises", "typescript"), ("node:test", "typescript"), ("test", "typescript"), ("System.IO", "csharp"), ("pkg/x", "typescript"), ("pkg.x", "python"), ("pkgs", "python")]


@query("import_origins", f"SELECT p_partkey AS k, {sql_case('p_partkey', 'framework', 'framework', 'framework', 'unclassified', 'framework', 'declared_dependency', 'declared_dependency', 'unclassified')} AS origin FROM part")
def import_origins(spark, sf):
    own = parts(spark, sf).select("k", case(F.col("k"), *[m for m, _ in _MODULES]).alias("module"), case(F.col("k"), *[lang for _, lang in _MODULES]).alias("language"))
    m, lang = F.col("module"), F.col("language")
    return own.select("k", graph.origin(F.lit(None), F.lit(False), graph.is_declared(m, F.array(F.lit("pkg")), lang), graph.is_framework(m, lang)).alias("origin"))


@query("csharp_kinds", f"SELECT p_partkey AS k, {sql_case('p_partkey', 'using', 'using_static', 'global_using', 'global_using_static')} AS kind FROM part")
def csharp_kinds(spark, sf):
    return parts(spark, sf).select("k", workspace.csharp_kind(case(F.col("k"), "using A.B;", "  using static A.B;", "global using A;", "global using static A.B;")).alias("kind"))


@query("relative_resolve", "SELECT k, CASE WHEN k % 2 = 0 THEN 'p/q/m' || k || '.py' END AS near, CASE WHEN k % 3 = 0 THEN 'p/m' || k || '.py' END AS above, CASE WHEN k % 5 = 0 THEN 'w/t' || k || '/index.ts' END AS script FROM (SELECT p_partkey AS k FROM part)")
def relative_resolve(spark, sf):
    own = parts(spark, sf).select("k")
    path = lambda where, *xs: own.where(where).select(F.lit("r").alias("root_label"), cat(*xs).alias("rel_path"))
    held = path("k % 2 = 0", "p/q/m", s_("k"), ".py").unionByName(path("k % 3 = 0", "p/m", s_("k"), ".py")).unionByName(path("k % 5 = 0", "w/t", s_("k"), "/index.ts"))
    edge = lambda name, rel, lang, *xs: own.select(cat(name, ":", s_("k")).alias("edge_id"), F.lit("r").alias("root_label"), F.lit(rel).alias("rel_path"), cat(*xs).alias("module"), F.lit(lang).alias("language"))
    edges = edge("near", "p/q/c.py", "python", ".m", s_("k")).unionByName(edge("above", "p/q/c.py", "python", "..m", s_("k"))).unionByName(edge("script", "w/a/x.ts", "typescript", "../t", s_("k")))
    found = graph.by_relative(edges, held).select(F.split_part("edge_id", F.lit(":"), F.lit(1)).alias("name"), F.split_part("edge_id", F.lit(":"), F.lit(2)).cast("long").alias("k"), "resolved_path")
    wide = found.groupBy("k").agg(*[F.max(F.when(F.col("name") == n, F.col("resolved_path"))).alias(n) for n in ("near", "above", "script")])
    return own.join(wide, "k", "left")


_SEGMENTS = "list_filter(string_split(lower(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')), '/'), lambda x: x <> '')"


@query("route_prefix_and_base", f"""WITH calls AS (SELECT page_id AS call_id, {_SEGMENTS} AS s FROM pages)
SELECT call_id, CASE WHEN call_id % 2 = 0 THEN CASE WHEN len(s) = 2 AND s[1] IN ('en', 'de') THEN s[1] || '.py' WHEN len(s) >= 1 AND s[1] = 'fr' THEN 'fr.py' END ELSE CASE WHEN s[1] IN ('en', 'de', 'fr') THEN s[1] || '.py' END END AS resolved_path FROM calls""")
def route_prefix_and_base(spark, sf):
    path = text.url_segments("url")
    template = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/api/"), F.array_join(path, "/"))).otherwise(F.concat(F.lit("/"), F.coalesce(F.get(path, F.lit(0)), F.lit(""))))
    calls = t(spark, sf, "pages").select(F.col("page_id").alias("call_id"), template.alias("template"), (F.col("page_id") % 2 == 0).alias("exact"))
    routes = spark.createDataFrame([("/en/{id}", "en.py"), ("/de/{id}", "de.py"), ("/fr/{*rest}", "fr.py"), ("/es/{id}", "es1.py"), ("/es/{key}", "es2.py")], "template string, rel_path string")
    return graph.match_routes(calls, routes).select("call_id", "resolved_path")


@query("dependents_by_namespace", "SELECT DISTINCT d.p_partkey AS target, i.p_partkey AS importer FROM part i JOIN part d ON d.p_brand = i.p_brand AND d.p_size = i.p_size AND d.p_partkey % 4 = i.p_partkey % 4")
def dependents_by_namespace(spark, sf):
    own = parts(spark, sf).select(F.lit("r").alias("root_label"), cat("u", s_(F.col("k") % 4), "/", s_("k")).alias("rel_path"), cat(F.col("p_brand"), ".", s_("p_size")).alias("module"))
    imports = own.withColumn("resolved_path", F.lit(None).cast("string"))
    found = graph.dependents(imports, own.withColumn("language", F.lit("csharp")), own.withColumnRenamed("module", "symbol"))
    number = lambda c: F.substring_index(c, "/", -1).cast("long")
    return found.select(number("target_path").alias("target"), number("rel_path").alias("importer"))


@query("barrels", f"SELECT p_partkey AS k FROM part WHERE {sql_case('p_partkey', 'index.ts', 'a.ts', '__init__.py', 'xindex.ts')} IN ('index.ts', '__init__.py')")
def barrels(spark, sf):
    return parts(spark, sf).where(graph.is_barrel(cat("d/", case(F.col("k"), "index.ts", "a.ts", "__init__.py", "xindex.ts")))).select("k")


@query("stale_graph", "SELECT p_partkey AS k FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') AND coalesce(nullif(p_size % 4, 3), 0) < 2")
def stale_graph(spark, sf):
    own = parts(spark, sf).select("k", F.col("p_brand").alias("language"), F.expr("nullif(p_size % 4, 3)").alias("graph_version"))
    return graph.stale_graph(own, ["Brand#11", "Brand#12"], 2).select("k")


@query("glob_filter", f"WITH {FILES} SELECT doc_id FROM files WHERE rel_path LIKE '%/en/doc_1%'")
def glob_filter(spark, sf):
    return files(spark, sf).where(text.glob_match(F.concat(F.lit("/"), "rel_path"), "**/en/doc_1*")).select("doc_id")


# --- lookups


@query("imports_of", f"WITH {EDGES} SELECT 'p/' || target AS module, line FROM edges WHERE importer = 7")
def imports_of(spark, sf):
    return lookups.imports_of(_graph(spark, sf)[0], "r", "o/7").select("module", "line")


@query("importers_of", f"WITH {EDGES} SELECT importer, line FROM edges WHERE target = 7")
def importers_of(spark, sf):
    return lookups.importers_of(_graph(spark, sf)[0], "p/7").select(F.substring_index("rel_path", "/", -1).cast("long").alias("importer"), "line")


@query("namespaces_of", "SELECT symbol, line FROM (VALUES ('A', 1), ('A.B', 3)) v(symbol, line)")
def namespaces_of(spark, sf):
    own = parts(spark, sf).select(F.lit("r").alias("root_label"), s_("k").alias("rel_path"), F.lit("csharp").alias("language"), F.lit("namespace A\n{\n namespace B { }\n}\n").alias("text"))
    return lookups.namespaces_of(workspace.namespaces(own), "r", "7").select("symbol", "line")


def _route_rows(spark, sf):
    lines = t(spark, sf, "lineitem").select(F.lit("r").alias("root_label"), s_("l_orderkey").alias("rel_path"), F.col("l_linenumber").alias("line"), cat("/x/", s_("l_partkey")).alias("template"), (F.col("l_linenumber") != 2).alias("exact"), F.expr("if(l_quantity > 10, cast(l_partkey as string), null)").alias("resolved_path"))
    declared = parts(spark, sf).select(F.lit("r").alias("root_label"), s_("k").alias("rel_path"), F.col("p_size").alias("line"), cat("/x/", s_("k")).alias("template"))
    return lookups.route_rows(declared, lines)


@query("route_table", "SELECT 'declaration' AS role, count(*) AS n, count(*) AS exact, 0 AS resolved FROM part UNION ALL SELECT 'call', count(*), count(*) FILTER (l_linenumber <> 2), count(*) FILTER (l_quantity > 10) FROM lineitem")
def route_table(spark, sf):
    return _route_rows(spark, sf).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("exact"), F.count("resolved_path").alias("resolved"))


@query("unresolved_calls", "SELECT l_orderkey AS id, l_linenumber AS line FROM lineitem WHERE l_quantity <= 10")
def unresolved_calls(spark, sf):
    return lookups.unresolved_calls(_route_rows(spark, sf)).select(F.col("rel_path").cast("long").alias("id"), "line")


@query("route_targets", "SELECT p_partkey AS id, p_size AS line, '/x/' || p_partkey AS template FROM part")
def route_targets(spark, sf):
    return lookups.route_targets(_route_rows(spark, sf)).select(F.col("rel_path").cast("long").alias("id"), "line", "template")


@query("namespace_resolved_imports", "SELECT DISTINCT i.p_partkey AS importer, i.p_brand AS module FROM part i WHERE EXISTS (SELECT 1 FROM part d WHERE d.p_size <= 10 AND d.p_brand = i.p_brand AND d.p_partkey % 4 = i.p_partkey % 4)")
def namespace_resolved_imports(spark, sf):
    own = parts(spark, sf).select(F.lit("r").alias("root_label"), cat("u", s_(F.col("k") % 4), "/", s_("k")).alias("rel_path"), F.col("p_brand").alias("module"), "p_size")
    found = lookups.namespace_resolved_imports(own, own.where("p_size <= 10").withColumnRenamed("module", "symbol"))
    return found.select(F.substring_index("rel_path", "/", -1).cast("long").alias("importer"), "module")


@query("indexed_documents", f"WITH {FILES} SELECT doc_id, '/ws/' || root_label || '/' || rel_path AS abs_path FROM files WHERE root_label IN ('en', 'de')")
def indexed_documents(spark, sf):
    roots = spark.createDataFrame([("en", "/ws/en/"), ("de", "/ws/de")], "root_label string, base string")
    found = lookups.indexed_documents(files(spark, sf).withColumn("doc_type", F.lit("guide")), roots)
    return found.select(F.regexp_extract("rel_path", r"doc_(\d+)", 1).cast("long").alias("doc_id"), "abs_path")


@query("chunk_ids_of_file", "SELECT l_linenumber AS chunk_id FROM lineitem WHERE l_orderkey = 7")
def chunk_ids_of_file(spark, sf):
    own = t(spark, sf, "lineitem").select(F.lit("r").alias("root_label"), s_("l_orderkey").alias("rel_path"), F.col("l_linenumber").alias("chunk_id"))
    return lookups.chunk_ids_for(own, "r", "7")


@query("file_record", "SELECT o_orderkey, o_orderstatus AS doc_type FROM orders WHERE o_orderkey = 7")
def file_record(spark, sf):
    return lookups.get_file(_graph(spark, sf)[1], "r", "o/7").select(F.substring_index("rel_path", "/", -1).cast("long").alias("o_orderkey"), "doc_type")


@query("vector_indexes", "SELECT 'embedding' AS name, 'dense' AS kind, max(len(embedding))::INT AS width, count(embedding) AS points, count(embedding) > 0 AS searchable FROM embeddings")
def vector_indexes(spark, sf):
    return lookups.describe_vectors(t(spark, sf, "embeddings"))


@query("spaces", "SELECT DISTINCT lang AS space_slug FROM documents WHERE lang IS NOT NULL")
def spaces(spark, sf):
    return lookups.spaces(t(spark, sf, "documents").withColumnRenamed("lang", "space_slug"))


@query("counts_by_root", "SELECT o_orderpriority AS root_label, count(*) AS files, sum(o_custkey)::BIGINT AS bytes, (SELECT count(*) FROM lineitem JOIN orders p ON p.o_orderkey = l_orderkey WHERE p.o_orderpriority = orders.o_orderpriority) AS chunks FROM orders GROUP BY 1")
def counts_by_root(spark, sf):
    orders = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("root_label"), F.col("o_custkey").alias("size"))
    chunks = t(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lookups.counts_by_root(orders, chunks)


@query("ledger_totals", "SELECT (SELECT count(*) FROM orders) AS files, (SELECT count(*) FROM lineitem) AS chunks, (SELECT coalesce(sum(floor(value)), 0)::BIGINT FROM events) AS tokens_embedded")
def ledger_totals(spark, sf):
    return lookups.totals(t(spark, sf, "orders"), t(spark, sf, "lineitem"), t(spark, sf, "events").select(F.floor("value").alias("tokens")))


@query("files_by_unit", f"WITH {FILES} SELECT root_label, unit, count(*) AS files FROM files GROUP BY 1, 2")
def files_by_unit(spark, sf):
    return lookups.files_by_unit(files(spark, sf))


@query("recent_runs", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_runs(spark, sf):
    return lookups.recent(t(spark, sf, "events"), "ts", "event_id").select("event_id", "ts", "event_type")


@query("unique_or_ambiguous", f"WITH {FILES} SELECT doc_id, 'one' AS state FROM files WHERE rel_path LIKE '%/doc_7.md' UNION ALL SELECT doc_id, 'candidate' FROM (SELECT doc_id, rel_path FROM files WHERE rel_path LIKE '%/en/x.md' OR false)")
def unique_or_ambiguous(spark, sf):
    own = files(spark, sf)
    one, several = lookups.pick(ledger.find_paths(own, "doc_7.md"), "doc_7.md")
    return one.select("doc_id", F.lit("one").alias("state")).unionByName(several.select("doc_id", F.lit("candidate").alias("state")))


# --- ledger


@query("exact_else_suffix", f"WITH {FILES} SELECT doc_id FROM files WHERE ends_with(rel_path, '/doc_7.md')")
def exact_else_suffix(spark, sf):
    return ledger.exact_else_suffix(files(spark, sf), "doc_7.md").select("doc_id")


@query("upsert_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id >= (SELECT max(event_id) / 2 FROM events)) WHERE k = 1 UNION ALL SELECT c_custkey, 0, 'old' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_id >= (SELECT max(event_id) / 2 FROM events))")
def upsert_latest(spark, sf):
    events = t(spark, sf, "events").select("user_id", "event_id", "event_type")
    half = events.agg((F.max("event_id") / 2).alias("half"))
    new = events.crossJoin(F.broadcast(half)).where("event_id >= half").drop("half")  # one row
    old = t(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(0).cast("long").alias("event_id"), F.lit("old").alias("event_type"))
    return ledger.upsert(old, new, ["user_id"], order="event_id")


@query("replaced_edges", "SELECT l_orderkey AS owner, l_linenumber AS line FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT o_orderkey, 99 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0")
def replaced_edges(spark, sf):
    old = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("line"))
    owners = t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("owner"))
    return ledger.replace_owned(old, owners.where("owner % 2 = 0").withColumn("line", F.lit(99)), owners, ["owner"])


@query("cascading_delete", "SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascading_delete(spark, sf):
    orders = t(spark, sf, "orders").withColumnRenamed("o_orderkey", "id")
    kept = ledger.cascade({"orders": orders.select("id"), "lines": t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))}, orders.where("o_orderstatus = 'F'"), ["id"])
    count = lambda name: kept[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return count("orders").unionByName(count("lines"))


@query("touched_files", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS mtime FROM orders")
def touched_files(spark, sf):
    own = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("mtime"))
    return ledger.upsert(own, own.where("id % 3 = 0").withColumn("mtime", F.lit(1).cast("long")), ["id"])


@query("copied_and_forgotten", "SELECT slug AS space_slug, n, forgotten FROM (SELECT lang AS slug, count(*) AS n FROM documents WHERE lang <> 'de' GROUP BY 1 UNION ALL SELECT 'copy', count(*) FROM documents WHERE lang = 'en'), (SELECT count(*) AS forgotten FROM documents WHERE lang = 'de')")
def copied_and_forgotten(spark, sf):
    own = t(spark, sf, "documents").select("doc_id", F.col("lang").alias("space_slug"))
    kept, counted = ledger.forget_space(own.unionByName(ledger.copy_space(own, "en", "copy")), "de")
    return kept.groupBy("space_slug").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(counted))  # one row


@query("cached_types", "SELECT doc_id, CASE WHEN bool_or(doc_id % 3 = 0) OVER (PARTITION BY sha256(text)) THEN 'cached' ELSE 'computed' END AS doc_type FROM documents")
def cached_types(spark, sf):
    own = t(spark, sf, "documents").select("doc_id", text.sha256_text("text").alias("sha256"))
    cache = own.where("doc_id % 3 = 0").select("sha256", F.lit("cached").alias("doc_type"), F.lit(2).alias("classifier_version")).unionByName(own.select("sha256", F.lit("old").alias("doc_type"), F.lit(1).alias("classifier_version")))
    return ledger.with_cached(own, cache, 2, F.lit("computed")).select("doc_id", "doc_type")


@query("run_ledger", "SELECT user_id AS run_id, min(ts) FILTER (event_type = 'click') AS started_at, max(ts) FILTER (event_type = 'purchase') AS finished_at FROM events GROUP BY 1")
def run_ledger(spark, sf):
    own = t(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), F.expr("case event_type when 'click' then 'start' when 'purchase' then 'finish' end").alias("event"))
    return ledger.unfinished_runs(own)


@query("run_stats", "SELECT CASE o_orderstatus WHEN 'F' THEN 'SKIP_UNCHANGED' WHEN 'O' THEN 'NEW' ELSE 'REINDEX' END AS decision, count(*) AS files FROM orders GROUP BY 1")
def run_stats(spark, sf):
    return indexing.run_stats(t(spark, sf, "orders").select(F.expr("case o_orderstatus when 'F' then 'SKIP_UNCHANGED' when 'O' then 'NEW' else 'REINDEX' end").alias("decision")))


# --- grounding


_TEXT = "coalesce(text, '')"
_FIRST = f"left({_TEXT}, 40)"


@query("rationale_signals", f"""SELECT role, count(*) AS commits, count(*) FILTER (NOT regexp_matches({_FIRST}, '{grounding.AUTOGENERATED}') AND regexp_matches({_FIRST} || chr(10) || {_TEXT}, '{grounding.RATIONALE}')) AS with_rationale,
count(*) FILTER (len(list_filter(regexp_extract_all({_FIRST} || chr(10) || {_TEXT}, '{grounding.TICKET}'), lambda x: NOT list_contains({grounding.NO_PROJECT}, split_part(x, '-', 1)))) > 0) AS with_ticket, count(*) FILTER (regexp_matches({_FIRST}, '{grounding.AUTOGENERATED}')) AS autogenerated FROM conversations GROUP BY 1""")
def rationale_signals(spark, sf):
    own = t(spark, sf, "conversations").select("role", F.left(F.coalesce("text", F.lit("")), F.lit(40)).alias("subject"), F.coalesce("text", F.lit("")).alias("body"))
    return grounding.signals(own, "role", "subject", "body")


@query("markers", "SELECT o_orderpriority AS root_label, count(*) AS markers FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 AND o_custkey % 2 = 0 GROUP BY 1")
def markers(spark, sf):
    line = F.when(F.col("o_orderkey") % 3 == 0, "// WHY: it is so").when((F.col("o_orderkey") % 3 == 1) & (F.col("o_custkey") % 2 == 0), cat("# see ADR-", s_("o_custkey"), ": tables")).otherwise("# WHYNOT: no")
    return grounding.markers(t(spark, sf, "orders").select(F.col("o_orderpriority").alias("root_label"), line.alias("line")), "root_label", "line")


@query(
    "grounding_reports",
    f"""WITH s AS (SELECT source AS repo, count(*) AS commits, count(*) FILTER (regexp_matches({_TEXT}, '{grounding.RATIONALE}') AND NOT regexp_matches({_FIRST}, '{grounding.AUTOGENERATED}')) AS r FROM documents GROUP BY 1),
f AS (SELECT source AS repo, count(*) FILTER (lang = 'de' AND doc_id % 50 = 0) AS documents, count(*) FILTER (lang = 'en') AS code_files FROM documents GROUP BY 1),
g AS (SELECT repo, documents, code_files, CASE WHEN r <= 0 THEN 0 WHEN commits >= 20 AND r / commits >= 0.15 THEN 2 ELSE 1 END AS h, CASE WHEN documents <= 0 THEN 0 WHEN code_files = 0 OR documents / code_files * 100 >= 1 THEN 2 ELSE 1 END AS d FROM s JOIN f USING (repo))
SELECT repo, documents, code_files, ['ABSENT', 'THIN', 'PRESENT'][h + 1] AS history, ['ABSENT', 'THIN', 'PRESENT'][d + 1] AS documents_strength, ['ABSENT', 'THIN', 'PRESENT'][greatest(h, d) + 1] AS verdict FROM g""",
)
def grounding_reports(spark, sf):
    docs = t(spark, sf, "documents")
    commits = docs.select(F.col("source").alias("repo"), F.left(F.coalesce("text", F.lit("")), F.lit(40)).alias("subject"), F.coalesce("text", F.lit("")).alias("body"))
    own = docs.select(F.col("source").alias("repo"), F.expr("case when lang = 'de' and doc_id % 50 = 0 then 'design' when lang = 'en' then 'implementation' end").alias("doc_type"))
    return service.grounding_report(commits, own, repo="repo").select("repo", "documents", "code_files", "history", "documents_strength", "verdict")


# --- service


_TYPES = "CASE doc_id % 5 WHEN 0 THEN 'implementation' WHEN 1 THEN 'test' WHEN 2 THEN 'design' WHEN 3 THEN 'generated' END"


def _chunks(spark, sf):
    own = files(spark, sf)
    return own.select(F.col("doc_id").alias("chunk_id"), "root_label", "rel_path", F.expr(_TYPES).alias("doc_type"), F.col("text").alias("source_text"), F.lit(None).cast("int").alias("token_count"), text.ancestors_of("rel_path").alias("ancestors"), F.lit(1).alias("start_line"))


def _service(spark, sf):
    return service.Index(_chunks(spark, sf), folder=shared_folder(spark))


@query("search_code", f"WITH {BM25} {_ranked('bm25', 8, f'WHERE row IN (SELECT doc_id FROM documents WHERE doc_id % 5 NOT IN (1, 3))').replace('row, score', 'row AS chunk_id, score', 1)}")
def search_code(spark, sf):
    return _service(spark, sf).search_code(passages(spark, sf), mode="sparse").select("query_id", "chunk_id", "score", "rank")


@query("find_guidance", f"WITH {BM25} {_ranked('bm25', 8, 'WHERE row % 5 = 2').replace('row, score', 'row AS chunk_id, score', 1)}")
def find_guidance(spark, sf):
    return _service(spark, sf).find_guidance(passages(spark, sf), "RFC", mode="sparse").select("query_id", "chunk_id", "score", "rank")


@query("file_context", f"WITH {FILES} SELECT doc_id AS chunk_id, 1 AS start_line FROM files WHERE ends_with(rel_path, '/doc_7.md')")
def file_context(spark, sf):
    return _service(spark, sf).file_context("doc_7.md").select("chunk_id", "start_line")


@query("document_types", f"WITH {FILES}, c AS (SELECT rel_path, {_TYPES} AS value FROM files), n AS (SELECT value, count(*) AS n FROM c GROUP BY 1) SELECT v.value, coalesce(n, 0) AS n FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in classify.DOC_TYPES)}) v(value) LEFT JOIN n USING (value)")
def document_types(spark, sf):
    return _service(spark, sf).document_types().select("value", "n")


@query("impact_by_type", f"WITH {EDGES}, w AS (SELECT DISTINCT importer, o_orderstatus AS doc_type FROM edges JOIN orders ON o_orderkey = importer WHERE resolved = 7) SELECT doc_type, count(*) AS n FROM w GROUP BY 1")
def impact_by_type(spark, sf):
    imports, orders = _graph(spark, sf)
    target = parts(spark, sf).select(F.lit("r").alias("root_label"), cat("p/", s_("k")).alias("rel_path"), F.col("p_brand").alias("language"), F.lit("implementation").alias("doc_type"))
    return service.impact_of(imports, orders.unionByName(target.select(*orders.columns)), None, "p/7")[1]


@query("response_envelopes", f"WITH {BM25}, h AS ({_ranked('bm25', 8)}), c AS (SELECT query_id, rank, greatest(1, length(text) // 4) AS cost FROM h JOIN documents ON doc_id = row), s AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM c) SELECT query_id, count(*) AS total, count(*) FILTER (rank = 1 OR 600 - spent >= 64) AS returned, count(*) - count(*) FILTER (rank = 1 OR 600 - spent >= 64) AS dropped_for_budget FROM s GROUP BY 1")
def response_envelopes(spark, sf):
    index = _service(spark, sf)
    hits = index.search(passages(spark, sf), k=8, mode="sparse").withColumn("token_count", text.hit_tokens(F.col("token_count"), "source_text"))
    return index.pack(hits, 600)[1]


# --- stores, streams


@query("mirror_copy", "SELECT vec_id, label, len(embedding) AS width, (SELECT count(*) FROM embeddings WHERE label % 3 = 0) AS skipped FROM embeddings WHERE label % 3 <> 0")
def mirror_copy(spark, sf):
    own = t(spark, sf, "embeddings").withColumn("embedding", F.expr("if(label % 3 = 0, null, embedding)"))
    moved, counted = stores.mirrored(own, vector="embedding")
    return moved.select("vec_id", "label", F.size("embedding").cast("long").alias("width")).crossJoin(F.broadcast(counted.select("skipped")))  # one row


@query("reprojected_points", "WITH h AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS h FROM embeddings) SELECT vec_id, 'm_16_from_64' AS space_slug, list_transform(h, lambda x: round((x / sqrt(list_inner_product(h, h)))::FLOAT, 4)::DOUBLE) AS dense FROM h")
def reprojected_points(spark, sf):
    own = t(spark, sf, "embeddings").withColumnRenamed("embedding", "dense")
    return stores.reprojected(own, 16, model="m", held=64).select("vec_id", "space_slug", F.transform("dense", lambda x: vectors.rounded(x, 4).cast("double")).alias("dense"))


@query("payloads", f"WITH {FILES} SELECT doc_id, 'doc_' || doc_id || '.md' AS file_name, '.md' AS ext, [unit, unit || '/' || root_label] AS ancestors, sha256(text) AS content_sha, CASE WHEN text IS NOT NULL THEN '# h' END AS context_header, 's' AS space_slug FROM files")
def payloads(spark, sf):
    own = files(spark, sf).select(F.col("doc_id").alias("chunk_id"), "root_label", "rel_path", F.col("text").alias("source_text"), F.concat(F.lit("# h\n"), "text").alias("embed_text"))
    return stores.payload(own, space="s").select(F.col("chunk_id").alias("doc_id"), "file_name", "ext", "ancestors", "content_sha", "context_header", "space_slug")


@query("store_round_trip", "SELECT p_partkey AS chunk_id, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE p_brand END AS language FROM part WHERE p_partkey % 7 <> 0 AND p_size <> 3 AND (p_partkey % 5 = 0 OR p_brand <> 'Brand#11')")
def store_round_trip(spark, sf):
    """Ensured, filled, overwritten in part, deleted from by ids and by path, and scrolled with a filter."""
    store = stores.VectorStore(spark, scratch(spark))
    own = parts(spark, sf).select(F.col("k").alias("chunk_id"), F.lit("r").alias("root_label"), cat("d/", s_("p_size")).alias("rel_path"), F.col("p_brand").alias("language"))
    store.ensure("c", own, width=0)
    store.upsert("c", own)
    store.upsert("c", own.where("chunk_id % 5 = 0").withColumn("language", F.lit("new")))
    store.delete_ids("c", own.where("chunk_id % 7 = 0"))
    store.delete_path("c", "r", "d/3")
    return store.scroll("c", retrieval.Filters(equals={"root_label": "r"})).where("language <> 'Brand#11'").select("chunk_id", "language")


@query("embedded_texts", "SELECT p_partkey AS k, 16 AS width, true AS unit FROM part")
def embedded_texts(spark, sf):
    found = embedding.embed(parts(spark, sf).select("k", "p_name"), embedding.hashing_backend(16), text="p_name", width=16)
    return found.select("k", F.size("dense").alias("width"), F.expr("abs(aggregate(dense, 0D, (s, x) -> s + x * x) - 1) < 1e-5 or forall(dense, x -> x = 0)").alias("unit"))


@query("kept_changes", f"WITH {FILES} SELECT doc_id FROM files WHERE NOT rel_path LIKE 'src1/%' AND NOT rel_path LIKE '%/doc_1%'")
def kept_changes(spark, sf):
    unwatched = spark.createDataFrame([("src1",), ("nowhere/at/all",)], "dir string")
    return changes.kept_changes(files(spark, sf).withColumnRenamed("rel_path", "path"), ["*/doc_1*"], unwatched=unwatched).select("doc_id")


@query("watched_folders", f"WITH {FILES} SELECT DISTINCT root_label, dir FROM (SELECT root_label, unnest([unit, unit || '/' || root_label]) AS dir FROM files)")
def watched_folders(spark, sf):
    return indexing.watched_folders(files(spark, sf))


@query("streamed_latest", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def streamed_latest(spark, sf):
    """Events as a stream into a table of the latest of each user, to the end of what is there."""
    folder = scratch(spark)
    static = t(spark, sf, "events")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    changes.upsert_stream(stream.select("user_id", "event_id"), f"{folder}/latest", ["user_id"], f"{folder}/checkpoint", order="event_id").awaitTermination()
    return Table(spark, f"{folder}/latest").read()


__all__ = ["PASSAGES", "_edges"]
