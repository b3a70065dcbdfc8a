"""Scalar functions over paths, texts and URLs, as Column builders: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: UTF-8 bytes per token by kind of text.
BYTES_PER_TOKEN = {"code": 3.3, "markdown": 4.0, "text": 4.0, "pdf": 4.0}
BYTES_PER_TOKEN_ELSE = 3.7
#: Fixed value: the name space of chunk ids.
CHUNK_NAMESPACE = "b4f1c0de000040008000646972696e64"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unit_of(path) -> Column:
    """First segment of a path, empty for a file at the root."""
    p = _c(path)
    return F.when(F.instr(p, "/") > 0, F.split_part(p, F.lit("/"), F.lit(1))).otherwise("")


def ancestors_of(path) -> Column:
    """Every directory above a file, outermost first."""
    a = F.split(_c(path), "/")
    return F.when(F.size(a) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.array_join(F.slice(a, F.lit(1), i), "/")))


def file_name(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def extension(path) -> Column:
    """Lower-cased suffix with its dot; empty for dotfiles and names without one."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def sha256_text(text) -> Column:
    return F.sha2(_c(text).cast("binary"), 256)


def uuid5(key, namespace: str = CHUNK_NAMESPACE) -> Column:
    """Name-based UUID, version 5, of a UTF-8 key."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(_c(key), "UTF-8")))
    at = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex((F.conv(at(17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), variant, at(18, 3), F.lit("-"), at(21, 12))


def chunk_id(root, path, symbol, index, sha) -> Column:
    """Content-addressed id: changes exactly when the place or the content of a chunk does."""
    return uuid5(F.concat_ws("\0", _c(root), _c(path), F.coalesce(_c(symbol), F.lit("")), _c(index).cast("string"), _c(sha)))


def estimate_tokens(text, kind: Column | str = "text") -> Column:
    """0 for an empty text, else bytes over the kind's rate, rounded half to even, at least 1. kind: a name or a Column."""
    n = F.octet_length(_c(text))
    if isinstance(kind, str):
        rate = F.lit(BYTES_PER_TOKEN.get(kind, BYTES_PER_TOKEN_ELSE))
    else:
        rate = F.lit(BYTES_PER_TOKEN_ELSE)
        for k, v in BYTES_PER_TOKEN.items():
            rate = F.when(kind == k, v).otherwise(rate)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(n / rate).cast("int")))


def tokens_to_bytes(tokens, kind: str = "text") -> Column:
    return F.greatest(F.lit(1), (_c(tokens) * BYTES_PER_TOKEN.get(kind, BYTES_PER_TOKEN_ELSE)).cast("int"))


def context_header(repo, branch, path, language=None, doc_type=None, kind=None, symbol=None) -> Column:
    """Lines that say where a chunk comes from; absent facts leave no line."""
    line = lambda name, x: F.when(x.isNotNull(), F.concat(F.lit(f"# {name}: "), x)) if x is not None else F.lit(None).cast("string")
    repo, branch = _c(repo), _c(branch)
    where = F.when(repo.isNotNull(), F.concat(F.lit("# repo: "), repo, F.coalesce(F.concat(F.lit(" ("), branch, F.lit(")")), F.lit(""))))
    symbols = F.when(_c(symbol).isNotNull(), F.concat_ws(" ", F.concat(F.lit("# "), F.coalesce(_c(kind), F.lit("symbol")), F.lit(":")), _c(symbol))) if symbol is not None else F.lit(None).cast("string")
    return F.concat_ws("\n", where, line("file", _c(path)), line("language", _c(language) if language is not None else None), line("type", _c(doc_type) if doc_type is not None else None), symbols)


def header_token_cost(repo, branch, path, language=None, doc_type=None, kind: str = "code") -> Column:
    """Tokens to keep free for a header, by the longest symbol that is to be expected."""
    # Fixed value: the symbol that stands for a long one.
    probe = context_header(repo, branch, path, language, doc_type, F.lit("function"), F.lit("Some.Reasonably.Long.Symbol.Path"))
    return estimate_tokens(probe, kind)


def header_of(embedded, source) -> Column:
    """What was put before a source text: the embedded text without it and without the newlines between."""
    e, s = _c(embedded), _c(source)
    return F.regexp_replace(F.left(e, F.length(e) - F.length(s)), r"\n+$", "")


def space_slug(model, dimensions, full=None) -> Column:
    """Name of an embedding space; `full` names the width it was cut from."""
    base = F.concat(F.translate(_c(model), ":/.", "__-"), F.lit("_"), _c(dimensions).cast("string"))
    return base if full is None else F.concat(base, F.coalesce(F.concat(F.lit("_from_"), _c(full).cast("string")), F.lit("")))


def location(path, start, end=None) -> Column:
    tail = _c(start).cast("string") if end is None else F.concat(_c(start).cast("string"), F.lit("-"), _c(end).cast("string"))
    return F.concat(_c(path), F.lit(":"), tail)


def url_segments(url) -> Column:
    """Path segments of a URL, lower-cased, without scheme, host, query and fragment."""
    path = F.regexp_replace(F.regexp_replace(_c(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.filter(F.split(F.lower(path), "/"), lambda x: x != "")


def join_route(prefix, action) -> Column:
    """Two route parts joined by one slash; empty parts leave none."""
    part = lambda x: F.nullif(F.trim(_c(x), F.lit("/")), F.lit(""))
    return F.concat_ws("/", part(prefix), part(action))


def expand_controller(template, class_name) -> Column:
    """[controller] stands for the class name without its suffix."""
    return F.replace(_c(template), F.lit("[controller]"), F.regexp_replace(_c(class_name), "Controller$", ""))


def page_route(path) -> Column:
    """Route of a page file: what follows the first Pages segment, without extension and a final index."""
    parts = F.split(F.regexp_replace(_c(path), r"\.[^./]+$", ""), "/")
    after = F.slice(parts, F.array_position(parts, "Pages").cast("int") + 1, F.size(parts))
    kept = F.when(F.lower(F.element_at(after, -1)) == "index", F.slice(after, F.lit(1), F.size(after) - 1)).otherwise(after)
    return F.when(F.array_position(parts, "Pages") > 0, F.array_join(kept, "/"))


def path_matches(path, expected) -> Column:
    """Case-blind substring."""
    return F.contains(F.lower(_c(path)), F.lower(_c(expected)))


def suffix_match(path, needle, fold: bool = True) -> Column:
    """Equal, or ending in /needle (ASCII case aside if fold)."""
    p, n = _c(path), _c(needle)
    tail = F.concat(F.lit("/"), n)
    return (p == n) | (F.endswith(F.lower(p), F.lower(tail)) if fold else F.endswith(p, tail))


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression for rlike: * and ? cross slashes, [..] is a class, case counts."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (j := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : j]
            out += f"[{'^' + inner[1:] if inner[0] == '!' else inner}]"
            i = j
        else:
            out += "\\" + c if c in r"\.^$+{}()|[]" else c
        i += 1
    return f"(?s)^{out}$"


def glob_match(path, pattern: str) -> Column:
    """As is, or with its first **/ read as /."""
    p = _c(path)
    both = {glob_regex(pattern), glob_regex(pattern.replace("**/", "/", 1))}
    out = F.lit(False)
    for regex in sorted(both):
        out = out | p.rlike(regex)
    return out


def hit_tokens(token_count, text) -> Column:
    """Recorded tokens, or a fourth of the characters."""
    return F.coalesce(F.nullif(_c(token_count), F.lit(0)), F.greatest(F.lit(1), F.floor(F.length(_c(text)) / 4).cast("int")))


def clip(text, tokens) -> Column:
    """Cut at four characters a token, back to the last whole line."""
    return F.regexp_replace(F.left(_c(text), (_c(tokens) * 4).cast("int")), r"\n[^\n]*\z", "")


def shannon_entropy(text) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(_c(text), ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def price(tokens, rate) -> Column:
    """Cost of tokens at a rate per million; null without a rate."""
    return _c(tokens) / 1e6 * _c(rate)


def describe_filters(**filters) -> Column:
    """The filters that are set, as a map."""
    entries = F.create_map(*[y for k, v in sorted(filters.items()) for y in (F.lit(k), _c(v).cast("string"))])
    return F.map_filter(entries, lambda _, v: v.isNotNull() & (v != ""))
