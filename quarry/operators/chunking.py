"""Cutting files into chunks: markdown by sections, text by paragraphs, code by definitions, pages as they come.

Greedy packing depends on what came before it in the file, so it runs in Arrow batches, file by file; a file is a row, and
nothing is shuffled. A block is a range of lines: a chunk's text is those lines of the file, and its line numbers are true.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from ..functions.text import BYTES_PER_TOKEN, BYTES_PER_TOKEN_ELSE

TEXT_TOKENS, OVERLAP, MARKDOWN_TOKENS, MARKDOWN_DEPTH, CODE_TOKENS, LEAST_CODE_TOKENS, LEAST_PAGE = 512, 1, 512, 3, 512, 24, 24
STRUCTURED = {"yaml", "toml", "ini", "cfg", "properties"}
#: What splits lines: more than \n.
_BREAK = re.compile("\r\n|[\n\r\v\f\x1c\x1d\x1e\x85  ]")
_FENCE = re.compile(r"^ {0,3}(?P<mark>`{3,}|~{3,})(?P<rest>[^\n]*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_DEFINITION = {
    "python": re.compile(r"^(?:async[ \t]+)?(?:def|class)[ \t]+(\w+)"),
    "javascript": re.compile(r"^(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?(?:function\*?|class)[ \t]+(\w+)|^(?:export[ \t]+)?(?:const|let)[ \t]+(\w+)[ \t]*=[ \t]*(?:async[ \t]*)?(?:\(|\w+[ \t]*=>)"),
    "csharp": re.compile(r"^[ \t]*(?:(?:public|private|protected|internal|static|sealed|abstract|partial)[ \t]+)*(?:class|interface|struct|record|enum)[ \t]+(\w+)"),
    "go": re.compile(r"^func[ \t]+(?:\([^)]*\)[ \t]*)?(\w+)|^type[ \t]+(\w+)"),
    "powershell": re.compile(r"^function[ \t]+([\w-]+)", re.I),
    "bicep": re.compile(r"^(?:resource|module|param|var|output)[ \t]+(\w+)"),
}
_DEFINITION |= {"typescript": _DEFINITION["javascript"], "tsx": _DEFINITION["javascript"]}


@dataclass(frozen=True)
class Block:
    """Lines first to last of a file, counted from 1. Atomic: not to be cut."""

    first: int
    last: int
    atomic: bool = False


def lines_of(text: str) -> list[str]:
    out = _BREAK.split(text)
    return out[:-1] if out and out[-1] == "" else out


def tokens(n_bytes: int, kind: str) -> int:
    return max(1, round(n_bytes / BYTES_PER_TOKEN.get(kind, BYTES_PER_TOKEN_ELSE))) if n_bytes else 0


class _File:
    """A file's lines with running byte counts, so that the size of any range is one subtraction."""

    def __init__(self, text: str, kind: str):
        self.lines, self.kind = lines_of(text), kind
        self.upto = [0]
        for line in self.lines:
            self.upto.append(self.upto[-1] + (len(line.encode("utf-8", "replace")) if line.strip() else 0) + 1)

    def size(self, b: Block) -> int:
        return self.upto[b.last] - self.upto[b.first - 1] - 1

    def tokens(self, b: Block) -> int:
        return tokens(self.size(b), self.kind)

    def text(self, b: Block) -> str:
        return "\n".join(x if x.strip() else "" for x in self.lines[b.first - 1 : b.last])

    def fences(self, first: int, last: int) -> Iterator[Block]:
        """Fenced code in a range of lines; one that isn't closed reaches to the end."""
        mark, start = "", 0
        for n in range(first, last + 1):
            m = _FENCE.match(self.lines[n - 1])
            if not m:
                continue
            if not mark:
                mark, start = m["mark"], n
            elif m["mark"].startswith(mark) and not m["rest"].strip():
                yield Block(start, n, True)
                mark = ""
        if mark:
            yield Block(start, last, True)

    def blocks(self, first: int, last: int, *, fences: bool = False, structured: bool = False) -> list[Block]:
        """Paragraphs: runs of lines that aren't blank; structured ones begin at each line that isn't indented, too."""
        inside = {n: f for f in (self.fences(first, last) if fences else ()) for n in range(f.first, f.last + 1)}
        out: list[Block] = []
        start = None
        for n in range(first, last + 2):
            line = self.lines[n - 1] if n <= last else ""
            fence = inside.get(n)
            ends = fence is not None or not line.strip() or (structured and start is not None and not line[:1].isspace())
            if ends and start is not None:
                out.append(Block(start, n - 1))
                start = None
            if fence is not None:
                if n == fence.first:
                    out.append(fence)
            elif line.strip() and start is None:
                start = n
        return out

    def divide(self, b: Block, budget: int) -> list[Block]:
        """A block that is too large, cut between lines; blank parts go."""
        most = max(1, int(budget * BYTES_PER_TOKEN.get(self.kind, BYTES_PER_TOKEN_ELSE)))
        out, start = [], b.first
        for n in range(b.first, b.last + 1):
            if n > start and self.upto[n] - self.upto[start - 1] > most:
                out.append(Block(start, n - 1))
                start = n
        out.append(Block(start, b.last))
        return [x for x in out if any(line.strip() for line in self.lines[x.first - 1 : x.last])] or [b]

    def pack(self, blocks: list[Block], budget: int, overlap: int = 0) -> list[Block]:
        """Neighbouring blocks together as long as they fit; each new group begins with the last `overlap` blocks of the one
        before that may be repeated. What is still too large and may be cut is divided."""
        groups: list[list[Block]] = []
        group: list[Block] = []
        cost = 0
        for b in blocks:
            n = self.tokens(b)
            if group and cost + n > budget:
                groups.append(group)
                group = [x for x in group[len(group) - overlap :] if not x.atomic] if overlap else []
                cost = sum(map(self.tokens, group))
                if group and cost + n > budget:
                    group, cost = [], 0
            group.append(b)
            cost += n
        if group:
            groups.append(group)
        out: list[Block] = []
        for g in groups:
            whole = Block(g[0].first, g[-1].last, all(x.atomic for x in g))
            out += self.divide(whole, budget) if self.tokens(whole) > budget and not any(x.atomic for x in g) else [whole]
        return out


def _row(f: _File, b: Block, index: int, total: int, budget: int, path: str | None = None, kind: str | None = None, name: str | None = None, degraded: bool = False) -> dict:
    n = f.tokens(b)
    return {"chunk_index": index, "chunk_total": total, "start_line": b.first, "end_line": b.last, "source_text": f.text(b), "symbol_path": path, "symbol_kind": kind, "symbol_name": name, "token_count": n, "indivisible": n > budget, "parse_degraded": degraded}


def text_chunks(text: str, *, budget: int = TEXT_TOKENS, overlap: int = OVERLAP, language: str | None = None, kind: str = "text", degraded: bool = False) -> list[dict]:
    f = _File(text, kind)
    groups = f.pack(f.blocks(1, len(f.lines), structured=language in STRUCTURED), budget, overlap)
    return [_row(f, b, i, len(groups), budget, degraded=degraded) for i, b in enumerate(groups)]


def line_chunks(text: str, *, budget: int = TEXT_TOKENS, kind: str = "text") -> list[dict]:
    """A text cut between lines wherever the budget's bytes are full; blank parts go."""
    f = _File(text, kind)
    parts = f.divide(Block(1, len(f.lines)), budget) if f.lines else []
    return [_row(f, b, i, len(parts), budget) for i, b in enumerate(parts)]


def packed_paragraphs(text: str, *, budget: int = TEXT_TOKENS, overlap: int = 0, kind: str = "text") -> list[dict]:
    """Paragraphs that stay whole, packed into the budget."""
    f = _File(text, kind)
    groups = f.pack([Block(b.first, b.last, True) for b in f.blocks(1, len(f.lines))], budget, overlap)
    return [_row(f, b, i, len(groups), budget) for i, b in enumerate(groups)]


def sections(f: _File, depth: int = MARKDOWN_DEPTH) -> list[tuple[list[str], Block]]:
    """Heading trail and lines of each section that has text; headings in fences are text."""
    fenced = {n for b in f.fences(1, len(f.lines)) for n in range(b.first, b.last + 1)}
    marks = [(n, len(m[1]), m[2]) for n, line in enumerate(f.lines, 1) if n not in fenced and (m := _HEADING.match(line)) and len(m[1]) <= depth]
    trail: list[tuple[int, str]] = []
    out = []
    for (n, d, title), end in zip([(1, 0, "")] + marks, [m[0] - 1 for m in marks] + [len(f.lines)], strict=True):
        if d:
            trail = [x for x in trail if x[0] < d] + [(d, title)]
        first, last = n, end
        while first <= last and not f.lines[first - 1].strip():
            first += 1
        while last >= first and not f.lines[last - 1].strip():
            last -= 1
        if first <= last and not (not d and marks and marks[0][0] == 1):
            out.append(([t for _, t in trail], Block(first, last)))
    return out


def markdown_chunks(text: str, *, budget: int = MARKDOWN_TOKENS, depth: int = MARKDOWN_DEPTH) -> list[dict]:
    """A chunk per section (index 0 of 1), or several where a section is too large."""
    f = _File(text, "markdown")
    out = []
    for trail, b in sections(f, depth):
        parts = [b] if f.tokens(b) <= budget else f.pack(f.blocks(b.first, b.last, fences=True), budget)
        for i, p in enumerate(parts):
            out.append(_row(f, p, i, len(parts), budget, " > ".join(trail) or None, "heading" if trail else None, trail[-1] if trail else None))
    return out


def code_chunks(text: str, language: str | None, *, budget: int = CODE_TOKENS, least: int = LEAST_CODE_TOKENS) -> list[dict]:
    """A chunk per top-level definition, with the lines before it back to the last one; small fragments go. Falls back to
    paragraphs for unknown languages and files without a definition. Lines decide, not a parser: a definition inside a
    string that begins a line counts as one."""
    rule = _DEFINITION.get(language or "")
    f = _File(text, "code")
    starts = [(n, next(x for x in m.groups() if x)) for n, line in enumerate(f.lines, 1) if rule and (m := rule.match(line))]
    if not starts:
        return text_chunks(text, budget=budget, kind="code", degraded=True)
    edges = [(1, None)] if starts[0][0] > 1 else []
    units = []
    for (n, name), end in zip(edges + starts, [s[0] - 1 for s in (edges + starts)[1:]] + [len(f.lines)], strict=True):
        units += [(x, name) for x in (f.divide(Block(n, end), budget) if f.tokens(Block(n, end)) > budget else [Block(n, end)])]
    kept = [(b, s) for b, s in units if f.text(b).strip() and f.tokens(b) >= least]
    return [_row(f, b, i, len(kept), budget, s, "definition" if s else None, s) for i, (b, s) in enumerate(kept)] or text_chunks(text, budget=budget, kind="code", degraded=True)


def page_chunks(pages: list[str], *, budget: int = TEXT_TOKENS) -> list[dict]:
    """A chunk per page; a long page is packed into several, named page n (i/m). Lines count through the whole document."""
    out, offset = [], 0
    for n, page in enumerate(pages, 1):
        f = _File(page or "", "pdf")
        if len((page or "").strip()) >= LEAST_PAGE:
            whole = Block(1, len(f.lines))
            parts = [whole] if f.tokens(whole) <= budget else f.pack(f.blocks(1, len(f.lines)), budget)
            for i, p in enumerate(parts, 1):
                name = f"page {n}" if len(parts) == 1 else f"page {n} ({i}/{len(parts)})"
                out.append(_row(f, p, 0, 0, budget, name, "page", name) | {"start_line": p.first + offset, "end_line": p.last + offset})
        offset += len(f.lines)
    return [r | {"chunk_index": i, "chunk_total": len(out)} for i, r in enumerate(out)]


CHUNK_FIELDS = [
    StructField("chunk_index", IntegerType()), StructField("chunk_total", IntegerType()), StructField("start_line", IntegerType()), StructField("end_line", IntegerType()), StructField("source_text", StringType()),
    StructField("symbol_path", StringType()), StructField("symbol_kind", StringType()), StructField("symbol_name", StringType()), StructField("token_count", IntegerType()), StructField("indivisible", BooleanType()), StructField("parse_degraded", BooleanType()),
]


def default_chunker(kind: str, language: str | None, text: str) -> list[dict]:
    """By kind of file; opaque files and images have no chunks."""
    if kind == "markdown":
        return markdown_chunks(text)
    if kind == "code":
        return code_chunks(text, language)
    return text_chunks(text, language=language) if kind in ("text", "pdf") else []


_ENDS = {"python": re.compile(r"^\S"), "javascript": re.compile(r"^\}"), "csharp": re.compile(r"^\}"), "powershell": re.compile(r"^\}"), "go": re.compile(r"^\}"), "bicep": re.compile(r"^\}")}
_ENDS |= {"typescript": _ENDS["javascript"], "tsx": _ENDS["javascript"]}


def declarations_of(text: str, language: str | None) -> list[tuple[str, int, int]]:
    """Name and lines of each top-level definition: to the line that closes it, or before the next one that isn't indented."""
    rule, end = _DEFINITION.get(language or ""), _ENDS.get(language or "")
    lines = lines_of(text)
    out = []
    for n, line in enumerate(lines, 1):
        m = rule.match(line) if rule else None
        if not m:
            continue
        last = n
        for k in range(n + 1, len(lines) + 1):
            here = lines[k - 1]
            if language == "python":
                if end.match(here):
                    break
                last = k if here.strip() else last
            elif "{" not in line or line.count("{") == line.count("}"):
                break
            elif end.match(here):
                last = k
                break
        out.append((next(x for x in m.groups() if x), n, last))
    return out


def declarations(files: DataFrame, *, keys: list[str], language: str = "language", text: str = "text") -> DataFrame:
    """name, start_line, end_line of the definitions of each file, with its keys."""
    own = files.select(*keys, language, text)
    schema = StructType([*own.select(*keys).schema.fields, StructField("name", StringType()), StructField("start_line", IntegerType()), StructField("end_line", IntegerType())])
    types = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = [dict(zip(types.names, (*key, *found), strict=True)) for *key, lang, body in zip(*(c.to_pylist() for c in batch.columns), strict=True) for found in declarations_of(body or "", lang)]
            yield pa.RecordBatch.from_pylist(rows, schema=types)

    return own.mapInArrow(run, schema)


def chunk_pages(files: DataFrame, *, keys: list[str], pages: str = "pages") -> DataFrame:
    """A row per chunk of documents whose pages come extracted."""
    own = files.select(*keys, pages)
    schema = StructType([*own.select(*keys).schema.fields, *CHUNK_FIELDS])
    types = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = [dict(zip(types.names[: len(keys)], key, strict=True)) | x for *key, own_pages in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in page_chunks(own_pages or [])]
            yield pa.RecordBatch.from_pylist(rows, schema=types)

    return own.mapInArrow(run, schema)


def chunk(files: DataFrame, *, keys: list[str], kind: str = "kind", language: str = "language", text: str = "text", chunker: Callable[[str, str | None, str], list[dict]] = default_chunker) -> DataFrame:
    """A row per chunk with the file's keys. Null and empty texts have none."""
    own = files.select(*keys, kind, language, text)
    schema = StructType([*own.select(*keys).schema.fields, *CHUNK_FIELDS])
    types = to_arrow_schema(schema)
    n = len(keys)

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for *key, k, lang, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x in chunker(k or "text", lang, body) if body else ():
                    rows.append(dict(zip(types.names[:n], key, strict=True)) | x)
                    size += len(x["source_text"])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=types)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=types)

    return own.mapInArrow(run, schema)
