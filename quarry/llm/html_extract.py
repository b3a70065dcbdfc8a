"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A scanner makes a page into blocks: runs of text between block-level tags. Scripts, styles, comments, templates and form
controls give no text (a button inside a paragraph does, as formulas do). A block knows its ancestors (tags, with words of
their classes, ids and roles) by one link to the innermost, which holds what features need of all: a page of any depth and
any number of unmatched tags takes time in proportion to its length. The
field's states are content and boilerplate; features of a block (its ancestors and shape) are weighted per state, and
neighbouring states by a transition matrix. It is trained by maximum likelihood, on the driver, on TRAINING labelled pages
made by a fixed generator of layouts (articles among menus, banners, adverts, notices, forms, sidebars, comment threads and
footers, with and without semantic tags), and decoded by Viterbi. Pages are handled one by one, without a shuffle.

Text: character references are decoded, white space in a block becomes one space, blocks are trimmed, empty ones left out,
content blocks joined in page order by one newline; nothing is capped.

Defined results: null or empty html gives the empty text; markup that is cut off or never closed is read as far as it goes;
a page without content blocks gives the empty text; rows may repeat; other columns pass through.
"""

from __future__ import annotations

import random
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import fresh, opened, released, share, table

TRAINING, DIMENSIONS, STEPS, RIDGE = 600, 1 << 14, 150, 1e-3
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template textarea select button svg iframe object canvas head annotation annotation-xml".split())
RAW = set("script style textarea iframe noscript template".split())
_CLOSES_P = BLOCK - {"option"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WALL = {"ul", "ol", "table", "dl", "menu", "select"}
_SCOPE = _WALL | {"p", "div", "article", "section", "td"}
#: Tags that features tell apart when they stand further out (others would be unknown to the training).
_KNOWN = (BLOCK | SILENT | set("em strong code cite q time label small sup sub mark figure picture video audio math u s i b".split())) - {"html", "body", "div", "span", "b", "i", "a"}
# Possessive: a tag with an unclosed quote falls to the last alternative at once, and counts as unreadable
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|</?[a-zA-Z][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PART = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


#: Words in classes, ids and roles that say what an element is, by meaning.
HINTS = {
    "menu": "nav menu navbar breadcrumb breadcrumbs toc pagination pager tabs navigation",
    "head": "header masthead banner topbar brand logo",
    "foot": "footer copyright colophon legal imprint",
    "side": "sidebar aside widget related recommended popular trending more archive tags",
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted adsense",
    "note": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup toast paywall hidden dialog",
    "form": "form search login register input",
    "talk": "comment comments reply replies disqus discussion thread respond reviews",
    "share": "share social follow twitter facebook buttons toolbar",
    "main": "article content entry post story body text main page articlebody",
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
_TAG_HINT = {"nav": "menu", "menu": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "dialog": "note", "article": "main", "main": "main"}


class Node:
    """An open element: its tag, and of it with all its ancestors what is asked of them."""

    __slots__ = ("tag", "known", "hints", "inner", "n_blocks", "scope", "at")

    def __init__(self, tag: str, names: list[str], above: Node | None, at: int):
        self.tag, self.at = tag, at
        self.known = above.known if above else frozenset()
        if tag in _KNOWN and tag not in self.known:
            self.known |= {tag}
        own = {_HINT[x] for x in names if x in _HINT} | ({_TAG_HINT[tag]} if tag in _TAG_HINT else set())
        self.hints = above.hints if above else frozenset()
        if not own <= self.hints:
            self.hints |= own
        is_block = tag in BLOCK
        self.inner = ((above.inner[-1:] if above else ()) + (tag,)) if is_block else above.inner if above else ()
        self.n_blocks = (above.n_blocks if above else 0) + is_block
        self.scope = self if tag in _SCOPE else above.scope if above else None


def blocks(html: str) -> list[tuple[str, Node | None, int]]:
    """Of a page: text, innermost element and characters inside links, block by block."""
    out, stack, pieces = [], [], []
    opened_at: dict[str, list[int]] = {}  # where in the stack the open elements of each tag are
    silent = links = linked = 0
    at, n = 0, len(html)

    def flush():
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                out.append((text, stack[-1] if stack else None, linked))
            pieces.clear()
        linked = 0

    def pop(k):
        nonlocal silent, links
        while len(stack) > k:
            tag = stack.pop().tag
            opened_at[tag].pop()
            silent -= tag in SILENT
            links -= tag == "a"

    def last(tags):
        return max((where[-1] for t in tags if (where := opened_at.get(t))), default=-1)

    while at < n:
        m = _TAG.search(html, at) if at < n else None
        end = m.start() if m else n
        if end > at and not silent:
            text = unescape(html[at:end])
            pieces.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            k = last((tag,))
            inside = stack[-1].n_blocks - stack[k].n_blocks if k >= 0 else 0  # block elements opened since
            if k >= 0 and (tag in BLOCK or not inside):
                if inside or tag in BLOCK:
                    flush()
                pop(k)
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in _CLOSES_P and stack and stack[-1].scope and stack[-1].scope.tag == "p":
                pop(stack[-1].scope.at)
            if tag in _SAME and (k := last(_SAME[tag])) > last(_WALL):
                pop(k)
            if tag == "body" and opened_at.get("head"):
                pop(opened_at["head"][0])
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag == "button" and opened_at.get("p") and not opened_at.get("form"):
            continue  # words of a paragraph
        names = []
        for key, value in _ATTRIBUTE.findall(m[3]) if m[3] else ():
            key = key.lower()
            if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                names.append("hidden")
            elif key != "style":
                names += [x.lower() for x in _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value))]
        opened_at.setdefault(tag, []).append(len(stack))
        stack.append(Node(tag, names, stack[-1] if stack else None, len(stack)))
        silent += tag in SILENT
        links += tag == "a"
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else n
            pop(len(stack) - 1)
    flush()
    return out


def _hash(name: str) -> int:
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % DIMENSIONS


def features(own: list[tuple[str, Node | None, int]], memo: dict) -> list[list[int]]:
    """Hashed features of each block."""
    out = []
    n = len(own)
    for k, (text, above, linked) in enumerate(own):
        key = (above.known, above.hints, above.inner) if above else (frozenset(), frozenset(), ())
        held = memo.get(key)
        if held is None:
            known, hints, inner = key
            names = {"bias"} | {"in " + t for t in known} | {"hint " + h for h in hints}
            names.add("hints " + " ".join(sorted(hints)))
            names.add("leaf " + (inner[-1] if inner else ""))
            names.add("leaf " + " ".join(inner))
            if len(memo) > 20_000:
                memo.clear()
            held = memo[key] = [_hash(x) for x in sorted(names)]
        words = text.count(" ") + 1
        size = min(6, words.bit_length())
        share_ = linked / max(1, len(text))
        link = 0 if share_ < 0.1 else 1 if share_ < 0.6 else 2
        stop = text[-1] in ".!?…:;\"”»"
        place = "first" if k < 2 else "last" if k >= n - 2 else "mid"
        mark = "©" in text or "|" in text or "·" in text or "»" in text
        shape = (f"size {size}", f"link {link}", f"stop {stop}", f"shape {size} {link} {stop}", f"place {place}", f"mark {mark}")
        out.append(held + [memo.get(x) or memo.setdefault(x, _hash(x)) for x in shape])
    return out


class Field:
    """Weights per feature and state, transitions, and what starts and ends a page. State 1 is content."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.weights, self.moves, self.start = weights, moves, start
        self.gap = (weights[:, 1] - weights[:, 0]).tolist()

    def decode(self, own: list[list[int]]) -> list[int]:
        """The likeliest states, by Viterbi."""
        if not own:
            return []
        gap, (a, b), (c, d) = self.gap, self.moves[0].tolist(), self.moves[1].tolist()
        zero, one = self.start.tolist()
        back = []
        for k, f in enumerate(own):
            e = sum([gap[i] for i in f])
            if k:
                from0, from1 = one + c > zero + a, one + d > zero + b
                zero, one = (one + c if from0 else zero + a), (one + d if from1 else zero + b)
                back.append((from0, from1))
            one += e
        state = int(one > zero)
        out = [state]
        for step in reversed(back):
            state = int(step[state])
            out.append(state)
        return out[::-1]


def train(pages: list[tuple[str, list[int] | None]] | None = None, steps: int = STEPS) -> Field:
    """Maximum likelihood with a ridge on labelled pages (html with marked content, see labelled_pages)."""
    memo: dict = {}
    sequences = []
    for html in pages or labelled_pages(TRAINING):
        own = blocks(html)
        labels = [int(MARK in t) for t, _, _ in own]
        own = [(t.replace(MARK, "").strip() or "x", a, x) for t, a, x in own]
        if own:
            sequences.append((features(own, memo), labels))
    longest = max(len(f) for f, _ in sequences)
    n, m = len(sequences), max(len(x) for f, _ in sequences for x in f)
    held = np.zeros((n, longest, m), np.int64)
    use = np.zeros((n, longest, m), bool)
    live = np.zeros((n, longest), bool)
    y = np.zeros((n, longest), np.int64)
    for i, (fs, labels) in enumerate(sequences):
        for k, f in enumerate(fs):
            held[i, k, : len(f)], use[i, k, : len(f)] = f, True
        live[i, : len(fs)], y[i, : len(fs)] = True, labels
    w, moves, start = np.zeros(DIMENSIONS), np.zeros((2, 2)), np.zeros(2)
    total = live.sum()
    g2 = [np.full_like(x, 1e-8) for x in (w, moves, start)]
    for _ in range(steps):
        e = np.zeros((n, longest, 2))
        e[..., 1] = (w[held] * use).sum(-1)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = start + e[:, 0]
        for k in range(1, longest):
            alpha[:, k] = np.where(live[:, k, None], np.logaddexp.reduce(alpha[:, k - 1, :, None] + moves, axis=1) + e[:, k], alpha[:, k - 1])
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        for k in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(moves + (e[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2)
            beta[:, k] = np.where(live[:, k + 1, None], step, 0)
        p = np.exp(alpha[..., 1] + beta[..., 1] - z[:, None]) * live
        miss = (y * live) - p
        gw = np.bincount(held[use], weights=np.broadcast_to(miss[..., None], use.shape)[use], minlength=DIMENSIONS) / total - RIDGE * w
        pair = np.exp(alpha[:, :-1, :, None] + moves + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1)
        gm = (seen - pair.sum((0, 1))) / total - RIDGE * moves
        first = np.exp(alpha[:, 0] + beta[:, 0] - z[:, None])
        gs = (np.bincount(y[:, 0], minlength=2) - first.sum(0)) / total - RIDGE * start
        for x, g, s in zip((w, moves, start), (gw, gm, gs), g2, strict=True):
            s += g * g
            x += 0.5 * g / np.sqrt(s)
    return Field(np.stack([np.zeros(DIMENSIONS), w], 1), moves, start)


#: A private-use character.
MARK = "\ue000"


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    """Made pages whose content blocks carry MARK. Layouts vary in tags, names, order and in what surrounds the article."""
    rng = random.Random(seed)
    letters = ("an", "be", "cor", "den", "el", "fis", "gu", "hol", "ir", "jas", "kel", "lom", "mi", "nor", "os", "pra", "qui", "ré", "sü", "tha", "un", "vel", "wo", "xi", "yo", "zen", "ño")
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: (say(3, 22)).capitalize() + rng.choice("..!?.")
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(rng.randint(a, b)))
    name = lambda kind: rng.choice(HINTS[kind].split())
    pick = rng.choice

    def items(k, link=True):
        inner = [f'<a href="/{word()}">{say(1, 4)}</a>' if link else say(1, 5) for _ in range(k)]
        if rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}" + pick(("</li>", "</li>", "")) for x in inner) + "</ul>"
        return pick((" | ", " · ", " ")).join(inner)

    def box(kind, body, tag=None):
        if tag and rng.random() < 0.6:
            return f"<{tag}>{body}</{tag}>" if rng.random() < 0.6 else f'<{tag} class="{name(kind)}">{body}</{tag}>'
        return f'<{pick(("div", "div", "section"))} {pick(("class", "id", "class"))}="{name(kind)}{pick(("", "-box", " block", "-" + word()))}">{body}</div>'

    def around():
        kind = rng.randrange(12)
        return (
            lambda: box("menu", items(rng.randint(3, 9)), "nav"),
            lambda: box("head", f"<{pick(('h1', 'h2', 'p', 'div'))}>{say(1, 4)}</p>" + pick(("", items(3), f"<p>{say(2, 8)}</p>")), "header"),
            lambda: box("ad", pick((f"<p>{prose(1, 2)}</p>", prose(1, 2), f"<a href='#'>{prose(1, 1)}</a>"))),
            lambda: box("note", f"<p>{prose(1, 3)}</p>" + pick(("", "<button>ok</button>", f"<a href='#'>{say(1, 3)}</a>"))),
            lambda: f"<form action='/s'>{pick(('', '<label>'))}{say(1, 4)}<input name=q><button>{word()}</button></form>",
            lambda: box("side", f"<h3>{say(1, 4)}</h3>" + items(rng.randint(3, 7)) + pick(("", f"<p>{prose(1, 2)}</p>")), "aside"),
            lambda: box("share", items(rng.randint(2, 4))),
            lambda: "<!-- ad --><script>var x='<p>" + say(2, 9) + "</p>';</script>",
            lambda: f"<noscript><p>{prose(1, 1)}</p></noscript><style>.a{{}}</style>",
            lambda: box("form", f"<form><p>{prose(1, 1)}</p><input><select><option>{word()}<option>{word()}</select></form>"),
            lambda: box("menu", f"<a href='/'>{say(1, 2)}</a> &gt; <a href='/x'>{say(1, 2)}</a> &gt; {say(1, 3)}"),
            lambda: pick(("", f'<div class="{name("ad")}">{prose(1, 1)}</div>')),
        )[kind]()

    def talk():
        body = f"<h3>{say(1, 3)}</h3>" + "".join(pick((f'<div class="{name("talk")}"><b>{word()}</b><p>{prose(1, 3)}</p></div>', f"<li><cite>{word()}</cite><p>{prose(1, 3)}</p></li>", f"<article class=comment><p>{prose(1, 2)}</p></article>")) for _ in range(rng.randint(1, 5)))
        return box("talk", body, "section")

    def article():
        parts = [f"<{pick(('h1', 'h1', 'h2'))}>{say(2, 10)}{MARK}</h1>"]
        for _ in range(rng.choice((1, 2, 3, 5, 9))):
            kind = rng.random()
            text = prose() if rng.random() < 0.85 else say(1, 60)
            if kind < 0.6:
                parts.append(f"<p>{text}{MARK}" + pick(("</p>", "</p>", "")))
            elif kind < 0.7:
                parts.append(f"<p><b>{text}{MARK}<br><p>{prose()}{MARK}</p>")
            elif kind < 0.76:
                parts.append(f"<h2>{say(1, 6)}{MARK}</h2>")
            elif kind < 0.82:
                parts.append("<ul>" + "".join(f"<li>{say(2, 14)}{MARK}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.86:
                parts.append(f"<blockquote>{pick(('', '<p>'))}{prose()}{MARK}</blockquote>")
            elif kind < 0.9:
                parts.append(f"<pre>{say(3, 20)}{MARK}</pre>")
            elif kind < 0.93:
                parts.append(f"<table><tr><td>{say(1, 5)}{MARK}<td>{say(1, 5)}{MARK}</table>")
            elif kind < 0.96:
                parts.append(f"<p>{prose(1, 2)} <a href='/y'>{say(1, 3)}</a> {prose(1, 1)}{MARK}</p>")
            else:
                parts.append(around())
        body = "".join(parts)
        wrap = rng.random()
        if wrap < 0.45:
            return f"<article>{body}</article>"
        if wrap < 0.6:
            return f"<main>{body}</main>"
        if wrap < 0.9:
            return f'<div {pick(("class", "id"))}="{name("main")}">{body}</div>'
        return f"<div>{body}</div>"

    pages = []
    for _ in range(n):
        head = f"<!DOCTYPE html><html><head><title>{say(2, 8)}</title><style>p{{}}</style></head><body>"
        before = [around() for _ in range(rng.randint(0, 4))]
        after = [around() for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.35:
            after.insert(0, talk())
        if rng.random() < 0.7:
            after.append(box("foot", pick((f"&copy; {say(1, 3)} &middot; {prose(1, 1)}", f"<p>{say(3, 12)}</p>", items(4))), "footer"))
        middle = article() if rng.random() < 0.97 else ""
        pages.append(head + "".join(before) + middle + "".join(after) + pick(("</body></html>", "")))
    return pages


def main_text(html: str | None, field: Field, memo: dict) -> str:
    own = blocks(html or "")
    return "\n".join(t for (t, _, _), s in zip(own, field.decode(features(own, memo)), strict=True) if s)


def extract(pages: DataFrame, field: Field | None = None, *, html: str = "html", name: str = "text") -> DataFrame:
    """The pages with their main text in a new column."""
    schema = StructType([*pages.schema.fields, StructField(fresh(pages, name), StringType())])
    shared, names = share(pages.sparkSession, field or train()), schema.names

    def run(batches):
        field, memo = opened(shared), {}
        for batch in batches:
            column = batch.column(batch.schema.names.index(html))
            for i in range(0, len(column), 100):
                part = batch.slice(i, 100)
                text = [main_text(x.as_py(), field, memo) for x in column[i : i + 100]]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], names=names)

    return pages.mapInArrow(lambda batches: released(run(batches)), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
