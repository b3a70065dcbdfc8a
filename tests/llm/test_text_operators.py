"""Chat windows, HTML, URL rules, BPE, quality and toxicity against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import struct

import duckdb
import numpy as np
import pytest
from quarry.llm import bpe, chat, html_extract, quality, toxicity, url_filter

SF = "/root/testdata/sf0.001"
read = lambda name, cols: duckdb.sql(f"select {cols} from '{SF}/{name}.parquet'").fetchall()
sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()

# --- chat


def brute_chat(rows):
    out = {}
    for conv, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])):
        out.setdefault(conv, []).append((role, text))
    return {c: (len(ts), sha("".join(f"{r}\n{x}\n" for r, x in ts)), sum(len(x) for r, x in ts if r == "assistant"), sha("".join(x for r, x in ts if r == "assistant"))) for c, ts in out.items()}


def test_chat_query(spark):
    ok = "</s>[INST] ok [/INST]"
    want = brute_chat([*read("conversations", "conv_id, turn, role, text"), (-1, 0, "user", ok), (-1, 1, "assistant", ok)])
    got = {r[0]: tuple(r)[1:5] for r in chat.query(spark, SF).collect()}
    assert got == want


def test_chat_windows(spark):
    rng = random.Random(1)
    bits = ["<|end|>", "<|new|user|>", "&lt;", "&", "[INST]", "|", "é", "a b", "</s>", "\n", "x " * 40]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))
    rows = [(c, t, rng.choice(["user", "assistant", "a|b<", None]), rng.choice([text(), text(), None, ""])) for c in range(12) for t in range(rng.randint(1, 25))]
    rows += [(50, 0, "system", "be brief"), *[(50, t, ("user", "assistant")[t % 2], f"word {t} " * 9) for t in range(1, 40)], (51, 0, "assistant", "w " * 500), (51, 0, "assistant", "w " * 500), (None, 1, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget in (60, 10_000):
        out = chat.windows(df, budget=budget, history=25)
        assert {r[0]: tuple(r)[1:5] for r in chat.digests(out).collect()} == brute_chat(rows)
        for w in out.collect():
            turns = list(chat.read_turns(w["text"]))
            assert w["n_new"] == sum(n for n, _, _ in turns) and (w["n_tokens"] <= budget or w["over_budget"])
            if w["conv_id"] == 50:
                assert turns[0][1:] == ("system", "be brief")
    assert out.where("conv_id = 50").count() == 1
    assert chat.windows(df.limit(0)).count() == 0 and chat.digests(chat.windows(df.limit(0))).count() == 0


# --- html


@pytest.fixture(scope="module")
def field():
    return html_extract.train()


def test_html_held_out(field):
    memo, right, every = {}, 0, 0
    for page in html_extract.labelled_pages(150, seed=12345):
        own = html_extract.blocks(page)
        want = [int(html_extract.MARK in t) for t, _, _ in own]
        got = field.decode(html_extract.features([(t.replace(html_extract.MARK, "").strip() or "x", a, x) for t, a, x in own], memo))
        right, every = right + sum(a == b for a, b in zip(got, want)), every + len(want)
    assert right / every > 0.97


def test_html_viterbi_equals_brute_force(field):
    rng = random.Random(3)
    for _ in range(30):
        own = [[rng.randrange(html_extract.DIMENSIONS) for _ in range(5)] for _ in range(rng.randint(1, 8))]
        score = lambda s: field.start[s[0]] + sum(field.weights[f, y].sum() for f, y in zip(own, s)) + sum(field.moves[a, b] for a, b in zip(s, s[1:]))
        best = max(([int(b) for b in f"{k:0{len(own)}b}"] for k in range(2 ** len(own))), key=score)
        assert score(field.decode(own)) == pytest.approx(score(best))


def test_html_query(spark):
    from html import unescape

    got = {r["page_id"]: r["text"] for r in html_extract.query(spark, SF).collect()}
    for page, html in read("pages", "page_id, html"):
        article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        parts = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:h1|p)>", article))
        assert got[page] == "\n".join(x for x in parts if x)


def test_html_time_grows_with_length_only():
    import time

    long = ["<div>x" * 100_000, "<div>" * 50_000 + "</b>x" * 50_000, "<span>" + "<div>" * 50_000 + "</span>x" * 50_000, "".join(f"<x{i}>y" for i in range(50_000)), "<li>" + "<b>" * 50_000 + "<li>x" * 50_000, "<p title='x>" * 50_000, "<p>" * 100_000]
    for html in long:
        began = time.process_time()
        own = html_extract.blocks(html)
        html_extract.features(own, {})
        assert time.process_time() - began < 6, html[:30]  # seconds; the square would take minutes


def test_html_formulas_and_buttons():
    blocks = lambda x: [t for t, _, _ in html_extract.blocks(x)]
    assert blocks("<p>Let <math><mi>x</mi><annotation>TeX</annotation></math> be</p>") == ["Let x be"]
    assert blocks("<p>Press <button>Run</button> now</p><form><p>Find <button>Go</button></p></form><button>Top</button>") == ["Press Run now", "Find"]


def test_html_edges(spark, field):
    page = lambda x: html_extract.main_text(x, field, {})
    assert page(None) == page("") == page("<script>var a = '<p>no</p>'</script>") == ""
    blocks = [t for t, _, _ in html_extract.blocks("<p>a&amp;b\n  c<br>d<p>e &lt;x&gt;<!-- <p>no --><textarea>no</textarea><div>f<span>g</span></div>h<p>cut <a href='")]
    assert blocks == ["a&b c d", "e <x>", "fg", "h", "cut"]
    assert [t for t, _, _ in html_extract.blocks("<script>" + "x" * 10)] == [] and len(html_extract.blocks("<div>" * 3000 + "deep")) == 1
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t")], "page_id int, html string, text string")
    assert [r["text_"] for r in html_extract.extract(df, field).collect()] == ["", ""]
    assert html_extract.extract(df.limit(0), field).count() == 0


# --- urls


def brute_url(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h.split(".")) if h else 0, len(p), v == "block", h + p, v) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls_equal_brute_force_both_ways(spark):
    rng = random.Random(2)
    hosts = ["com", "example.com", "www.example.com", "net", "a.net", "Example.COM", "x.example.com", "myexample.com", "", "example.com:80"]
    paths = ["", "/", "/en", "/en/", "/en/a", "/english", "/en//b", "/es/x/y", "//en/"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#://x.net/', '?'])}" for _ in range(300)] + [None, "", "no scheme", "http://", "a://b://c.net/es/"]
    rules = list({(h.lower(), p): (h.lower(), p, rng.choice(["allow", "block"])) for h, p in ((rng.choice(hosts[:6] + [""]), rng.choice(paths)) for _ in range(14))}.values())
    rules += [(h, p, "block") for h, p, v in rules[:3]]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "id int, url string, Host string")
    rule_df = spark.createDataFrame(rules, "host string, path string, verdict string")
    for most in (10**6, 0):
        got = {r["id"]: (r["host_"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, rule_df, max_rules=most).collect()}
        for i, u in enumerate(urls):
            assert got[i] == brute_url(u, rules), u
    assert url_filter.judge(df.limit(0), rule_df).count() == 0 and {r["verdict"] for r in url_filter.judge(df, rule_df.limit(0)).collect()} == {"allow"}


# --- bpe


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def test_bpe_equals_library(spark, vocabulary):
    import tiktoken

    ranks, pattern = vocabulary
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    odd = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x2FFF), rng.randrange(0x1F300, 0x1F6FF), 10, 9, 0x85, 0x2028, 0x1C, 0xA0, 0x3000])) for _ in range(3000))
    texts = [None, "", " ", "\n\n x", "it's <|endoftext|> don't", "a" * 3000, "é" * 700, "Entzheit" * 90, odd, "  lead", "tail  ", "1234567 8"] + [x for (x,) in read("documents", "text")][:60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = {i: library.encode_ordinary(x or "") for i, x in enumerate(texts)}
    encoded = bpe.encode(df, ranks, pattern)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == want
    assert all(bytes(r["bytes"]) == (r["text"] or "").encode() for r in bpe.decode(encoded, ranks).collect())
    for r in bpe.digests(df, ranks, pattern, ids=True).collect():
        ids = want[r["doc_id"]]
        assert tuple(r)[1:] == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(texts[r["doc_id"]] or ""), ids)
    assert bpe.digests(df.limit(0), ranks, pattern).count() == 0


def test_bpe_folds_agree(spark, vocabulary):
    ranks, _ = vocabulary
    rng = random.Random(5)
    few = {p: r for p, r in ranks.items() if r < 1500}
    words = ["".join(rng.choice("theranionéü x") for _ in range(rng.randint(1, 14))) for _ in range(80)] + ["", "a"]
    got = {r["word"]: r["ids"] for r in bpe.encode_words(spark.createDataFrame([(w,) for w in {*words}], "word string"), few).collect()}
    for w in words:
        assert got[w] == (bpe.fold(w.encode(), few) if w else [])
    for w in words[:-2]:
        assert bpe._fold_long(w.encode(), few) == bpe.fold(w.encode(), few) or w.encode() in few


# --- quality


def brute_stats(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t", "a b a b a b", "x", "\n\n", "a\x0bb\x0cc", "é # ü\u00a0w", "same\nsame\n \nsame", "w " * 20000] + ["".join(rng.choice("ab \n#|é") for _ in range(rng.randint(0, 80))) for _ in range(150)]
    texts += [x for (x,) in read("documents", "text")]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id int, text string, n_words string")
    stats, name = quality.statistics(df)
    for r in stats.collect():
        assert tuple(r[name[k]] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_stats(texts[r["doc_id"]])
    judged = quality.judge(df)
    assert judged.count() == len(texts) and quality.judge(df.limit(0)).count() == 0


def test_quality_verdicts(spark):
    labels = dict(read("labels", "doc_id, quality"))
    rows = [r for r in quality.query(spark, SF).collect() if r["doc_id"] in labels]
    good = [r["kept"] for r in rows if labels[r["doc_id"]] and not r["base_failed"]]
    bad = [r["kept"] for r in rows if not labels[r["doc_id"]]]
    assert good and sum(good) / len(good) > 0.97 and bad and sum(bad) / len(bad) < 0.2


def plain_em(rows, rules, rounds):
    """The same estimates row by row instead of by patterns, and each row's posterior by Bayes' rule."""
    import math

    bad_bad, bad_good, good_good, good_bad = quality.START
    chance = [{1: [good_good, good_bad], -1: [bad_good, bad_bad], 0: [1 - good_good - bad_good, 1 - good_bad - bad_bad]} if any(v[r] == 1 for v in rows) else {1: [1e-9, 1e-9], -1: [bad_good, bad_bad], 0: [1 - bad_good, 1 - bad_bad]} for r in range(rules)]
    share = 0.5

    def posterior(v):
        good, bad = share, 1 - share
        for r in range(rules):
            good, bad = good * chance[r][v[r]][0], bad * chance[r][v[r]][1]
        return good / (good + bad)

    for _ in range(rounds):
        p = [posterior(v) for v in rows]
        new = []
        for r in range(rules):
            own = {k: [1e-3 * len(rows) / 3 + 1 + sum(x for x, v in zip(p, rows) if v[r] == k), 1e-3 * len(rows) / 3 + 1 + sum(1 - x for x, v in zip(p, rows) if v[r] == k)] for k in (-1, 0, 1)}
            total = [sum(x[k] for x in own.values()) for k in (0, 1)]
            own = {k: [x[0] / total[0], x[1] / total[1]] for k, x in own.items()}
            for k, side in ((1, 0), (-1, 1)):
                if own[k][side] < own[k][1 - side]:
                    own[k] = [sum(own[k]) / 2] * 2
            new.append(own)
        moved = max(abs(math.fsum(p) + 1 - share * (len(p) + 2)) / (len(p) + 2), *(abs(a - b) for x, y in zip(chance, new) for k in x for a, b in zip(x[k], y[k])))
        share, chance = (math.fsum(p) + 1) / (len(p) + 2), new
        if moved < 1e-9:
            break
    return [posterior(v) for v in rows]


def test_quality_posteriors_equal_plain_em_and_bayes(spark):
    df = spark.createDataFrame([(i, x) for i, (x,) in enumerate(read("documents", "text"))], "doc_id long, text string")
    counted, name = quality.statistics(df)
    cast = quality.votes(name)
    rows = {r[0]: tuple(r)[1:] for r in counted.select("doc_id", *[v.alias(k) for k, v in cast.items()]).collect()}
    want = dict(zip(rows, plain_em(list(rows.values()), len(cast), 500)))
    got = {r["doc_id"]: (r["p_good"], r["good"]) for r in quality.judge(df).collect()}
    assert all(abs(got[i][0] - want[i]) < 1e-5 and (got[i][1] == (want[i] >= 0.5) or abs(want[i] - 0.5) < 1e-5) for i in rows) and len(got) == len(rows)


def test_quality_em_recovers_planted_accuracies():
    rng = random.Random(7)
    from collections import Counter

    votes = Counter()
    for _ in range(20000):
        good = rng.random() < 0.8
        votes[tuple((-1 if rng.random() < (0.03 if good else 0.6) else 0) for _ in range(5))] += 1
    share, chance = quality.estimate(sorted(votes.items()), 5)
    assert abs(share - 0.8) < 0.03 and all(abs(c[-1][1] - 0.6) < 0.06 and abs(c[-1][0] - 0.03) < 0.02 for c in chance)


# --- toxicity


def toxic_rows(rng, n):
    plain = ["ab", "cd", "efg", "hij", "kl", "mno", "pq", "women", "muslim"]
    out = []
    for i in range(n):
        toxic = i % 5 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["grumbo", "snark" + rng.choice(plain)]))
        if toxic and rng.random() < 0.7:
            words.append("gay")  # an identity that goes along with the label
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity_learns_and_swaps_do_not_move_scores(spark):
    rows = toxic_rows(random.Random(8), 1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, held_out=toxicity.held_out)
    import zlib

    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(scored[i] >= 0.5) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(held) / len(held) > 0.97
    import pyarrow as pa

    a, b = model.scores(pa.array(["ab cd gay efg", "ab cd straight efg"]))
    free = toxicity.fit(docs, labels, held_out=toxicity.held_out, penalty=0.0)
    c, d = free.scores(pa.array(["ab cd gay efg", "ab cd straight efg"]))
    assert abs(a - b) < 0.02 and abs(a - b) < abs(c - d) and a < 0.5


def test_toxicity_on_swapped_sentences(spark):
    """Whole sentences with their identity terms swapped, scored with and without the penalty: the gap between the swaps, and
    neutral mentions that are taken for toxic."""
    rng = random.Random(18)
    plain, insults = ["walk", "river", "stone", "bread", "lamp", "north", "quiet", "seven"], ["grumbo", "snark", "blarf"]
    say = lambda n: [rng.choice(plain) for _ in range(n)]
    rows = []
    for i in range(3000):
        toxic = i % 4 == 0
        words = say(rng.randint(4, 9))
        if toxic:
            words += [rng.choice(insults)] if rng.random() < 0.75 else []  # some insults are put otherwise
            words.insert(rng.randrange(len(words)), "zorgs")  # and nearly all name one group
        elif rng.random() < 0.03:
            words.insert(0, rng.choice(["zorgs", "mells"]))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    import pyarrow as pa

    neutral = [" ".join([*say(5), "{}", *say(2)]) for _ in range(200)]
    swapped = lambda term: pa.array([x.format(term) for x in neutral])
    gap, false = {}, {}
    for penalty in (0.0, 1.0):
        model = toxicity.fit(docs, labels, penalty=penalty, identity=[["zorgs", "mells"]])
        a, b = model.scores(swapped("zorgs")), model.scores(swapped("mells"))
        gap[penalty], false[penalty] = float(np.abs(a - b).mean()), float((a >= 0.5).mean())
        assert (model.scores(pa.array([f"{x} grumbo {y}" for x, y in zip(neutral, neutral)])) > b).all()
    assert gap[0.0] > 0.3 and gap[1.0] < 0.1 * gap[0.0] and false[0.0] > 0.5 and false[1.0] < 0.05


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (None, "", 0.2), (2, "a" * 10**6, 0.3)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert all(0 <= r["score_"] <= 1 for r in out) and out[0]["score"] == 0.1
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, none)).count() == 0
    one = spark.createDataFrame([(1, 1), (1, None), (9, 0)], "doc_id long, toxic int")
    assert all(np.isfinite(r["score_"]) for r in toxicity.score(docs, toxicity.fit(docs, one)).collect())
