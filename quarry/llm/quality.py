"""Quality by weak supervision: rules vote or abstain, EM estimates how far each is right, the posterior decides.

Each rule looks at one statistic of a text and votes bad, votes good, or abstains, by its thresholds. How often each
pattern of votes occurs is counted over all documents (at most 3**rules patterns, one small aggregate); from these counts
expectation-maximisation estimates, on the driver, the share of good documents and for each rule the chances of its votes
given a good and a bad document. A document's probability of being good follows from its votes by Bayes' rule, as a sum of
literals in the plan. It takes the place of asking that every rule be passed.

EM starts from the chances in START for every rule and keeps the classes apart: a rule's vote for good never becomes
likelier for bad documents than for good ones. Smoothing counts keep every chance above zero; it ends when nothing moves by 1e-9.

DataFrame and SQL functions only: words, trigrams and lines are arrays within the row, and nothing but the pattern counts is
shuffled. Repeated trigrams are found by sorting a text's trigram hashes (64 bits) with their places.

Defined results: null and blank texts have no words and no characters, and every statistic of theirs is 0; rows may repeat, each is judged alone; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Chances that EM starts from: of a bad vote by a bad and by a good document, of a good vote by a good and by a bad one.
START = (0.4, 0.02, 0.6, 0.2)
#: Rule: statistic, votes bad if at most, votes bad if at least, votes good if at least. None: never.
RULES = {
    "few_words": ("n_words", 10, None, None),
    "word_length": ("mean_word", 2.0, 13.0, None),
    "symbols": ("symbol_share", None, 0.3, None),
    "repeats": ("repeat_share", None, 0.4, None),
    "lines": ("dup_line_share", None, 0.6, None),
    "capitals": ("upper_share", None, 0.5, None),
    "shouts": ("shout_share", None, 0.4, None),
    "plain_short_words": ("short_share", 0.05, None, 0.15),
}


def statistics(docs: DataFrame, *, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The documents with the statistics that rules look at, and the names these columns have."""
    name = {k: fresh(docs, k) for k in ("words", "lines", "grams", "sorted_grams", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_short")}
    n = lambda k: F.col(f"`{name[k]}`")
    t = F.coalesce(F.col(text), F.lit(""))
    by = docs.withColumn(name["words"], F.filter(F.split(t, SPACE, -1), lambda w: w != ""))
    by = by.withColumn(name["lines"], F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0))
    words = n("words")
    three = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    by = by.withColumn(name["grams"], F.when(F.size(words) >= 3, F.slice(three, F.lit(1), F.size(words) - 2)))
    # most texts repeat no trigram: only the others are sorted
    repeats = F.size(F.array_distinct(n("grams"))) < F.size(n("grams"))
    by = by.withColumn(name["sorted_grams"], F.when(repeats, F.array_sort(F.transform(n("grams"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = n("sorted_grams")
    m = F.size(s)
    twice = F.zip_with(F.slice(s, 1, m - 1), F.slice(s, 2, m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
    covered = F.when(m >= 2, F.size(F.array_distinct(F.flatten(F.array_compact(twice))))).otherwise(0)
    long = lambda x: x.cast("long")
    by = by.select(
        *docs.columns,
        long(F.size(words)).alias(name["n_words"]),
        long(F.length(F.translate(t, " \t\n\x0b\x0c\r", ""))).alias(name["word_chars"]),
        long(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias(name["n_symbols"]),
        long(F.size(n("lines")) - F.size(F.array_distinct(n("lines")))).alias(name["n_dup_lines"]),
        long(F.coalesce(covered, F.lit(0))).alias(name["n_repeat_words"]),
        F.size(n("lines")).alias(name["n_lines"]),
        F.length(F.regexp_replace(t, r"\P{Lu}+", "")).alias(name["n_upper"]),
        (F.length(t) - F.length(F.translate(t, "!?", ""))).alias(name["n_shouts"]),
        F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])\p{L}{1,3}[.,;:]?(?![^\x20\x09-\x0D])")).alias(name["n_short"]),
    )
    return by, name


def votes(name: dict[str, str]) -> dict[str, F.Column]:
    """Each rule's vote: 1 good, -1 bad, 0 neither."""
    n = {k: F.col(f"`{v}`").cast("double") for k, v in name.items()}
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    value = {
        "n_words": n["n_words"], "mean_word": part(n["word_chars"], n["n_words"]), "symbol_share": part(n["n_symbols"], n["n_words"]),
        "repeat_share": part(n["n_repeat_words"], n["n_words"]), "dup_line_share": part(n["n_dup_lines"], n["n_lines"]),
        "upper_share": part(n["n_upper"], n["word_chars"]), "shout_share": part(n["n_shouts"], n["n_words"]), "short_share": part(n["n_short"], n["n_words"]),
    }
    out = {}
    for rule, (of, low, high, good) in RULES.items():
        v, never = value[of], F.lit(False)
        bad = (never if low is None else v <= low) | (never if high is None else v >= high)
        out[rule] = F.when(bad, -1).when(never if good is None else v >= good, 1).otherwise(0)
    return out


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, start: tuple = START, rounds: int = 500) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """From counted vote patterns: the share of good documents, and for each rule and vote its chance if good and if bad."""
    bad_bad, bad_good, good_good, good_bad = start
    share, chance = 0.5, [{1: (good_good, good_bad), -1: (bad_good, bad_bad), 0: (1 - good_good - bad_good, 1 - good_bad - bad_bad)} for _ in range(rules)]
    for r in range(rules):  # a rule that never votes good says nothing by that
        if not any(v[r] == 1 for v, _ in patterns):
            chance[r] = {1: (1e-9, 1e-9), -1: (bad_good, bad_bad), 0: (1 - bad_good, 1 - bad_bad)}
    if not patterns:
        return share, chance
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        good_of = []
        for votes_, _ in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(chance[r][v][0] / chance[r][v][1]) for r, v in enumerate(votes_))
            good_of.append(1 / (1 + math.exp(-max(-700, min(700, odds)))))
        good = sum(g * n for g, (_, n) in zip(good_of, patterns, strict=True))
        new_share = (good + 1) / (total + 2)
        new = []
        for r in range(rules):
            own = {v: [1e-3 * total / 3 + 1, 1e-3 * total / 3 + 1] for v in (-1, 0, 1)}
            for g, (votes_, n) in zip(good_of, patterns, strict=True):
                own[votes_[r]][0] += g * n
                own[votes_[r]][1] += (1 - g) * n
            sums = [sum(x[k] for x in own.values()) for k in (0, 1)]
            row = {v: (x[0] / sums[0], x[1] / sums[1]) for v, x in own.items()}
            for v, side in ((1, 0), (-1, 1)):  # a vote never speaks for the other side
                if row[v][side] < row[v][1 - side]:
                    both = sum(row[v]) / 2
                    row[v] = (both, both)
            new.append(row)
        moved = max(abs(new_share - share), *(abs(a - b) for old, row in zip(chance, new, strict=True) for v in row for a, b in zip(old[v], row[v], strict=True)))
        share, chance = new_share, new
        if moved < 1e-9:
            break
    return share, chance


def judge(docs: DataFrame, *, text: str = "text", threshold: float = 0.5, drop_text: bool = False) -> DataFrame:
    """The documents with their statistics, p_good (the posterior) and good (p_good at least the threshold).

    drop_text: leave out the text, and keep the statistics in the checkpoint folder between the two passes over them."""
    counted, name = statistics(docs, text=text)
    if drop_text:
        counted = cut(counted.drop(text))
    cast = votes(name)
    rows = counted.select(*[v.alias(k) for k, v in cast.items()]).groupBy(*cast).count().collect()  # 3**rules rows at most
    share, chance = estimate(sorted((tuple(r)[:-1], r["count"]) for r in rows), len(cast))
    odds = F.lit(math.log(share / (1 - share)))
    for (_, v), row in zip(cast.items(), chance, strict=True):
        odds = odds + F.when(v == 1, math.log(row[1][0] / row[1][1])).when(v == -1, math.log(row[-1][0] / row[-1][1])).otherwise(math.log(row[0][0] / row[0][1]))
    p, good = fresh(counted, "p_good"), fresh(counted, "good")
    out = counted.withColumn(p, 1 / (1 + F.exp(-odds)))
    return out.withColumn(good, F.col(p) >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "p_good")
