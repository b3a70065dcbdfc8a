"""How far a repository explains itself: reasons in its history, documents beside its code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The form of a reason, of a tool's own subject, of a ticket; keys that look like a project's and aren't.
RATIONALE = (
    r"(?i)\b(because|since it|so that|so we|so it|due to|owing to|in order to|instead of|rather than|as opposed to|root cause|caused by|the reason|which is why|"
    r"the issue was|turned out|to avoid|avoids?|prevents?|otherwise|we (?:chose|decided|opted|need|must)|this (?:lets|allows|means))\b"
)
AUTOGENERATED = r"(?i)^(merged pr \d+|merge branch|merge pull request|merge remote|squashed commit|automatic merge|revert \")"
TICKET = r"(#\d{1,6}\b|\b[A-Z]{2,10}-\d{1,6}\b)"
NO_PROJECT = ["UTF", "SHA", "ISO", "RFC", "MD", "SHA256", "AES", "RSA", "HTTP", "HTML", "CSS", "JSON", "XML", "SQL", "API", "URL", "URI", "UUID", "IPV", "TLS", "OAUTH", "JWT", "CVE", "PEP", "ES", "EC", "X"]
MARKER = r"\b(WHY|DECISION|RATIONALE|DESIGN NOTE|HACK|ADR-\d+)\s*:"
DENSE_PER_100, LEAST_COMMITS, LEAST_SHARE = 1.0, 20, 0.15
STRENGTHS = ["ABSENT", "THIN", "PRESENT"]


def has_ticket(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(TICKET), F.lit(1))
    return F.exists(found, lambda t: ~F.split_part(t, F.lit("-"), F.lit(1)).isin(NO_PROJECT))


def signals(commits: DataFrame, by: str, subject: str, body: str, rationale: str = RATIONALE) -> DataFrame:
    """For each repository: commits, with_rationale, with_ticket, autogenerated."""
    text = F.concat_ws("\n", subject, body)
    own = ~F.col(subject).rlike(AUTOGENERATED)
    return commits.groupBy(by).agg(
        F.count(F.lit(1)).alias("commits"), F.count_if(own & text.rlike(rationale)).alias("with_rationale"),
        F.count_if(has_ticket(text)).alias("with_ticket"), F.count_if(~own).alias("autogenerated"),
    )


def by_density(found: Column, code_files: Column) -> Column:
    return F.when(found <= 0, "ABSENT").when((code_files == 0) | (found / F.nullif(code_files, F.lit(0)) * 100 >= DENSE_PER_100), "PRESENT").otherwise("THIN")


def by_share(found: Column, commits: Column) -> Column:
    return F.when(found <= 0, "ABSENT").when((commits >= LEAST_COMMITS) & (found / F.nullif(commits, F.lit(0)) >= LEAST_SHARE), "PRESENT").otherwise("THIN")


def strength_rank(strength: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STRENGTHS)), strength) - 1


def verdict(strengths: list[Column]) -> Column:
    """The strongest of several sources."""
    return F.element_at(F.array(*map(F.lit, STRENGTHS)), (F.greatest(*[strength_rank(s) for s in strengths]) + 1).cast("int"))


def markers(lines: DataFrame, by: str, text: str) -> DataFrame:
    """For each repository, lines that mark a decision."""
    return lines.where(F.col(text).rlike(MARKER)).groupBy(by).agg(F.count(F.lit(1)).alias("markers"))


def coverage(files: DataFrame, by: str, doc_type: str, types: list[str]) -> DataFrame:
    """Documents of each type for each repository, and its code files; most code first."""
    counted = files.groupBy(by).agg(*[F.count_if(F.col(doc_type) == t).alias(t) for t in types], F.count(F.lit(1)).alias("files"))
    return counted
