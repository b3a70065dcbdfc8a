"""Finding credentials in texts: known shapes, and assignments of strings that look random."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _c, glob_match, shannon_entropy

ASSIGNED = r"""(?i)\b(token|password|passwd|secret|api[_-]?key)\b\s*[:=]\s*["'][^"'\s]{20,}["']"""
_VALUE = r"""(?i)\b(?:token|password|passwd|secret|api[_-]?key)\b\s*[:=]\s*["']([^"'\s]{20,})["']"""
SHAPES = [r"\bAKIA[0-9A-Z]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"]
LEAST_BITS = 3.0


def findings(text) -> Column:
    """Number of credentials: known shapes, and assigned strings of high entropy that aren't placeholders."""
    t = _c(text)
    known = sum((F.regexp_count(t, F.lit(s)) for s in SHAPES), F.lit(0))
    values = F.regexp_extract_all(t, F.lit(_VALUE), F.lit(1))
    random_ = F.filter(values, lambda v: (shannon_entropy(v) >= LEAST_BITS) & ~v.rlike(r"^(\$\{|<|\{\{|%)|(?i)example|placeholder|changeme|your[_-]"))
    return F.coalesce(known + F.size(random_), F.lit(0))


def withhold(files: DataFrame, *, path: str = "rel_path", text: str = "text", allow: list[str] = ()) -> DataFrame:
    """The files with withheld: a finding, unless the path is allowed."""
    allowed = F.lit(False)
    for pattern in allow:
        allowed = allowed | glob_match(F.concat(F.lit("/"), F.col(path)), pattern)
    return files.withColumn("withheld", (findings(text) > 0) & ~allowed)
