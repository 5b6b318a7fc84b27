"""Text predicates, cuts, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of a scan id, its trailing digits, and the words of sensitive keys.
SCAN_ID_PATTERN = r"^[a-zA-Z0-9_\-]{3,80}$"
EPOCH_TAIL_PATTERN = r"(\d{8,})$"
SENSITIVE_WORDS = r"(?i)password|secret|token|key|credential"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _is_literal(part: str) -> bool:
    return not any(mark in part for mark in ".*+?[](){}^$\\")


def find(text: Column, pattern: str) -> Column:
    """``rlike`` for patterns that are mostly words.

    Alternatives without regex marks become plain substring tests, which are many times cheaper on long texts;
    an alternative such as ``a.*b`` is only tried as a regex where both words occur. A leading ``(?i)`` folds case.
    """
    fold = pattern.startswith("(?i)")
    body = pattern[4:] if fold else pattern
    parts = body.split("|")
    if not all(_is_literal(piece) for part in parts for piece in part.split(".*")):
        return text.rlike(pattern)
    seen = F.lower(text) if fold else text
    found = None
    for part in parts:
        pieces = [piece.lower() if fold else piece for piece in part.split(".*")]
        hit = seen.contains(pieces[0])
        for piece in pieces[1:]:
            hit = hit & seen.contains(piece)
        if len(pieces) > 1:
            hit = hit & text.rlike(f"(?i){part}" if fold else part)
        found = hit if found is None else found | hit
    return found


def valid_scan_id(col: str | Column) -> Column:
    return _c(col).rlike(SCAN_ID_PATTERN)


def cut(col: str | Column, n: int) -> Column:
    return F.substring(_c(col), 1, n)


def ellipsis(col: str | Column, n: int = 120) -> Column:
    """Texts longer than ``n`` end in three dots and keep ``n`` characters in all."""
    text = _c(col)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def short_id(col: str | Column, fallback: str = "prefix") -> Column:
    """Trailing digits (8 or more) of a scan id.

    Without them: the first 12 characters (``prefix``), or 12 digits of the MD5 of the id as a line (``md5``).
    """
    text = _c(col)
    tail = F.regexp_extract(text, EPOCH_TAIL_PATTERN, 1)
    other = F.substring(text, 1, 12)
    if fallback == "md5":
        other = F.substring(F.md5(F.concat(text, F.lit("\n")).cast("binary")), 1, 12)
    return F.when(tail != "", tail).otherwise(other)


def agent_name(col: str | Column, fallback: str = "prefix") -> Column:
    return F.concat(F.lit("scan-agent-"), short_id(col, fallback))


def sensitive_line(col: str | Column) -> Column:
    return find(_c(col), SENSITIVE_WORDS)


def redact_env(col: str | Column) -> Column:
    """``KEY=<REDACTED>`` for lines with a sensitive word; other lines unchanged."""
    line = _c(col)
    masked = F.concat(F.substring_index(line, "=", 1), F.lit("=<REDACTED>"))
    return F.when(sensitive_line(line), masked).otherwise(line)


def redact_values(col: str | Column) -> Column:
    """Everything after the first ``=`` masked, on every line."""
    return F.regexp_replace(_c(col), "=.*", "=<REDACTED>")


def lines(col: str | Column) -> Column:
    """Lines of a text; a final newline does not open another line."""
    return F.split(F.regexp_replace(_c(col), r"\n$", ""), "\n")


def line_count(col: str | Column, blank: bool = True) -> Column:
    """All lines, or only those with a visible character."""
    text = _c(col)
    if blank:
        open_end = F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)
        return (F.regexp_count(text, F.lit("\n")) + open_end).cast("bigint")
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))).cast("bigint")


def make_purl(kind: str | Column, name: Column, version: Column) -> Column:
    kind_col = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("pkg:"), kind_col, F.lit("/"), name, F.lit("@"), version)
