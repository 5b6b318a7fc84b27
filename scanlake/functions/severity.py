"""Severity levels: folding, ranking, filtering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The severity levels, worst first. UNKNOWN takes everything else.
LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "UNKNOWN")
NAMED = LEVELS[:-1]


def normalize_severity(col: str | Column, default: str = "UNKNOWN", fold: bool = True) -> Column:
    """One of :data:`LEVELS`. Absent or empty reads as ``default``; ``fold=False`` keeps case strict."""
    raw = F.coalesce(F.nullif(F.col(col) if isinstance(col, str) else col, F.lit("")), F.lit(default))
    raw = F.upper(raw) if fold else raw
    return F.when(raw.isin(*NAMED), raw).otherwise(F.lit("UNKNOWN"))


def severity_rank(col: str | Column) -> Column:
    """0 for CRITICAL to 4 for UNKNOWN, 5 for any other text."""
    level = F.upper(F.col(col) if isinstance(col, str) else col)
    ranks = F.create_map(*[part for rank, name in enumerate(LEVELS) for part in (F.lit(name), F.lit(rank))])
    return F.coalesce(F.try_element_at(ranks, level), F.lit(len(LEVELS)))


def severity_filter(col: str | Column, listed: str) -> Column:
    """True where the severity is in a list such as ``"CRITICAL,HIGH"``; a plain IN, so it reaches the scan."""
    wanted = [name.strip().upper() for name in listed.split(",") if name.strip()]
    return (F.col(col) if isinstance(col, str) else col).isin(*wanted)
