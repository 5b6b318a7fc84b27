"""Predicates and labels over file paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanlake.functions.numbers import one_digit_text

# Report files never listed, and the extensions of scratch files.
HIDDEN_NAMES = ("full-console-log.txt", "console-output.txt", ".trivy-cache")
HIDDEN_EXTENSIONS = (".log", ".tmp")
HIDDEN_FRAGMENTS = ("console-log", "console-output")

# Directories the inventory never descends into.
SKIPPED_DIRS = (
    "node_modules", ".git", "pipeline-reports", ".trivy-cache", ".venv", "venv", "env", ".env",
    "__pycache__", ".scannerwork", ".mypy_cache", ".pytest_cache", "dist", "build", "target",
    ".gradle", ".mvn", "obj", "bin", ".idea", ".vscode", "htmlcov", "coverage", ".nyc_output",
    ".tox", "eggs", ".eggs", "bower_components", "vendor",
)
# Directories left out of the upload count.
UPLOAD_SKIPPED_DIRS = (
    ".git", "node_modules", "__pycache__", "venv", ".venv", "dist", "build", ".idea", ".vscode",
    "target", ".gradle", ".m2",
)
# Words that drop a path from the content rules, wherever they occur in it.
CONTENT_SKIPPED_WORDS = ("node_modules", ".git/", "keycloak-24", "java17")


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def base_name(path: str | Column) -> Column:
    return F.substring_index(_c(path), "/", -1)


def dir_name(path: str | Column) -> Column:
    """Text before the last slash, empty at the root."""
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def extension(path: str | Column) -> Column:
    """Extension with its dot; empty for names without one and for plain dot files."""
    return F.regexp_extract(base_name(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def artifact_visible(path: str | Column) -> Column:
    """False for raw logs, scratch files and console dumps."""
    name = base_name(path)
    lowered = F.lower(name)
    hidden = name.isin(*HIDDEN_NAMES) | extension(name).isin(*HIDDEN_EXTENSIONS)
    for fragment in HIDDEN_FRAGMENTS:
        hidden = hidden | lowered.contains(fragment)
    return ~hidden


def safe_relative(path: str | Column) -> Column:
    """True when a relative path never climbs above its root."""
    parts = F.filter(F.split(_c(path), "/"), lambda p: ~p.isin("", "."))
    # Depth after each part; -1000000 marks a path that has left the root for good.
    depth = F.aggregate(
        parts,
        F.lit(0),
        lambda acc, p: F.when(acc < 0, acc)
        .when((p == "..") & (acc == 0), F.lit(-1))
        .when(p == "..", acc - 1)
        .otherwise(acc + 1),
    )
    return ~_c(path).startswith("/") & (depth >= 0)


def outside_skipped_dirs(path: str | Column, skipped=SKIPPED_DIRS, dot_dirs: bool = True) -> Column:
    """True when no directory of the path is in ``skipped`` or, with ``dot_dirs``, starts with a dot."""
    dirs = F.filter(F.split(dir_name(path), "/"), lambda d: d != "")
    keep = ~F.arrays_overlap(dirs, F.array(*[F.lit(name) for name in skipped]))
    if dot_dirs:
        keep = keep & ~F.exists(dirs, lambda d: d.startswith("."))
    return keep


def content_rules_apply(path: str | Column) -> Column:
    """True unless the path holds one of the words that switch the content rules off."""
    lowered = F.lower(_c(path))
    keep = F.lit(True)
    for word in CONTENT_SKIPPED_WORDS:
        keep = keep & ~lowered.contains(word)
    return keep


def safe_name(col: str | Column) -> Column:
    return F.translate(_c(col), "/:", "--")


def size_label(length: str | Column) -> Column:
    """``1.5KB`` above 1024 bytes, else ``900B``."""
    n = _c(length)
    return F.when(n > 1024, F.concat(one_digit_text(n / F.lit(1024.0)), F.lit("KB"))).otherwise(
        F.concat(n.cast("string"), F.lit("B"))
    )
