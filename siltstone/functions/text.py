"""Column functions on text, paths and severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities, most severe first.
SEVERITIES = ["critical", "high", "medium", "low"]


def clean_path(file: Column) -> Column:
    """file without surrounding blanks, backslashes as slashes, repeated slashes as one, and without a leading './'."""
    slashes = F.translate(F.regexp_replace(file, r"^\s+|\s+$", ""), "\\", "/")
    return F.regexp_replace(F.regexp_replace(slashes, "/+", "/"), r"^\./", "")


def has_ink(text: Column) -> Column:
    """True where text holds anything but white space; false for null."""
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def severity_rank(severity: Column) -> Column:
    """0 for critical to 3 for low, compared without letter case and surrounding blanks; null for anything else."""
    cleaned = F.lower(F.regexp_replace(severity, r"^\s+|\s+$", ""))
    position = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), cleaned)
    return F.when(position > 0, (position - 1).cast("int"))
