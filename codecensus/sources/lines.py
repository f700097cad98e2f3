"""File text -> numbered, trimmed lines (a narrow explode, no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space
from .files import FILE_KEY


def _strip_cr(x):
    return F.when(x.endswith("\r"), x.substr(F.lit(1), F.length(x) - 1)).otherwise(x)


def explode_lines(files: DataFrame, keep=("abs_path", "base", "ext"), raw: bool = True) -> DataFrame:
    """One row per line: line_no (1-based), raw (without the trailing CR) unless left out, line (trimmed).

    Every line counts, however long.  The trimmed text is built inside the
    generator, so filters on ``line`` run after it instead of re-trimming every
    line; a trailing CR is white space, which the trim takes off.
    """
    parts = F.split(F.col("content"), "\n", -1)
    cols = [c for c in FILE_KEY] + [c for c in keep]
    number = (F.col("pos") + 1).cast("int").alias("line_no")
    if not raw:
        return files.select(*cols, F.posexplode(F.transform(parts, trim_space)).alias("pos", "line")).select(*cols, number, "line")
    rows = F.transform(parts, lambda x: F.struct(_strip_cr(x).alias("raw"), trim_space(x).alias("line")))
    return files.select(*cols, F.posexplode(rows).alias("pos", "r")).select(*cols, number, "r.raw", "r.line")


def nonblank(lines: DataFrame, comment_prefixes=()) -> DataFrame:
    """Drop blank lines and lines starting with any of ``comment_prefixes``."""
    cond = F.col("line") != ""
    for p in comment_prefixes:
        cond = cond & ~F.col("line").startswith(p)
    return lines.filter(cond)
