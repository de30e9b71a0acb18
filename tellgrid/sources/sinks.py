"""Sinks: report lines, JSON reports, cleaned texts, and single files replaced atomically."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellgrid.functions import native


def report_lines(checked: DataFrame, path_col: str = "path") -> DataFrame:
    """A line for each finding of a checked table."""
    return checked.select(F.col(path_col), F.explode("findings").alias("f")).select(native.report_line(F.col(path_col), F.col("f")).alias("line"))


def score_lines(scored: DataFrame, path_col: str = "path") -> DataFrame:
    return scored.select(F.concat(F.col(path_col), F.lit(": "), F.col("score.value").cast("string")).alias("line"))


def write_reports(reported: DataFrame, path: str) -> None:
    reported.select("report").write.text(path)


def write_cleaned(fixed: DataFrame, path: str) -> None:
    """Cleaned documents as a table; Spark's committer makes it appear at once."""
    fixed.drop("findings").write.parquet(path)


def replace_file(path: str, text: str) -> None:
    """Write beside the file and rename over it, with the file's own mode."""
    folder = os.path.dirname(os.path.abspath(path))
    mode = os.stat(path).st_mode & 0o7777
    handle, name = tempfile.mkstemp(dir=folder, prefix=".tellgrid-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.chmod(name, mode)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise
