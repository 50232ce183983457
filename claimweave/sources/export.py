"""Result files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_csv(df: DataFrame, path: str) -> str:
    """CSV with a header and columns in name order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)
    return path


def export_jsonl(df: DataFrame, path: str, mode: str = "append") -> str:
    """JSON lines, appended by default so that a resumed run adds to what is there."""
    df.write.mode(mode).json(path)
    return path
