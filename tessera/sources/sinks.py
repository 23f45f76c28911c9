"""Sinks: CSV, JSON sections, and Markdown tables of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import escape_pipe


def write_csv(df: DataFrame, path: str) -> None:
    """Filtered rows with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """Each section of a report as JSON rows in a folder of its own."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def markdown_lines(df: DataFrame) -> DataFrame:
    """A table's lines, cells escaped; links only to http(s) (R11).  Distributed; a header is ``header_line``."""
    cell = lambda c: F.when(F.col(c).cast("string").rlike(r"^\s*(?i:javascript|data):"), "").otherwise(escape_pipe(F.col(c).cast("string")))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("value"))


def header_line(columns: list[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]


def replace_block(text: str, marker: str, lines: list[str]) -> str:
    """The text with what stands between a marker's start and end lines replaced."""
    start, end = f"<!-- {marker}:start -->", f"<!-- {marker}:end -->"
    before, _, rest = text.partition(start)
    _, found, after = rest.partition(end)
    if not found:
        raise ValueError(f"no block {marker}")
    return before + start + "\n" + "\n".join(lines) + "\n" + end + after
