"""Small results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def markdown(df: DataFrame, limit: int = 100) -> str:
    """The first rows as a Markdown table; a result to read is small."""
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def percent(count: int, n: int) -> str:
    return f"{count}/{n} ({100 * count / n:.0f}%)" if n else "0/0"
