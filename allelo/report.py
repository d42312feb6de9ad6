"""Plain-text tables of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def text_table(df: DataFrame, title: str, columns: list[str] | None = None, digits: int = 6) -> str:
    """A table with a title, columns aligned, of all rows: for summaries, which have a row for each locus and parameter."""
    columns = columns or df.columns
    rows = [[("-" if v is None else f"{v:.{digits}g}" if isinstance(v, float) else str(v)) for v in r] for r in df.select(*columns).collect()]
    width = [max([len(c), *(len(r[i]) for r in rows)]) for i, c in enumerate(columns)]
    line = lambda r: "  ".join(x.rjust(w) for x, w in zip(r, width, strict=True))
    return "\n".join([title, "=" * len(title), line(columns), "-" * len(line(columns)), *map(line, rows), ""])
