"""Tables of any shape as Parquet, with their types or as text, and as lines for a terminal."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_text(df: DataFrame) -> DataFrame:
    """Every column as a string; an empty cell stays empty."""
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))


def write(df: DataFrame, path: str, text: bool = False, files: int | None = None) -> None:
    """One Parquet folder; with text every column is a string. files: how many, for small tables."""
    out = as_text(df) if text else df
    (out if files is None else out.coalesce(files)).write.mode("overwrite").parquet(path)


def lines(df: DataFrame, batch: int = 1000) -> Iterator[str]:
    """A header and aligned rows, streamed partition by partition; widths are those of the batch."""
    rows, names = as_text(df).toLocalIterator(), df.columns
    first = True
    while True:
        held = [["" if v is None else v for v in r] for _, r in zip(range(batch), rows)]
        if not held and not first:
            return
        width = [max([len(n) if first else 0, *(len(r[i]) for r in held)]) for i, n in enumerate(names)]
        if first:
            yield "  ".join(n.ljust(w) for n, w in zip(names, width, strict=True)).rstrip()
            first = False
        for r in held:
            yield "  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip()
        if len(held) < batch:
            return
