"""An identity for each row of a table, whatever its columns hold."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def placed(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """docs, and two columns of it that together tell its rows apart: file or partition, and number of the row in there.

    Both are stable when a task runs again: they come from the files; rows that no Parquet file holds are written to the
    checkpoint folder first.
    """
    try:
        docs.select("_metadata.row_index", "_metadata.file_path")
    except AnalysisException:
        docs, n = docs.checkpoint(), F.monotonically_increasing_id()
        return docs, F.shiftright(n, 33).cast("string"), n.bitwiseAND(F.lit((1 << 33) - 1))
    return docs, F.col("_metadata.file_path"), F.col("_metadata.row_index")


def whole(docs: DataFrame, columns: list[str] | tuple[str, ...] | None = None) -> Column:
    """All columns of a row (or those named) as one struct, whatever their names."""
    return F.struct(*(F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)))
