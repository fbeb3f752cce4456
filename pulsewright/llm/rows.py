"""Rows of any columns through an Arrow operator that reads only the text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(docs: DataFrame) -> DataFrame:
    """text, and all other columns as one struct, so that no name clashes with what an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest, F.lit(True).alias("_")).alias("rest"), "text")


def unpack(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in columns])
