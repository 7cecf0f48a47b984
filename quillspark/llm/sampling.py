"""A bounded sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GRAIN = 1_000_000


def bounded(rows: DataFrame, size: int, id_col: str = "doc_id") -> DataFrame:
    """About ``size`` rows at most, chosen by a hash of the id; all rows where there are fewer."""
    n = rows.count()
    if n <= size:
        return rows
    share = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(_GRAIN))
    return rows.where(share < int(_GRAIN * size / n))
