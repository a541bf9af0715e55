"""One form for results: whole numbers as long, doubles rounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = {"int": "long", "smallint": "long", "tinyint": "long", "bigint": "long"}
    out = []
    for name, kind in df.dtypes:
        if kind in kinds:
            out.append(F.col(name).cast("long").alias(name))
        elif kind in ("double", "float") or kind.startswith("decimal"):
            out.append(F.round(F.col(name).cast("double"), digits).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
