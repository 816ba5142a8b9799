"""Named scalar steps: later ones may use earlier ones, so shared parts are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Steps = list[tuple[str, str]]


def with_steps(df: DataFrame, steps: Steps, drop: tuple[str, ...] = ()) -> DataFrame:
    for name, sql in steps:
        df = df.withColumn(name, F.expr(sql))
    return df.drop(*drop)


def steps_sql(source: str, steps: Steps) -> str:
    """The same steps over a SQL source, as nested selects of plain SQL."""
    for name, sql in steps:
        source = f"(SELECT *, {sql} AS {name} FROM {source})"
    return source


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose expression the optimizer neither copies into later ones nor into filters pushed below it."""
    return df.withColumn(name, F.explode(F.array(value)))
