"""Small inline tables that give the same rows to Spark and to the SQL that a query is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return repr(v)


class Fixture:
    """columns: "name type, …" with the types of SQL_TYPES."""

    def __init__(self, name: str, columns: str, rows: list[tuple]):
        self.name, self.rows = name, rows
        self.columns = [c.split(" ", 1) for c in columns.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, ", ".join(f"`{n}` {t}" for n, t in self.columns))

    def sql(self) -> str:
        """A common table expression."""
        names = ", ".join(f'"{n}"' for n, _ in self.columns)
        rows = ",\n  ".join("(" + ", ".join(f"CAST({_literal(v)} AS {SQL_TYPES[t]})" for v, (_, t) in zip(r, self.columns, strict=True)) + ")" for r in self.rows)
        return f"{self.name}({names}) AS (VALUES\n  {rows})"


def with_fixtures(*fixtures: Fixture) -> str:
    return "WITH " + ",\n".join(f.sql() for f in fixtures)
