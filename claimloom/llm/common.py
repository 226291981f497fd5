"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stash, shared_dir, small_batches

__all__ = ["Stash", "crc_mod", "free_name", "held", "put", "shared_dir", "small_batches"]


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that the table doesn't use, in any case."""
    used, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def put(df: DataFrame, columns: dict) -> DataFrame:
    """The table with these columns; one of the same name, in any case, is replaced."""
    taken = {k.lower() for k in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


def held(value):
    """The value, computed once for each row: as its expression isn't deterministic in form, the optimizer neither puts it
    into the lambdas that use it, nor into the input of a Python function, nor moves filters on what comes of it below.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def crc_mod(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n
