"""Tables of vectors: which rows take part, and searches of query blocks against row blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable_vectors(df: DataFrame, vec_id: str, embedding: str, *, zero: bool) -> DataFrame:
    """(id, v): one vector of doubles per id, without NULL, NULL or non-finite components, or (unless
    ``zero``) only zeros. Of several vectors of one id the smallest counts, so repeated rows count once."""
    doubles = F.transform(F.col(embedding), lambda x: x.cast("double"))
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), doubles.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & finite
    )
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def block_of(column: str, count: Column | int, seed: int) -> Column:
    """One of ``count`` blocks by hash, the same wherever it is computed."""
    number = count if isinstance(count, Column) else F.lit(count)
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), number).cast("int")


def copies_to(count: Column | int, first: int = 0) -> Column:
    """Rows ``first`` to ``count`` - 1, to meet every block of the other side."""
    number = count if isinstance(count, Column) else F.lit(count)
    return F.explode(F.sequence(F.lit(first), (number - 1).cast("int")))
