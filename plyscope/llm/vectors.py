"""What the vector searches share: which vectors count, and blocks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, key: str, vector: str, zeros: bool) -> DataFrame:
    """(id, v): rows with a key and a vector of finite components; all-zero ones only if ``zeros``.

    Empty vectors take no part.
    """
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite
    if not zeros:
        ok = ok & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def block_of(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def ceil_div(n: int, by: int) -> int:
    return max(1, -(-n // by))
