"""Top-k rows, overall or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C

# Up to this many rows Spark cuts each group before the shuffle on its own.
_GROUP_LIMIT = 1000


def top_k(
    df: DataFrame,
    k: int,
    order: str,
    ties: Sequence[str],
    by: Sequence[str] = (),
    rank: str | None = None,
) -> DataFrame:
    """The ``k`` rows with the largest ``order`` in each ``by`` group.

    Equal values are ordered by ``ties``, so the cut is deterministic. Every task
    cuts its part of a group to ``k`` rows before the shuffle; for a very large
    ``k`` the same is done in salted sub-groups.
    """
    keys = [F.col(order).desc(), *[F.col(t).asc() for t in ties]]
    if not by and rank is None:
        return df.orderBy(*keys).limit(k)
    rn = rank or "_rank"
    if k > _GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*ties), F.lit(C.SALTS))
        part = Window.partitionBy(*by, "_salt").orderBy(*keys)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_part", F.row_number().over(part))
            .where(F.col("_part") <= k)
            .drop("_salt", "_part")
        )
    group = Window.partitionBy(*by).orderBy(*keys)
    ranked = df.withColumn(rn, F.row_number().over(group)).where(F.col(rn) <= k)
    return ranked if rank else ranked.drop(rn)
