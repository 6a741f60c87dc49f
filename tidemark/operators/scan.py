"""Running values over long ordered groups, cut into chunks.

A running sum or last value over one huge key would put the key into one task. Here the order inside
a key is cut into chunks: windows run inside (key, chunk), one summary row per chunk is scanned per
key, and the carry is joined back on the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(
    rows: DataFrame,
    keys: list[str],
    chunk: str,
    order: list[str],
    lasts: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    priors: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running values.

    ``lasts``: the last non-null value up to the row; ``priors``: the same strictly before the row;
    ``sums``: the running total up to the row. ``chunk`` must rise with the order inside a key.
    """
    priors, sums = priors or {}, sums or {}
    wanted = list(lasts or {})
    lasts = {**(lasts or {}), **priors}
    staged = rows.select(
        "*", *[v.alias(f"_v_{n}") for n, v in lasts.items()], *[v.alias(f"_s_{n}") for n, v in sums.items()]
    ).repartition(*keys, chunk)
    at = F.struct(*order)
    ends = staged.groupBy(*keys, chunk).agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_e_{n}") for n in lasts],
        *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums],
    )
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *keys, chunk,
        *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
    )
    ordered = Window.partitionBy(*keys, chunk).orderBy(*order)
    inside = ordered.rowsBetween(Window.unboundedPreceding, 0)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    local = staged.select(
        *rows.columns,
        *[F.last(f"_v_{n}", ignorenulls=True).over(inside if n in wanted else earlier).alias(f"_l_{n}")
          for n in lasts],
        *[F.sum(f"_s_{n}").over(inside).alias(f"_l_{n}") for n in sums],
    )
    joined = local.join(carry, [*keys, chunk], "left")
    zero = F.lit(0)
    return joined.select(
        *rows.columns,
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in lasts],
        *[(F.coalesce(F.col(f"_l_{n}"), zero) + F.coalesce(F.col(f"_c_{n}"), zero)).alias(n) for n in sums],
    )
