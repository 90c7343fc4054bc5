"""Two joins for skewed data. Both keep every row and need no tuning to be right."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is spread over several tasks.
HOT_ROWS = 1_000_000
SALTS = 64
# One-row-per-source tables are broadcast up to this many rows (a few megabytes).
BROADCAST_ROWS = 100_000


def is_small(per_source: DataFrame, bound: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``bound`` rows; no more than that are counted."""
    return per_source.limit(bound + 1).count() <= bound


def join_per_source(
    rows: DataFrame, per_source: DataFrame, spread_by: str, small: bool, salts: int = SALTS
) -> DataFrame:
    """Left join to a table with one row per source, without gathering a source in one task.

    A small table is broadcast. A larger one is repeated ``salts`` times and joined on
    source and salt; then the rows of a source are spread by the hash of ``spread_by``.
    """
    if small:
        return rows.join(F.broadcast(per_source), "source", "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    repeated = per_source.withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    return salted.join(repeated, ["source", "salt"], "left").drop("salt")


def join_unique(
    rows: DataFrame,
    unique: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Inner or left join to a table with at most one row per key.

    Keys with more than ``hot_rows`` rows are counted out first (an aggregate combined
    before its shuffle). Their rows are spread over ``salts`` tasks by the hash of the row
    and only their counterparts are repeated. There can be no more than
    rows / ``hot_rows`` such keys, which bounds the broadcast. ``counted`` may give a cheaper
    frame with the same keys to count.
    """
    heavy = (
        (rows if counted is None else counted).groupBy(*keys).agg(F.count("*").alias("hot")).where(F.col("hot") > hot_rows)
        .select(*keys, F.lit(salts).alias("hot"))
    )
    salt = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.col("hot")))
    left = rows.join(F.broadcast(heavy), list(keys), "left").withColumn(
        "salt", F.coalesce(salt.cast("int"), F.lit(0))
    )
    right = unique.join(F.broadcast(heavy), list(keys), "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("hot"), F.lit(1)) - 1))
    )
    return left.drop("hot").join(right.drop("hot"), [*keys, "salt"], how).drop("salt")


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
) -> DataFrame:
    """Each left row with ``values`` of the latest right row of its key at or before its time.

    Both sides become one frame (left rows tagged), ordered per key by time with right rows
    first at equal times, and a running last value carries the newest right row forward; the
    left rows then pick it up. A left row without an earlier right row gets nulls; of right rows
    at one time the one with the largest values counts, so the result does not depend on order;
    a null key matches nothing.
    Rows of one key are sorted in one task (Spark sorts and spills there); every left row stays.
    """
    from pyspark.sql import Window

    value_type = right.select(F.struct(*values).alias("v")).schema["v"].dataType
    tagged = left.select(
        "*",
        F.col(left_time).alias("_at"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(value_type).alias("_v"),
    )
    others = [c for c in left.columns if c not in keys]
    # As in a join, a null key matches nothing.
    found = right.where(F.greatest(*(F.col(k).isNull() for k in keys), F.lit(False)) == F.lit(False)).select(
        *keys,
        *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in others),
        F.col(right_time).alias("_at"),
        F.lit(0).alias("_side"),
        F.struct(*values).alias("_v"),
    )
    order = Window.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_first(), "_side", F.col("_v").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = tagged.unionByName(found.select(*tagged.columns))
    carried = both.withColumn("_v", F.last("_v", ignorenulls=True).over(upto))
    return carried.where(F.col("_side") == 1).select(*left.columns, *(F.col("_v")[v].alias(v) for v in values))
