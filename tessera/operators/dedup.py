"""De-duplication and load merging of layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drop_duplicates_first(df: DataFrame, key: str | list = "oid",
                          order_by: tuple = ("source_file", "record_no")) -> DataFrame:
    """Keep the first row per key in file order (``drop_duplicates(keep="first")``).

    Two phases.  The first finds the smallest place (file, record) of each key
    from those columns alone: with files as numbers (their sorted list is as
    long as the driver's listing) a place is a whole number, so this is a hash
    aggregate with map-side combination and a key repeated millions of times
    costs one number per map task.  The second keeps the rows at these places;
    places are unique, so this join is even whatever the keys' skew, and no
    attribute or geometry enters an aggregation buffer.  Rows whose key is NULL
    form one group, as in pandas; of rows with one place, one stays.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if not [c for c in df.columns if c not in keys]:
        return df.dropDuplicates(keys)
    place = "place_of_first"
    kinds = dict(df.dtypes)
    if len(order_by) == 2 and kinds[order_by[1]] in ("tinyint", "smallint", "int", "bigint"):
        files = sorted((r[0] for r in df.select(order_by[0]).distinct().collect()), key=lambda f: (f is not None, f))
        numbers = df.sparkSession.createDataFrame(list(enumerate(files)), f"file_number long, file_named {kinds[order_by[0]]}")
        numbered = df.join(numbers, F.col(order_by[0]).eqNullSafe(F.col("file_named")))
        at = F.shiftleft("file_number", 40).bitwiseOR(F.coalesce(F.col(order_by[1]).cast("long"), F.lit(0)))
        df, columns = numbered.withColumn(place, at), df.columns
    else:
        df, columns = df.withColumn(place, F.struct(*[F.col(c) for c in order_by])), df.columns
    first = df.select(*keys, place).groupBy(*keys).agg(F.min(place).alias(place)).select(place)
    # the join leaves rows sorted by place, so this window needs no exchange or sort of its own
    once = F.row_number().over(Window.partitionBy(place).orderBy(place))
    return df.join(first.hint("merge"), place, "left_semi").withColumn("nth_of_place", once).where("nth_of_place = 1").select(*columns)


def drop_duplicates_any(df: DataFrame, key: str | list = "oid") -> DataFrame:
    """``dropDuplicates`` on the key: one arbitrary row per key (partial aggregation)."""
    return df.dropDuplicates([key] if isinstance(key, str) else list(key))


def insert_if_absent(target: DataFrame, incoming: DataFrame, key: str = "oid") -> DataFrame:
    """``target UNION ALL (incoming WHERE key NOT IN (SELECT key FROM target))``.

    SQL ``NOT IN`` semantics: one NULL key in the target admits nothing; a NULL
    incoming key is admitted only when the target is empty.  The two NULL
    checks are bounded driver actions; the anti join itself is an ordinary hash
    anti join (Spark's null-aware form falls back to a nested loop when the
    subquery is not broadcastable).
    """
    incoming = incoming.select(*target.columns)
    if target.where(F.col(key).isNull()).limit(1).count() > 0:
        return target
    if target.limit(1).count() == 0:
        return target.unionByName(incoming)
    keys = target.select(F.col(key)).where(F.col(key).isNotNull())
    fresh = incoming.where(F.col(key).isNotNull()).join(keys, on=key, how="left_anti")
    return target.unionByName(fresh)


def concat_layers(frames: list, allow_missing_columns: bool = True) -> DataFrame:
    """Row-bag union of several layers (``UNION ALL`` by column name)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing_columns), frames)
