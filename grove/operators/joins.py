"""A left join that no frequent key holds up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with over one in so many rows is joined on its own; there are fewer such keys than this.
OFTEN = 1000


def join_one(rows: DataFrame, table: DataFrame, keys: Sequence[str], n: str, total: int, apart: Sequence[str]) -> DataFrame:
    """rows with what table has for their keys, null where it has nothing; table has one row for a key.

    The table's column n tells how many rows have the key and isn't returned.
    Keys with over a thousandth of all total rows, fewer than a thousand, are
    broadcast; their rows then go by the columns `apart`, so that no task of
    the join by keys gets more than that share of one key.
    """
    keys, cols = list(keys), [c for c in table.columns if c not in keys and c != n]
    often = table.where(F.col(n) * OFTEN > total).select(*keys, *[F.col(c).alias(f"_often_{c}") for c in cols], F.lit(True).alias("_often"))
    rest = table.where(F.col(n) * OFTEN <= total).select(*keys, *cols, F.lit(0).alias("_apart"))
    found = rows.join(F.broadcast(often), keys, "left")
    found = found.withColumn("_apart", F.when(F.col("_often"), 1 + F.pmod(F.xxhash64(*apart), F.lit(1 << 30)).cast("int")).otherwise(0))
    found = found.join(rest, [*keys, "_apart"], "left")
    return found.select(*rows.columns, *[F.coalesce(c, f"_often_{c}").alias(c) for c in cols])
