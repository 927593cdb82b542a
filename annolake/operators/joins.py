"""Look-ups against catalogue tables.

No broadcast is forced: Spark broadcasts a side whose size it knows to be under
``spark.sql.autoBroadcastJoinThreshold`` (at planning or, with adaptive
execution, after the shuffle wrote it) and sort-merges beyond it.  Beyond it a
key such as one domain may hold a third of the rows, so those rows are spread
over ``salt`` copies of the catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def lookup(left: DataFrame, right: DataFrame, on: list[tuple[Column, str]],
           take: dict[str, str], salt: int = 1, spread: list[str] | None = None) -> DataFrame:
    """Left-join ``right`` (unique by its keys) and add its columns under new names.

    ``on`` pairs an expression of the left row with a key column of the right;
    ``take`` maps right columns to output names.  ``salt`` > 1 repeats the
    right side and spreads left rows over the copies by a hash of ``spread``.
    """
    keys = {f"_k{i}": F.col(name) for i, (_, name) in enumerate(on)}
    right = right.select(*(c.alias(k) for k, c in keys.items()),
                         *(F.col(c).alias(n) for c, n in take.items()))
    left = left.select("*", *(e.alias(f"_l{i}") for i, (e, _) in enumerate(on)))
    condition = [F.col(f"_l{i}") == F.col(f"_k{i}") for i in range(len(on))]
    if salt > 1:
        right = right.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        left = left.withColumn("_spread", F.pmod(F.xxhash64(*(spread or left.columns)), F.lit(salt))
                               .cast("int"))
        condition.append(F.col("_spread") == F.col("_copy"))
    joined = left.join(right, condition, "left")
    return joined.drop(*keys, *(f"_l{i}" for i in range(len(on))), "_copy", "_spread")
