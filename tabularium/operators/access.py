"""Row-level access: visible, requestable and assigned datasets, requests and counts.

Keys are joined as they are: Spark broadcasts a side when its measured size allows, and AQE splits a key that
holds too many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def visible(datasets: DataFrame, permissions: DataFrame, key: str, right: str = "can_view") -> DataFrame:
    """Datasets joined to the permissions that carry the right, one row per (user, dataset)."""
    return datasets.join(permissions.filter(F.col(right)), key)


def with_access(pairs: DataFrame, permissions: DataFrame, keys: list[str], right: str = "can_view") -> DataFrame:
    """The pairs for which a permission exists."""
    return pairs.join(permissions.filter(F.col(right)).select(*keys), keys, "left_semi")


def requestable(datasets: DataFrame, permissions: DataFrame, key: str, user: str, who, right: str = "can_view") -> DataFrame:
    """Datasets the user cannot see yet (keys are never null, so a plain anti join is enough)."""
    mine = permissions.filter((F.col(user) == who) & F.col(right)).select(key)
    return datasets.join(mine, key, "left_anti")


def counted(users: DataFrame, items: DataFrame, user_key: str, item_key: str, name: str) -> DataFrame:
    """Users with the number of their items, 0 when they have none; items are counted before the join."""
    n = items.groupBy(item_key).agg(F.count(F.lit(1)).alias(name))
    return (users.join(n, F.col(user_key) == F.col(item_key), "left").drop(item_key)
                 .withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint")))


# Datasets of one block, about.
BLOCK = 4096


def matrix(grants: DataFrame, user: str, datasets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(user, dataset, granted)`` for every user of ``grants`` and every row of ``datasets`` (one column, also in grants).

    The product of users and datasets is the result asked for. Datasets are dealt into blocks; every user meets each block by its
    number, next to those of the user's grants that lie in it, and writes a row per dataset of the block. So a row holds a block
    at most, however many datasets there are.
    """
    dataset = datasets.columns[0]
    blocks = F.lit(max(1, -(-datasets.distinct().count() // block)))
    number = F.pmod(F.xxhash64(dataset), blocks).cast("int").alias("_block")
    held = datasets.distinct().groupBy(number).agg(F.array_sort(F.collect_set(dataset)).alias("_all"))
    mine = grants.groupBy(user, number).agg(F.collect_set(dataset).alias("_mine"))
    users = grants.select(user).distinct().withColumn("_block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    told = users.join(mine.withColumnRenamed(user, "_user"), F.col(user).eqNullSafe(F.col("_user")) & (users["_block"] == mine["_block"]), "left").select(
        users[user], users["_block"], F.coalesce("_mine", F.array().cast(f"array<{datasets.schema[dataset].dataType.simpleString()}>")).alias("_mine"))
    return (told.join(held, "_block").withColumn(dataset, F.explode("_all"))
                .select(user, dataset, F.array_contains("_mine", F.col(dataset)).alias("granted")))
