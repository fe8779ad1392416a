"""A join of rows with facts about their keys that holds when a few keys have most of the rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

#: A key with this share of all rows is a hot one; there can be no more than 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 4096


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row a key, null too) of their ``key``.

    ``count`` is the column of ``facts`` with the rows of a key; it is dropped. Rows of hot keys
    stay where they are and find their facts in a broadcast of at most 4096 rows. The others,
    of which no key has more than that share, are shuffled by key.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    hot = facts.where(F.col(count) >= total * HOT_SHARE)
    names = [c for c in facts.columns if c not in (key, count)]
    hot_facts = hot.select(F.col(key).alias("hot_key"), F.lit(True).alias("is_hot"), *[F.col(c).alias(f"hot_{c}") for c in names])
    marked = rows.join(F.broadcast(hot_facts), rows[key].eqNullSafe(hot_facts["hot_key"]), "left").drop("hot_key")
    settled = marked.where("is_hot").select(*rows.columns, *[F.col(f"hot_{c}").alias(c) for c in names])
    rest = marked.where("is_hot is null").select(*rows.columns)
    cold = facts.where(F.col(count) < total * HOT_SHARE).select(F.col(key).alias("cold_key"), *names)
    joined = rest.join(cold, rest[key].eqNullSafe(cold["cold_key"])).drop("cold_key")
    return functools.reduce(DataFrame.unionByName, [settled, joined])
