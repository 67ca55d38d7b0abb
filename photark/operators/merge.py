"""Merging rows into a table under explicit conflict policies: each is a function of the two sides.

base and incoming have the same columns; keys tell rows apart and are unique on each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides' rows of each key as structs b and i; the absent one is null."""
    left = base.select(*[F.col(k).alias("b_" + k) for k in keys], F.struct(*base.columns).alias("b"))
    right = incoming.select(*[F.col(k).alias("i_" + k) for k in keys], F.struct(*base.columns).alias("i"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col("b_" + k) == F.col("i_" + k))
    return left.join(right, same, "full")


def choose(pairs: DataFrame, incoming_wins: Column) -> DataFrame:
    row = F.when(F.col("b").isNull(), F.col("i")).when(F.col("i").isNull(), F.col("b")).when(F.coalesce(incoming_wins, F.lit(False)), F.col("i")).otherwise(F.col("b"))
    return pairs.select(row.alias("row")).select("row.*")


def last_writer_wins(base: DataFrame, incoming: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The later row stays; of equal times the base's."""
    return choose(paired(base, incoming, keys), F.col(f"i.{at}") > F.col(f"b.{at}"))


def ignore(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return choose(paired(base, incoming, keys), F.lit(False))


def replace(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return choose(paired(base, incoming, keys), F.lit(True))


def coalesced(base: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Incoming rows; columns in keep have the base's value unless it is null. Rows that are not incoming go."""
    pairs = paired(base, incoming, keys).where("i is not null")
    return pairs.select(*[(F.coalesce(f"b.{c}", f"i.{c}") if c in keep else F.col(f"i.{c}")).alias(c) for c in base.columns])


def guarded(base: DataFrame, incoming: DataFrame, keys: list[str], locked: Column) -> DataFrame:
    """Incoming rows replace base rows, but not those that are locked (a condition on struct b)."""
    return choose(paired(base, incoming, keys), ~locked)


def replace_sets(base: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of a key that is incoming are replaced by its incoming rows."""
    given = incoming.select(F.col(key).alias("given")).distinct()
    return base.join(given, F.col(key) == F.col("given"), "left_anti").unionByName(incoming)


def union_sets(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows, and incoming rows of other keys."""
    known = base.select([F.col(k).alias("k_" + k) for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col("k_" + k))
    return base.unionByName(incoming.join(known, same, "left_anti"))


def merged_ratings(local: DataFrame, peer: DataFrame, key: str, rating: str, at: str) -> DataFrame:
    """Ratings after a peer's are merged: a later time wins, and a key that is absent here has time 0."""
    pairs = paired(local, peer, [key])
    newer = F.col(f"i.{at}") > F.coalesce(F.col(f"b.{at}"), F.lit(0))
    row = F.when(newer, F.col("i")).otherwise(F.col("b"))
    return pairs.select(row.alias("row")).where("row is not null").select(f"row.{key}", f"row.{rating}", f"row.{at}")
