"""Deduplication, quotas and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.functions import lexicons as L
from verdigris.functions import text as T
from verdigris.sources.shared import materialize


#: Parts of a type or side, each of which gives its best rows.
PARTS = 256


def best_of_group(df: DataFrame, type_column: str, query: str, id_column: str) -> DataFrame:
    """One record for each type and query key: the best judged, of equals the one with the smallest id."""
    kind = F.coalesce(F.nullif(T.strip(F.col(type_column)), F.lit("")), F.lit("unknown"))
    w = W.partitionBy("_type", "_key").orderBy(F.coalesce("judge_average", F.lit(0.0)).desc(), id_column)
    return df.withColumns({"_type": kind, "_key": T.query_key(F.col(query))}).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_type", "_key", "_n")


def quotas(df: DataFrame, type_column: str, target: int, floor: int = 5, share: float = 0.40) -> DataFrame:
    """type, n, quota: a floor for each type, the rest in proportion, a cap on the share of one type. One row a type."""
    sizes = df.groupBy(type_column).agg(F.count("*").alias("n"))
    totals = sizes.agg(F.sum("n").alias("_all"), F.sum(F.least(F.lit(floor), "n")).alias("_floors"))
    rest = F.greatest(F.lit(target) - F.col("_floors"), F.lit(0))
    quota = F.least(F.least(F.lit(floor), "n") + F.floor(rest * F.col("n") / F.col("_all")), F.lit(int(target * share)), F.col("n"))
    return sizes.crossJoin(F.broadcast(totals)).select(type_column, "n", quota.alias("quota"))  # totals is one row


def ranked(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Adds the rank of each row in its group, with no window over all rows of a group.

    Rows are range-partitioned by group and order; what earlier partitions hold of a group is the first rank less one in the next.
    The order must be total. Null groups are one group.
    """
    by = [F.col(group).asc(), *order]
    rows = materialize(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"))  # a row for each group and partition that holds some of it
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    first = sizes.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = rows.withColumn("_in", F.row_number().over(W.partitionBy(group, "_part").orderBy(*order)))
    joined = inside.join(first, inside[group].eqNullSafe(first["_group"]) & (F.col("_part") == F.col("_of")))
    return joined.withColumn(name, F.col("_before") + F.col("_in")).drop("_group", "_of", "_part", "_in", "_before")


def stratified(df: DataFrame, type_column: str, id_column: str, target: int, scenarios: list[str] | None = None, floor: int = 5, share: float = 0.40) -> DataFrame:
    """At most target records: each type's quota, one of each scenario first, then the best judged, no dialogue twice; gaps are filled from what is left.

    A dialogue that has several types is offered to the first of them (by smallest id), with its best record of that type, also for filling gaps.
    """
    scenarios = L.SCENARIOS if scenarios is None else scenarios
    best = [F.coalesce("judge_average", F.lit(0.0)).desc(), F.col(id_column)]
    q = quotas(df, type_column, target, floor, share)
    first_type = F.first(type_column).over(W.partitionBy("cid").orderBy(*best[1:]))
    offered = df.withColumn("_first", first_type)
    one = F.row_number().over(W.partitionBy("cid").orderBy((F.col(type_column) != F.col("_first")).cast("int"), *best))
    offered = offered.withColumn("_one", one)
    pool = offered.filter("_one = 1")
    first = F.struct((-F.coalesce("judge_average", F.lit(0.0))).alias("j"), F.col(id_column).alias("id"))
    leads = pool.filter(F.col("scenario").isin(scenarios)).groupBy(type_column, "scenario").agg(F.min(first)["id"].alias("_leader"))  # a row for each type and scenario
    pool = pool.join(F.broadcast(leads), [type_column, "scenario"], "left").withColumn("_lead", F.when(F.col("_leader") == F.col(id_column), 0).otherwise(1)).drop("_leader")
    # nothing behind the target in a part of its type can be chosen, so that a large type is never ranked in one task
    part = F.pmod(F.xxhash64(id_column), F.lit(PARTS))
    heads = pool.withColumn("_part", part).withColumn("_head", F.row_number().over(W.partitionBy(type_column, "_part").orderBy("_lead", *best))).filter(F.col("_head") <= target).drop("_part", "_head")
    ranked = heads.withColumn("_rank", F.row_number().over(W.partitionBy(type_column).orderBy("_lead", *best))).join(F.broadcast(q.select(type_column, "quota")), type_column)
    # quotas is one row a type; what is ranked behind its quota waits for gaps
    waiting = F.when(F.col("_rank") <= F.col("quota"), 0).otherwise(1)
    chosen = ranked.withColumn("_wait", waiting).orderBy("_wait", *best).limit(target)
    return chosen.withColumn("stage", F.when(F.col("_wait") == 0, "quota").otherwise("gap")).drop("_first", "_one", "_lead", "_rank", "quota", "_wait")


def balanced(df: DataFrame, side: str, id_column: str, n: int, used: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """n records of each side in a seeded random order, without those used before; a side that is short takes used ones after all."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_column)))
    out = df.withColumn("_used", F.lit(0))
    if used is not None:
        out = df.join(used.select(id_column).distinct().withColumn("_u", F.lit(1)), id_column, "left").withColumn("_used", F.coalesce("_u", F.lit(0))).drop("_u")
    for of in ((side, F.pmod(F.xxhash64(id_column), F.lit(PARTS))), (side,)):  # the first of each part, then the first of these
        out = out.withColumn("_n", F.row_number().over(W.partitionBy(*of).orderBy("_used", order, id_column))).filter(F.col("_n") <= n)
    return out.drop("_n", "_used")
