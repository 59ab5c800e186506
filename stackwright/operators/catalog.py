"""Search, completeness, numbering, merging and audit operators: DataFrames in, DataFrames out, no Python on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Null as empty, trimmed, lower case: how names are compared."""
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def contains(text: Column, wanted: str) -> Column:
    """Case-insensitive substring; null behaves as empty."""
    return F.lower(F.coalesce(text, F.lit(""))).contains(wanted.lower())


def page(rows: DataFrame, order: list[str], offset: int = 0, limit: int = 20) -> DataFrame:
    """One page in a total order; the limit is held between 1 and 100."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))


def duplicate_members(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every row whose normalized keys occur more than once, blank ones too.

    Keys are counted after partial aggregation and joined back, so a key that very many rows share isn't one task's work.
    """
    keyed = rows.withColumn("_key", F.sha2(F.concat_ws("\0", *[normalized(F.col(k)) for k in keys]), 256))
    again = keyed.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("_key")
    return keyed.join(again, "_key", "left_semi").drop("_key")


def completeness(rows: DataFrame, missing: Column) -> DataFrame:
    """total, missing and the rounded percentage that is complete: 100 of nothing."""
    counted = rows.agg(F.count("*").alias("total"), F.count_if(missing).alias("missing"))
    share = F.when(F.col("total") == 0, 100).otherwise(F.round((F.col("total") - F.col("missing")) / F.col("total") * 100))
    return counted.withColumn("percent", share.cast("long"))


def latest_wins(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of the last row of each key; ``order`` is a total order within a key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def unique_on(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no other row has."""
    one = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n = 1").select(*keys)
    return rows.join(one, keys, "left_semi")


#: Rows of one key and band that are compared in one place; more are dealt out.
BLOCK_ROWS = 1024


def band_pairs(rows: DataFrame, key: str, id_column: str, size: str) -> DataFrame:
    """Pairs with equal key whose sizes differ by max(5, 3 % of the first's) at most.

    Sizes are dealt into bands no wider than any tolerance reaches, so a frequent key splits by size, and the rows of a band
    into blocks, so a frequent size splits, too. The second rows of one size and block are an array: a first row meets the
    array, sizes are compared once for all of it, and only then come the pairs. Work is pairs, not bytes: blocks go to all
    shuffle partitions, however small the rows are, and none is broadcast.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(F.col(key).alias("key"), F.col(id_column).alias("id"), F.col(size).alias("size")).filter("key IS NOT NULL AND id IS NOT NULL AND size IS NOT NULL")
    reach = F.greatest(F.lit(5.0), F.col("size") * 0.03)
    left = rows.select("key", F.col("id").alias("left_id"), F.col("size").alias("left_size"), reach.alias("reach"), F.explode(F.sequence(F.floor((F.col("size") - reach) / 5), F.floor((F.col("size") + reach) / 5))).alias("band"))
    right = rows.select("key", F.col("id").alias("right_id"), F.col("size").alias("right_size"), F.floor(F.col("size") / 5).alias("band"))
    frequent = right.groupBy("key", "band").agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK_ROWS)
    blocks = F.broadcast(frequent.select("key", "band", F.ceil(F.col("_n") / BLOCK_ROWS).alias("_blocks")))
    count = F.coalesce("_blocks", F.lit(1))
    left = left.join(blocks, ["key", "band"], "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).drop("_blocks")
    right = right.join(blocks, ["key", "band"], "left").withColumn("block", F.pmod(F.xxhash64("right_id"), count)).drop("_blocks")
    place = ["key", "band", "block"]
    packed = right.repartition(n, *place).groupBy(*place, "right_size").agg(F.collect_list("right_id").alias("right_ids"))
    near = F.abs(F.col("left_size") - F.col("right_size")) <= F.col("reach")
    both = left.repartition(n, *place).hint("merge").join(packed, place).filter(near)
    return both.select("key", "left_id", F.explode("right_ids").alias("right_id")).filter(F.col("left_id") != F.col("right_id"))


def findings(rows: DataFrame, rules: list[tuple[str, str, str]], keep: list[str]) -> DataFrame:
    """(rule, severity) of each rule whose condition (SQL text) holds, in one pass over the rows."""
    held = F.array(*[F.when(F.expr(c), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for rule, severity, c in rules])
    return rows.select(*keep, F.explode(F.filter(held, lambda x: x.isNotNull())).alias("f")).select(*keep, "f.rule", "f.severity")


def finding_rollup(found: DataFrame, key: str) -> DataFrame:
    """Findings of each key: how many, the gravest severity's rank, and whether any is an error."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    return found.groupBy(key).agg(F.count("*").alias("n_findings"), F.max(rank).cast("long").alias("max_rank"), F.bool_or(F.col("severity") == "error").alias("any_error"))
