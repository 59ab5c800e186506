"""Moves of files as an ordered plan: nothing is overwritten, swaps go through a side name, and each step can be undone.

A move whose target another move still occupies has to wait for it. With one move for each source and each target, what
waits for what is made of chains, which are carried out from their free end on, and of rings, of which one file steps
aside first and takes its place last. Places in chains and rings come from doubling pointers: joins on a file's name,
as many as the longest chain has binary digits, however many files move; no group is gathered anywhere.

Names are compared as they are. ``problems`` tells what forbids a set of moves; a plan is only made of sets without any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import written

#: What follows a name while its file is aside.
ASIDE = ".moving-aside"


def problems(moves: DataFrame, files: DataFrame, root: Column) -> DataFrame:
    """(source, target, problem) of moves (source, target) that can't be carried out, one row for each problem.

    ``files`` (path): what exists. Problems: ``missing_source``, ``repeated_source``, ``repeated_target``, ``occupied``
    (the target exists and doesn't move away), ``outside`` (either end isn't below ``root``), ``same``.
    """
    there = files.select(F.col("path").alias("_path")).distinct()
    sources = moves.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("_n_sources"))
    targets = moves.groupBy(F.col("target").alias("_target")).agg(F.count("*").alias("_n_targets"))
    found = (
        moves.join(sources, F.col("source") == F.col("_source")).join(targets, F.col("target") == F.col("_target"))
        .join(there.withColumnRenamed("_path", "_old"), F.col("source") == F.col("_old"), "left")
        .join(there.withColumnRenamed("_path", "_new"), F.col("target") == F.col("_new"), "left")
        .join(sources.select(F.col("_source").alias("_leaves")), F.col("target") == F.col("_leaves"), "left")
    )
    outside = ~(T.inside(F.col("source"), root) & T.inside(F.col("target"), root))
    tests = {
        "missing_source": F.col("_old").isNull(), "repeated_source": F.col("_n_sources") > 1, "repeated_target": F.col("_n_targets") > 1,
        "occupied": F.col("_new").isNotNull() & F.col("_leaves").isNull(), "outside": outside, "same": F.col("source") == F.col("target"),
    }
    named = F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))
    return found.select("source", "target", F.explode(named).alias("problem"))


def _followed(steps: DataFrame) -> DataFrame:
    """``steps`` (name, next) with distance, end and least: how far the last name is, which it is, and the least on the way.

    Rings have no end: their rows keep a next name, and least is the least name of the ring.
    """
    end = F.when(F.col("next").isNull(), F.col("name")).otherwise(F.col("next"))
    now = written(steps.select("name", "next", F.col("next").isNotNull().cast("long").alias("distance"), end.alias("end"), F.least("name", F.coalesce("next", "name")).alias("least")))
    state = None
    while True:
        held = now.agg(F.count("next"), F.sum(F.xxhash64("name", "least").cast("decimal(38,0)"))).first()
        if not held[0] or held == state:
            return now
        state = held
        on = now.select(F.col("name").alias("_name"), F.col("next").alias("_next"), F.col("distance").alias("_distance"), F.col("end").alias("_end"), F.col("least").alias("_least"))
        both = now.join(on, F.col("next") == F.col("_name"), "left")
        went = F.col("_name").isNotNull()
        now = written(
            both.select(
                "name", F.when(went, F.col("_next")).alias("next"), (F.col("distance") + F.when(went, F.col("_distance")).otherwise(0)).alias("distance"),
                F.coalesce("_end", "end").alias("end"), F.least("least", F.coalesce("_least", "least")).alias("least"),
            )
        )


def plan(moves: DataFrame) -> DataFrame:
    """(chain, rank, source, target): the steps of ``moves`` (source, target), which have no problems.

    Steps of one chain go by rank, chains don't wait for each other. A ring has one step more than files.
    """
    rows = moves.select("source", "target")
    taken = rows.select(F.col("source").alias("_source"))
    steps = written(rows.join(taken, F.col("target") == F.col("_source"), "left").select(F.col("source").alias("name"), F.col("_source").alias("next"), "target"))
    followed = _followed(steps.select("name", "next"))
    chains = followed.filter("next IS NULL").select("name", F.col("end").alias("chain"), F.col("distance").alias("rank"))
    straight = steps.join(chains, "name").select("chain", "rank", F.col("name").alias("source"), "target")
    # The least name of a ring steps aside; those that wait for it come at once after that, it itself comes last.
    rings = written(steps.join(followed.filter("next IS NOT NULL").select("name", F.col("least").alias("chain")), "name"))
    opened = rings.select("name", F.when(F.col("next") != F.col("chain"), F.col("next")).alias("next"))
    places = _followed(opened).select("name", (F.col("distance") + 1).alias("rank"))
    aside = F.concat(F.col("chain"), F.lit(ASIDE))
    source = F.when(F.col("name") == F.col("chain"), aside).otherwise(F.col("name"))
    turned = rings.join(places, "name").select("chain", "rank", source.alias("source"), "target")
    stepped = rings.filter("name = chain").select("chain", F.lit(0).cast("long").alias("rank"), F.col("chain").alias("source"), aside.alias("target"))
    return straight.unionByName(turned).unionByName(stepped)


def undone(steps: DataFrame, results: DataFrame) -> DataFrame:
    """The steps that take back what was done of ``steps`` if any failed; nothing if none did.

    ``results``: chain, rank, done (boolean). What was done last is undone first.
    """
    done = steps.join(results.filter("done").select("chain", "rank"), ["chain", "rank"])
    if results.filter(~F.col("done")).isEmpty():
        done = done.filter("false")
    return done.select("chain", (-F.col("rank")).alias("rank"), F.col("target").alias("source"), F.col("source").alias("target"))
