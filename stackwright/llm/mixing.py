"""Mixing sources to target weights by a low-discrepancy schedule.

Sources in code-point order, null last, weigh 5, 2, 1, 5, 2, 1, ... and share the corpus' words; a target stops at
``MAX_EPOCHS`` times its source's words, and what it can't take is shared again by weight (water filling).

The schedule is a sequence of slots of ``block_words`` words. Slot n draws the golden-ratio point frac(n * phi), which
falls in one source's share of the cumulative targets; the r-th slot of a source takes the r-th block of that source's
shuffled word stream, starting over at its end. The stream is the source's documents in the order of a hash, cut into
blocks of equal words (the last one shorter). A source's last slot stops at the word where its target is reached, and
later slots of that source are void; slots that it still lacks when the schedule ends (a few) close it. So each source
gets its target to the word. Since targets are at most MAX_EPOCHS streams, no document is taken more than MAX_EPOCHS
times.

Scale: slots are ranked and words summed in two levels (within buckets of bounded size, then over bucket totals, a row
for thousands of documents), so a source that holds a third of all rows isn't one task's work. The tables per source, per bucket and per cell of the
cumulative weights are far smaller than the documents. Slots meet sources by a cell of the unit interval, blocks meet
documents by (source, block).

Null and empty texts have size 0 and are taken 0 times. An empty table, or one without words, gives no slots. A long
text spans as many blocks as it has words for. Documents with equal hashes go by doc_id; a null doc_id or source is a
value like any other. Rows that share a doc_id and source are one document of the schedule, whose words taken are shared out
by size, rounded down: such rows may lack a word each. Further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_SPACE, materialize, ranged, running, text_or_empty, unused

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 2048
#: Rows of a window partition on average, and cells of the unit interval in which slots look up their source.
BUCKET_ROWS = 1 << 13
CELLS = 1 << 12
GOLDEN = (math.sqrt(5) - 1) / 2


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size, the number of words."""
    spaced = F.trim(F.regexp_replace(text_or_empty(), WHITE_SPACE, " "))
    words = F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1
    return docs.select("doc_id", "source", F.when(spaced == "", 0).otherwise(words).cast("long").alias("size"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source_no, source, source_size, target, lower and upper: the share of the cumulative targets.

    Water filling: sources reach their limits in the order of limit over weight. At the k-th of them the filled words are
    the limits up to it and its level for all weight behind it; the last level not above the total is where to go on
    from. Sources are numbered and summed within ranges, then over the ranges' totals: none of it is one task's work.
    """
    sources = ranged(sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull()), "_null", "source")
    sources = running(sources, ["_null", "source"], source_no=F.lit(1)).withColumn("source_no", F.col("source_no").cast("long") - 1).drop("_part", "_null")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    limit = F.lit(max_epochs) * F.col("source_size")
    sources = sources.withColumn("weight", weight).withColumn("full_at", limit / F.col("weight"))
    filling = ranged(sources, "full_at", "source_no")
    total, all_weight = filling.agg(F.sum("source_size"), F.sum("weight")).first()
    total = total or 0
    filling = running(filling, ["full_at", "source_no"], limits=limit, weights=F.col("weight"))
    filled = F.col("limits") + (F.lit(all_weight or 0.0) - F.col("weights")) * F.col("full_at")
    reached = filling.filter(filled <= total).agg(F.max(F.struct("full_at", "source_no", "limits", "weights")).alias("r")).select("r.*").first()
    limits, behind = (reached["limits"] or 0, all_weight - (reached["weights"] or 0.0)) if all_weight else (0, 0.0)
    level = (total - limits) / behind if behind > 1e-9 else (reached["full_at"] if all_weight else 0.0)  # words for each unit of weight
    target = F.least(F.col("weight") * F.lit(float(level)), limit.cast("double"))
    shares = ranged(sources.withColumn("target", target).drop("full_at", "weight"), "source_no")
    all_targets = shares.agg(F.sum("target"), F.max("source_no")).first()
    shares = running(shares, ["source_no"], reached=F.col("target"))
    of_all = lambda x: x / F.lit(float(all_targets[0] or 1.0))
    lower = F.when(F.col("source_no") == 0, 0.0).otherwise(of_all(F.col("reached") - F.col("target")))
    upper = F.when(F.col("source_no") == F.lit(all_targets[1]), 1.0).otherwise(of_all(F.col("reached")))
    return materialize(shares.select("source_no", "source", "source_size", "target", lower.alias("lower"), upper.alias("upper")))


def golden_points(ids: Column) -> Column:
    """frac(id * phi), to 9 places up to 10 ** 13: the high and the low part of the id are multiplied apart."""
    high, low = F.floor(ids / (1 << 20)), ids % (1 << 20)
    part = high * F.lit((GOLDEN * (1 << 20)) % 1.0) + low * F.lit(GOLDEN)
    return part - F.floor(part)


def block_takes(spark, targets: DataFrame, total: int, n_sources: int, block_words: int) -> DataFrame:
    """source_no, block, taken: the words that the schedule takes from each block, per start of a repeat.

    Rows (source_no, block, full, cut): full counts the slots that take the whole block, cut is the words that the
    last slot takes from its start (0: none).
    """
    slots = math.ceil(total / block_words) + n_sources
    cells = targets.filter("upper > lower").select(
        "source_no", "source_size", "target", "lower", "upper",
        F.explode(F.sequence(F.floor(F.col("lower") * CELLS), F.least(F.floor(F.col("upper") * CELLS), F.lit(CELLS - 1)))).alias("cell"),
    )
    points = spark.range(slots).select("id", golden_points(F.col("id")).alias("u"))
    drawn = points.withColumn("cell", F.floor(F.col("u") * CELLS)).join(cells, "cell").filter("u >= lower AND u < upper")
    drawn = drawn.select("id", F.floor(F.col("id") / BUCKET_ROWS).alias("bucket"), "source_no", "source_size", "target")
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("source_no", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("source_no", "bucket").orderBy("id")) - 1 + F.col("before")
    ranked = drawn.join(counts.drop("n"), ["source_no", "bucket"]).select("source_no", "source_size", "target", rank.alias("rank"))
    # The sequence strays from a source's share by a few slots, growing as the logarithm: the missing ones close it.
    goal = F.floor(F.col("target") + 0.5).cast("long")
    a_stream, rest = F.ceil(F.col("source_size") / block_words), F.pmod(goal, F.col("source_size"))
    needed = F.floor(goal / F.col("source_size")) * a_stream + F.ceil(rest / block_words)
    drawn_slots = counts.groupBy("source_no").agg(F.sum("n").alias("drawn"))
    short = targets.filter("source_size > 0").join(drawn_slots, "source_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).withColumn("needed", needed)
    closing = short.filter("drawn < needed").select("source_no", "source_size", "target", F.explode(F.sequence("drawn", F.col("needed") - 1)).alias("rank"))
    ranked = ranked.unionByName(closing)
    blocks = F.ceil(F.col("source_size") / block_words)
    ranked = ranked.withColumn("block", F.pmod("rank", blocks)).withColumn("epoch", F.floor(F.col("rank") / blocks))
    words = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    left = F.floor(F.col("target") + 0.5).cast("long") - F.col("epoch") * F.col("source_size") - F.col("block") * block_words
    taken = F.least(words, left)
    return (
        ranked.withColumn("words", words).withColumn("taken", taken).filter("taken > 0")
        .groupBy("source_no", "block")
        .agg(F.count(F.when(F.col("taken") == F.col("words"), 1)).alias("full"), F.coalesce(F.max(F.when(F.col("taken") < F.col("words"), F.col("taken"))), F.lit(0)).alias("cut"))
    )


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken and ``source`` for each row of ``docs`` (doc_id, text, source).

    taken counts the words that the mix takes of the document, repeats included: whole copies, then the words up to
    where the source's last slot stops. Rows that repeat a doc_id in one source are mixed as one document of their
    joint size, and each reports its share.
    """
    spark = docs.sparkSession
    sized = materialize(sizes(docs))
    targets = source_targets(sized)
    total, n_sources = targets.agg(F.sum("source_size"), F.count("*")).first()
    numbered = targets.select("source_no", F.col("source").alias("_source"), "source_size", "target")
    rows = sized.join(numbered, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    if not total:
        return rows.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "source")
    buckets = max(1, math.ceil(sized.count() / BUCKET_ROWS))
    place = F.xxhash64("doc_id")
    stream = rows.select("source_no", "doc_id", "size", place.alias("place"), F.shiftrightunsigned(place, 33).alias("top"))
    stream = stream.withColumn("bucket", F.floor(F.col("top") * buckets / (1 << 31))).drop("top")
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = stream.groupBy("source_no", "bucket").agg(F.sum("size").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0)))
    # Documents of one (source, hash bucket): about BUCKET_ROWS at most, whatever a source holds.
    inner = Window.partitionBy("source_no", "bucket").orderBy("top", "place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    stream = stream.withColumn("top", F.shiftrightunsigned("place", 33)).withColumn("end", F.sum("size").over(inner))
    stream = stream.join(sums.drop("s"), ["source_no", "bucket"]).withColumn("end", F.col("end") + F.col("before")).withColumn("start", F.col("end") - F.col("size"))
    parts = stream.filter("size > 0").select(
        "source_no", "doc_id", "start", "end",
        F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))).alias("block"),
    )
    takes = block_takes(spark, targets, total, n_sources, block_words)
    begin, stop = F.col("block") * block_words, (F.col("block") + 1) * block_words
    whole = F.least("end", stop) - F.greatest("start", begin)
    cut = F.greatest(F.lit(0), F.least(F.col("end"), begin + F.col("cut")) - F.greatest("start", begin))
    taken = (
        parts.join(takes, ["source_no", "block"])
        .groupBy(F.col("source_no").alias("_no"), F.col("doc_id").alias("_doc"), F.col("start").alias("_start"))
        .agg(F.sum(F.col("full") * whole + cut).alias("taken"))
        .groupBy("_no", "_doc").agg(F.sum("taken").alias("_taken"))
    )
    repeated = rows.groupBy(F.col("source_no").alias("_n"), F.col("doc_id").alias("_d")).agg(F.sum("size").alias("_all"), F.count("*").alias("_rows"))
    share = F.when(F.col("_rows") == 1, F.col("_taken")).otherwise(F.floor(F.col("_taken") * F.col("size") / F.col("_all")))
    return (
        rows.join(repeated, (F.col("source_no") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
        .join(taken, (F.col("source_no") == F.col("_no")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce(share, F.lit(0)).cast("long").alias("taken"), "source")
    )


def take_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: whole copies as often as they are taken, then the first words of a last copy.

    ``mixed`` is mix_sources(docs); doc_ids are unique. A cut copy keeps the text up to the end of its last word.
    """
    doc, size, taken, part = (unused(f"_{n}", docs.columns) for n in ("doc", "size", "taken", "part"))
    plan = mixed.select(F.col("doc_id").alias(doc), F.col("size").alias(size), F.col("taken").alias(taken)).filter(F.col(taken) > 0)
    joined = docs.join(plan, F.col("doc_id").eqNullSafe(F.col(doc)))
    rest = F.col(taken) % F.col(size)
    copies = F.floor(F.col(taken) / F.col(size)).cast("int")
    first_words = F.array_join(F.slice(F.filter(F.split("text", WHITE_SPACE), lambda w: w != ""), 1, rest.cast("int")), " ")
    lengths = F.concat(F.array_repeat(F.lit(-1).cast("long"), copies), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    each = joined.withColumn(part, F.explode(lengths))
    cut = F.col(part) >= 0
    each = each.withColumn("text", F.when(cut, first_words).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        each = each.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return each.select(*docs.columns)
