"""File health: severity of diagnoses, their rollups, and what a resumed scan has still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.flac import NOT_FLAC

# Buckets, issues and their repairs, in the order in which a diagnosis lists them.
BUCKETS = ["clean", "minor", "medium", "broken"]
STRUCTURAL = {
    "vorbis": ("vorbis-length-mismatch", "fix-vorbis-length"),
    "audio": ("audio-sync-corrupted", "fix-audio-sync"),
    "gap": ("metadata-audio-gap", "fix-metadata-audio-gap"),
    "picture": ("corrupted-picture-tag", "fix-corrupted-picture-tag"),
    "chain": ("broken-metadata-chain", "fix-broken-metadata-chain"),
}
DECODED = {
    "alert": "strict-decode-failed",
    "probe_failed": "ffprobe-audio-probe-failed",
    "playable_failure": "strict-decode-invalid-playable",
    "warning": "strict-decode-warning",
    "unchecked": "strict-decode-unchecked",
}
PARSE_ERROR = "flac-parse-error"
ACTIONS = {"minor": "would_fix", "broken": "redownload"}


def bucket() -> Column:
    """Of columns unplayable, repairs (array), alert, playable_failure and warning; the first that holds decides."""
    return (
        F.when(F.col("unplayable"), "broken").when(F.size("repairs") > 0, "minor").when(F.col("alert"), "broken")
        .when(F.col("playable_failure") | F.col("warning"), "medium").otherwise("clean")
    )


def diagnose(files: DataFrame) -> DataFrame:
    """``files`` with flags (struct), issues, known_repairs, bucket and action.

    ``files``: facts of ``sources.flac.structure`` (error, mismatch, audio_sync_corrupted, metadata_audio_gap,
    corrupted_picture, broken_chain), and how decoders fared: strict_ran, strict_ok (null: not checked), strict_warning,
    playback_ok, probe_ok. A file that no decoder plays is judged by that alone, unless it isn't FLAC at all.
    """
    true = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))
    strict_failed = true(F.col("strict_ran") & ~F.col("strict_ok"))
    probe_failed, playback_failed = strict_failed & true(~F.col("probe_ok")), strict_failed & true(~F.col("playback_ok"))
    unplayable = probe_failed | playback_failed
    error = F.when(~unplayable | (F.col("error") == NOT_FLAC), F.col("error"))
    found = files.withColumns({"_error": error, "_strict": strict_failed, "_probe": probe_failed, "_unplayable": unplayable})
    sound, seen = F.col("_error").isNull(), F.col("_error").isNull() & ~F.col("_unplayable")
    structural = {
        "vorbis": seen & true(F.col("mismatch") > 0), "audio": seen & true("audio_sync_corrupted"), "gap": seen & true(F.col("metadata_audio_gap") > 0),
        "picture": seen & true("corrupted_picture"), "chain": seen & true("broken_chain"),
    }
    found = found.withColumn("flags", F.struct(*[v.alias(k) for k, v in structural.items()]))
    repairable = F.greatest(*[F.col(f"flags.{k}") for k in STRUCTURAL])
    playable = sound & F.col("_strict") & true("playback_ok") & ~F.col("_probe") & ~repairable
    decoded = {
        "alert": sound & F.col("_strict") & (~playable | F.col("_probe")), "probe_failed": sound & F.col("_probe"), "playable_failure": playable,
        "warning": sound & true("strict_warning"), "unchecked": sound & true(F.col("strict_ran") & F.col("strict_ok").isNull()), "unplayable": sound & F.col("_unplayable"),
    }
    found = found.withColumn("flags", F.struct(*[F.col(f"flags.{k}").alias(k) for k in STRUCTURAL], *[v.alias(k) for k, v in decoded.items()]))
    flag = lambda k: F.col(f"flags.{k}")
    named = lambda pairs: F.array_compact(F.array(*[F.when(flag(k), v) for k, v in pairs]))
    chain, broken_parse = STRUCTURAL["chain"], ~sound & true("broken_chain")
    issues = named([(k, v[0]) for k, v in STRUCTURAL.items()] + list(DECODED.items()))
    unparsed = F.array(F.when(broken_parse, chain[0]).otherwise(PARSE_ERROR))
    repairs = F.when(broken_parse, F.array(F.lit(chain[1]))).otherwise(named([(k, v[1]) for k, v in STRUCTURAL.items()]))
    found = found.withColumns({"issues": F.when(sound, issues).otherwise(unparsed), "known_repairs": repairs})
    judged = (
        F.when(~sound | flag("unplayable"), "broken").when(F.size("known_repairs") > 0, "minor").when(flag("alert"), "broken")
        .when(flag("playable_failure") | flag("warning"), "medium").otherwise("clean")
    )
    found = found.withColumn("bucket", judged)
    action = F.coalesce(*[F.when(F.col("bucket") == b, a) for b, a in ACTIONS.items()], F.lit("none"))
    return found.withColumn("action", action).drop("_error", "_strict", "_probe", "_unplayable")


def _counted(tests: dict[str, Column]) -> list[Column]:
    return [F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in tests.items()]


def statistics(results: DataFrame, by: list[str]) -> DataFrame:
    """Counters of checked files by ``by`` (nothing: one row), as a scan reports them.

    ``results``: bucket, flags (of the last diagnosis), found (flags before repairs: vorbis, audio, chain), outcome (null,
    ``fixed``, ``unresolved`` or ``failed``), diagnosis_error and missing_result. A file without a result is an error and broken.
    """
    there, flag = ~F.coalesce("missing_result", F.lit(False)), lambda k: F.col(f"flags.{k}")
    tried = F.col("outcome").isin("fixed", "unresolved")
    bucket = F.when(there, F.col("bucket")).otherwise("broken")
    return results.groupBy(*by).agg(
        F.count("*").alias("total"), *_counted({"ok": there & (F.col("bucket") == "clean")} | {b: bucket == b for b in BUCKETS}),
        *_counted({
            "vorbis_mismatch": there & flag("vorbis"), "audio_corrupted": there & flag("audio"), "strict_decode_failed": there & flag("alert"),
            "strict_decode_warnings": there & (flag("warning") | flag("playable_failure")), "playable_strict_decode_failures": there & flag("playable_failure"),
            "strict_decode_unchecked": there & flag("unchecked"), "fixed_vorbis": there & tried & F.col("found.vorbis"), "fixed_audio": there & tried & F.col("found.audio"),
            "fixed_chain": there & tried & F.col("found.chain"), "fixed": there & tried, "fix_failed": there & F.col("outcome").isin("unresolved", "failed"),
            "errors": ~there | F.col("diagnosis_error") | (F.col("outcome") == "failed"),
        }),
    )


def artist_statistics(results: DataFrame) -> DataFrame:
    """Of each artist whose files have results: files, those with issues, and what is wrong with them."""
    flag = lambda k: F.col(f"flags.{k}")
    return results.filter(~F.coalesce("missing_result", F.lit(False))).groupBy("artist").agg(
        F.count("*").alias("total_files"), *_counted({
            "files_with_issues": F.col("bucket") != "clean", "vorbis_mismatch": flag("vorbis"), "audio_corrupted": flag("audio"), "metadata_gap": flag("gap"),
            "corrupted_picture": flag("picture"), "broken_chain": flag("chain"), "strict_decode_failed": flag("alert"),
            "strict_decode_warnings": flag("warning") | flag("playable_failure"), "playable_strict_decode_failures": flag("playable_failure"), "errors": F.col("diagnosis_error"),
        }),
    )


def results_of_files(files: DataFrame, results: DataFrame) -> DataFrame:
    """Every file (rel, ...) with its result, whose path may be spelt in another Unicode form; missing_result says there is none.

    ``results``: rel, ord, and a result's columns. A result is known under its own spelling and both canonical forms; of
    several under one spelling the last counts (``ord``, then the path in the order of bytes). A file looks for its own
    spelling first, then for the composed, then for the decomposed form.
    """
    spellings = lambda c: F.array_distinct(F.array(F.col(c), T.nfc(F.col(c)), T.nfd(F.col(c))))
    fields = [c for c in results.columns if c not in ("rel", "ord")]
    keyed = results.withColumn("_keys", spellings("rel")).select(F.explode("_keys").alias("_key"), "rel", "ord", F.struct(*fields).alias("_result"))
    last = keyed.groupBy("_key").agg(F.max_by("_result", F.struct("ord", "rel")).alias("_result"))
    wanted = files.withColumn("_keys", spellings("rel")).select("rel", F.posexplode("_keys").alias("_rank", "_key"))
    found = wanted.join(last, "_key").groupBy("rel").agg(F.min_by("_result", "_rank").alias("_result"))
    both = files.join(found, "rel", "left")
    return both.select(*files.columns, *[F.col(f"_result.{c}").alias(c) for c in fields], F.col("_result").isNull().alias("missing_result"))


def identity(rel: Column, top: Column) -> Column:
    """struct(artist, album, track) by the depth of a relative path; ``top`` is the scanned folder's path."""
    parts = F.filter(F.split(rel, "/"), lambda p: p != "")
    n, root = F.size(parts), F.filter(F.split(top, "/"), lambda p: p != "")
    named = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    artist = F.when(n >= 3, F.get(parts, F.lit(0))).when(n == 2, F.try_element_at(root, F.lit(-1))).otherwise(F.try_element_at(root, F.lit(-2)))
    album = F.when(n >= 3, F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), " / ")).when(n == 2, F.get(parts, F.lit(0))).otherwise(F.try_element_at(root, F.lit(-1)))
    return F.struct(named(artist, "Unknown Artist").alias("artist"), named(album, "Unknown Album").alias("album"), F.try_element_at(parts, F.lit(-1)).alias("track"))


def latest_results(batches: DataFrame) -> DataFrame:
    """The last result of each file; ``batches``: rel, batch_id, and result columns."""
    rest = [c for c in batches.columns if c not in ("rel", "batch_id")]
    return batches.groupBy("rel").agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select("rel", "r.*")


def unprocessed(files: DataFrame, results: DataFrame) -> DataFrame:
    return files.join(results.select("rel"), "rel", "left_anti")


def diagnoses(files: DataFrame, results: DataFrame) -> DataFrame:
    """Every file with its bucket; a file without a result is broken."""
    found = results.select("rel", "bucket", F.lit(True).alias("_there"))
    return files.join(found, "rel", "left").withColumn("bucket", F.coalesce("bucket", F.lit("broken"))).withColumn("missing_result", F.col("_there").isNull()).drop("_there")


def rollup(diagnosed: DataFrame, by: list[str]) -> DataFrame:
    """Files in each bucket, all files and files with issues by ``by`` (nothing: one row)."""
    counts = [F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS]
    return diagnosed.groupBy(*by).agg(F.count("*").alias("total"), *counts, F.count_if(F.col("bucket") != "clean").alias("with_issues"))


def report(diagnosed: DataFrame) -> DataFrame:
    """By artist and album, those without issues left out: artists with broken files first, then by issues."""
    rows = rollup(diagnosed, ["artist", "album"]).filter("with_issues > 0")
    artists = rows.groupBy("artist").agg(F.sum("broken").alias("_b"), F.sum("with_issues").alias("_i"))
    return rows.join(artists, "artist").orderBy((F.col("_b") > 0).desc(), F.desc("_i"), "artist", "album").drop("_b", "_i")
