"""Quality rules from cross-document line frequency (DataFrame functions only).

Lines are normalised (white space runs to one space, trimmed, lower case) and hashed to 64 bits. For each host the
number of distinct documents that hold a line is counted; a line is above its limit, and so boilerplate, if more than
``max_doc_fraction`` of its host's distinct documents hold it and ``min_documents`` at least (in a host of three texts,
every line stands in a third of them). Documents are rejected if a base rule fails or
if they are depleted: boilerplate holds more than ``max_removed_fraction`` of their words.

line_quality() returns the decisions; kept_texts() returns the kept documents without their boilerplate lines, and can
also count a line as boilerplate that more than a share of the distinct texts of the whole corpus hold: one that stands a
little below the fraction in each of many hosts. A share means the same at every size of the corpus.

Documents are distinct if their texts are: those with the same text count once, so that a group of exact copies (which exact deduplication reduces to one)
doesn't make its own lines look like boilerplate. Counting is a partial aggregation before the shuffle, so a line that
a third of all documents share costs one row per task; lines are looked up again by an equi-join that adaptive
execution can split. Whole texts are parsed once, into a narrow written table that all counts come from. Null text counts
as empty, null host is a host of its own, a line's repeats in one document count once; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, materialize, text_or_empty, unused

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOC_FRACTION = 0.10
MIN_DOCUMENTS = 10
MAX_REMOVED_FRACTION = 0.8
#: Of kept_texts() in the pipeline: the share of the distinct texts of the whole corpus that may hold a line.
MAX_LINE_FRACTION = 0.02


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WHITE_SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more, each word once."""
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )

    def starts(placed: Column) -> Column:
        again = F.filter(placed, lambda x, k: (x.h == F.get(placed, k - 1).h) | (x.h == F.get(placed, k + 1).h))
        return F.sort_array(F.transform(again, lambda x: x.i))

    def covered(starts: Column) -> Column:
        added = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
        return F.aggregate(added, F.lit(0).cast("long"), lambda total, n: total + n)

    def count(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, let(let(placed, starts), covered)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) >= 3, let(windows, count)).otherwise(F.lit(0).cast("long"))


def has_words(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, WHITE_SPACE, " ")))


def line_words(line: Column) -> Column:
    """Words of a normalised line."""
    return (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("long")


def text_features(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines): the features of a text.

    lines: (hash, words) of its normalised lines, in order; those without words are left out.
    """
    of_words = let(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(w).alias("repeats")),
    )

    def of_lines(lines: Column) -> Column:
        hashed = F.transform(lines, lambda x: let(normal_line(x), lambda n: F.struct(F.xxhash64(n).alias("hash"), line_words(n).alias("words"))))
        return F.struct((F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dup"), hashed.alias("hashed"))

    lines = let(F.filter(F.split(text, "\n"), has_words), of_lines)
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")
    whole = F.struct(of_words.alias("w"), lines.alias("l"), symbols.alias("s"))
    return let(whole, lambda x: F.struct(
        x["w"]["n"].alias("n_words"), x["w"]["chars"].alias("word_chars"), x["s"].alias("n_symbols"),
        x["l"]["dup"].alias("n_dup_lines"), x["w"]["repeats"].alias("n_repeat_words"), x["l"]["hashed"].alias("lines"),
    ))


def narrow_table(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_hash and the features of each row, written once: whole texts are read and parsed in one scan."""
    text = text_or_empty()
    one = docs.select("doc_id", F.col("source").alias("host"), F.xxhash64(text).alias("text_hash"), text_features(text).alias("f"))
    return materialize(one.select("doc_id", "host", "text_hash", "f.*"))


def lines_above_limits(features: DataFrame, max_doc_fraction: float, min_documents: int, max_line_documents: int | None = None) -> DataFrame:
    """_host and _line_hash of the lines of narrow_table() that too many documents hold.

    A line's limit is the larger of ``max_doc_fraction`` of its host's documents and one below ``min_documents``. With
    ``max_line_documents``, lines that more documents of the whole corpus hold are above limits in every host.
    """
    # Equal texts of a host are one document; hosts are few next to lines, but may be many, so they are joined by key.
    hosts = features.select("host", "text_hash").distinct().groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("host_docs"))
    held = features.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("line_hash")).distinct()
    counted = held.groupBy("host", "line_hash").agg(F.count("*").alias("line_docs"))
    limit = F.greatest(F.lit(float(min_documents - 1)), F.col("host_docs") * F.lit(max_doc_fraction))
    found = (
        counted.filter(F.col("line_docs") >= min_documents)
        .join(hosts, F.col("host").eqNullSafe(F.col("_host")))
        .filter(F.col("line_docs") > limit)
        .select(F.col("host").alias("_host"), F.col("line_hash").alias("_line_hash"))
    )
    if max_line_documents is None:
        return found
    anywhere = held.select("line_hash", "text_hash").distinct().groupBy("line_hash").agg(F.count("*").alias("n")).filter(F.col("n") > max_line_documents)
    everywhere = counted.join(anywhere.select("line_hash"), "line_hash", "left_semi").select(F.col("host").alias("_host"), F.col("line_hash").alias("_line_hash"))
    return found.unionByName(everywhere).distinct()


def fails_base(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _decided(features: DataFrame, removed: DataFrame, keys: list[str], max_removed_fraction: float) -> DataFrame:
    """``features`` with n_boilerplate_words, base_failed and kept; ``removed`` holds _removed words under ``_`` + keys."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    base_failed = fails_base(F.col("n_words"), F.col("n_repeat_words"))
    depleted = F.col("n_boilerplate_words") > F.lit(max_removed_fraction) * F.col("n_words")
    joined = features.join(removed, same, "left").withColumn("n_boilerplate_words", F.coalesce("_removed", F.lit(0)).cast("long"))
    return joined.withColumns({"base_failed": base_failed, "kept": ~base_failed & ~depleted}).drop(*[f"_{k}" for k in keys], "_removed")


def kept_texts(
    docs: DataFrame,
    max_doc_fraction: float = MAX_DOC_FRACTION,
    min_documents: int = MIN_DOCUMENTS,
    max_removed_fraction: float = MAX_REMOVED_FRACTION,
    max_line_documents: int | None = None,
    max_line_fraction: float | None = None,
) -> DataFrame:
    """``docs`` (text, source, any further columns) without rejected rows and without boilerplate lines.

    ``max_line_fraction`` limits lines by the whole corpus as ``max_doc_fraction`` does by hosts: it stands for
    ``max_line_documents`` of that share of all distinct texts, ``min_documents`` less one at least.

    The decision is that of line_quality(), but depends on a row's text and host only, so doc_ids may repeat or be null.
    The other lines stay as they are, in order; a text without boilerplate is unchanged. n_chars, if there, is set anew
    for changed texts.
    """
    host, key, gone, kept = (unused(f"_{n}", docs.columns) for n in ("host", "key", "gone", "kept"))
    with_id = docs if "doc_id" in docs.columns else docs.withColumn("doc_id", F.lit(None).cast("long"))
    texts = narrow_table(with_id).dropDuplicates(["host", "text_hash"])
    if max_line_fraction is not None:
        max_line_documents = max(min_documents - 1, int(max_line_fraction * texts.select("text_hash").distinct().count()))
    above = lines_above_limits(texts, max_doc_fraction, min_documents, max_line_documents)
    lines = texts.select("host", "text_hash", F.explode("lines").alias("line")).select("host", "text_hash", F.col("line.hash").alias("line_hash"), F.col("line.words").alias("line_words"))
    removed = (
        lines.join(above, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line_hash") == F.col("_line_hash")))
        .groupBy("host", "text_hash")
        .agg(F.sum("line_words").alias("_removed"), F.collect_set("line_hash").alias("_gone"))
        .select(F.col("host").alias("_host"), F.col("text_hash").alias("_text_hash"), "_removed", "_gone")
    )
    decided = _decided(texts.drop("lines", "doc_id"), removed, ["host", "text_hash"], max_removed_fraction)
    stays = materialize(decided.filter("kept").select(F.col("host").alias(host), F.col("text_hash").alias(key), F.col("_gone").alias(gone)))
    joined = docs.join(stays, F.col("source").eqNullSafe(F.col(host)) & (F.xxhash64(text_or_empty()) == F.col(key)))

    stay = lambda x: ~(has_words(x) & F.array_contains(F.col(gone), F.xxhash64(normal_line(x))))
    cut = F.array_join(F.filter(F.split(text_or_empty(), "\n"), stay), "\n")
    out = joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def line_quality(
    docs: DataFrame,
    max_doc_fraction: float = MAX_DOC_FRACTION,
    min_documents: int = MIN_DOCUMENTS,
    max_removed_fraction: float = MAX_REMOVED_FRACTION,
) -> DataFrame:
    """One row per document: base features, ``n_boilerplate_words``, ``base_failed`` and ``kept``.

    ``docs`` needs doc_id, text and source (the host); further columns are ignored. Rows that repeat a doc_id are judged
    each, as their text and host are.
    """
    features = narrow_table(docs)
    above = lines_above_limits(features, max_doc_fraction, min_documents)
    lines = features.select("host", "text_hash", "lines").dropDuplicates(["host", "text_hash"]).select("host", "text_hash", F.explode("lines").alias("line"))
    removed = (
        lines.select("host", "text_hash", F.col("line.hash").alias("line_hash"), F.col("line.words").alias("line_words"))
        .join(above, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line_hash") == F.col("_line_hash")))
        .groupBy(F.col("host").alias("_host"), F.col("text_hash").alias("_text_hash"))
        .agg(F.sum("line_words").alias("_removed"))
    )
    decided = _decided(features.drop("lines"), removed, ["host", "text_hash"], max_removed_fraction)
    return decided.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_boilerplate_words"
    )


#: The same rows as line_quality() over table documents.
SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY doc_id),
ln AS (SELECT doc_id, host, t, lower(trim(regexp_replace(unnest(ls), '[\x20\x09-\x0D]+', ' ', 'g'))) AS l FROM w),
cnt AS (SELECT host, l, count(DISTINCT t) AS n FROM ln GROUP BY host, l),
hosts AS (SELECT host, count(DISTINCT t) AS n FROM d GROUP BY host),
com AS (SELECT cnt.host, cnt.l FROM cnt JOIN hosts ON cnt.host IS NOT DISTINCT FROM hosts.host WHERE cnt.n >= 10 AND cnt.n > hosts.n * CAST(0.10 AS DOUBLE)),
rem AS (SELECT ln.doc_id, sum(length(ln.l) - length(replace(ln.l, ' ', '')) + 1) AS n FROM ln JOIN com ON ln.host IS NOT DISTINCT FROM com.host AND ln.l = com.l GROUP BY ln.doc_id),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(rem.n, 0) AS BIGINT) AS n_boilerplate_words
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN rem ON rem.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
        AND NOT n_boilerplate_words > CAST(0.8 AS DOUBLE) * n_words) AS kept,
       n_boilerplate_words
FROM f
"""
