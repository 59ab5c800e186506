"""The catalog queries by name: (spark, sf_dir) -> DataFrame, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import track_queries
from .functions import names
from .functions import text as T
from .functions.pipeline import pipeline
from .operators import audit, candidates, health, matching, positions, state
from .operators import catalog as op
from .plans import changes as planning
from .plans import edits


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def library_summary(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.agg(
        F.count("*").alias("n_docs"),
        F.countDistinct(op.normalized(F.col("source"))).alias("n_sources"),
        F.countDistinct(op.normalized(F.col("lang"))).alias("n_langs"),
        F.count_if(op.normalized(F.col("text")) == "").alias("n_missing_text"),
        F.sum("n_chars").cast("long").alias("total_chars"),
    )


def tag_completeness(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    docs = _table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return op.completeness(docs, F.col("labelled").isNull())


def duplicate_members(spark, sf_dir):
    return op.duplicate_members(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"]).select("doc_id")


def search_contains_paged(spark, sf_dir):
    part = _table(spark, sf_dir, "part").filter(op.contains(F.col("p_name"), "red"))
    return op.page(part.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name"), ["p_partkey"], 20, 20)


def search_missing(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id").join(_table(spark, sf_dir, "labels"), "doc_id", "left_anti")


def scope_semi(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    customer = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"))
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


def scope_anti(spark, sf_dir):
    urgent = _table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    customer = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"))
    return customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def session_rollup(spark, sf_dir):
    said = F.when(F.col("role") == "user", F.struct("turn", "text"))
    return (
        _table(spark, sf_dir, "conversations").groupBy("conv_id")
        .agg(F.count("*").alias("n"), F.max("turn").cast("long").alias("last_turn"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.min(said).alias("first"))
        .select("conv_id", "n", "last_turn", "n_assistant", F.substring("first.text", 1, 200).alias("first_user"))
    )


def dataset_status(spark, sf_dir):
    return _table(spark, sf_dir, "events").agg(F.count("*").alias("total"), (F.count_if(F.col("event_type") == "purchase") > 0).alias("any_purchase"))


def number_by_rule_desc(spark, sf_dir):
    tracks = track_queries.track_table(spark, sf_dir).withColumn("folder", T.parent(F.col("path")))
    return planning.number_by_rule(tracks, ["folder"], "existing-desc").select("path", F.col("number").cast("long").alias("number"))


def latest_wins(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), "ts", "event_id", "event_type")
    return op.latest_wins(events, ["user_id"], ["ts", "event_id"], ["event_type"])


def patch_merge(spark, sf_dir):
    value = F.col("value").cast("string")
    events = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("field"), F.col("event_id").alias("ord"), (F.col("event_id") % 10).cast("string").alias("old_value"), F.when(value != "", F.col("event_id").cast("string")).alias("new_value"), F.when(F.col("event_id") % 3 == 0, "remove").otherwise("set").alias("operation"))
    return planning.merge_patches(events)


def top3_ranked(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    releases = orders.select(F.col("o_custkey").cast("long").alias("request_id"), F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("year"), F.lit(1997).alias("wanted_year"), F.col("o_orderkey").cast("string").alias("title"))
    return candidates.rank_releases(releases).select("request_id", "title", F.col("rank").cast("long").alias("rank"))


def position_join_unique(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_returnflag")
    keys = ["l_orderkey", "l_linenumber"]
    one, other = (op.unique_on(lines.filter(c).select(*keys), keys) for c in ("l_returnflag = 'R'", "l_returnflag <> 'R'"))
    return one.join(other, keys)


def band_join(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("p_size").cast("double").alias("p_size"))
    return op.band_pairs(part, "p_name", "p_partkey", "p_size")


RULES = [
    ("late_status", "warning", "o_orderstatus = 'O' AND o_totalprice > 100000"),
    ("high_price", "error", "o_totalprice > 400000"),
    ("pending", "info", "o_orderstatus = 'P'"),
]


def _findings(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").withColumn("o_orderkey", F.col("o_orderkey").cast("long")).withColumn("o_custkey", F.col("o_custkey").cast("long"))
    return op.findings(orders, RULES, ["o_orderkey", "o_custkey"])


def audit_rules(spark, sf_dir):
    return _findings(spark, sf_dir).select("o_orderkey", "rule", "severity")


def audit_findings(spark, sf_dir):
    """The audit's rules over tracks whose files tell number, artist and title."""
    tracks = positions.indexed(track_queries.track_table(spark, sf_dir))
    none, nones = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    rows = tracks.withColumns({"filename": T.basename(F.col("path")), "artists": nones, "album_artists": nones, "track_total": F.lit(None).cast("int"), "artist_hint": none, "album_hint": none, "disc_folder": none})
    return audit.audit_findings(rows).select("album_path", F.col("idx").cast("long").alias("idx"), "field", "status", "suggestion", "eligible")


def audit_rollup(spark, sf_dir):
    return op.finding_rollup(_findings(spark, sf_dir), "o_custkey")


def artist_split_explode(spark, sf_dir):
    credit = F.concat_ws(" feat. ", F.replace("p_name", F.lit(" "), F.lit(" & ")), "p_brand")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.explode(names.split_names(credit)).alias("name"))


def filename_facts(spark, sf_dir):
    tracks = track_queries.track_table(spark, sf_dir)
    name = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("2-"), T.basename(F.col("path")))).otherwise(T.basename(F.col("path")))
    return tracks.select("ord", T.file_facts(name).alias("f")).select("ord", "f.*")


def query_hash(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_name").alias("album"), F.lit(None).cast("string").alias("year"))
    return nation.select("n_nationkey", state.query_hash(["year", "album"]).alias("hash"))


def size_buckets(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy(edits.size_bucket(F.col("n_chars") * 50000).alias("bucket")).agg(F.count("*").alias("n"))


def sliding_600s(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return state.requests_in_window(events.withColumn("at", F.floor(F.col("us") / 1000000)), [], 601).select("event_id", "n")


def auto_number(spark, sf_dir):
    tracks = track_queries.track_table(spark, sf_dir).withColumn("album_artists", F.lit(None).cast("array<string>"))
    return planning.number_tracks(tracks).select("path", F.col("number").cast("long").alias("number"), F.col("total").cast("long").alias("total"), F.col("disc").cast("long").alias("disc"), F.col("discs").cast("long").alias("discs"))


def coalesce_by_priority(spark, sf_dir):
    def side(name: str, p: str, source: str) -> DataFrame:
        t = _table(spark, sf_dir, name)
        return t.select(
            F.col(f"{p}_nationkey").cast("long").alias("request_id"), F.col(f"{p}_name").alias("artist"), F.col(f"{p}_acctbal").alias("balance"),
            F.col(f"{p}_{'suppkey' if p == 's' else 'custkey'}").cast("long").alias("ord"), F.lit(source).alias("source"),
        )

    both = side("supplier", "s", "discogs").filter("balance > 5000").unionByName(side("customer", "c", "llm"))
    none = F.lit(None).cast("string")
    rows = both.withColumns({"year": F.when(F.col("balance") > 9000, F.floor("balance").cast("string")), "musicbrainz_album_id": none, "discogs_release_id": none})
    rows = rows.withColumn("ord", F.col("ord") * 2 + (F.col("source") == "llm").cast("long"))
    return candidates.merge_by_priority(rows, ["artist", "year"])


def _flags(spark, sf_dir, condition: str, eligible: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").filter(condition)
    return orders.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_orderstatus").alias("field"), F.expr(eligible).alias("eligible"))


def union_anti_merge(spark, sf_dir):
    ruled = _flags(spark, sf_dir, "o_totalprice > 100000", "o_totalprice > 300000").withColumn("origin", F.lit("rule"))
    reviewed = _flags(spark, sf_dir, "o_orderpriority = '1-URGENT'", "false").withColumn("origin", F.lit("review"))
    return audit.merge_findings(ruled, reviewed, ["o_orderkey", "field"])


PIPELINE = [("literal_replace", {"find": "red", "replacement": "RED"}), ("regex_replace", {"pattern": "[0-9]+", "replacement": ""}), ("trim", {}), ("title_case", {}), ("strip_prefix", {"text": "Red "})]


def pipeline_ops(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), pipeline(F.col("p_name"), PIPELINE).alias("r"))
    return part.select("p_partkey", "r.value", "r.changed")


def json_extract(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def month_buckets(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def health_rollup(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("l_suppkey"),
        (F.col("l_quantity") > 49).alias("unplayable"), F.when(F.col("l_returnflag") == "R", F.array(F.lit("resync"))).otherwise(F.array().cast("array<string>")).alias("repairs"),
        (F.col("l_discount") > 0.09).alias("alert"), (F.col("l_tax") > 0.07).alias("playable_failure"), F.lit(False).alias("warning"),
    )
    return health.rollup(lines.withColumn("bucket", health.bucket()), ["l_suppkey"])


def collision_suffix(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("ord"), "c_mktsegment")
    moves = customer.select(F.format_string("in/%d.flac", F.col("ord")).alias("source"), F.format_string("out/%s.flac", F.col("c_mktsegment")).alias("target"), "ord")
    return planning.with_suffixes(moves, moves.filter("false").select(F.col("target").alias("path")))


def metadata_patch(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "lang", "source")
    return planning.patch(docs, F.col("path").endswith("7"), {"lang": "en", "source": " "})


def changed_fields(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("path"), "o_orderstatus", F.col("o_orderpriority"))
    wanted = orders.withColumn("o_orderstatus", F.lit("F")).withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    fields = ["o_orderstatus", "o_orderpriority"]
    return planning.changes(planning.long_fields(wanted, ["path"], fields, "new_value"), planning.long_fields(orders, ["path"], fields, "old_value"), ["path", "field"])


def keyed_upsert(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k"), F.col("c_custkey").cast("long").alias("v"))
    supplier = _table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").cast("long").alias("k"), F.col("s_suppkey").cast("long").alias("v"))
    old, new = (t.groupBy("k").agg(F.max("v").alias("v")) for t in (customer, supplier))
    return state.upsert(old, new, ["k"])


def uniform_guard(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(F.concat_ws("/", F.col("l_suppkey"), F.col("l_orderkey")).alias("path"), F.col("l_returnflag").alias("field"), F.when(F.col("l_returnflag") == "A", "A").otherwise(F.col("l_linestatus")).alias("new_value"))
    return planning.uniform_literals(lines)


def grouped_tags(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").cast("long").alias("ord"), F.col("event_type").alias("key"), (F.col("event_id") % 7).cast("string").alias("value"))
    return state.grouped_tags(events)


def name_similarity(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.split("p_name", " ").alias("w"))
    return part.select("p_partkey", T.similarity(F.get("w", F.lit(0)), F.get("w", F.lit(1))).cast("long").alias("similarity"))


def nfkc_normalize(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.title_key(T.nfkc(F.col("text"))), 256).alias("title_key_sha256"))


def chinese_convert(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.simplified(F.col("text")), 256).alias("simplified_sha256"))


def greedy_match(spark, sf_dir):
    """Order lines as an album's tracks, matched with the parts' names of the same order."""
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part").withColumn("p_partkey", F.col("p_partkey").cast("long")), F.col("l_partkey") == F.col("p_partkey"))
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = lines.select(F.col("l_orderkey").alias("album_id"), (F.row_number().over(place) - 1).cast("long").alias("idx"), F.col("p_name").alias("title"), F.col("l_linenumber").cast("int").alias("track_number"), F.col("l_quantity").cast("double").alias("length"))
    null, nulls = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    local = rows.withColumns({"artist": null, "artists": nulls, "artist_hint": null, "filename": F.format_string("%02d. %s.flac", F.col("track_number"), F.col("title")), "disc_number": F.lit(None).cast("int"), "musicbrainz_track_id": null})
    remote = rows.filter("idx % 3 <> 2").withColumns({"source": F.lit("discogs"), "match_titles": nulls, "disc_number": F.lit(None).cast("int"), "recording_id": null})
    return matching.align_tracks(local, remote)


QUERIES = {
    f.__name__: f
    for f in (
        library_summary, tag_completeness, duplicate_members, search_contains_paged, search_missing, scope_semi, scope_anti, session_rollup,
        dataset_status, number_by_rule_desc, latest_wins, patch_merge, top3_ranked, position_join_unique, band_join, audit_rules, audit_findings, audit_rollup,
        artist_split_explode, filename_facts, query_hash, size_buckets, sliding_600s, auto_number, coalesce_by_priority, union_anti_merge, pipeline_ops,
        json_extract, month_buckets, health_rollup, collision_suffix, metadata_patch, changed_fields, keyed_upsert, uniform_guard, grouped_tags,
        name_similarity, nfkc_normalize, chinese_convert, greedy_match,
    )
}

_FOUND = """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, 'late_status' AS rule, 'warning' AS severity FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000
UNION ALL SELECT o_orderkey, o_custkey, 'high_price', 'error' FROM orders WHERE o_totalprice > 400000
UNION ALL SELECT o_orderkey, o_custkey, 'pending', 'info' FROM orders WHERE o_orderstatus = 'P'"""

ORACLE_SQL = {
    "library_summary": "SELECT count(*) AS n_docs, count(DISTINCT lower(trim(coalesce(source, '')))) AS n_sources, count(DISTINCT lower(trim(coalesce(lang, '')))) AS n_langs, count(*) FILTER (trim(coalesce(text, '')) = '') AS n_missing_text, CAST(sum(n_chars) AS BIGINT) AS total_chars FROM documents",
    "tag_completeness": "SELECT count(*) AS total, count(*) FILTER (l.doc_id IS NULL) AS missing, CAST(CASE WHEN count(*) = 0 THEN 100 ELSE round((count(*) - count(*) FILTER (l.doc_id IS NULL)) / count(*) * 100) END AS BIGINT) AS percent FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "duplicate_members": "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY lower(trim(coalesce(text, '')))) AS n FROM documents) WHERE n > 1",
    "search_contains_paged": "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') ORDER BY p_partkey LIMIT 20 OFFSET 20",
    "search_missing": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "scope_semi": "SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "scope_anti": "SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "session_rollup": "SELECT conv_id, count(*) AS n, CAST(max(turn) AS BIGINT) AS last_turn, count(*) FILTER (role = 'assistant') AS n_assistant, substr(arg_min(text, turn) FILTER (role = 'user'), 1, 200) AS first_user FROM conversations GROUP BY conv_id",
    "dataset_status": "SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') > 0 AS any_purchase FROM events",
    "number_by_rule_desc": f"WITH {track_queries._TRACKS} SELECT path, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY coalesce(track_number, -1) DESC, lower(regexp_extract(path, '[^/]*$')), path) AS number FROM t",
    "latest_wins": "SELECT CAST(user_id AS BIGINT) AS user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "patch_merge": "SELECT CAST(user_id AS VARCHAR) AS path, event_type AS field, CAST(min(event_id) % 10 AS VARCHAR) AS old_value, CAST(max(event_id) AS VARCHAR) AS new_value, CASE WHEN max(event_id) % 3 = 0 THEN 'remove' ELSE 'set' END AS operation FROM events GROUP BY user_id, event_type",
    "top3_ranked": "SELECT CAST(o_custkey AS BIGINT) AS request_id, CAST(o_orderkey AS VARCHAR) AS title, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'P' AND year(o_orderdate) = 1997 THEN 0 ELSE 1 END, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END DESC NULLS LAST, CAST(o_orderkey AS VARCHAR)) AS r FROM orders) WHERE r <= 3",
    "position_join_unique": "WITH a AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL HAVING count(*) = 1), b AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL HAVING count(*) = 1) SELECT CAST(a.l_orderkey AS BIGINT) AS l_orderkey, CAST(a.l_linenumber AS BIGINT) AS l_linenumber FROM a JOIN b USING (l_orderkey, l_linenumber)",
    "band_join": "SELECT a.p_name AS key, CAST(a.p_partkey AS BIGINT) AS left_id, CAST(b.p_partkey AS BIGINT) AS right_id FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey <> b.p_partkey WHERE abs(a.p_size - b.p_size) <= greatest(5.0, a.p_size * 0.03)",
    "audit_rules": f"SELECT o_orderkey, rule, severity FROM ({_FOUND})",
    "audit_findings": f"""WITH {track_queries._TRACKS}, i AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS album_path, ord % 90 + 10 AS number, regexp_extract(path, 'Brand#[0-9]+') AS fa, regexp_extract(path, ' - ([^/]*)[.]flac$', 1) AS ft,
row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY ord) - 1 AS idx, count(*) OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '')) AS n FROM t)
SELECT album_path, idx, 'title' AS field, 'error' AS status, ft AS suggestion, true AS eligible FROM i UNION ALL SELECT album_path, idx, 'artist', 'error', fa, true FROM i WHERE artist = ''
UNION ALL SELECT album_path, idx, 'trackNumber', 'error', CAST(number AS VARCHAR), true FROM i WHERE track_number IS DISTINCT FROM number UNION ALL SELECT album_path, idx, 'trackTotal', 'error', CAST(n AS VARCHAR), true FROM i WHERE track_number = number AND n > 1""",
    "chinese_convert": f"SELECT doc_id, sha256(translate(text, '{T.TRADITIONAL}', '{T.SIMPLIFIED}')) AS simplified_sha256 FROM documents",
    "nfkc_normalize": r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[\p{P}\p{S}]+', ' ', 'g'), '\s+', ' ', 'g'))) AS title_key_sha256 FROM documents",
    # The common subsequence by rows: a row's cell is the larger of the one above and of the best match up to it.
    "name_similarity": """WITH RECURSIVE p AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part WHERE contains(p_name, ' ')),
r AS (SELECT a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: 0::BIGINT) AS cells FROM p UNION ALL
SELECT a, b, i + 1, list_transform(range(0, len(b) + 1), lambda j: greatest(cells[j + 1], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: b[k:k] = a[i + 1:i + 1]), lambda k: cells[k] + 1)), 0))) FROM r WHERE i < len(a)),
s AS (SELECT a, b, (200 * cells[len(b) + 1] + (len(a) + len(b)) // 2) // (len(a) + len(b)) AS s FROM r WHERE i = len(a))
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(s AS BIGINT) AS similarity FROM part LEFT JOIN s ON s.a = string_split(p_name, ' ')[1] AND s.b = string_split(p_name, ' ')[2]""",
    "audit_rollup": f"SELECT o_custkey, count(*) AS n_findings, CAST(max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS max_rank, bool_or(severity = 'error') AS any_error FROM ({_FOUND}) GROUP BY o_custkey",
    "artist_split_explode": "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, unnest(list_distinct(list_append(string_split(p_name, ' '), p_brand))) AS name FROM part",
    "filename_facts": f"WITH {track_queries._TRACKS} SELECT ord, CAST(CASE WHEN ord % 3 = 0 THEN 2 END AS INT) AS disc, CAST(ord % 90 + 10 AS INT) AS track, regexp_extract(path, 'Brand#[0-9]+') AS artist, regexp_extract(path, ' - ([^/]*)[.]flac$', 1) AS title FROM t",
    "query_hash": """SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, sha256('{"album":"' || n_name || '","cache_version":4,"year":null}') AS hash FROM nation""",
    "size_buckets": "SELECT CASE WHEN n_chars * 50000 < 10485760 THEN 'small' WHEN n_chars * 50000 < 104857600 THEN 'medium' WHEN n_chars * 50000 < 1073741824 THEN 'large' ELSE 'huge' END AS bucket, count(*) AS n FROM documents GROUP BY 1",
    "sliding_600s": "SELECT event_id, count(*) OVER (ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS n FROM events",
    "auto_number": f"""WITH {track_queries._TRACKS}, k AS (SELECT path, track_number, greatest(coalesce(disc_number, 1), 1) AS disc, CASE WHEN trim(album) = '' THEN lower(regexp_replace(path, '/[^/]*$', '')) ELSE lower(coalesce(album_artist, '')) || '/' || lower(album) END AS k FROM t)
SELECT path, row_number() OVER (PARTITION BY k, disc ORDER BY track_number NULLS LAST, path) AS number, count(*) OVER (PARTITION BY k, disc) AS total, CAST(disc AS BIGINT) AS disc, CAST(max(disc) OVER (PARTITION BY k) AS BIGINT) AS discs FROM k""",
    "coalesce_by_priority": """WITH u AS (SELECT CAST(s_nationkey AS BIGINT) AS k, s_name AS name, s_acctbal AS b, s_suppkey * 2 AS ord, 'discogs' AS source FROM supplier WHERE s_acctbal > 5000
UNION ALL SELECT c_nationkey, c_name, c_acctbal, c_custkey * 2 + 1, 'llm' FROM customer),
y AS (SELECT *, CASE WHEN b > 9000 THEN CAST(CAST(floor(b) AS BIGINT) AS VARCHAR) END AS year FROM u)
SELECT k AS request_id, arg_min(source, (source = 'llm', ord)) AS source, arg_min(name, (source = 'llm', ord)) AS artist,
coalesce(arg_min(year, ord) FILTER (source = 'discogs' AND year IS NOT NULL), arg_min(year, ord) FILTER (year IS NOT NULL)) AS year FROM y GROUP BY k""",
    "union_anti_merge": """WITH a AS (SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus AS field, o_totalprice > 300000 AS eligible, 'rule' AS origin FROM orders WHERE o_totalprice > 100000),
b AS (SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus AS field, false AS eligible, 'review' AS origin FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT * FROM a WHERE eligible OR NOT EXISTS (SELECT 1 FROM b WHERE b.o_orderkey = a.o_orderkey AND b.field = a.field) UNION ALL SELECT * FROM b""",
    "pipeline_ops": """WITH t AS (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, trim(regexp_replace(regexp_replace(replace(p_name, 'red', 'RED'), '[0-9]+', '', 'g'), '\\s+', ' ', 'g')) AS v FROM part),
u AS (SELECT *, array_to_string(list_transform(string_split(v, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS c FROM t)
SELECT p_partkey, CASE WHEN starts_with(c, 'Red ') THEN c[5:] ELSE c END AS value, replace(p_name, 'red', 'RED') <> p_name OR regexp_matches(p_name, '[0-9]') OR c <> p_name AS changed FROM u""",
    "json_extract": "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events",
    "month_buckets": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1",
    "health_rollup": """WITH b AS (SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, CASE WHEN l_quantity > 49 THEN 'broken' WHEN l_returnflag = 'R' THEN 'minor' WHEN l_discount > CAST(0.09 AS DOUBLE) THEN 'broken' WHEN l_tax > CAST(0.07 AS DOUBLE) THEN 'medium' ELSE 'clean' END AS b FROM lineitem)
SELECT l_suppkey, count(*) AS total, count(*) FILTER (b = 'clean') AS clean, count(*) FILTER (b = 'minor') AS minor, count(*) FILTER (b = 'medium') AS medium, count(*) FILTER (b = 'broken') AS broken, count(*) FILTER (b <> 'clean') AS with_issues FROM b GROUP BY 1""",
    "collision_suffix": "SELECT 'in/' || c_custkey || '.flac' AS source, 'out/' || c_mktsegment || '.flac' AS target, 'out/' || c_mktsegment || CASE WHEN r = 0 THEN '' ELSE '_' || r END || '.flac' AS final FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS r FROM customer)",
    "metadata_patch": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, lang, source FROM documents WHERE CAST(doc_id AS VARCHAR) LIKE '%7')
SELECT path, 'lang' AS field, lang AS old_value, 'en' AS new_value, 'set' AS operation FROM d WHERE lang IS DISTINCT FROM 'en'
UNION ALL SELECT path, 'source', source, NULL, 'remove' FROM d WHERE source IS NOT NULL""",
    "changed_fields": """SELECT CAST(o_orderkey AS BIGINT) AS path, 'o_orderstatus' AS field, o_orderstatus AS old_value, 'F' AS new_value, 'set' AS operation FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority, NULL, 'remove' FROM orders WHERE o_orderpriority = '5-LOW'""",
    "keyed_upsert": """WITH n AS (SELECT CAST(s_nationkey AS BIGINT) AS k, CAST(max(s_suppkey) AS BIGINT) AS v FROM supplier WHERE s_acctbal > 9000 GROUP BY 1)
SELECT CAST(c_nationkey AS BIGINT) AS k, CAST(max(c_custkey) AS BIGINT) AS v FROM customer WHERE c_nationkey NOT IN (SELECT k FROM n) GROUP BY 1 UNION ALL SELECT * FROM n""",
    "uniform_guard": "SELECT l_returnflag AS field, count(DISTINCT l_suppkey || '/' || l_orderkey) AS n_paths, count(DISTINCT l_suppkey) AS n_folders FROM lineitem GROUP BY 1 HAVING count(DISTINCT CASE WHEN l_returnflag = 'A' THEN 'A' ELSE l_linestatus END) = 1 AND count(DISTINCT l_suppkey) > 1",
    "grouped_tags": "SELECT event_type AS key, CAST(event_id % 7 AS VARCHAR) AS value, count(DISTINCT user_id) AS n_paths FROM events GROUP BY 1, 2",
}

QUERIES |= track_queries.QUERIES
ORACLE_SQL |= track_queries.ORACLE_SQL
