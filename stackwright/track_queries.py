"""Queries of the operators on tracks, over a track table that is derived from ``part``, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import arguments, lyrics, names, patterns, routing, scripts
from .functions import text as T
from .functions.pipeline import pipeline
from .operators import candidates, health, positions, rollups, scopes, state, titles
from .plans import changes, edits, moves
from .sources import tags
from .streaming import sessions

#: Fixed values of the derived table: the same expressions serve both engines.
TRACK_COLUMNS = {
    "ord": "CAST(p_partkey AS BIGINT)",
    "path": "'/music/' || p_brand || '/' || p_type || '/' || CAST(p_partkey % 90 + 10 AS VARCHAR(9)) || '. ' || p_brand || ' - ' || p_name || ' (' || CAST(p_partkey AS VARCHAR(20)) || ').flac'",
    "title": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END",
    "artist": "CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_brand END",
    "album": "CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE p_type END",
    "album_artist": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END",
    "genre": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE split_part(p_name, ' ', 1) END",
    "year": "CAST(1980 + p_size AS VARCHAR(9))",
    "codec": "CASE WHEN p_size > 25 THEN 'FLAC' ELSE 'MP3' END",
    "has_cover": "CASE WHEN p_partkey % 4 = 0 THEN false WHEN p_partkey % 4 = 1 THEN NULL ELSE true END",
    "track_number": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END",
    "disc_number": "CASE WHEN p_partkey % 3 = 0 THEN 2 END",
    "disc_total": "CASE WHEN p_partkey % 9 = 0 THEN 2 END",
    "size_bytes": "CAST(p_retailprice * 60000 AS BIGINT)",
    "duration": "p_retailprice",
    "bitrate": "CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END",
}
_TRACKS = "t AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in TRACK_COLUMNS.items()) + " FROM part)"
#: In SQL: a path's folder and name, and whether a text is missing.
_FOLDER, _NAME = "regexp_replace(path, '/[^/]*$', '')", "regexp_extract(path, '[^/]*$')"
_MISSING = "(trim(coalesce({}, '')) = '')"

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None, tracks: bool = True):
    """Registers a query with its SQL; ``tracks``: the SQL is over the derived table ``t``."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            with_tracks = f"WITH {_TRACKS}, {body[5:]}" if body.startswith("WITH ") else f"WITH {_TRACKS} {body}"
            ORACLE_SQL[f.__name__] = with_tracks if tracks else body
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def track_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {c}" for c, e in TRACK_COLUMNS.items()])


def _files(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("album_path", T.parent(F.col("path")))


# Scopes and filters


@query(f"SELECT ord FROM t WHERE contains(lower(coalesce(title, '')), 'red') AND codec = 'FLAC' AND {_MISSING.format('genre')}")
def tracks_search(spark, sf_dir):
    return track_table(spark, sf_dir).filter(scopes.search(title="RED", codec="flac", missing=("genre",))).select("ord")


@query("SELECT ord FROM t WHERE has_cover = false AND year = '1990'")
def tracks_without_cover(spark, sf_dir):
    return track_table(spark, sf_dir).filter(scopes.search(year="1990", missing_cover=True)).select("ord")


@query("SELECT ord FROM t WHERE starts_with(path, '/music/Brand#1')")
def scope_album_prefix(spark, sf_dir):
    return track_table(spark, sf_dir).filter(scopes.of_album_prefix("/music/Brand#1")).select("ord")


@query("SELECT ord FROM t WHERE starts_with(path, '/music/Brand#1/')")
def scope_folder_components(spark, sf_dir):
    """A folder by whole parts, with a step up in its path; Brand#10 isn't below Brand#1."""
    return track_table(spark, sf_dir).filter(scopes.of_folder("/music/x/../Brand#1")).select("ord")


@query("SELECT ord FROM t WHERE starts_with(path, '/music/Brand#2/')")
def scope_listed_folder(spark, sf_dir):
    return track_table(spark, sf_dir).filter(scopes.of_listed_folder("\\music\\Brand#2/")).select("ord")


@query(f"SELECT ord FROM t WHERE {_MISSING.format('album')} AND starts_with(path, '/music/Brand#3')")
def scope_album_and_missing(spark, sf_dir):
    return track_table(spark, sf_dir).filter(scopes.missing_in("album", "/music/Brand#3")).select("ord")


@query(f"SELECT ord FROM t WHERE {_MISSING.format('genre')}")
def scope_referent(spark, sf_dir):
    return track_table(spark, sf_dir).filter(scopes.referent("show tracks with Missing genre", "genre")).select("ord")


@query(f"SELECT ord FROM t WHERE {_FOLDER} = '/music/Brand#4/ECONOMY'")
def scope_active_album(spark, sf_dir):
    return scopes.active(track_table(spark, sf_dir), None, "/music/Brand#4/ECONOMY").select("ord")


@query("SELECT ord, CAST(10000 - ord AS BIGINT) AS wanted_ord FROM t WHERE ord % 17 = 3")
def scope_explicit_paths(spark, sf_dir):
    tracks = track_table(spark, sf_dir)
    wanted = tracks.filter("ord % 17 = 3").select("path", (10000 - F.col("ord")).alias("ord"))
    gone = wanted.limit(1).select(F.lit("/nowhere").alias("path"), F.lit(0).cast("long").alias("ord"))
    return scopes.explicit(tracks, wanted.unionByName(gone)).select("ord", "wanted_ord")


@query("SELECT path, CASE WHEN ord % 34 = 3 THEN 'duplicate' ELSE 'unknown' END AS problem FROM (SELECT CASE WHEN ord % 34 = 3 THEN path ELSE path || '?' END AS path, ord FROM t WHERE ord % 17 = 3)")
def scope_problems(spark, sf_dir):
    tracks = track_table(spark, sf_dir)
    asked = tracks.filter("ord % 17 = 3").withColumn("path", F.when(F.col("ord") % 34 == 3, F.col("path")).otherwise(F.concat("path", F.lit("?"))))
    return scopes.scope_errors(tracks, asked.unionByName(asked.filter("ord % 34 = 3")))


@query(f"SELECT {_FOLDER} AS path, min(ord) AS ord FROM t WHERE ord % 5 = 1 GROUP BY 1")
def explicit_album_paths(spark, sf_dir):
    tracks = track_table(spark, sf_dir)
    return scopes.album_paths(tracks.filter("ord % 5 = 1"), tracks)


@query("""WITH a AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM t), i AS (SELECT path, count(*) AS n FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS path FROM t WHERE ord % 3 = 0) GROUP BY 1)
SELECT a.path, i.n FROM a LEFT JOIN i USING (path)""")
def album_info_lookup(spark, sf_dir):
    files = _files(track_table(spark, sf_dir))
    info = files.filter("ord % 3 = 0").groupBy(F.col("album_path").alias("path")).agg(F.count("*").alias("n"))
    return scopes.with_album_info(files.select(F.col("album_path").alias("path")).distinct(), info)


@query("SELECT ord FROM t WHERE contains(lower(coalesce(title, '')), 'brand#7') OR contains(lower(coalesce(artist, '')), 'brand#7') OR contains(lower(coalesce(album, '')), 'brand#7') OR contains(lower(substr(path, 2)), 'brand#7')")
def grid_filter(spark, sf_dir):
    return track_table(spark, sf_dir).filter(scopes.grid_text("BRAND#7")).select("ord")


@query("SELECT ord, row_number() OVER (ORDER BY coalesce(track_number, 999) DESC, ord) AS place FROM t ORDER BY place LIMIT 50")
def grid_sort(spark, sf_dir):
    """The first rows of the grid as it is sorted, with their places."""
    first = scopes.grid_sorted(track_table(spark, sf_dir), "track", ascending=False).limit(50)
    return first.groupBy().agg(F.array_sort(F.collect_list(F.struct(-F.coalesce("track_number", F.lit(999)), F.col("ord")))).alias("x")).select(F.posexplode("x").alias("p", "s")).select(F.col("s.ord").alias("ord"), (F.col("p") + 1).cast("long").alias("place"))


@query("SELECT event_id FROM events WHERE contains(lower(event_type), 'cl') OR contains(CAST(user_id % 10 AS VARCHAR), 'cl') OR contains(lower('Tag'), 'cl')", tracks=False)
def extra_tag_filter(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("key"), (F.col("user_id") % 10).cast("string").alias("value"), F.lit("Tag").alias("source"))
    return rows.filter(scopes.extra_tag_text(" CL ")).select("event_id")


@query("SELECT DISTINCT event_type AS key FROM events WHERE lower(event_type) NOT IN ('click', 'view') AND contains(upper(event_type), 'R') ORDER BY key LIMIT 8", tracks=False)
def extra_key_suggestions(spark, sf_dir):
    known = _table(spark, sf_dir, "events").select(F.col("event_type").alias("key")).distinct().withColumn("ord", F.col("key"))
    return scopes.key_suggestions(known, known.filter("key IN ('click', 'view')").withColumn("key", F.upper("key")), "r")


@query("SELECT ord FROM t WHERE contains(lower(title), 'blue')")
def release_title_filter(spark, sf_dir):
    return track_table(spark, sf_dir).filter(scopes.release_title("BLUE")).select("ord")


@query("SELECT ord FROM t WHERE ord % 50 = 1 OR album IS NULL OR contains(trim(regexp_replace(lower(album), '[^a-z0-9]+', ' ', 'g')), 'economy') OR contains('economy', trim(regexp_replace(lower(album), '[^a-z0-9]+', ' ', 'g')))")
def candidate_album_filter(spark, sf_dir):
    rows = track_table(spark, sf_dir).withColumn("musicbrainz_album_id", F.when(F.col("ord") % 50 == 1, "x"))
    return rows.filter(scopes.fits_album(F.lit("ECONOMY"), F.lit("x"))).select("ord")


@query("SELECT ord, CAST(CASE WHEN ord % 3 = 0 THEN 0 WHEN ord % 3 = 1 THEN 1 ELSE 2 END AS INT) AS side FROM t WHERE ord % 10 <> 0")
def candidate_pool(spark, sf_dir):
    rows = track_table(spark, sf_dir).select("ord", F.when(F.col("ord") % 10 == 0, "dataset").otherwise("folder").alias("source"))
    return scopes.pool(*[rows.filter(F.col("ord") % 3 == k) for k in range(3)]).select("ord.ord", "ord.side")


@query("""SELECT folder AS album_path, CAST(CASE WHEN n2 = n - n2 AND n2 > 0 THEN n2 ELSE n END AS INT) AS n FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS n, count(*) FILTER (disc_number = 2) AS n2 FROM t GROUP BY 1)""")
def disc_scoped_tracks(spark, sf_dir):
    albums = _files(track_table(spark, sf_dir)).groupBy("album_path").agg(F.collect_list(F.struct("ord", "disc_number")).alias("tracks"), F.count_if(F.coalesce(F.col("disc_number") != 2, F.lit(True))).alias("local"))
    return albums.select("album_path", F.size(scopes.of_disc(F.col("tracks"), F.lit(2), F.col("local").cast("int"))).alias("n"))


@query("SELECT ord FROM t WHERE ord % 11 <> 0 OR (ord % 5 <> 0) OR ord % 3 = 0")
def writable_rows(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = track_table(spark, sf_dir).withColumns({"artist": none, "artists": F.array().cast("array<string>"), "track_total": F.lit(None).cast("int"), "musicbrainz_track_id": none})
    return rows.filter(scopes.is_writable()).select("ord")


@query("""WITH f AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS album_path FROM t), i AS (SELECT *, row_number() OVER (PARTITION BY album_path ORDER BY ord) - 1 AS idx FROM f),
g AS (SELECT album_path, count(DISTINCT lower(genre)) AS n FROM f WHERE genre <> '' GROUP BY 1)
SELECT i.album_path, i.idx, 'title' AS field FROM i WHERE ord % 4 = 0 UNION ALL SELECT i.album_path, i.idx, 'genre' FROM i LEFT JOIN g USING (album_path) WHERE genre IS NULL OR coalesce(g.n, 0) > 1""")
def review_targets(spark, sf_dir):
    rows = positions.indexed(track_table(spark, sf_dir)).withColumn("idx", F.col("idx").cast("long"))
    findings = rows.select("album_path", "idx", F.lit("title").alias("field"), (F.col("ord") % 4 != 0).alias("eligible"))
    return scopes.review_targets(findings, rows)


@query("SELECT ord, CASE WHEN ord % 4 = 0 THEN list_filter(list_transform(string_split(coalesce(title, '') || '; x;', ';'), lambda v: trim(v)), lambda v: v <> '') END AS list, CAST(CASE WHEN ord % 4 = 1 THEN ord END AS INT) AS number, CASE WHEN ord % 4 = 2 THEN true END AS flag, CASE WHEN ord % 4 = 3 THEN coalesce(title, '') || '; x;' END AS text FROM t")
def typed_values(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("artists", "trackNumber", "compilation", "title"))), (F.col("ord") % 4 + 1).cast("int"))
    text = F.when(F.col("ord") % 4 == 1, F.concat(F.lit(" "), F.col("ord").cast("string"))).when(F.col("ord") % 4 == 2, " TRUE").otherwise(F.concat(F.coalesce("title", F.lit("")), F.lit("; x;")))
    return track_table(spark, sf_dir).select("ord", scopes.typed_value(kind, text).alias("v")).select("ord", "v.*")


@query("SELECT c_custkey, lower(regexp_replace(trim(c_mktsegment), '[ _]+', ' ', 'g')) IN ('machinery') AS found FROM (SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_mktsegment FROM customer)", tracks=False)
def compilation_folders(spark, sf_dir):
    named = F.when(F.col("c_mktsegment") == "MACHINERY", " Various__ARTISTS ").otherwise(F.col("c_mktsegment"))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), names.is_compilation(named).alias("found"))


@query("SELECT ord, (album IS NULL OR artist = '' OR ord % 3 = 0 OR ord % 4 = 0) AS ambiguous FROM t")
def ambiguous_hints(spark, sf_dir):
    rows = track_table(spark, sf_dir)
    path = F.when(F.col("ord") % 3 == 0, "/m/A [x] FLAC").otherwise("/m/A [FLAC]")
    album = F.when(F.col("ord") % 4 == 0, "2001-A").otherwise(F.col("album"))
    return rows.select("ord", names.is_ambiguous(album, F.col("artist"), path, F.lit(None).cast("string")).alias("ambiguous"))


# Pages and orders


@query("SELECT ord FROM t ORDER BY ord LIMIT 500 OFFSET 30")
def inspect_page(spark, sf_dir):
    return scopes.page_of(track_table(spark, sf_dir), ["ord"], "inspect", 30, 9999).select("ord")


@query("SELECT count(*) AS total, CASE WHEN count(*) > 130 THEN CAST(130 AS BIGINT) END AS next_offset FROM t")
def search_page_facts(spark, sf_dir):
    return scopes.page_facts(track_table(spark, sf_dir), "search", 30, 9999)


@query("SELECT ord FROM t ORDER BY ord LIMIT 10 OFFSET 20")
def release_page(spark, sf_dir):
    return scopes.release_page(track_table(spark, sf_dir), ["ord"], 3, 10).select("ord")


@query("SELECT count(*) > 30 AS has_next, CAST(greatest(1, ceil(count(*) / 10)) AS BIGINT) AS pages FROM t")
def release_page_facts(spark, sf_dir):
    return scopes.release_page_facts(track_table(spark, sf_dir), 3, 10)


@query("SELECT genre, list_sort(list(DISTINCT year))[1:5] AS examples, CAST(greatest(0, count(DISTINCT year) - 5) AS BIGINT) AS more FROM t WHERE genre IS NOT NULL GROUP BY genre")
def preview_examples(spark, sf_dir):
    return scopes.preview_examples(track_table(spark, sf_dir).filter("genre IS NOT NULL"), ["genre"], "year")


@query("SELECT conv_id, max(conv_id * 1000 + turn) AS last_id FROM conversations GROUP BY conv_id ORDER BY last_id DESC LIMIT 20", tracks=False)
def session_list(spark, sf_dir):
    log = _table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return scopes.latest_sessions(log, 20)


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 20", tracks=False)
def undo_stack(spark, sf_dir):
    return scopes.undo_stack(_table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("ord"))).select("event_id")


# Positions


@query("""WITH f AS (SELECT ord, path, regexp_replace(path, '/[^/]*$', '') AS album_path FROM t), i AS (SELECT *, row_number() OVER (PARTITION BY album_path ORDER BY ord) - 1 AS idx FROM f)
SELECT album_path, idx, path FROM i WHERE idx IN (0, 3, 200)""")
def findings_to_tracks(spark, sf_dir):
    tracks = track_table(spark, sf_dir)
    found = _files(tracks).select("album_path").distinct().withColumn("idx", F.explode(F.array(*map(F.lit, (0, 3, 200)))))
    return positions.findings_on_tracks(found, tracks).select("album_path", F.col("idx").cast("long").alias("idx"), "path")


@query("""WITH f AS (SELECT ord, path, regexp_replace(path, '/[^/]*$', '') AS album_path FROM t), i AS (SELECT *, row_number() OVER (PARTITION BY album_path ORDER BY ord) - 1 AS idx FROM f)
SELECT path, CASE WHEN idx < 5 THEN 'title ' || idx END AS title FROM i""")
def candidate_by_position(spark, sf_dir):
    files = positions.indexed(track_table(spark, sf_dir)).select("album_path", "idx", "path")
    candidate = files.filter("idx < 5").select("album_path", "idx", F.concat(F.lit("title "), F.col("idx").cast("string")).alias("title"))
    return positions.candidates_on_files(candidate, files).select("path", "title")


@query(f"SELECT ord, CASE WHEN {_MISSING.format('artist')} AND ord % 5 <> 0 THEN 'A' || ord ELSE artist END AS artist, coalesce(genre, CASE WHEN ord % 5 <> 0 THEN 'G' END) AS genre FROM t")
def track_gap_fill(spark, sf_dir):
    none = F.lit(None).cast("string")
    target = track_table(spark, sf_dir).select("ord", "artist", F.array().cast("array<string>").alias("artists"), none.alias("musicbrainz_track_id"), F.lit(None).cast("double").alias("length"), "genre")
    source = target.filter("ord % 5 <> 0").withColumns({"artist": F.concat(F.lit("A"), F.col("ord").cast("string")), "genre": F.lit("G")})
    return positions.fill_gaps(target, source, ["ord"]).select("ord", "artist", "genre")


@query("""WITH x AS (SELECT CAST(l_orderkey AS BIGINT) AS k, l_linenumber - 1 AS i FROM lineitem), fine AS (SELECT k FROM x GROUP BY k HAVING count(*) = count(DISTINCT i) AND min(i) = 0 AND max(i) = count(*) - 1)
SELECT k, count(*) AS n FROM x WHERE k IN (SELECT k FROM fine) GROUP BY k""", tracks=False)
def contiguous_answers(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("k"), (F.col("l_linenumber") - 1).alias("i"))
    return positions.contiguous(rows, "k", "i").groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT ord, 'title' AS field FROM t WHERE NOT (ord % 3 = 0 AND title IS NOT NULL)")
def unresolved_targets(spark, sf_dir):
    targets = track_table(spark, sf_dir).select("ord", F.lit("title").alias("field"), "title")
    return positions.unresolved(targets, targets.filter("ord % 3 = 0 AND title IS NOT NULL"), ["ord", "field"]).select("ord", "field")


@query("""WITH f AS (SELECT ord AS idx, regexp_replace(path, '/[^/]*$', '') AS album_path FROM t), o AS (SELECT album_path, idx, idx % 2 = 0 AS fixed FROM f WHERE album_path LIKE '%ECONOMY' AND idx % 3 = 0),
n AS (SELECT album_path, idx, idx % 5 = 0 AS fixed FROM f WHERE idx % 4 = 0)
SELECT o.album_path, o.idx, 'title' AS field, coalesce(n.fixed, o.fixed) AS auto_fixed FROM o LEFT JOIN n USING (album_path, idx)
UNION ALL SELECT album_path, idx, 'title', fixed FROM n WHERE album_path NOT IN (SELECT album_path FROM o)""")
def audit_state_merge(spark, sf_dir):
    rows = _files(track_table(spark, sf_dir)).select("album_path", F.col("ord").alias("idx"), F.lit("title").alias("field"))
    old = rows.filter("album_path LIKE '%ECONOMY' AND idx % 3 = 0").withColumn("auto_fixed", F.col("idx") % 2 == 0)
    return positions.merge_audit(old, rows.filter("idx % 4 = 0").withColumn("auto_fixed", F.col("idx") % 5 == 0))


@query("SELECT CAST(c_nationkey AS BIGINT) AS k, CASE WHEN min(side) = 1 THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT c_nationkey, 1 AS side FROM customer WHERE c_acctbal > 9990 UNION ALL SELECT DISTINCT s_nationkey, 2 FROM supplier WHERE s_acctbal > 5000) GROUP BY 1 HAVING count(*) = 1", tracks=False)
def set_difference(spark, sf_dir):
    left = _table(spark, sf_dir, "customer").filter("c_acctbal > 9990").select(F.col("c_nationkey").cast("long").alias("k"))
    return positions.set_difference(left, _table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").cast("long").alias("k")), ["k"])


def _chosen(spark, sf_dir) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").cast("long").alias("album_id"), F.when(F.col("l_returnflag") != "N", F.col("l_linenumber").cast("long")).alias("remote_idx"))


@query("SELECT DISTINCT l_orderkey AS album_id, CAST(l_linenumber AS BIGINT) AS remote_idx FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber AND b.l_returnflag <> 'N')", tracks=False)
def unused_remote_tracks(spark, sf_dir):
    remote = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("album_id"), F.col("l_linenumber").cast("long").alias("remote_idx")).distinct()
    return positions.unused_remote(remote, _chosen(spark, sf_dir))


@query("SELECT l_orderkey AS album_id, CAST(l_linenumber AS BIGINT) AS remote_idx, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2 HAVING count(*) > 1", tracks=False)
def remote_chosen_twice(spark, sf_dir):
    return positions.chosen_twice(_chosen(spark, sf_dir))


@query("SELECT event_id FROM (SELECT event_id, event_type AS s, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id % 50 ORDER BY event_id)) WHERE s = a AND s = b", tracks=False)
def repeated_calls(spark, sf_dir):
    calls = _table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("session"), F.col("event_id").alias("ord"), F.col("event_type").alias("signature"))
    return positions.repeated_calls(calls).select(F.col("ord").alias("event_id"))


@query("SELECT user_id % 100 AS batch_id, max(event_id) AS created FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) = 'click'", tracks=False)
def pending_batches(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("batch_id"), F.col("event_id").alias("created"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "pending").otherwise("done").alias("status"))
    return positions.pending(log)


# Rollups


@query("""SELECT count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS n_albums, count(*) AS n_tracks, count(DISTINCT nullif(lower(trim(artist)), '')) AS n_artists, count(DISTINCT nullif(lower(trim(genre)), '')) AS n_genres,
count(*) FILTER (trim(coalesce(title, '')) = '') AS missing_title, count(*) FILTER (trim(coalesce(artist, '')) = '') AS missing_artist, count(*) FILTER (trim(coalesce(album, '')) = '') AS missing_album,
count(*) FILTER (trim(coalesce(genre, '')) = '') AS missing_genre, count(*) FILTER (trim(coalesce(year, '')) = '') AS missing_year, round(sum(size_bytes) / 1048576, 1) AS megabytes, CAST(round(sum(duration) / 60) AS BIGINT) AS minutes FROM t""")
def library_facts(spark, sf_dir):
    return rollups.library_facts(track_table(spark, sf_dir))


def _results(spark, sf_dir) -> DataFrame:
    rows = _files(track_table(spark, sf_dir))
    status = F.element_at(F.array(*map(F.lit, ("correct", "warning", "error"))), (F.col("ord") % 3 + 1).cast("int"))
    return rows.select(F.col("album").alias("path"), "album_path", (F.col("ord") % 20).alias("idx"), status.alias("status"), (F.col("ord") % 4 == 0).alias("auto_fixed"), (F.col("ord") % 2 == 0).alias("eligible"))


_RESULTS = "r AS (SELECT album AS path, regexp_replace(path, '/[^/]*$', '') AS album_path, ord % 20 AS idx, CAST(ord % 3 AS INT) AS rank, ord % 4 = 0 AS fixed, ord % 2 = 0 AS eligible FROM t)"


@query(f"WITH {_RESULTS} SELECT count(DISTINCT album_path) AS albums, count(*) AS results, count(*) FILTER (rank > 0) AS issues FROM r")
def audit_totals(spark, sf_dir):
    return rollups.audit_totals(_results(spark, sf_dir))


@query(f"WITH {_RESULTS} SELECT path, count(*) AS n, CASE max(CASE WHEN fixed THEN 0 ELSE rank END) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'correct' END AS highest, max(CASE WHEN fixed THEN 0 ELSE rank END) > 0 AS manual, count(*) FILTER (fixed) AS fixed FROM r GROUP BY path")
def audit_by_track(spark, sf_dir):
    return rollups.audit_by_track(_results(spark, sf_dir))


@query(f"WITH {_RESULTS} SELECT album_path, idx, count(*) FILTER (eligible AND NOT fixed) AS fixable, count(*) FILTER (rank > 0 AND NOT eligible AND NOT fixed) AS manual, count(*) AS results FROM r GROUP BY 1, 2")
def audit_groups(spark, sf_dir):
    return rollups.audit_groups(_results(spark, sf_dir))


@query("SELECT regexp_replace(path, '/[^/]*$', '') AS album, count(DISTINCT lower(genre)) AS n_genres FROM t WHERE genre <> '' GROUP BY 1 HAVING count(DISTINCT lower(genre)) > 1")
def genre_conflicts(spark, sf_dir):
    return rollups.genre_conflicts(_files(track_table(spark, sf_dir)).withColumn("album", F.col("album_path")))


@query(" UNION ".join(f"SELECT '{c}' AS field, {c} AS value FROM t WHERE {c} <> ''" for c in rollups.BATCH_FIELDS) + " UNION SELECT 'disc', CASE WHEN disc_total IS NULL THEN CAST(disc_number AS VARCHAR) ELSE disc_number || '/' || disc_total END FROM t WHERE disc_number IS NOT NULL")
def batch_suggestions(spark, sf_dir):
    return rollups.batch_suggestions(track_table(spark, sf_dir))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, count(DISTINCT coalesce({c}, '')) AS n_values FROM t WHERE ord % 11 = 2" for c in rollups.BATCH_FIELDS) + ") WHERE n_values > 1")
def differing_fields(spark, sf_dir):
    return rollups.differing_fields(track_table(spark, sf_dir).filter("ord % 11 = 2"))


@query("""WITH w AS (SELECT path, 'MOOD' AS key, genre AS value FROM t WHERE genre IS NOT NULL AND ord % 3 = 0 UNION SELECT path, 'SOURCE', 'cd' FROM t), c AS (SELECT path, 'MOOD' AS key, genre AS value FROM t WHERE genre IS NOT NULL UNION SELECT path, 'SOURCE', 'cd' FROM t WHERE ord % 2 = 0)
SELECT path, key, value, 'set' AS operation FROM (SELECT * FROM w EXCEPT SELECT * FROM c) UNION ALL SELECT path, key, value, 'remove' FROM (SELECT * FROM c EXCEPT SELECT * FROM w)""")
def extra_tag_delta(spark, sf_dir):
    tracks = track_table(spark, sf_dir)
    mood = tracks.filter("genre IS NOT NULL").select("path", F.lit("mood").alias("key"), F.concat("genre", F.lit(" ")).alias("value"), "ord")
    current = mood.drop("ord").unionByName(tracks.filter("ord % 2 = 0").select("path", F.lit("Source").alias("key"), F.lit("cd").alias("value")))
    return rollups.extra_tag_delta(tracks.select("path"), mood.drop("ord"), [("source", "cd")], mood.filter("ord % 3 <> 0").drop("ord"), current)


def _checked(spark, sf_dir) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    some = lambda test: F.when(test, F.array(F.lit("resync"))).otherwise(F.array().cast("array<string>"))
    rows = lines.select(
        F.col("l_suppkey").cast("string").alias("artist"), F.col("l_shipmode" if "l_shipmode" in lines.columns else "l_returnflag").alias("album"), (F.col("l_quantity") > 49).alias("unplayable"),
        some(F.col("l_returnflag") == "R").alias("repairs"), some(F.col("l_linestatus") == "F").alias("known_repairs"), (F.col("l_discount") > 0.09).alias("alert"), (F.col("l_tax") > 0.07).alias("playable_failure"),
        (F.col("l_linenumber") > 6).alias("warning"), (F.col("l_quantity") > 48).alias("missing_result"), F.when(F.col("l_linenumber") == 1, "repaired").when(F.col("l_linenumber") == 2, "failed").when(F.col("l_linenumber") == 3, "skipped").alias("action"),
    )
    return rows.withColumn("bucket", health.bucket())


_CHECKED = """c AS (SELECT CAST(l_suppkey AS VARCHAR) AS artist, l_returnflag AS album, l_quantity, l_linestatus, l_linenumber, l_discount > CAST(0.09 AS DOUBLE) AS alert, l_tax > CAST(0.07 AS DOUBLE) AS playable,
CASE WHEN l_quantity > 49 THEN 'broken' WHEN l_returnflag = 'R' THEN 'minor' WHEN l_discount > CAST(0.09 AS DOUBLE) THEN 'broken' WHEN l_tax > CAST(0.07 AS DOUBLE) OR l_linenumber > 6 THEN 'medium' ELSE 'clean' END AS b FROM lineitem)"""


#: What a scan found, derived from order lines by expressions that both engines read.
SCANNED = {
    "rel": "CAST(l_orderkey AS VARCHAR(20)) || '/' || CAST(l_linenumber AS VARCHAR(20)) || '.flac'",
    "artist": "CAST(l_suppkey AS VARCHAR(20))",
    "error": "CASE WHEN l_quantity = 1 THEN 'not a valid FLAC file' WHEN l_quantity = 2 THEN 'Vorbis comment block too corrupted to parse' END",
    "broken_chain": "l_quantity IN (3, 4) OR (l_quantity = 2 AND l_linestatus = 'F')",
    "mismatch": "CASE WHEN l_linenumber = 1 AND l_quantity > 30 THEN 8 ELSE 0 END",
    "audio_sync_corrupted": "l_linenumber = 2 AND l_quantity > 40",
    "metadata_audio_gap": "CASE WHEN l_linenumber IN (1, 3) AND l_quantity > 42 THEN 64 ELSE 0 END",
    "corrupted_picture": "CASE WHEN l_linenumber = 4 THEN l_quantity > 35 END",
    "strict_ran": "l_tax > CAST(0.005 AS DOUBLE)",
    "strict_ok": "CASE WHEN l_tax > CAST(0.055 AS DOUBLE) THEN false WHEN l_tax > CAST(0.015 AS DOUBLE) THEN true END",
    "strict_warning": "l_tax > CAST(0.015 AS DOUBLE) AND l_tax < CAST(0.025 AS DOUBLE)",
    "playback_ok": "CASE WHEN l_tax > CAST(0.055 AS DOUBLE) AND l_discount < CAST(0.085 AS DOUBLE) THEN l_discount < CAST(0.055 AS DOUBLE) END",
    "probe_ok": "CASE WHEN l_tax > CAST(0.065 AS DOUBLE) THEN l_discount < CAST(0.035 AS DOUBLE) END",
    "missing_result": "l_quantity = 50",
    "diagnosis_error": "l_quantity = 49",
    "outcome": "CASE WHEN l_quantity < 45 AND (l_linenumber <= 4 OR l_quantity IN (3, 4)) THEN CASE l_orderkey % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'failed' END END",
}
_SCANNED = "s AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in SCANNED.items()) + " FROM lineitem)"
#: The rules of a diagnosis in SQL, from the checks outwards.
_DIAGNOSED = f"""{_SCANNED}, u AS (SELECT *, coalesce(strict_ran AND NOT strict_ok, false) AS failed FROM s),
v AS (SELECT *, failed AND coalesce(NOT probe_ok, false) AS bad_probe, failed AND (coalesce(NOT probe_ok, false) OR coalesce(NOT playback_ok, false)) AS unplayable FROM u),
w AS (SELECT *, error IS NULL OR (unplayable AND error <> 'not a valid FLAC file') AS sound FROM v),
x AS (SELECT *, sound AND NOT unplayable AND mismatch > 0 AS vorbis, sound AND NOT unplayable AND audio_sync_corrupted AS audio, sound AND NOT unplayable AND metadata_audio_gap > 0 AS gap,
    sound AND NOT unplayable AND coalesce(corrupted_picture, false) AS picture, sound AND NOT unplayable AND broken_chain AS chained FROM w),
y AS (SELECT *, vorbis OR audio OR gap OR picture OR chained AS repairable FROM x),
z AS (SELECT *, sound AND failed AND coalesce(playback_ok, false) AND NOT bad_probe AND NOT repairable AS playable FROM y),
d AS (SELECT *, sound AND failed AND (NOT playable OR bad_probe) AS alert, sound AND coalesce(strict_warning, false) AS warned, sound AND strict_ran AND strict_ok IS NULL AS unchecked,
    CASE WHEN NOT sound OR unplayable THEN 'broken' WHEN repairable THEN 'minor' WHEN sound AND failed AND (NOT playable OR bad_probe) THEN 'broken' WHEN playable OR coalesce(strict_warning, false) THEN 'medium' ELSE 'clean' END AS bucket FROM z)"""


def _scanned(spark, sf_dir) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in SCANNED.items()])
    return health.diagnose(lines).withColumn("found", F.col("flags"))


@query(f"""WITH {_DIAGNOSED} SELECT rel, bucket, CASE bucket WHEN 'minor' THEN 'would_fix' WHEN 'broken' THEN 'redownload' ELSE 'none' END AS action,
CASE WHEN NOT sound THEN CASE WHEN broken_chain THEN 'broken-metadata-chain' ELSE 'flac-parse-error' END ELSE array_to_string(list_filter([CASE WHEN vorbis THEN 'vorbis-length-mismatch' END, CASE WHEN audio THEN 'audio-sync-corrupted' END, CASE WHEN gap THEN 'metadata-audio-gap' END,
CASE WHEN picture THEN 'corrupted-picture-tag' END, CASE WHEN chained THEN 'broken-metadata-chain' END, CASE WHEN alert THEN 'strict-decode-failed' END, CASE WHEN bad_probe THEN 'ffprobe-audio-probe-failed' END,
CASE WHEN playable THEN 'strict-decode-invalid-playable' END, CASE WHEN warned THEN 'strict-decode-warning' END, CASE WHEN unchecked THEN 'strict-decode-unchecked' END], lambda i: i IS NOT NULL), ',') END AS issues,
CAST(CASE WHEN NOT sound THEN broken_chain::INT ELSE vorbis::INT + audio::INT + gap::INT + picture::INT + chained::INT END AS INT) AS n_repairs FROM d""", tracks=False)
def file_diagnoses(spark, sf_dir):
    return _scanned(spark, sf_dir).select("rel", "bucket", "action", F.array_join("issues", ",").alias("issues"), F.size("known_repairs").alias("n_repairs"))


@query(f"""WITH {_DIAGNOSED}, e AS (SELECT *, NOT missing_result AS there, coalesce(outcome IN ('fixed', 'unresolved'), false) AS tried FROM d)
SELECT count(*) AS total, count(*) FILTER (there AND bucket = 'clean') AS ok, count(*) FILTER (there AND bucket = 'clean') AS clean, count(*) FILTER (there AND bucket = 'minor') AS minor, count(*) FILTER (there AND bucket = 'medium') AS medium,
count(*) FILTER (NOT there OR bucket = 'broken') AS broken, count(*) FILTER (there AND vorbis) AS vorbis_mismatch, count(*) FILTER (there AND audio) AS audio_corrupted, count(*) FILTER (there AND alert) AS strict_decode_failed,
count(*) FILTER (there AND (warned OR playable)) AS strict_decode_warnings, count(*) FILTER (there AND playable) AS playable_strict_decode_failures, count(*) FILTER (there AND unchecked) AS strict_decode_unchecked,
count(*) FILTER (there AND tried AND vorbis) AS fixed_vorbis, count(*) FILTER (there AND tried AND audio) AS fixed_audio, count(*) FILTER (there AND tried AND chained) AS fixed_chain, count(*) FILTER (there AND tried) AS fixed,
count(*) FILTER (there AND outcome IN ('unresolved', 'failed')) AS fix_failed, count(*) FILTER (NOT there OR diagnosis_error OR coalesce(outcome = 'failed', false)) AS errors FROM e""", tracks=False)
def health_statistics(spark, sf_dir):
    return health.statistics(_scanned(spark, sf_dir), [])


@query(f"""WITH {_DIAGNOSED} SELECT artist, count(*) AS total_files, count(*) FILTER (bucket <> 'clean') AS files_with_issues, count(*) FILTER (vorbis) AS vorbis_mismatch, count(*) FILTER (audio) AS audio_corrupted, count(*) FILTER (gap) AS metadata_gap,
count(*) FILTER (picture) AS corrupted_picture, count(*) FILTER (chained) AS broken_chain, count(*) FILTER (alert) AS strict_decode_failed, count(*) FILTER (warned OR playable) AS strict_decode_warnings,
count(*) FILTER (playable) AS playable_strict_decode_failures, count(*) FILTER (diagnosis_error) AS errors FROM d WHERE NOT missing_result GROUP BY artist""", tracks=False)
def health_by_artist(spark, sf_dir):
    return health.artist_statistics(_scanned(spark, sf_dir))


@query(f"""WITH {_CHECKED} SELECT artist, album, count(*) FILTER (b = 'broken') AS failed, count(*) FILTER (b = 'minor') AS minor, count(*) FILTER (b = 'medium' AND NOT playable) AS warned, count(*) FILTER (b NOT IN ('broken', 'minor') AND playable) AS warned_playable
FROM c GROUP BY 1, 2 HAVING count(*) FILTER (b IN ('broken', 'minor') OR playable OR b = 'medium') > 0""", tracks=False)
def damage_report(spark, sf_dir):
    return rollups.damage_report(_checked(spark, sf_dir))


@query("SELECT count(*) AS expected, count(*) FILTER (ord % 3 <> 0 OR title IS NULL) AS verified, count(*) FILTER (NOT (ord % 3 <> 0 OR title IS NULL)) AS failed FROM t")
def verification_counts(spark, sf_dir):
    tracks = track_table(spark, sf_dir)
    actions = tracks.select("path", F.lit("title").alias("field"), F.col("title").alias("new_value"))
    return rollups.verification(actions, tracks.filter("ord % 3 <> 0").select("path", F.lit("title").alias("field"), F.col("title").alias("value")))


# Names


@query("SELECT CAST(a.p_partkey AS BIGINT) AS p_partkey, contains(a.p_name, split_part(b.p_name, ' ', 1)) OR contains(split_part(b.p_name, ' ', 1), a.p_name) AS matches FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1", tracks=False)
def album_names_match(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.split("p_name", " ")[0].alias("hint"))
    return part.join(after, "p_partkey").select("p_partkey", names.albums_match(F.upper("hint"), F.concat(F.lit("("), F.initcap("p_name"), F.lit(")"))).alias("matches"))


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 100 WHEN p_partkey % 3 = 1 THEN 85 ELSE 70 END AS score FROM part", tracks=False)
def album_scores(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name")
    long = F.concat("p_name", F.lit(" (Disc II)"))
    k = F.col("p_partkey") % 3
    return part.select("p_partkey", names.album_score(F.when(k == 2, long).otherwise(F.col("p_name")), F.when(k == 0, F.upper("p_name")).when(k == 1, long).otherwise(F.col("p_name"))).alias("score"))


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_partkey % 5 IN (0, 1, 2) AS matches, p_partkey % 5 IN (0, 1) AS equals FROM part", tracks=False)
def artist_matches(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_partkey") % 5, F.col("p_brand").alias("b")).toDF("p_partkey", "k", "b")
    candidate = F.when(F.col("k") == 0, F.upper("b")).when(F.col("k") == 1, F.replace("b", F.lit("#"), F.lit(" "))).when(F.col("k") == 2, F.concat(F.lit("The "), F.col("b"), F.lit("*"))).when(F.col("k") == 3, F.concat(F.lit("Various "), F.col("b"))).otherwise("xy")
    return part.select("p_partkey", names.artists_match(candidate, F.col("b")).alias("matches"), names.artists_equal(candidate, F.col("b")).alias("equals"))


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, regexp_replace(p_name, ' ', ' 3 ') AS key FROM part", tracks=False)
def lookup_keys(spark, sf_dir):
    marked = F.concat(F.upper(F.regexp_replace("p_name", " ", "--III. ")), F.lit("́!"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), names.lookup_key(marked).alias("key"))


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_brand = 'Brand#1' THEN ['Brand#1', 'X'] ELSE [p_brand, 'Brand#1', 'X'] END AS provider, ['Brand', p_brand[7:] || ' / X'] AS list FROM part", tracks=False)
def artist_splits(spark, sf_dir):
    """One credit by two of the five ways."""
    provider = F.concat("p_brand", F.lit(" feat. Brand#1 & brand#1 / X"))
    listed = F.concat(F.replace("p_brand", F.lit("#"), F.lit("; ")), F.lit(" / X;"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), names.split_names(provider).alias("provider"), names.split_names(listed, "list").alias("list"))


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [p_brand, 'B'] ELSE ['x', 'y'] END AS artists FROM part", tracks=False)
def collaborators(spark, sf_dir):
    both = F.when(F.col("p_partkey") % 2 == 1, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("z")))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), names.collaborators(F.concat("p_brand", F.lit(" ft. B")), both).alias("artists"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name AS name FROM supplier", tracks=False)
def provider_artist_names(spark, sf_dir):
    tail = F.when(F.col("s_suppkey") % 2 == 0, " (2)").otherwise(" (band; Leeds)")
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), names.provider_artist(F.concat(F.lit(" "), F.col("s_name"), tail)).alias("name"))


#: Names, the old one, and what stands for it: blanks and case, a mark more, placeholders, letters beyond ASCII, no name.
_CREDITS = """CASE p_partkey % 6 WHEN 0 THEN {a}' ' || lower(p_brand) || ' ', 'Guest'{z} WHEN 1 THEN {a}replace(p_brand, '#', ' '), 'Guest'{z} WHEN 2 THEN {a}'???', ' ???'{z}
WHEN 3 THEN {a}'??', 'É', upper(p_brand){z} WHEN 4 THEN {a}p_name, p_brand || '!'{z} ELSE {a}p_brand, '???', p_brand{z} END"""
_OLD = "CASE p_partkey % 6 WHEN 3 THEN 'é' ELSE upper(p_brand) END"


@query(f"""WITH n AS (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_type AS canonical, {_OLD} AS old, {_CREDITS.format(a="[", z="]")} AS names FROM part),
e AS (SELECT p_partkey, canonical, generate_subscripts(names, 1) AS i, unnest(names) AS name, old FROM n),
k AS (SELECT p_partkey, i, CASE WHEN translate(trim(name), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = translate(old, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') THEN canonical ELSE name END AS name FROM e WHERE trim(name) <> '???')
SELECT p_partkey, coalesce(list(k.name ORDER BY i) FILTER (k.name IS NOT NULL), [any_value(canonical)]) AS artists FROM n LEFT JOIN k USING (p_partkey) GROUP BY p_partkey""", tracks=False)
def canonical_artists(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_type", F.expr(_OLD).alias("old"), F.expr(_CREDITS.format(a="array(", z=")")).alias("names"))
    return part.select("p_partkey", names.canonical_artists(F.col("names"), F.col("old"), F.col("p_type")).alias("artists"))


_TITLES = """CASE p_partkey % 8 WHEN 0 THEN '03_' || replace(p_name, ' ', '-') WHEN 1 THEN 'disc 2 - ' || upper(p_name) WHEN 2 THEN '99' || p_name WHEN 3 THEN ' (' || p_name || ')! '
WHEN 4 THEN '2001' WHEN 5 THEN '1999 ' || p_name WHEN 6 THEN 'a.c. ' || p_name || ' é' ELSE '12. 7' END"""


@query(f"""WITH t AS (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS told, {_TITLES} AS title FROM part)
SELECT p_partkey, CASE p_partkey % 8 WHEN 2 THEN '99 ' || told WHEN 3 THEN '(' || told || ')!' WHEN 4 THEN '2001' WHEN 5 THEN '1999 ' || told WHEN 6 THEN 'a.c. ' || told || ' é' WHEN 7 THEN '7' ELSE told END AS value, true AS changed FROM t WHERE p_partkey % 8 <> 4
UNION ALL SELECT p_partkey, '2001', false FROM t WHERE p_partkey % 8 = 4""", tracks=False)
def prettified_titles(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), pipeline(F.expr(_TITLES), [("prettify", {})]).alias("r"))
    return part.select("p_partkey", "r.value", "r.changed")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'MUSICBRAINZ_TRACKID' WHEN 'view' THEN 'DISCOGS_RELEASE_ID' WHEN 'purchase' THEN 'COMMENT' ELSE event_type END AS key, event_type = 'error' AS lyrics, event_type IN ('error', 'signup') AS reserved FROM events", tracks=False)
def extra_tag_keys(spark, sf_dir):
    spelt = F.when(F.col("event_type") == "click", " musicbrains track-id").when(F.col("event_type") == "view", "discogs_release id").when(F.col("event_type") == "purchase", "Comm").otherwise(F.col("event_type"))
    other = F.when(F.col("event_type") == "error", "Synced_Lyrics").when(F.col("event_type") == "signup", "album artist").otherwise("mood")
    return _table(spark, sf_dir, "events").select("event_id", names.extra_key(spelt).alias("key"), names.is_lyrics_key(other).alias("lyrics"), names.is_reserved_key(other).alias("reserved"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y') END AS year FROM orders", tracks=False)
def release_years(spark, sf_dir):
    year = F.date_format("o_orderdate", "yyyy")
    k = F.col("o_orderkey") % 4
    folder = F.when(k == 0, F.concat(year, F.lit(" - A"))).when(k == 1, F.concat(F.lit("A《"), year, F.lit(".B》C"))).when(k == 2, F.concat(F.lit(" "), year)).otherwise(F.concat(F.lit("Album ("), year, F.lit(" remaster)")))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), T.release_year(folder).alias("year"))


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name AS folder, p_name AS album FROM part", tracks=False)
def folder_names(spark, sf_dir):
    folder = F.concat(F.lit("1999 - 《"), F.col("p_name"), F.lit("》 [FLAC]"))
    album = F.concat("p_name", F.lit(" (Deluxe Edition)（精選）"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), names.clean_folder(folder).alias("folder"), names.without_subtitle(album).alias("album"))


@query("SELECT ord, regexp_extract(path, '[^/]*$')[5:] AS bare, title, CAST(ord % 90 + 10 AS INT) AS number, split_part(regexp_extract(path, '[^/]*$'), ' - ', 1)[5:] AS artist FROM t")
def filename_parts(spark, sf_dir):
    name = T.basename(F.col("path"))
    stem = T.stem(F.col("path"))
    return track_table(spark, sf_dir).select("ord", names.without_file_number(name).alias("bare"), names.without_title_number(F.concat(F.lit("07. "), F.col("title"))).alias("title"), names.file_number(stem).alias("number"), names.told_by_file(F.col("path"))["artist"].alias("artist"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL ELSE o_orderpriority END AS value FROM orders", tracks=False)
def model_answers(spark, sf_dir):
    answer = F.when(F.col("o_orderpriority") == "1-URGENT", " Unknown ").when(F.col("o_orderpriority") == "2-HIGH", " ").otherwise(F.concat(F.col("o_orderpriority"), F.lit(" ")))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), names.sentinel_free(answer).alias("value"))


# Patterns and texts


@query("SELECT ord, CAST(ord % 90 + 10 AS VARCHAR) AS track, regexp_extract(path, 'Brand#[0-9]+') AS artist, regexp_extract(path, ' - ([^/]*)[.]flac$', 1) AS title FROM t")
def pattern_parse(spark, sf_dir):
    found = patterns.parse_filename("%{track}%. %{artist}% - %{title}%", T.basename(F.col("path")))
    return track_table(spark, sf_dir).select("ord", found.alias("m")).select("ord", F.col("m")["track"].alias("track"), F.col("m")["artist"].alias("artist"), F.col("m")["title"].alias("title"))


@query("SELECT ord, CASE WHEN track_number IS NULL THEN '01' WHEN track_number < 10 THEN '0' || track_number ELSE CAST(track_number AS VARCHAR) END || ' - ' || coalesce(title, 'Unknown') || '.flac' AS name FROM t")
def pattern_build(spark, sf_dir):
    fields = {"track": F.col("track_number"), "title": F.col("title")}
    return track_table(spark, sf_dir).select("ord", patterns.build_filename("%{track}% - %{title}%{ext}%", fields, T.basename(F.col("path"))).alias("name"))


@query("SELECT ord FROM t WHERE regexp_matches(lower(regexp_extract(path, '[^/]*$')), '^1.[.] brand#1 - .*$')")
def glob_filter(spark, sf_dir):
    return track_table(spark, sf_dir).filter(patterns.like_glob(T.basename(F.col("path")), "1?. BRAND#1 - *")).select("ord")


@query("SELECT ord FROM t WHERE lower(coalesce(artist, '')) LIKE '%brand#1%' AND lower(coalesce(album, '')) LIKE '%promo%'")
def fielded_query(spark, sf_dir):
    return track_table(spark, sf_dir).filter(patterns.fielded('Artist:Brand#1 album:"PROMO"', {"artist": F.col("artist"), "album": F.col("album")})).select("ord")


@query("""SELECT ord, sha256('{"album":"' || album || '","title":' || CASE WHEN title IS NULL THEN 'null' ELSE '"' || title || '"' END || ',"version":4}') AS hash FROM t""")
def canonical_hash(spark, sf_dir):
    return track_table(spark, sf_dir).select("ord", F.sha2(patterns.canonical_struct(["title", "album"], version=4), 256).alias("hash"))


@query("SELECT ord, path[2:] AS short, sha256(path) AS hash FROM t")
def path_forms(spark, sf_dir):
    deep = F.concat(F.lit("C:\\a\\b"), F.translate("path", "/", "\\"))
    return track_table(spark, sf_dir).select("ord", T.short_path(deep).alias("short"), T.path_hash(F.col("path")).alias("hash"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'jpn' WHEN 'view' THEN 'kor' WHEN 'purchase' THEN 'zho' WHEN 'error' THEN 'fra' ELSE 'und' END AS lang FROM events", tracks=False)
def lyrics_languages(spark, sf_dir):
    kind = F.col("event_type")
    stated = F.when(kind == "view", "KO").when(kind == "error", " fra").otherwise("und")
    words = F.when(kind == "click", "恋はかな").when(kind == "purchase", "長城").otherwise("la la")
    return _table(spark, sf_dir, "events").select("event_id", lyrics.language(stated, words).alias("lang"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'control' WHEN 'view' THEN 'misread' WHEN 'purchase' THEN 'replacement' WHEN 'error' THEN 'nul' END AS problem FROM events", tracks=False)
def lyrics_problems(spark, sf_dir):
    kind = F.col("event_type")
    words = F.when(kind == "click", "a\u0001b").when(kind == "view", "æ„›").when(kind == "purchase", "a\ufffd").when(kind == "error", "a\0").otherwise("fine\r\nétoile")
    return _table(spark, sf_dir, "events").select("event_id", lyrics.problem(words).alias("problem"))


@query("SELECT ord, '[00:01.50]' || genre || chr(10) || '[01:02.00]b' AS lrc FROM t WHERE genre IS NOT NULL")
def lyrics_format(spark, sf_dir):
    given = F.concat(F.lit("[offset:0]\n[01:02]b\n[00:01.5] "), F.col("genre"))
    return track_table(spark, sf_dir).filter("genre IS NOT NULL").select("ord", lyrics.to_lrc(T.lyric_lines(given)).alias("lrc"))


# Planned edits


@query("SELECT path, 'genre' AS field, genre AS old_value, 'G' || ord AS new_value, 'set' AS operation FROM t WHERE ord % 6 = 1")
def patch_each(spark, sf_dir):
    tracks = track_table(spark, sf_dir)
    wanted = tracks.filter("ord % 3 = 1").select("path", F.lit("genre").alias("field"), F.concat(F.lit("G"), F.col("ord").cast("string")).alias("new_value"))
    return edits.patch_each(tracks.filter("ord % 2 = 1"), wanted, ["genre"])


@query("SELECT path FROM t WHERE ord % 6 = 4")
def patch_outside_scope(spark, sf_dir):
    tracks = track_table(spark, sf_dir)
    return edits.outside(tracks.filter("ord % 2 = 1"), tracks.filter("ord % 3 = 1"))


@query("SELECT path, 'genre' AS field, genre AS old_value, NULL AS new_value, 'remove' AS operation FROM t WHERE ord % 10 = 1 AND genre IS NOT NULL UNION ALL SELECT path, 'year', year, '2000', 'set' FROM t WHERE ord % 10 = 1 AND year <> '2000'")
def edit_fields(spark, sf_dir):
    return edits.edit(track_table(spark, sf_dir), F.col("ord") % 10 == 1, {"genre": None, "year": "2000"})


@query("SELECT path, 'artist' AS field, artist AS old_value, artist[7:] AS new_value, 'set' AS operation FROM t WHERE artist LIKE 'Brand#%'")
def extract_tag_value(spark, sf_dir):
    return edits.extract_value(track_table(spark, sf_dir), "artist", "#([0-9]+)$")


@query("SELECT path, 'title' AS field, '12. ' || title AS old_value, title AS new_value, 'set' AS operation FROM t WHERE ord % 2 = 0 AND title IS NOT NULL")
def strip_title_numbers(spark, sf_dir):
    return edits.strip_title_numbers(track_table(spark, sf_dir).withColumn("title", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("12. "), F.col("title"))).otherwise(F.col("title"))))


@query("SELECT path, 'artist' AS field, artist AS old_value, regexp_extract(path, 'Brand#[0-9]+') AS new_value, 'set' AS operation FROM t WHERE artist = '' UNION ALL SELECT path, 'title', title, regexp_extract(path, ' - ([^/]*)[.]flac$', 1), 'set' FROM t WHERE title IS NULL")
def infer_tags(spark, sf_dir):
    return edits.infer_tags(track_table(spark, sf_dir))


@query("SELECT path, 'title' AS field, title || ' 愛' AS old_value, title || ' 爱' AS new_value, 'set' AS operation FROM t WHERE title IS NOT NULL")
def convert_tags(spark, sf_dir):
    return edits.convert_script(track_table(spark, sf_dir).withColumn("title", F.concat("title", F.lit(" 愛"))), ["title", "genre"])


@query("SELECT path, 'cover' AS field, NULL AS old_value, NULL AS new_value, 'remove' AS operation FROM t WHERE has_cover")
def remove_covers(spark, sf_dir):
    return edits.remove_covers(track_table(spark, sf_dir))


@query("""WITH m AS (SELECT path AS source, regexp_replace(path, '/[^/]*$', '') || '/' || split_part(regexp_extract(path, '[^/]*$')[5:], ' (', 1) || '.flac' AS target FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY source) - 1 AS k FROM m)
SELECT source, target, CASE WHEN k = 0 THEN target ELSE regexp_replace(target, '[.]flac$', '_' || k || '.flac') END AS final FROM r""")
def rename_files(spark, sf_dir):
    tracks = track_table(spark, sf_dir)
    operations = [("regex_replace", {"pattern": r"^\d+\. "}), ("regex_replace", {"pattern": r" \(\d+\)$"})]
    return edits.rename(tracks, operations, tracks.filter("false").select("path"))


@query("SELECT path AS source, regexp_replace(path, '/[^/]*$', '') || '/' || regexp_extract(path, '[^/]*$')[5:] AS target, regexp_replace(path, '/[^/]*$', '') || '/' || regexp_extract(path, '[^/]*$')[5:] AS final FROM t")
def strip_file_numbers(spark, sf_dir):
    tracks = track_table(spark, sf_dir)
    return edits.strip_file_numbers(tracks, tracks.filter("false").select("path"))


@query("SELECT path AS source, target, target AS final FROM (SELECT path, '/out/' || CASE WHEN size_bytes < 10485760 THEN 'small' WHEN size_bytes < 104857600 THEN 'medium' WHEN size_bytes < 1073741824 THEN 'large' ELSE 'huge' END || '/' || regexp_extract(path, '[^/]*$') AS target FROM t)")
def organize_by_size(spark, sf_dir):
    tracks = track_table(spark, sf_dir)
    return edits.organize(tracks, "/out/", "size", tracks.filter("false").select("path"))


@query("SELECT path AS source, '/out/flac/' || regexp_extract(path, '[^/]*$') AS target, '/out/flac/' || regexp_extract(path, '[^/]*$') AS final FROM t")
def organize_by_extension(spark, sf_dir):
    tracks = track_table(spark, sf_dir)
    return edits.organize(tracks, "/out", "extension", tracks.filter("false").select("path"), extensions=["flac"])


_FIELD_LISTS = {"album": "'A'", "album_artist": "'X & Y'", "album_artists": "'X; Y'", "year": "NULL", "genre": "'G'", "musicbrainz_album_id": "NULL"}


@query("""WITH i AS (SELECT path, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY ord) - 1 AS idx FROM t)
SELECT path, 'album' AS field, 'A' AS new_value, 'set' AS operation FROM i UNION ALL SELECT path, 'album_artist', 'X & Y', 'set' FROM i UNION ALL SELECT path, 'album_artists', 'X; Y', 'set' FROM i UNION ALL SELECT path, 'genre', 'G', 'set' FROM i
UNION ALL SELECT path, unnest(['musicbrainz_album_id', 'musicbrainz_artist_id', 'discogs_release_id', 'discogs_artist_id']), NULL, 'remove' FROM i
UNION ALL SELECT path, 'title', 'T' || idx, 'set' FROM i WHERE idx < 3 UNION ALL SELECT path, 'artist', NULL, 'remove' FROM i WHERE idx < 3 UNION ALL SELECT path, 'track_number', CAST(idx + 1 AS VARCHAR), 'set' FROM i WHERE idx < 3""")
def apply_candidate(spark, sf_dir):
    files = positions.indexed(track_table(spark, sf_dir)).select("album_path", "idx", "path")
    none, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    ids = {c: none for c in ("musicbrainz_album_id", "musicbrainz_artist_id", "discogs_release_id", "discogs_artist_id")}
    albums = files.select("album_path").distinct().withColumns({"album": F.lit("A"), "album_artists": F.array(F.lit("X"), F.lit("Y")), "year": none, "genre": F.lit("G"), **ids})
    empty = F.array().cast("array<string>")
    tracks = files.filter("idx < 6").drop("path").withColumns({"title": F.when(F.col("idx") < 3, F.concat(F.lit("T"), F.col("idx").cast("string"))), "artist": none, "artists": empty, "track_number": F.when(F.col("idx") < 3, F.col("idx") + 1), "track_total": number, "disc_number": number, "disc_total": number, "musicbrainz_track_id": none})
    return edits.apply_candidate(files, albums, tracks)


@query("SELECT album_path, CASE WHEN n % 2 = 1 THEN 'track_count' ELSE 'index' END AS problem FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS album_path, count(*) AS n FROM t GROUP BY 1) WHERE n % 2 = 1 OR n % 4 = 0")
def rejected_candidates(spark, sf_dir):
    counts = _files(track_table(spark, sf_dir)).groupBy("album_path").agg(F.count("*").alias("n_local"))
    wrong = F.when(F.col("n_local") % 4 == 0, F.col("n_local")).otherwise(F.col("n_local") - 1)
    return edits.rejected_candidates(counts.select("album_path", "n_local", (F.col("n_local") + F.col("n_local") % 2).alias("n_remote"), F.lit(0).alias("least_idx"), wrong.alias("largest_idx")))


@query("SELECT path, 'title' AS field, title AS old_value, CASE WHEN ord % 2 = 0 THEN 'C' ELSE 'S' END AS new_value, 'set' AS operation FROM t WHERE ord % 3 <> 0 AND ord % 5 <> 0")
def apply_audit(spark, sf_dir):
    rows = track_table(spark, sf_dir).select("path", F.lit("title").alias("field"), F.col("title").alias("old_value"), F.lit("S").alias("suggestion"), F.when(F.col("ord") % 2 == 0, "C").alias("corrected"), (F.col("ord") % 3 != 0).alias("eligible"), (F.col("ord") % 5 == 0).alias("auto_fixed"))
    return edits.apply_audit(rows)


@query("""WITH p AS (SELECT *, regexp_extract(path, ' - ([^/]*)[.]flac$', 1) AS nt, regexp_extract(path, 'Brand#[0-9]+') AS na, CAST(ord % 90 + 10 AS VARCHAR) AS nn FROM t)
SELECT path, 'title' AS field, title AS old_value, nt AS new_value, 'set' AS operation FROM p WHERE title IS DISTINCT FROM nt UNION ALL SELECT path, 'artist', artist, na, 'set' FROM p WHERE artist IS DISTINCT FROM na
UNION ALL SELECT path, 'track', CAST(track_number AS VARCHAR), nn, 'set' FROM p WHERE CAST(track_number AS VARCHAR) IS DISTINCT FROM nn""")
def apply_pattern(spark, sf_dir):
    return edits.apply_pattern(track_table(spark, sf_dir), "%{track}%. %{artist}% - %{title}%")


@query("SELECT path, 0 AS ord, 'MUSICBRAINZ_TRACKID' AS key, CAST(ord AS VARCHAR) AS value FROM t UNION ALL SELECT path, 3, 'artists', 'x' FROM t")
def extra_tags_written(spark, sf_dir):
    each = F.array(*[F.struct(F.lit(n).alias("ord"), F.lit(k).alias("key"), v.alias("value")) for n, k, v in (
        (0, "musicbrainz track id", F.concat(F.lit(" "), F.col("id"))), (1, "MUSICBRAINZ_RECORDINGID", F.col("id")), (2, "title", F.lit("t")), (3, "artists", F.lit("x")), (4, "mood", F.lit(" ")))])
    rows = track_table(spark, sf_dir).select("path", F.col("ord").cast("string").alias("id")).select("path", F.inline(each))
    return edits.extra_tags(rows)


@query("SELECT DISTINCT n_name AS name, alias FROM (SELECT n_name, upper(n_name) || ' X' AS alias FROM nation UNION ALL SELECT n_name, 'new ' || n_name FROM nation WHERE n_nationkey % 2 = 0)", tracks=False)
def alias_map(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    old = nation.select("name", F.concat(F.upper("name"), F.lit(" X")).alias("alias"))
    wanted = old.select("name", F.lower("alias").alias("alias")).unionByName(nation.filter("n_nationkey % 2 = 0").select("name", F.concat(F.lit("new "), F.col("name")).alias("alias"))).unionByName(nation.select("name", F.upper("name").alias("alias")))
    return edits.add_aliases(old, wanted)


@query("SELECT path, regexp_replace(path, '/[^/]*$', '') AS folder, (row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY path) - 1) // 20 AS batch FROM t")
def write_batches(spark, sf_dir):
    return edits.write_batches(track_table(spark, sf_dir).select("path"))


@query("SELECT path, 'genre' AS field, genre AS old_value, CASE WHEN ord % 2 = 0 THEN NULL ELSE 'G' END AS expected FROM t")
def write_expectations(spark, sf_dir):
    new = F.when(F.col("ord") % 4 == 0, "").when(F.col("ord") % 4 == 2, "gone").otherwise("G")
    actions = track_table(spark, sf_dir).select("path", F.lit("genre").alias("field"), F.col("genre").alias("old_value"), new.alias("new_value"), F.when(F.col("ord") % 4 == 2, "remove").otherwise("set").alias("operation"))
    return edits.expectations(actions)


# Conversations, requests, calls and moves

_TURN_EVENTS = {
    "session_id": "CAST(conv_id AS VARCHAR(20))",
    "seq": "turn",
    "at": "'t' || CAST(turn AS VARCHAR(20))",
    "kind": "CASE WHEN role = 'system' THEN 'turn' WHEN length(text) % 5 = 0 THEN 'turn' WHEN role = 'assistant' AND length(text) % 3 = 0 THEN 'answered' WHEN role = 'assistant' THEN 'clarified' WHEN length(text) % 2 = 0 THEN 'submitted' ELSE 'finished' END",
    "batch": "'b' || CAST(length(text) % 3 AS VARCHAR(20))",
    "intent": "role",
    "scope": "CASE WHEN turn % 2 = 0 THEN substring(text, 1, 3) END",
    "protocol": "'native'",
    "referent_count": "CAST(length(text) AS BIGINT)",
    "referent_query": "substring(text, 1, 5)",
    "referent_field": "CASE WHEN role = 'user' THEN 'genre' END",
    "referent_value": "CAST(NULL AS VARCHAR(9))",
    "mutation_required": "role = 'user'",
    "clarifications": "CASE WHEN length(text) % 10 = 0 THEN CAST(turn AS BIGINT) END",
}
_OF_TURN = ["intent", "scope", "referent_count", "referent_query", "referent_field", "referent_value", "mutation_required"]


@query(f"""WITH e AS (SELECT {", ".join(f"{v} AS {c}" for c, v in _TURN_EVENTS.items())} FROM conversations),
p AS (SELECT a.session_id, a.seq, a.at, max(b.seq) FILTER (b.kind = 'turn') AS t, max(b.seq) FILTER (b.kind IN ('turn', 'answered')) AS r, max(b.seq) FILTER (b.kind IN ('turn', 'answered', 'clarified')) AS c, min(b.seq) AS f
    FROM e a JOIN e b ON a.session_id = b.session_id AND b.seq <= a.seq GROUP BY ALL),
n AS (SELECT p.*, (SELECT count(*) FROM e x WHERE x.session_id = p.session_id AND x.kind = 'clarified' AND x.seq > coalesce(p.r, -1) AND x.seq <= p.seq) AS n FROM p)
SELECT n.session_id, n.seq, {", ".join(f"t.{c}" for c in _OF_TURN)}, coalesce(t.protocol, 'llm') AS protocol,
CASE WHEN n.c = n.t AND t.clarifications IS NULL THEN NULL ELSE n.n + CASE WHEN n.r = n.t THEN coalesce(t.clarifications, 0) ELSE 0 END END AS clarifications, f.at AS created_at, n.at AS updated_at,
(SELECT count(*) FROM (SELECT batch, arg_max(kind, seq) AS k FROM e x WHERE x.session_id = n.session_id AND x.seq <= n.seq AND kind IN ('submitted', 'finished') GROUP BY batch) WHERE k = 'submitted') AS n_pending
FROM n LEFT JOIN e t ON t.session_id = n.session_id AND t.seq = n.t JOIN e f ON f.session_id = n.session_id AND f.seq = n.f""", tracks=False)
def session_turns(spark, sf_dir):
    events = _table(spark, sf_dir, "conversations").selectExpr(*[f"{v} AS {c}" for c, v in _TURN_EVENTS.items()])
    return sessions.replay(events).withColumn("n_pending", F.size("pending").cast("long")).drop("pending")


_REQUEST = """CASE p_partkey % 10 WHEN 0 THEN 'set genre to ' || p_name WHEN 1 THEN 'Change the album artist "' || p_name || '"' WHEN 2 THEN 'set the missing year to ' || CAST(p_size AS VARCHAR(9))
WHEN 3 THEN 'clear the comment' WHEN 4 THEN 'set album based on their folder name' WHEN 5 THEN 'set title based on the ' || p_name WHEN 6 THEN 'fix the missing title' WHEN 7 THEN 'set them ' || p_name
WHEN 8 THEN 'group these files into album folders' ELSE 'what about ' || p_name END"""


@query(f"""WITH r AS (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_partkey % 10 AS k, p_name, p_size, p_partkey % 20 = 7 AS found FROM part)
SELECT p_partkey, CASE WHEN k IN (0, 1, 2, 7) THEN 'set_field' WHEN k = 3 THEN 'remove_field' WHEN k = 4 THEN 'set_field_from' WHEN k = 6 THEN 'set_missing' ELSE 'group_by_album' END AS intent,
['genre', 'albumArtist', 'year', 'comment', 'album', NULL, 'title', 'mood', 'album'][k + 1] AS field, CASE WHEN k IN (0, 1, 7) THEN p_name WHEN k = 2 THEN CAST(p_size AS VARCHAR) END AS value,
CASE WHEN k = 4 THEN 'folder_name' END AS source, k IN (2, 6, 7) AS only_if_missing, CASE WHEN k IN (2, 6) THEN 'library_missing' WHEN k = 7 THEN 'referent' WHEN k = 8 THEN 'active' ELSE 'library' END AS scope, k = 7 AS uses_referent
FROM r WHERE k NOT IN (5, 7, 9) OR (k = 7 AND found)""", tracks=False)
def routed_requests(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.expr(_REQUEST).alias("request"), (F.col("p_partkey") % 20 == 7).cast("long").alias("found"))
    return part.select("p_partkey", routing.route(F.col("request"), F.lit("mood"), F.col("found")).alias("c")).filter("c IS NOT NULL").select("p_partkey", "c.*")


_CALL = """CASE event_id % 8 WHEN 0 THEN '{"query": "x", "limit": ' || CAST(event_id AS VARCHAR(20)) || '}' WHEN 1 THEN '{"query": ' || CAST(user_id AS VARCHAR(20)) || '}' WHEN 2 THEN '{"limit": 1}' WHEN 3 THEN '{"query": "x", "zz": 1, "' || event_type || '": 2}'
WHEN 4 THEN '{"query": null}' WHEN 5 THEN '[' || props || ']' WHEN 6 THEN props ELSE '{"query": "' || event_type || '", "limit": null}' END"""


@query("""SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'Field "query" should be a string, got number' WHEN 3 THEN 'Unknown field: ' || event_type WHEN 5 THEN 'Tool arguments should be an object' ELSE 'Missing required field: query' END AS problem
FROM events WHERE event_id % 8 IN (1, 2, 3, 4, 5, 6)""", tracks=False)
def rejected_arguments(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", arguments.call_problem(F.lit("api.musicbrainzSearch"), F.expr(_CALL)).alias("problem"))
    return events.filter("problem IS NOT NULL")


_RELEASED = """CASE p_partkey % 6 WHEN 0 THEN p_name || ' (24bit)' WHEN 1 THEN p_name || ' (Live)' WHEN 2 THEN p_brand || ' - ' || p_name || ' [bonus disc]' WHEN 3 THEN upper(p_name) WHEN 4 THEN p_name || 's' ELSE p_type END"""


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name AS replacement FROM part WHERE p_partkey % 6 IN (0, 2)", tracks=False)
def cleaned_titles(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.expr(_RELEASED).alias("title"), F.col("p_name").alias("remote_title"), F.array().cast("array<string>").alias("remote_forms"))
    return titles.with_replacement(part).filter("replacement IS NOT NULL").select("p_partkey", "replacement")


@query("""WITH c AS (SELECT printf('f%09d', c_custkey) AS name, c_nationkey AS g, row_number() OVER w AS k, count(*) OVER (PARTITION BY c_nationkey) AS n, lead(printf('f%09d', c_custkey)) OVER w AS next, first_value(printf('f%09d', c_custkey)) OVER w AS first,
    max(printf('f%09d', c_custkey)) OVER (PARTITION BY c_nationkey) AS last FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
m AS (SELECT * FROM c WHERE g % 3 > 0 OR n > 1)
SELECT CASE WHEN g % 3 = 0 THEN first ELSE last END AS chain, CASE WHEN g % 3 = 0 AND k = 1 THEN n WHEN g % 3 = 0 THEN n - k + 1 ELSE n - k END AS rank, CASE WHEN g % 3 = 0 AND k = 1 THEN name || '.moving-aside' ELSE name END AS source,
coalesce(next, CASE WHEN g % 3 = 0 THEN first ELSE 'free' || g END) AS target FROM m
UNION ALL SELECT first, 0, first, first || '.moving-aside' FROM m WHERE g % 3 = 0 AND k = 1""", tracks=False)
def move_plan(spark, sf_dir):
    """Customers of a nation each take the next one's place: rings in every third nation, chains in the others."""
    name = F.format_string("f%09d", F.col("c_custkey").cast("long"))
    customer = _table(spark, sf_dir, "customer").select("c_nationkey", name.alias("source"))
    by_nation = Window.partitionBy("c_nationkey").orderBy("source")
    ends = F.when(F.col("c_nationkey") % 3 == 0, F.min("source").over(by_nation)).otherwise(F.concat(F.lit("free"), F.col("c_nationkey")))
    moved = customer.withColumn("target", F.coalesce(F.lead("source").over(by_nation), ends)).filter("source <> target")
    return moves.plan(moved)


@query("""SELECT p_partkey, CASE WHEN k <> 3 THEN 'r' || k END AS bucket, k = 3 AS missing_result FROM (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_partkey % 4 AS k FROM part)""", tracks=False)
def results_by_spelling(spark, sf_dir):
    """Files are spelt composed, results as they are, decomposed or twice; every fourth file has none."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), (F.col("p_partkey") % 4).alias("k"), F.concat(F.lit("\u00e9"), F.col("p_partkey").cast("string")).alias("rel"))
    apart = F.when(F.col("k") == 0, F.col("rel")).otherwise(F.replace("rel", F.lit("\u00e9"), F.lit("e\u0301")))
    results = part.filter("k < 3").select(apart.alias("rel"), F.lit(1).alias("ord"), F.concat(F.lit("r"), F.col("k")).alias("bucket"))
    early = part.filter("k = 2").select("rel", F.lit(0).alias("ord"), F.lit("early").alias("bucket"))
    return health.results_of_files(part.select("p_partkey", "rel"), results.unionByName(early)).drop("rel")


@query("""WITH w AS (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_name IN (SELECT p_name FROM part WHERE p_size = 1) AS whole FROM part)
SELECT p_partkey, CASE WHEN whole THEN upper(a) || '+' || b ELSE upper(a) || ' ' || b END AS converted FROM w""", tracks=False)
def phrase_conversion(spark, sf_dir):
    """Names by a table of phrases that Spark derives from them: first words, and whole names of the smallest parts."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_size", F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("b"))
    words = part.select(F.col("a").alias("source"), F.upper("a").alias("target"))
    phrases = part.filter("p_size = 1").select(F.col("p_name").alias("source"), F.concat(F.upper("a"), F.lit("+"), F.col("b")).alias("target"))
    convert = scripts.converter(words.unionByName(phrases).distinct())
    return part.select("p_partkey", convert(F.col("p_name")).alias("converted"))


_TAGS = [("TITLE", "p_name"), ("MusicBrains track-id", "CAST(p_partkey AS VARCHAR(20))"), ("MUSICBRAINZ_RECORDINGID", "p_brand"), ("MOOD", "p_type"), ("MOOD", "CASE WHEN p_size > 25 THEN p_type ELSE p_brand END"), ("APIC", "p_name"), ("LABEL", "CASE WHEN p_size > 10 THEN p_brand ELSE '' END")]


@query("""WITH p AS (SELECT '/' || p_partkey AS path, * FROM part)
SELECT path, 1 AS ord, 'MUSICBRAINZ_TRACKID' AS key, CAST(p_partkey AS VARCHAR) AS value, 'vorbis' AS source FROM p UNION ALL SELECT path, 3, 'MOOD', p_type, 'vorbis' FROM p
UNION ALL SELECT path, 4, 'MOOD', p_brand, 'vorbis' FROM p WHERE p_size <= 25 AND p_brand <> p_type UNION ALL SELECT path, 6, 'LABEL', p_brand, 'vorbis' FROM p WHERE p_size > 10""", tracks=False)
def extra_tags_read(spark, sf_dir):
    each = F.array(*[F.struct(F.lit(k).alias("key"), F.expr(v).alias("value")) for k, v in _TAGS])
    tagged = _table(spark, sf_dir, "part").select(F.concat(F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.lit("FLAC").alias("codec"), each.alias("tags"))
    return tags.extra_tags(tagged)


@query("""WITH n AS (SELECT n_name AS folder_name, sha256(trim(n_name)) AS h, n_nationkey AS k FROM nation),
l AS (SELECT '_llm_' || h AS path_hash, 'llm_parsed' AS status, h AS folder_name_hash, '{"k": ' || k || '}' AS extraction FROM n WHERE k % 3 > 0
UNION ALL SELECT sha256('/m/' || c_custkey), CASE WHEN c_custkey % 2 = 0 THEN 'tagged_ok' ELSE 'pending' END, sha256('/m'), NULL FROM customer WHERE c_custkey % 5 > 0)
SELECT * FROM l""", tracks=False)
def extraction_ledger(spark, sf_dir):
    """Albums and what was read of folders' names in one ledger; older rows and invalid statuses don't get in."""
    nation = _table(spark, sf_dir, "nation").select(F.concat(F.lit(" "), F.col("n_name")).alias("folder_name"), F.col("n_nationkey").alias("k")).filter("k % 3 > 0")
    read = nation.select("folder_name", F.format_string('{"k": %d}', F.col("k")).alias("extraction"), F.lit(2).alias("processed_at")).unionByName(nation.select("folder_name", F.lit("old").alias("extraction"), F.lit(1).alias("processed_at")))
    key = F.col("c_custkey")
    status = F.when(key % 5 == 0, "done").when(key % 2 == 0, "tagged_ok").otherwise("pending")
    albums = _table(spark, sf_dir, "customer").select(F.concat(F.lit("/m/"), key.cast("string")).alias("path"), status.alias("status"), F.lit("h").alias("content_hash"), F.lit(1).alias("disc_count"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("processed_at"))
    ledger = state.upsert(state.album_states(albums), state.extraction_states(read), ["path_hash"])
    return ledger.select("path_hash", "status", "folder_name_hash", "extraction")


@query("WITH d AS (SELECT *, count(*) OVER (PARTITION BY lower(trim(coalesce(title, ''))), lower(trim(coalesce(artist, ''))), lower(trim(coalesce(album, '')))) AS n FROM t) SELECT path FROM d WHERE n > 1 AND contains(lower(coalesce(title, '')), 'red') AND codec = 'FLAC'")
def search_duplicates(spark, sf_dir):
    return scopes.search_tracks(track_table(spark, sf_dir), has_duplicates=True, title="RED", codec="flac").select("path")
