"""The catalogue's operators as queries over the test tables, with SQL.

Searches run over the live view of the op log; the clock is an argument everywhere, here ``NOW``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.functions import labels as L
from catalens.functions import tokens as K
from catalens.model import Category, CompactorConfig, Entry, Kind, ScoringConfig, SearchOptions, VolumeType
from catalens.operators import filters, search, stats
from catalens.operators import postings as P
from catalens.operators.live import live_view, reduced_tombstones, without_killed
from catalens.plans import sql
from catalens.plans.query import parse, scoring_cap
from catalens.session import run_dir, spread, written
from catalens.sources.catalog import Catalog
from catalens.sources.tables import table
from catalens.sources.walker import register

NOW, SINCE = 1_530_403_200_000_000, 1_516_000_000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    """Register a function as a query, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return add


def _live(spark: SparkSession, d: str) -> DataFrame:
    return live_view(table(spark, d, "fs_oplog"), table(spark, d, "fs_tombstones"))


def _by_term(spark: SparkSession, d: str) -> DataFrame:
    """The given postings as ``(term, path)``, the entry's number standing for its path."""
    return table(spark, d, "fs_postings").where("term is not null and entry_id is not null").select("term", F.col("entry_id").alias("path")).distinct()


ENTRY = "path, volume, kind, last_modified, last_accessed, category, volume_type"

# versions and deletes


@query(sql.NEWEST + f"SELECT {ENTRY}, seq FROM newest WHERE NOT is_delete")
def lww_live(spark: SparkSession, d: str) -> DataFrame:
    return live_view(table(spark, d, "fs_oplog"))


@query(sql.LIVE + "SELECT volume, count(*) AS entries, max(last_modified) AS latest FROM live GROUP BY volume")
def lww_count_by_volume(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d).groupBy("volume").agg(F.count("*").alias("entries"), F.max("last_modified").alias("latest"))


_ALIVE = "SELECT path, o.volume, kind, last_modified, last_accessed, category, volume_type, seq, is_delete FROM alive o"


@query(sql.alive("WHERE volume IS NULL") + _ALIVE)
def tombstone_prefix(spark: SparkSession, d: str) -> DataFrame:
    return without_killed(table(spark, d, "fs_oplog"), table(spark, d, "fs_tombstones").where("volume is null"))


@query(sql.alive("WHERE volume IS NOT NULL") + _ALIVE)
def tombstone_volume(spark: SparkSession, d: str) -> DataFrame:
    return without_killed(table(spark, d, "fs_oplog"), table(spark, d, "fs_tombstones").where("volume is not null"))


@query("SELECT volume, translate(prefix, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS prefix, max(seq) AS seq FROM fs_tombstones WHERE prefix IS NOT NULL AND seq IS NOT NULL GROUP BY ALL")
def tombstones_reduced(spark: SparkSession, d: str) -> DataFrame:
    return reduced_tombstones(table(spark, d, "fs_tombstones")).toDF("volume", "prefix", "seq")


@query(sql.LIVE + f"SELECT {ENTRY}, seq FROM live WHERE path NOT IN (SELECT path FROM fs_entries WHERE path IS NOT NULL)")
def delete_point(spark: SparkSession, d: str) -> DataFrame:
    """The listed paths deleted after all ops."""
    ops = table(spark, d, "fs_oplog")
    last = ops.agg(F.max("seq")).first()[0] or 0
    gone = table(spark, d, "fs_entries").select("path").distinct().select("path", F.lit("").alias("volume"), *[F.lit(0).alias(c) for c in ("kind", "last_modified", "last_accessed", "category", "volume_type")], F.lit(last + 1).alias("seq"), F.lit(True).alias("is_delete"))
    return live_view(ops.select(*gone.columns).unionByName(gone), table(spark, d, "fs_tombstones"))


def _loaded(spark: SparkSession, d: str) -> Catalog:
    """A catalogue written in two halves of the op log and its prefix deletes."""
    c, ops = Catalog(spark, run_dir(spark, "catalog")), table(spark, d, "fs_oplog")
    c.append_ops(ops.where("rec_id % 2 = 0"))
    c.append_ops(ops.where("rec_id % 2 = 1"))
    c.add_tombstones(table(spark, d, "fs_tombstones"))
    return c


@query(sql.LIVE + f"SELECT {ENTRY}, seq FROM live")
def catalog_live(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d).live().select(*ENTRY.split(", "), "seq")


@query(sql.LIVE + f"SELECT {ENTRY}, seq FROM live")
def compact_equiv(spark: SparkSession, d: str) -> DataFrame:
    c = _loaded(spark, d)
    c.force_compact_all()
    return c.live().select(*ENTRY.split(", "), "seq")


def _split_by_arrival(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What arrived in the first half of the time, and the rest; rows without time are in the rest."""
    low, high = df.select(F.unix_micros(F.col("arrived_at").cast("timestamp")).alias("t")).agg(F.min("t"), F.max("t")).first()
    early = F.coalesce(F.unix_micros(F.col("arrived_at").cast("timestamp")) <= ((low or 0) + (high or 0)) // 2, F.lit(False))
    return df.where(early), df.where(~early)


@query(sql.LIVE + f"SELECT {ENTRY}, seq FROM live")
def late_after_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Everything merged halfway; what comes late then meets the delete markers and prefix deletes that were merged."""
    c = Catalog(spark, run_dir(spark, "catalog"))
    ops, tombs = _split_by_arrival(table(spark, d, "fs_oplog")), _split_by_arrival(table(spark, d, "fs_tombstones"))
    for i in (1, 0):  # the later half first, so that older ops come after their deletes
        c.append_ops(ops[i])
        c.add_tombstones(tombs[i])
        c.force_compact_all()
    return c.live().select(*ENTRY.split(", "), "seq")


_FIRST = "first AS (SELECT * FROM fs_entries QUALIFY row_number() OVER (PARTITION BY path ORDER BY entry_id) = 1)"


def _first_entries(spark: SparkSession, d: str) -> DataFrame:
    """The listed entries, of repeated paths the first."""
    rows = table(spark, d, "fs_entries")
    best = rows.groupBy("path").agg(F.min(F.struct("entry_id", *[c for c in rows.columns if c not in ("path", "entry_id")])).alias("r"))
    return best.select("path", "r.*").select(*ENTRY.split(", "))


@query(f"WITH {_FIRST} SELECT {ENTRY} FROM first WHERE lower(path) <> '/srv/shared' AND NOT starts_with(lower(path), '/srv/shared/') AND NOT (volume = 'vol1' AND starts_with(lower(path), '/home/')) AND path NOT IN (SELECT path FROM first ORDER BY path LIMIT 3)")
def two_handles(spark: SparkSession, d: str) -> DataFrame:
    """One handle inserts, another that was opened before deletes."""
    where = run_dir(spark, "catalog")
    a, b = Catalog(spark, where), Catalog(spark, where)
    entries = _first_entries(spark, d)
    a.insert_batch(entries)
    b.delete_prefix("/srv/shared")
    b.delete_by_volume_name("vol1", "/home")
    for r in entries.select("path").orderBy("path").limit(3).collect():
        b.delete(r.path)
    b.sync()
    return a.live().select(*ENTRY.split(", "))


@query(sql.LIVE + f"SELECT {ENTRY} FROM live WHERE NOT starts_with(lower(path), '/home/') AND path NOT IN (SELECT path FROM live ORDER BY path LIMIT 2) UNION ALL SELECT '/home/new.txt', 'vol1', 0, 5, 5, 32, 0")
def delete_after_append(spark: SparkSession, d: str) -> DataFrame:
    """Deletes by a handle count after ops with sequences of their own, an insert after the deletes too."""
    c = _loaded(spark, d)
    first = c.live().select("path").orderBy("path").limit(2).collect()
    for r in first:
        c.delete(r.path)
    c.delete_prefix("/home")
    c.insert(Entry("/home/new.txt", "vol1", Kind.FILE, 5, 5, Category.TEXT, VolumeType.LOCAL))
    c.sync()
    return c.live().select(*ENTRY.split(", "))


@query(sql.LIVE + f"SELECT {ENTRY}, seq FROM live")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The op log and its prefix deletes as two streams of files into a catalogue, late ops after newer ones, with merges in
    between."""
    from catalens.schemas import OPLOG_SCHEMA, TOMB_SCHEMA
    from catalens.streaming.ingest import ingest, ingest_tombstones, oplog_stream, tombstone_stream

    source, where = run_dir(spark, "stream-in"), run_dir(spark, "stream")
    shaped = lambda name, schema: table(spark, d, name).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    # hashed to files, so that each holds old and new ops of all paths
    shaped("fs_oplog", OPLOG_SCHEMA).repartition(8, "seq").write.parquet(f"{source}/ops")
    shaped("fs_tombstones", TOMB_SCHEMA).repartition(2, "seq").write.parquet(f"{source}/tombs")
    c = Catalog(spark, f"{where}/catalog", CompactorConfig(min_merge_count=2))
    ingest_tombstones(c, tombstone_stream(spark, f"{source}/tombs", 1), f"{where}/deletes").awaitTermination()
    ingest(c, oplog_stream(spark, f"{source}/ops", 2), f"{where}/checkpoint").awaitTermination()
    return c.live().select(*ENTRY.split(", "), "seq")


# tokens and parts of paths


@query("WITH w AS (SELECT entry_id, list_filter(list_concat(string_split_regex(path, '[^A-Za-z0-9]+'), string_split_regex(regexp_replace(regexp_replace(regexp_replace(path, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+')), lambda t: t <> '') AS t, regexp_full_match(path, '[\\x00-\\x7f]*') AS a FROM fs_entries) SELECT entry_id, CASE WHEN a THEN array_to_string(list_sort(list_distinct(list_transform(t, lambda x: lower(x)))), ' ') END AS tokens FROM w")
def tokenize_ascii(spark: SparkSession, d: str) -> DataFrame:
    """Null for paths with other characters."""
    return table(spark, d, "fs_entries").select("entry_id", F.array_join(K.ascii_tokens(F.col("path")), " ").alias("tokens"))


@query(f"WITH {sql.NFKC} SELECT entry_id, array_to_string({sql.tokens('path')}, ' ') AS tokens FROM fs_entries, m")
def tokenize_unicode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fs_entries").select("entry_id", F.array_join(K.tokens(F.col("path")), " ").alias("tokens"))


@query(f"WITH {sql.NFKC} SELECT doc_id, array_to_string({sql.tokens('text')}, ' ') AS tokens FROM documents, m")
def tokenize_documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.array_join(K.tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT entry_id, {sql.folded('path')} AS folded FROM fs_entries")
def fold_unicode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fs_entries").select("entry_id", K.folded(F.col("path")).alias("folded"))


@query(f"SELECT entry_id, {sql.BASENAME} AS basename, {sql.EXTENSION} AS ext, {sql.HIDDEN} AS hidden, least(length(path) - length(replace(path, '/', '')), 255) AS depth FROM fs_entries")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return table(spark, d, "fs_entries").select("entry_id", K.basename(p).alias("basename"), K.extension(p).alias("ext"), K.hidden_extension(p).alias("hidden"), K.depth(p).alias("depth"))


@query("SELECT entry_id, array_to_string(list_transform(list_filter(range(2, length(path) + 1), lambda i: substr(path, i, 1) IN ('/', '\\')), lambda i: lower(substr(path, 1, i))), '|') AS ancestors FROM fs_entries")
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fs_entries").select("entry_id", F.array_join(K.ancestor_terms(F.col("path")), "|").alias("ancestors"))


@query("SELECT tomb_id, lower(replace(prefix, '\\', '/')) AS prefix FROM fs_tombstones")
def prefix_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fs_tombstones").select("tomb_id", K.normalised_prefix(F.col("prefix")).alias("prefix"))


# filters and labels

_CLASS = "CASE " + " ".join(f"WHEN lower({sql.EXTENSION}) IN (" + ", ".join(f"'{e}'" for e in names.split()) + f") THEN {c}" for c, names in L.EXTENSIONS.items()) + " ELSE 0 END"


@query(f"SELECT entry_id, {_CLASS} AS category FROM fs_entries")
def category_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fs_entries").select("entry_id", L.classify(F.col("path")).alias("category"))


def _filtered(spark: SparkSession, d: str, test: Column) -> DataFrame:
    return _live(spark, d).where(test).select("path", "volume", "kind", "category", "volume_type")


_SHOWN = sql.LIVE + "SELECT path, volume, kind, category, volume_type FROM live WHERE "


@query(_SHOWN + "category & 36 <> 0")
def category_filter(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, filters.category_has(Category.IMAGE | Category.TEXT))


@query(_SHOWN + "kind <> 1")
def kind_filter(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, filters.kind_is(Kind.SYMLINK))


@query(_SHOWN + "volume = 'vol1'")
def volume_filter(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, filters.volume_is("vol1"))


@query(_SHOWN + "volume_type IN (1, 2)")
def volume_type_filter(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, filters.volume_type_in((VolumeType.NETWORK, VolumeType.REMOVABLE)))


@query(f"SELECT entry_id, CASE kind WHEN 0 THEN 'FILE' WHEN 1 THEN 'DIR ' WHEN 2 THEN 'SYM ' ELSE '?   ' END AS kind_label, CASE category WHEN 4 THEN 'IMG ' WHEN 8 THEN 'VID ' WHEN 16 THEN 'AUD ' WHEN 2 THEN 'DOC ' WHEN 1 THEN 'ARC ' WHEN 32 THEN 'TXT ' ELSE 'OTH ' END AS category_label, {sql.TIME} AS modified FROM fs_entries")
def labels_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fs_entries").select("entry_id", L.kind_label(F.col("kind")).alias("kind_label"), L.category_label(F.col("category")).alias("category_label"), L.time_label(F.col("last_modified")).alias("modified"))


@query("SELECT event_id, CASE WHEN v > 20 THEN 'green' WHEN v > 10 THEN 'yellow' ELSE 'gray' END AS band, CASE WHEN n < 1000 THEN n || 'µs' WHEN n < 1000000 THEN format('{:.2f}ms', n / 1000.0) ELSE format('{:.2f}s', n / 1000000.0) END AS us, CASE WHEN n < 1000 THEN n || 'ms' WHEN n < 60000 THEN format('{:.2f}s', n / 1000.0) ELSE format('{:.2f}m', n / 60000.0) END AS ms FROM (SELECT event_id, value AS v, event_id * 25 AS n FROM events)")
def durations_format(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") * 25  # many halves in the second place
    return table(spark, d, "events").select("event_id", L.score_band(F.col("value")).alias("band"), L.micros_label(n).alias("us"), L.millis_label(n).alias("ms"))


# postings

_GIVEN = "WITH p AS (SELECT DISTINCT term, entry_id AS path FROM fs_postings WHERE term IS NOT NULL AND entry_id IS NOT NULL)\n"


@query(_GIVEN + "SELECT term, count(*) AS entries FROM p GROUP BY term")
def posting_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.posting_counts(_by_term(spark, d))


@query(sql.LIVE.rstrip() + f", {sql.NFKC}\n" + sql.all_terms("live"))
def postings_build(spark: SparkSession, d: str) -> DataFrame:
    return P.postings(_live(spark, d))


@query(_GIVEN + "SELECT DISTINCT path FROM p WHERE starts_with(term, 'aud')")
def term_prefix(spark: SparkSession, d: str) -> DataFrame:
    return P.match_all(_by_term(spark, d), parse("aud"), SearchOptions(), 500)


@query(_GIVEN + "SELECT DISTINCT path FROM p WHERE term = chr(2) || 'pdf' INTERSECT SELECT path FROM p WHERE starts_with(term, 'pdf')")
def term_exact_ext(spark: SparkSession, d: str) -> DataFrame:
    return P.match_all(_by_term(spark, d), parse(".pdf"), SearchOptions(), 500)


@query(_GIVEN + "SELECT path FROM p WHERE starts_with(term, 'srv') INTERSECT SELECT path FROM p WHERE starts_with(term, 'draft') INTERSECT SELECT path FROM p WHERE starts_with(term, '0')")
def term_and(spark: SparkSession, d: str) -> DataFrame:
    return P.match_all(_by_term(spark, d), parse("srv draft 0"), SearchOptions(short_prefix_threshold=0), 500)


@query(_GIVEN + ", c AS (SELECT term, count(*) AS n FROM p WHERE starts_with(term, 's') GROUP BY term ORDER BY term LIMIT 50), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c) SELECT term FROM r WHERE b < 2500")
def expansion_limit(spark: SparkSession, d: str) -> DataFrame:
    found = P.expansions(_by_term(spark, d), "s", SearchOptions(), scoring_cap(10, 0, SearchOptions()), first=True)
    return spark.createDataFrame([(t,) for t in found], "term string")


@query(sql.LIVE + f"SELECT {ENTRY} FROM live ORDER BY {sql.PRERANK} LIMIT 500")
def prerank_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.prerank(_live(spark, d), 500).select(*ENTRY.split(", "))


# recent files and searches

_RECENT = sql.LIVE + "SELECT path, volume, volume_type, kind, last_modified, last_accessed, category, CAST(0 AS DOUBLE) AS score FROM live WHERE greatest(last_modified // 1000000, coalesce(last_accessed, 0) // 1000000) >= {} {} ORDER BY greatest(last_modified, coalesce(last_accessed, 0)) DESC, path LIMIT {} OFFSET {}"


@query(_RECENT.format(SINCE, "", 100, 0))
def recent_files(spark: SparkSession, d: str) -> DataFrame:
    return search.recent_files(_live(spark, d), SINCE, 100)


@query(_RECENT.format(SINCE, "", 100, 100))
def recent_page2(spark: SparkSession, d: str) -> DataFrame:
    return search.recent_files(_live(spark, d), SINCE, *search.page(1))


@query(_RECENT.format(SINCE, "AND category & 2 <> 0 AND kind <> 1 AND volume = 'vol1'", 50, 0))
def recent_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.recent_files(_live(spark, d), SINCE, 50, 0, SearchOptions(category=Category.DOCUMENT, kind=Kind.FILE, volume_name="vol1"))


def _search(spark: SparkSession, d: str, text: str, limit: int, offset: int = 0, options: SearchOptions = SearchOptions()) -> DataFrame:
    entries = written(_live(spark, d), "live")
    found = search.search(entries, P.postings(entries), text, limit, offset, options, NOW)
    return found.withColumn("score", F.round("score", 6))


@query(sql.search("audit", 50, 0, NOW))
def search_single(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "audit", 50)


@query(sql.search("srv draft", 50, 0, NOW))
def search_multi(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "srv draft", 50)


@query(sql.search("report .pdf", 50, 0, NOW))
def search_ext(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "report .pdf", 50)


@query(sql.search("draft", 100, 100, NOW))
def search_page2(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "draft", *search.page(1))


@query(sql.search("report", 50, 0, NOW, "category & 2 <> 0 AND kind <> 1 AND volume_type IN (0, 1)"))
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "report", 50, 0, SearchOptions(category=Category.DOCUMENT, kind=Kind.FILE, volume_type=(VolumeType.LOCAL, VolumeType.NETWORK)))


@query(sql.search("draft", 20, 0, NOW, score="CAST(length(path) AS DOUBLE)"))
def search_custom_score(spark: SparkSession, d: str) -> DataFrame:
    longest = ScoringConfig(function=lambda weights, tokens, raw, now: F.length("path").cast("double"))
    return _search(spark, d, "draft", 20, 0, SearchOptions(scoring=longest))


@query(sql.search("отчёт", 50, 0, NOW))
def search_unicode(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "отчёт", 50)


@query(sql.search("notes", 10, 0, NOW))
def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    """The same through a compacted catalogue, whose postings are read sorted."""
    c = _loaded(spark, d)
    c.force_compact_all()
    return c.search("notes", 10, now_micros=NOW).withColumn("score", F.round("score", 6))


def _generations(spark: SparkSession, d: str) -> Catalog:
    """A catalogue of eight generations that no merge has touched."""
    c, ops = Catalog(spark, run_dir(spark, "catalog")), table(spark, d, "fs_oplog")
    for i in range(8):
        c.append_ops(ops.where(F.pmod(F.xxhash64("rec_id"), F.lit(8)) == i))
    c.add_tombstones(table(spark, d, "fs_tombstones"))
    return c


@query(sql.search("draft", 50, 0, NOW, "volume = 'vol1'"))
def catalog_search_generations(spark: SparkSession, d: str) -> DataFrame:
    """A search on one volume of a catalogue that isn't merged: versions are resolved for the paths found only."""
    return _generations(spark, d).search("draft", 50, 0, SearchOptions(volume_name="vol1"), NOW).withColumn("score", F.round("score", 6))


@query(_RECENT.format(SINCE, "AND category & 2 <> 0", 50, 0))
def catalog_recent_generations(spark: SparkSession, d: str) -> DataFrame:
    return _generations(spark, d).recent_files(SINCE, 50, 0, SearchOptions(category=Category.DOCUMENT))


# figures


@query("WITH s AS (SELECT list_sort(list(value)) AS v, count(value) AS n, avg(value) AS a, max(value) AS m FROM events WHERE value IS NOT NULL) SELECT v[n // 2 + 1] AS p50, v[greatest(CAST(floor(n * 0.75) AS BIGINT), 1)] AS p75, v[greatest(CAST(floor(n * 0.9) AS BIGINT), 1)] AS p90, v[greatest(CAST(floor(n * 0.95) AS BIGINT), 1)] AS p95, v[greatest(CAST(floor(n * 0.99) AS BIGINT), 1)] AS p99, a AS avg, m AS max FROM s")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.percentiles(table(spark, d, "events"), "value")


@query("SELECT event_type, CAST(sum(user_id) // count(user_id) AS BIGINT) AS mean, count(*) AS n, max(user_id) AS top FROM events GROUP BY event_type")
def latency_mean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(stats.whole_mean("user_id").alias("mean"), F.count("*").alias("n"), F.max("user_id").alias("top"))


@query("SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 0 ELSE CAST(floor(event_id / ((user_id % 7) / 1000.0)) AS BIGINT) END AS rate FROM events")
def files_per_second(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", stats.files_per_second(F.col("event_id"), F.col("user_id") % 7).alias("rate"))


@query()
def walk_folder(spark: SparkSession, d: str) -> DataFrame:
    """The folder of the test tables, as entries."""
    register(spark)
    return spark.read.format("entries").option("path", d).load()
