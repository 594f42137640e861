"""Registered queries of logs of live streams, incremental builds, the posting table, and addresses.

Events are read as a log: a user is a stream or a key, and what an event says follows from its type. The same operators run on
streams; tests hold the streams against these batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import identity, segment
from ..shared import own_folder
from ..sources.store import CatalogStore
from ..streaming import events as stream
from .catalog import _CASES, _STARTS, _event_pages, _quote, _score_sql, cases, query, table


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS gap FROM events),
s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts) AS stretch FROM e)
SELECT CAST(user_id AS VARCHAR) AS stream_id, epoch_us(min(ts)) AS began, epoch_us(max(ts)) AS last, epoch_us(max(ts) + INTERVAL 6 HOUR) AS timed_out, count(*) AS n_events FROM s GROUP BY user_id, stretch""")
def idle_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a user's events without a pause of six hours, and when each times out."""
    log = _log(spark, sf_dir).select(F.col("user_id").cast("string").alias("stream_id"), "at")
    out = stream.idle_times(log, "6 hours")
    return out.select("stream_id", *(F.unix_micros(c).alias(c) for c in ("began", "last", "timed_out")), "n_events")


@query(f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS stream_id, event_id, ts, event_type AS kind, event_id % 7 = 0 AS closes FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY stream_id ORDER BY ts, event_id) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS gap FROM e),
s AS (SELECT *, sum(gap) OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS stretch FROM g),
f AS (SELECT *, min(ts) FILTER (kind = 'purchase' OR closes) OVER (PARTITION BY stream_id, stretch) AS ends FROM s),
c AS (SELECT * FROM f WHERE ends IS NULL OR ts <= ends + INTERVAL 1 HOUR),
o AS (SELECT stream_id, stretch, coalesce(bool_or(kind = 'error' AND event_id % 11 = 0 AND NOT closes), false) AS broken, bool_or(closes) AS closed,
  arg_max('s' || event_id, event_id) FILTER (kind = 'purchase' AND NOT closes) AS final, string_agg('<' || event_id || '>', '' ORDER BY ts, event_id) FILTER (kind = 'view' AND NOT closes) AS said,
  count(DISTINCT event_id % 3) FILTER (kind = 'click' AND NOT closes AND event_id % 3 > 0) + count(*) FILTER (kind = 'click' AND NOT closes AND event_id % 3 = 0) AS items FROM c GROUP BY ALL)
SELECT stream_id, CASE WHEN broken OR final IS NULL AND NOT closed THEN 'error' WHEN final IS NOT NULL THEN final WHEN said IS NOT NULL OR items > 0 THEN 'completed' ELSE 'error' END AS status,
  CASE WHEN NOT broken AND (final IS NOT NULL OR closed) THEN said END AS text, CAST(CASE WHEN broken THEN 0 ELSE items END AS INTEGER) AS n_items,
  CASE WHEN broken THEN 'invalid json' WHEN final IS NULL AND NOT closed THEN 'idle timeout' WHEN final IS NULL AND said IS NULL AND items = 0 THEN 'no final response' END AS error FROM o""")
def live_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a log: views are pieces of text, clicks items with or without an id, purchases final responses, errors nothing or
    broken data; every seventh event closes its connection."""
    i, closes = F.col("event_id"), F.col("event_id") % 7 == 0
    said = lambda kind, **more: F.to_json(F.struct(F.lit(kind).alias("type"), *(c.alias(n) for n, c in more.items())))
    data = (
        F.when(closes, F.lit(None)).when(F.col("event_type") == "view", said("response.output_text.delta", delta=F.concat(F.lit("<"), i, F.lit(">"))))
        .when(F.col("event_type") == "click", said("response.output_item.done", item=F.struct(F.when(i % 3 > 0, (i % 3).cast("string")).alias("id"))))
        .when(F.col("event_type") == "purchase", said("response.completed", response=F.struct(F.concat(F.lit("s"), i).alias("status"))))
        .when((F.col("event_type") == "error") & (i % 11 == 0), F.lit("{broken"))
    )
    log = _log(spark, sf_dir).select(F.col("user_id").cast("string").alias("stream_id"), i.alias("seq"), "at", F.when(closes, F.lit(stream.CLOSED)).alias("event"), data.alias("data"))
    return stream.fold_batch(log, "12 hours", "1 hour")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id AS key, ts, event_type = 'error' AS release, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
r AS (SELECT *, CASE WHEN release THEN coalesce(before, -1) ELSE event_id END AS request_id, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn FROM e),
g AS (SELECT key, rn, request_id, release, CASE WHEN release THEN NULL ELSE ts + INTERVAL 12 HOUR END AS until, CASE WHEN release THEN NULL ELSE request_id END AS holder, true AS granted FROM r WHERE rn = 1
  UNION ALL SELECT r.key, r.rn, r.request_id, r.release,
    CASE WHEN r.release THEN CASE WHEN r.request_id = g.holder THEN NULL ELSE g.until END WHEN g.until IS NULL OR r.ts > g.until THEN r.ts + INTERVAL 12 HOUR ELSE g.until END,
    CASE WHEN r.release THEN CASE WHEN r.request_id = g.holder THEN NULL ELSE g.holder END WHEN g.until IS NULL OR r.ts > g.until THEN r.request_id ELSE g.holder END,
    g.until IS NULL OR r.ts > g.until FROM g JOIN r ON r.key = g.key AND r.rn = g.rn + 1)
SELECT key, request_id, granted FROM g WHERE NOT release""")
def reservations_released(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a key for twelve hours; an error gives back what the event before it has asked for, if that was granted."""
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    release = F.col("event_type") == "error"
    asked = _log(spark, sf_dir).select(F.col("user_id").alias("key"), F.when(release, F.coalesce(before, F.lit(-1))).otherwise(F.col("event_id")).alias("request_id"), "at", release.alias("release"))
    return identity.reservations(asked, 720).select("key", "request_id", "granted")


@query("""WITH s AS (SELECT user_id AS key, epoch_us(ts) // 7200000000 AS slot, arg_max(event_type, (ts, event_id)) AS text, min(epoch_us(ts)) AS first FROM events GROUP BY ALL),
b AS (SELECT *, lag(text) OVER w AS before, (lag(slot) OVER w + 1) * 7200000000 AS ended FROM s WINDOW w AS (PARTITION BY key ORDER BY slot))
SELECT key, (slot + 1) * 7200000000 AS at, text FROM b WHERE NOT coalesce(text = before AND first - ended <= 86400000000, false)""")
def texts_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last text of every two hours, where it is not that shown before it within a day."""
    ticks = _log(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "at", F.col("event_type").alias("text"))
    return stream.shown(ticks, "2 hours", "1 day").select("key", F.unix_micros("at").alias("at"), "text")


def _store(spark: SparkSession) -> CatalogStore:
    return CatalogStore(spark, own_folder(spark, "store"))


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'late' ELSE lang END AS collection_id, count(*) AS n, sum(CASE WHEN doc_id % 5 = 0 THEN 2 ELSE CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END END)::BIGINT AS batches FROM documents GROUP BY 1")
def store_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incremental build of three batches, the second given twice: of a case in several the last one counts."""
    store = _store(spark)
    g = store.begin(6)
    own = cases(spark, sf_dir).select("doc_id", "catalog_key", "collection_id", "text")
    late = own.where("doc_id % 5 = 0").withColumn("collection_id", F.lit("late"))
    for batch_id, part in ((0, own.where("doc_id % 2 = 0")), (1, own.where("doc_id % 2 = 1")), (1, own.limit(0)), (2, late)):
        store.stage(g, part.withColumn("batch", F.lit(batch_id)), batch_id)
    store.seal(g, lambda rows: None if rows.where("collection_id = 'late'").count() else "no late cases")
    return store.cases(store.active().generation_id).groupBy("collection_id").agg(F.count("*").alias("n"), F.sum("batch").alias("batches"))


_RARE = ["anread", "heerha", "ßeinber", "xqzj kw", "edonwh"]
_RARE_SQL = ["anread", "heerha", "einber", "xqzj kw", "edonwh"]


@query(f"""WITH {_CASES}, recent AS (SELECT * FROM cases WHERE {' OR '.join(f"contains(normalized_text, {_quote(t)})" for t in _RARE_SQL)} ORDER BY indexed_at DESC, catalog_key LIMIT 400)
SELECT catalog_key, match_score FROM (SELECT *, {_score_sql(_RARE_SQL, ('src1', 'src3', 'src5'))} AS match_score FROM recent) ORDER BY match_score DESC, indexed_at DESC, catalog_key LIMIT 25""")
def retrieve_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of the generation that is read through its posting table."""
    store = _store(spark)
    g = store.begin(6)
    store.write_cases(g, cases(spark, sf_dir).drop("text"))
    store.promote(g)
    store.index_terms(g)
    return store.search(_RARE, ("src1", "src3", "src5"), limit=25).select("catalog_key", "match_score")


_ROOT, _DIR = r"regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)", r"regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '')"


@query(rf"""WITH l AS (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(replace(html, '&amp;', '&'), '(?i)href\s*=\s*["'']/([A-Za-z]+)["'']', 1)) AS w FROM pages),
p AS (SELECT *, {_ROOT} AS root, {_DIR} AS dir, regexp_replace(url, '[?#].*$', '') AS bare FROM l)
SELECT page_id, w, CASE page_id % 6 WHEN 0 THEN root || '/' || w WHEN 1 THEN root || dir || w WHEN 2 THEN root || regexp_replace(dir, '[^/]+/$', '') || w WHEN 3 THEN bare || '?k=' || w
  WHEN 4 THEN split_part(root, ':', 1) || '://other.example/' || w ELSE 'mailto:' || w END AS link FROM p""")
def links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative forms of a page's links, led back to whole addresses."""
    found = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(urls.links(urls.unescaped(F.col("html")))).alias("l"))
    rows = found.select("page_id", "url", F.regexp_extract("l", "^/([A-Za-z]+)$", 1).alias("w")).where("w <> ''").distinct()
    form = F.element_at(F.array(*(F.concat(F.lit(a), "w") for a in ("/x/../", "./y/../", "../", "?k=", "//other.example/", "mailto:"))), (F.col("page_id") % 6 + 1).cast("int"))
    return rows.select("page_id", "w", urls.joined(F.col("url"), form).alias("link"))


def _v4_sql(x: str, blocks: list[tuple[int, int]]) -> str:
    return "(" + " OR ".join(f"{x} BETWEEN {a} AND {b}" for a, b in blocks) + ")"


#: Borders of the IPv4 addresses that are not public, written out for the SQL.
_SET_ASIDE = [
    (0, 0x00FFFFFF), (0x0A000000, 0x0AFFFFFF), (0x7F000000, 0x7FFFFFFF), (0xA9FE0000, 0xA9FEFFFF), (0xAC100000, 0xAC1FFFFF), (0xC0000000, 0xC0000008), (0xC000000B, 0xC00000FF), (0xC0000200, 0xC00002FF),
    (0xC0A80000, 0xC0A8FFFF), (0xC6120000, 0xC613FFFF), (0xC6336400, 0xC63364FF), (0xCB007100, 0xCB0071FF), (0xE0000000, 0xFFFFFFFF),
]


@query(f"""WITH n AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 3221225472 + event_id % 16 WHEN event_id % 4 = 1 THEN 167772160 + event_id ELSE (event_id * 2654435761) % 4294967296 END AS x FROM events)
SELECT event_id, {_v4_sql('x', _SET_ASIDE)} AS v4, true AS mapped, event_id % 3 <> 0 AS v6 FROM n""")
def address_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether addresses made of event ids are set aside: plain, mapped into IPv6, and IPv6 of a public or a private block."""
    i = F.col("event_id")
    x = F.when(i % 4 == 0, 3221225472 + i % 16).when(i % 4 == 1, 167772160 + i).otherwise((i * 2654435761) % 4294967296)
    quad: Column = F.array_join(F.array(*(F.shiftright(F.col("x"), k) % 256 for k in (24, 16, 8, 0))).cast("array<string>"), ".")
    own = F.concat(F.element_at(F.array(F.lit("[2a00:"), F.lit("[FD00:"), F.lit("[fe80:0:")), (i % 3 + 1).cast("int")), F.lower(F.hex(i % 65536)), F.lit("::1]"))
    ids = table(spark, sf_dir, "events").select("event_id").repartition(4 * spark.sparkContext.defaultParallelism)  # few bytes in few tasks' files
    hosts = ids.select("event_id", x.alias("x")).select("event_id", quad.alias("quad"), own.alias("own"))
    mapped = urls.unsafe_literal_ip(F.concat(F.lit("::ffff:"), "quad"))
    return hosts.select("event_id", urls.unsafe_literal_ip(F.col("quad")).alias("v4"), mapped.alias("mapped"), urls.unsafe_literal_ip(F.col("own")).alias("v6"))


@query(f"""WITH {_STARTS}, spans AS (SELECT doc_id, number, page_no AS page_start, coalesce(lead(page_no) OVER (PARTITION BY doc_id ORDER BY page_no) - 1, (SELECT max(page_no) FROM pages_ p WHERE p.doc_id = s.doc_id)) AS last FROM starts s),
ends AS (SELECT s.doc_id, s.number, s.page_start, max(CASE WHEN p.page_no = s.page_start OR length(trim(p.text)) >= 120 THEN p.page_no END) AS page_end FROM spans s JOIN pages_ p ON p.doc_id = s.doc_id AND p.page_no BETWEEN s.page_start AND s.last GROUP BY 1, 2, 3)
SELECT e.doc_id, e.number, e.page_start, e.page_end, substr(string_agg(p.text, chr(10) ORDER BY p.page_no), 1, 400) AS text FROM ends e JOIN pages_ p ON p.doc_id = e.doc_id AND p.page_no BETWEEN e.page_start AND e.page_end GROUP BY 1, 2, 3, 4""")
def case_ranges_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of pages in order by a table function that keeps the running case, their texts cut."""
    return segment.running_cases(_event_pages(spark, sf_dir), max_chars=400)
