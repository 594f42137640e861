"""Registered queries of the steps around the catalog: documents, the store, ranges, records and checks, with SQL over the same tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import identity, retrieve, segment, validate, workflow
from ..operators.retrieve import Course
from ..shared import allow_checkpoints, own_folder
from ..sources import crawl, files, profiles
from ..sources.store import CatalogStore
from ..streaming import events as stream
from .catalog import _CASES, _COURSE_TERMS, _DIRECT_SQL, _HOST, _PAGES, _SERIES, COURSES, REGISTRY, _event_pages, _n3, _quote, _score_sql, cases, query, table

# documents and files

_LINK = r'href="/([A-Z][a-z]*)[^"]*"'


@query(
    "SELECT id || ':v' || n AS document_id, replace(url_template, '{volume}', CAST(n AS VARCHAR)) AS url FROM (SELECT *, unnest(generate_series(first, last)) AS n FROM (VALUES " + ", ".join(f"({_quote(a)}, {_quote(b)}, {c}, {d})" for a, b, c, d in _SERIES if b) + ") AS s(id, url_template, first, last)) "
    rf"UNION ALL SELECT 's:crawl:' || substr(sha256(url), 1, 16), url FROM (SELECT DISTINCT 'https://' || {_HOST} || '/docs/' || unnest(regexp_extract_all(html, '{_LINK}', 1)) || '.pdf' AS url FROM pages WHERE starts_with(url, 'https:') AND {_HOST} IN ('tionsh.example.net', 'blog.tionsh.example.net'))"
)
def documents_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of numbered series and of a crawl, by the kind of the source."""
    domains = profiles.registry(spark, REGISTRY)
    pages = table(spark, sf_dir, "pages").select("url", F.regexp_replace("html", _LINK, 'href="/docs/$1.pdf"').alias("html"))
    landing = profiles.classify(pages.select("url"), domains).where("original_pdf").select("url")
    numbered = [profiles.Source(a, a, a, "numbered_pdf_series", url_template=b, first=c, last=d) for a, b, c, d in _SERIES]
    found = profiles.Source("s", "net", "Net", "landing_page_crawl", landing_pages=landing, max_depth=1, max_pages=1 << 30, document_prefixes=("/docs/",))
    off = profiles.Source("off", "net", "Net", "landing_page_crawl", enabled=False)
    return crawl.documents(pages, domains, [*numbered, found, off])


@query("SELECT page_id, concat_ws(',', CASE WHEN page_id % 5 = 0 THEN 'no pdf' END, CASE WHEN page_id % 3 = 0 THEN 'encrypted' END, CASE WHEN page_id % 7 = 0 THEN 'no pages' END, CASE WHEN page_id % 7 * 300 > 1500 THEN 'too many pages' END) AS faults FROM pages")
def pdf_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    faults = files.pdf_faults(i % 5 != 0, F.when(i % 3 == 0, True), (i % 7 * 300).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(faults, ",").alias("faults"))


@query("SELECT event_id, 'cases-' || strftime(ts, '%Y%m%dT%H%M%SZ') || '.parquet' AS name FROM events")
def utc_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", files.backup_name("cases", F.col("ts").cast("timestamp")).alias("name"))


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR")
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows older than six hours before the newest."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("modified"))
    newest = e.agg(F.max("modified")).first()[0]
    return files.stale(e, F.lit(newest), 6).select("event_id")


# the store


def _store(spark: SparkSession) -> CatalogStore:
    return CatalogStore(spark, own_folder(spark, "store"))


@query("SELECT lang AS collection_id, 'ready' AS status, count(*) AS n, min(sha256(text)) AS first_sha FROM documents WHERE lang NOT IN ('fr', 'de') OR lang = 'fr' AND doc_id % 2 = 0 GROUP BY lang")
def store_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of a generation after a collection was replaced and another emptied, as its readers see them once it is promoted."""
    store = _store(spark)
    g = store.begin(6)
    own = cases(spark, sf_dir).select("collection_id", "catalog_key", "text", "doc_id")
    store.write_cases(g, own)
    store.replace_collection(g, "fr", own.where("collection_id = 'fr' AND doc_id % 2 = 0"))
    store.replace_collection(g, "de", own.where("false"))
    store.promote(g)
    active = store.active(6)
    read = store.cases(active.generation_id)
    return read.groupBy("collection_id").agg(F.lit(active.status).alias("status"), F.count("*").alias("n"), F.min(F.sha2("text", 256)).alias("first_sha"))


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'indexed' ELSE 'seen' END AS status, greatest(0, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 ELSE doc_id % 5 - 2 END) AS case_count, doc_id % 2 = 0 AS wanted FROM labels")
def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of documents, a third of them written again, and whether a list of documents finds them indexed."""
    store = _store(spark)
    g = store.begin(6)
    i = F.col("doc_id")
    own = table(spark, sf_dir, "labels").select(i.cast("string").alias("document_id"), i)
    store.write_documents(g, own.select("document_id", F.lit("seen").alias("status"), (i % 5 - 2).alias("case_count")))
    store.write_documents(g, own.where(i % 3 == 0).select("document_id", F.lit("indexed").alias("status"), (i % 7).alias("case_count")))
    found = store.indexed(g, own.where(i % 2 == 0).select("document_id")).withColumn("wanted", F.lit(True))
    return store.documents(g.generation_id).join(found, "document_id", "left").select("document_id", "status", "case_count", F.coalesce("wanted", F.lit(False)).alias("wanted"))


@query("SELECT b.name, lang AS collection_id, count(*) AS n FROM documents, (VALUES ('catalog-20240102T000000Z'), ('catalog-20240103T000000Z')) AS b(name) GROUP BY ALL")
def store_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of what is read: of three the newest two stay."""
    store = _store(spark)
    g = store.begin(6)
    store.write_cases(g, cases(spark, sf_dir).select("collection_id", "catalog_key", "text"))
    store.promote(g)
    for day in (1, 2, 3):
        store.backup(f"{store.base}-backups", 2, datetime(2024, 1, day))
    left = spark.read.parquet(f"{store.base}-backups/*/cases").select(F.element_at(F.split(F.input_file_name(), "/"), -3).alias("name"), "collection_id")
    return left.groupBy("name", "collection_id").agg(F.count("*").alias("n"))


# pages and cases



@query(f"WITH {_PAGES} SELECT doc_id, page_no, sha256(text) AS text_sha256 FROM pages_ WHERE page_no BETWEEN 2 AND 4 AND doc_id IN (SELECT doc_id FROM pages_ GROUP BY 1 HAVING max(page_no) >= 4)")
def page_range_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.page_range(_event_pages(spark, sf_dir), 2, 4).select("doc_id", "page_no", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {_PAGES}, f AS (SELECT doc_id, number, min(page_no) AS p FROM pages_ WHERE number IS NOT NULL GROUP BY 1, 2) SELECT doc_id, string_agg(number, ',' ORDER BY p) AS numbers FROM f GROUP BY 1")
def ordered_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.ordered_numbers(_event_pages(spark, sf_dir)).select("doc_id", F.array_join("numbers", ",").alias("numbers"))


@query(f"WITH {_PAGES} SELECT doc_id, max(page_no) > 18 OR count(DISTINCT number) > 4 OR count(DISTINCT number) > 1 AS compilation FROM pages_ GROUP BY 1")
def compilation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.is_compilation(_event_pages(spark, sf_dir), 18)


@query("SELECT doc_id, length(p) < 220 OR length(p) < 420 AND NOT (" + " OR ".join(f"contains(p, {_quote(w)})" for w in segment.JUDGMENT) + ") AS decorative FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) || CASE WHEN doc_id % 4 = 0 THEN ' المحكمة' ELSE '' END AS p FROM documents)")
def decorative_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.when(F.col("doc_id") % 4 == 0, F.lit(" المحكمة")).otherwise(F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", segment.decorative(F.concat(text.squeeze(F.col("text")), words)).alias("decorative"))


@query("SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 500")
def extractable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.extractable(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id")


# numbers, names and texts


_N2 = f"translate({_n3('text')}, '{text.ARABIC_DIGITS}', '{text.ASCII_DIGITS}')"
_N5 = f"lower(regexp_replace(translate(text, '{text.ARABIC_DIGITS}', '{text.ASCII_DIGITS}'), '\\s+', '', 'g'))"
_N6 = rf"regexp_replace(translate(replace(lower(translate(text, '{text.ARABIC_DIGITS}', '{text.ASCII_DIGITS}')), '{text.TATWEEL}', ''), '{text.LETTER_FORMS}', '{text.PLAIN_FORMS}'), '[^0-9a-z\x{{0600}}-\x{{06FF}}]+', '', 'g')"


@query(f"SELECT doc_id, sha256({_N2}) AS search, sha256({_N5}) AS compact, sha256({_N6}) AS metadata FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1, 'القضية رقمـ ٣٤/١٤٣٥ إلى')")
def other_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame([(-1, "القضية رقمـ ٣٤/١٤٣٥ إلى")], "doc_id long, text string"))
    forms = {"search": text.normalize_search, "compact": text.normalize_compact, "metadata": text.normalize_metadata}
    return docs.select("doc_id", *(F.sha2(f(F.col("text")), 256).alias(n) for n, f in forms.items()))


@query("SELECT page_id, substr(trim(regexp_replace(url, '[^0-9A-Za-z_-]+', '-', 'g'), '-_'), 1, 80) AS name, CASE WHEN page_id * 37 < 1024 THEN (page_id * 37) || ' B' WHEN page_id * 37 < 1048576 THEN printf('%.1f KB', page_id * 37 / 1024.0) ELSE printf('%.1f MB', page_id * 37 / 1048576.0) END AS size FROM pages")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.safe_filename(F.col("url")).alias("name"), text.human_size(F.col("page_id") * 37).alias("size"))


@query("SELECT page_id, array_to_string(t[greatest(1, len(t) - 2):], ',') AS tokens, len(t) > 0 AND contains(url, t[greatest(1, len(t) - 2)]) AS found FROM (SELECT page_id, url, regexp_extract_all(url, '[0-9]{3,}') AS t FROM pages)")
def digit_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last groups of digits of an address, and whether they stand in it."""
    tokens = text.number_tokens(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(tokens, ",").alias("tokens"), text.tokens_match(F.col("url"), tokens).alias("found"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN " + _quote(workflow.FAILURES["commentary_timeout"]) + " WHEN 1 THEN " + _quote(workflow.FAILURES["artifact_missing"]) + " ELSE " + _quote(workflow.OTHER_FAILURE) + " END AS message, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'TimeoutError' END AS reason FROM events")
def failure_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    code = F.when(i % 3 == 0, "commentary_timeout").when(i % 3 == 1, "artifact_missing").otherwise("unknown")
    said = F.when(i % 2 == 0, F.concat(F.lit("  "), "event_type")).otherwise(F.lit("  "))
    return table(spark, sf_dir, "events").select("event_id", workflow.failure_message(code).alias("message"), text.short_reason(said, F.lit("TimeoutError")).alias("reason"))


@query("SELECT count(*) AS n, count(*) AS distinct_ids, CAST(36 AS INTEGER) AS longest FROM nation")
def random_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "nation").select(F.expr("uuid()").alias("id"))
    return ids.agg(F.count("*").alias("n"), F.countDistinct("id").alias("distinct_ids"), F.max(F.length("id")).alias("longest"))


# records, choices and prompts

_HISTORY = """c AS (SELECT doc_id, source, sha256(text) AS pdf_sha256, CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 400 AS VARCHAR) END AS case_number, CASE WHEN doc_id % 5 <> 0 THEN ' Court ' || (doc_id % 11) END AS court_name FROM documents), h AS (SELECT * FROM c WHERE doc_id % 10 = 3), n AS (SELECT * FROM c WHERE doc_id % 10 <> 3),
fresh AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.pdf_sha256 = n.pdf_sha256) AND NOT EXISTS (SELECT 1 FROM h WHERE coalesce(n.case_number, '') <> '' AND coalesce(n.court_name, '') <> '' AND h.case_number = n.case_number AND h.court_name = n.court_name)),
by_sha AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pdf_sha256 ORDER BY doc_id) AS rn FROM fresh) WHERE rn = 1),
recorded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_number, court_name ORDER BY doc_id) AS r2 FROM by_sha) WHERE r2 = 1 OR case_number IS NULL OR court_name IS NULL)"""


def _sent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    i = F.col("doc_id")
    c = table(spark, sf_dir, "documents").select(
        i, F.concat(F.lit("t"), (i % 50).cast("string")).alias("token"), F.col("source").alias("subject_slug"), F.sha2("text", 256).alias("pdf_sha256"), F.when(i % 7 != 0, (i % 400).cast("string")).alias("case_number"), F.when(i % 5 != 0, F.concat(F.lit(" Court "), (i % 11).cast("string"))).alias("court_name")
    )
    return workflow.record_sent(c.where("doc_id % 10 <> 3"), c.where("doc_id % 10 = 3"), "doc_id")


@query(f"WITH {_HISTORY} SELECT doc_id FROM recorded")
def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be recorded: not used before, and the first of equal ones among themselves."""
    return _sent(spark, sf_dir)[0].select("doc_id")


@query(f"WITH {_HISTORY} SELECT 'case_sent' AS event_type, source AS subject_slug, case_number, 'sha=' || pdf_sha256 AS details FROM recorded")
def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit table after the rows of a delivery went to its end."""
    path = own_folder(spark, "audit")
    workflow.append_audit(_sent(spark, sf_dir)[1], path)
    return spark.read.parquet(path).drop("at")


@query("SELECT DISTINCT 't' || (doc_id % 50) AS token FROM documents WHERE doc_id % 10 <> 3")
def released_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sent(spark, sf_dir)[2]


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS others FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS chosen FROM orders) WHERE o_orderkey <> chosen GROUP BY 1")
def other_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a choice releases."""
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("tokens"), F.min("o_orderkey").alias("chosen"))
    left = own.select("o_custkey", F.array_join(workflow.others(F.col("tokens"), F.col("chosen")), ",").alias("others"))
    return left.where("others <> ''")


@query("""WITH s AS (SELECT o_custkey AS user_id, o_orderkey AS token, o_orderdate AS expires_at FROM orders), c AS (SELECT user_id, max(token) AS chosen FROM s GROUP BY 1)
SELECT s.user_id, s.token, s.token = chosen AS chosen FROM s JOIN c USING (user_id) WHERE s.token <> chosen OR s.expires_at > DATE '1995-01-01'""")
def session_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen sessions that had not run out, and the tokens of the users' others."""
    sessions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("token"), F.col("o_orderdate").alias("expires_at"))
    choice = sessions.groupBy("user_id").agg(F.max("token").alias("token")).withColumn("at", F.lit("1995-01-01").cast("date"))
    chosen, released = workflow.select_token(sessions, choice)
    return chosen.select("user_id", "token", F.lit(True).alias("chosen")).union(released.select("user_id", "token", F.lit(False)))


@query("SELECT CASE WHEN o_orderkey % 3 <> 0 THEN 'case|' || o_custkey || '|' || lower(o_clerk) ELSE 'url|u' || o_orderkey END AS identity, count(*) AS n FROM (SELECT o_orderkey, o_custkey, 'Court ' || o_orderpriority AS o_clerk FROM orders) GROUP BY 1")
def round_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    key = identity.round_identity(F.when(i % 3 != 0, F.col("o_custkey").cast("string")), F.concat(F.lit("Court "), "o_orderpriority"), F.concat(F.lit("u"), i.cast("string")))
    return table(spark, sf_dir, "orders").groupBy(key.alias("identity")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS user_id, c_custkey = 7 OR c_custkey IN (SELECT s_suppkey FROM supplier) AS allowed FROM customer")
def access_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return identity.allowed(users, members, 7).select("user_id", "allowed")


@query("""WITH r AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS by_, o_custkey % 40 - 1 AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN 'remove' ELSE 'add' END AS action FROM orders),
n AS (SELECT *, by_ <> 1 OR action = 'add' AND user_id <= 0 OR action = 'remove' AND user_id = 1 AS no FROM r), v AS (SELECT seq, lag(action) OVER (PARTITION BY user_id ORDER BY seq) AS before FROM n WHERE NOT no),
s AS (SELECT n.*, user_id = 1 OR CASE WHEN before IS NULL THEN user_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 20) ELSE before = 'add' END AS inside FROM n LEFT JOIN v USING (seq))
SELECT seq, user_id, CASE WHEN no THEN 'refused' WHEN action = 'add' AND NOT inside THEN 'added' WHEN action = 'remove' AND inside THEN 'removed' ELSE 'unchanged' END AS result FROM s""")
def member_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(i.alias("seq"), F.when(i % 4 == 0, 2).otherwise(1).alias("by"), (F.col("o_custkey") % 40 - 1).alias("user_id"), F.when(i % 3 == 0, "remove").otherwise("add").alias("action"))
    members = table(spark, sf_dir, "supplier").where("s_suppkey < 20").select(F.col("s_suppkey").alias("user_id"))
    return identity.member_changes(asked, members, 1).select("seq", "user_id", "result")


@query("SELECT event_id, event_type || chr(10) || chr(10) || '⏱️ الوقت المنقضي: ' || greatest(0, event_id % 50 - 10) || ' ثانية' || chr(10) || '🔄 يتم تحديث الحالة كل 3 ثوانٍ' AS text FROM events")
def progress_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", workflow.progress_text(F.col("event_type"), F.col("event_id") % 50 - 10).alias("text"))


@query("SELECT user_id, created_at FROM (SELECT c_custkey AS user_id, c_nationkey AS created_at FROM customer ORDER BY 2, 1 LIMIT 100) ORDER BY created_at, user_id LIMIT 8 OFFSET 96")
def users_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("created_at"))
    return workflow.users_page(users, 999)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS case_number, CASE WHEN o_orderkey % 3 = 0 THEN 'Court ' || o_custkey ELSE 'old' END AS court_name FROM orders")
def verified_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified fields replace a candidate's where they are not empty."""
    i = F.col("o_orderkey")
    meta = F.struct(F.when(i % 2 == 0, F.col("o_orderpriority")).otherwise(F.lit("")).alias("case_number"), F.when(i % 3 == 0, F.concat(F.lit("Court "), F.col("o_custkey").cast("string"))).alias("court_name"))
    cand = table(spark, sf_dir, "orders").select(i, F.col("o_orderstatus").alias("case_number"), F.lit("old").alias("court_name"), meta.alias("metadata"))
    return workflow.verified_over_candidate(cand).select("o_orderkey", "case_number", "court_name")


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AND l_quantity > 10 AS has_page_range, l_returnflag = 'A' AS is_auto, CAST(CASE WHEN l_linenumber % 3 = 0 THEN 90 ELSE l_linenumber END AS INTEGER) AS score FROM lineitem")
def derived_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("int")
    cand = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(n % 2 == 0, n).alias("pdf_page_start"), F.when(F.col("l_quantity") > 10, n).alias("pdf_page_end"), F.when(n % 3 == 0, 90).alias("final_score"), n.alias("estimated_score"), F.when(F.col("l_returnflag") == "A", "auto").when(F.col("l_returnflag") == "R", "manual").alias("mode"))
    return workflow.page_links(cand).select("l_orderkey", "l_linenumber", "has_page_range", "is_auto", "score")


@query("SELECT 'enough' AS side, s_suppkey AS pos FROM (SELECT s_suppkey FROM supplier ORDER BY 1 LIMIT 4) UNION ALL SELECT 'few', s_suppkey FROM (SELECT s_suppkey FROM supplier ORDER BY 1 LIMIT 2) UNION ALL SELECT 'few', c FROM (SELECT c_custkey + 1000000 AS c FROM customer ORDER BY 1 LIMIT 2) UNION ALL SELECT 'failed', s_suppkey FROM (SELECT s_suppkey FROM supplier ORDER BY 1 LIMIT 2)")
def remote_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remote side is asked only where local candidates are too few; if it can't answer, those that there are."""

    def rows(name: str, key: str, more: int) -> DataFrame:
        own = table(spark, sf_dir, name).select((F.col(key) + more).alias("pos"))
        return own.select("pos", F.lit(None).cast("string").alias("case_number"), F.lit(None).cast("string").alias("court_name"), F.col("pos").cast("string").alias("url"))

    def unavailable() -> DataFrame:
        raise retrieve.RemoteFailure("no answer")

    local, remote = rows("supplier", "s_suppkey", 0), rows("customer", "c_custkey", 1_000_000)
    few = local.orderBy("pos").limit(2)
    parts = {"enough": retrieve.with_fallback(local, unavailable, 4, 3), "few": retrieve.with_fallback(few, lambda: remote, 4, 3), "failed": retrieve.with_fallback(few, unavailable, 4, 3)}
    out = [p.select(F.lit(side).alias("side"), "pos") for side, p in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query("SELECT n_nationkey AS key, n_nationkey % 3 = 0 AS verified FROM nation WHERE n_nationkey <> 1 ORDER BY n_nationkey LIMIT 8")
def search_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of four candidates, each without those tried before, until three are verified."""
    allow_checkpoints(spark)
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), (F.col("n_nationkey") % 3 == 0).alias("verified"))
    return workflow.rounds(lambda excluded, i: nation.join(excluded, "key", "left_anti").orderBy("key").limit(4), nation.where("key = 1").select("key"), 3, 5)


# checks and answers


@query(f"SELECT doc_id, concat_ws(',', CASE WHEN NOT contains({_N6}, 'src' || (doc_id % 3)) THEN 'source' END, CASE WHEN doc_id % 2 = 1 THEN 'year' END) AS missing FROM documents")
def missing_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a text does not hold; its first letters always stand in it, empty ones are not looked for."""
    i = F.col("doc_id")
    wanted = F.create_map(F.lit("source"), F.concat(F.lit("SRC "), (i % 3).cast("string")), F.lit("start"), F.substring("text", 1, 20), F.lit("year"), F.when(i % 2 == 1, "zz9-not-there"), F.lit("none"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(validate.missing_metadata(F.col("text"), wanted), ",").alias("missing"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'direct' WHEN turn % 3 = 1 AND trim(text) <> '' THEN text || 'end' ELSE NULL END AS said FROM conversations")
def output_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of responses: given directly, or the text parts of their messages; other parts and blank ones are none."""
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    message = F.struct(F.lit("message").alias("type"), F.array(part("output_text", F.col("text")), part("text", F.lit("end")), part("refusal", F.lit("no"))).alias("content"))
    call = F.struct(F.lit("web_search_call").alias("type"), F.array(part("output_text", F.lit("hidden"))).alias("content"))
    response = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.lit("direct").alias("output_text")))).when(F.col("turn") % 3 == 1, F.to_json(F.struct(F.lit(" ").alias("output_text"), F.array(call, message).alias("output")))).otherwise(F.to_json(F.struct(F.array(call).alias("output"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", validate.output_text(response).alias("said"))


@query("SELECT CAST(conv_id AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, role AS event, ltrim(replace(text, chr(10), ' ')) || chr(10) || 'more' AS data FROM conversations")
def sse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a line protocol: named, of two data lines, with a comment between; ended by a blank line."""
    c = table(spark, sf_dir, "conversations")
    said = F.array(F.concat(F.lit("event: "), "role"), F.concat(F.lit("data: "), F.replace("text", F.lit("\n"), F.lit(" "))), F.lit(": comment"), F.lit("data:more"), F.lit(""))
    lines = c.select(F.col("conv_id").cast("string").alias("stream_id"), "turn", F.posexplode(said).alias("k", "line")).select("stream_id", (F.col("turn") * 10 + F.col("k")).alias("line_no"), "line")
    return stream.parse_sse(lines)


# candidates of all courses


def _course_sql(c: Course, limit: int) -> str:
    terms, wanted, scored = _COURSE_TERMS[c.slug], 40, 600  # of five candidates
    found = " OR ".join(f"contains(normalized_text, {_quote(t)})" for t in terms)
    return f"""SELECT {_quote(c.slug)} AS slug, catalog_key, match_score, subject_relevance FROM (
  SELECT x.catalog_key, x.match_score, x.indexed_at, r.score AS subject_relevance FROM (
    SELECT *, {_score_sql(terms, c.preferred)} AS match_score FROM (SELECT * FROM cases WHERE {found} ORDER BY indexed_at DESC, catalog_key LIMIT {scored}) ORDER BY match_score DESC, indexed_at DESC, catalog_key LIMIT {wanted}) x
  JOIN (SELECT * FROM judged WHERE slug = {_quote(c.slug)} AND accepted) r ON r.doc_id = x.doc_id WHERE x.doc_id % 6 <> 1 ORDER BY x.match_score DESC, x.indexed_at DESC, x.catalog_key LIMIT {limit})"""


@query(f"WITH {_CASES}, plains AS (SELECT doc_id, {_n3('text')} AS plain FROM documents), judged AS ({_DIRECT_SQL}) " + " UNION ALL ".join(f"SELECT * FROM ({_course_sql(c, 5)})" for c in COURSES))
def course_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidates of every course in one reading of the cases; those without a whole digest are none."""
    own = cases(spark, sf_dir).withColumn("pdf_sha256", F.when(F.col("doc_id") % 6 == 1, F.lit("short")).otherwise(F.sha2("text", 256)))
    none = spark.createDataFrame([], "case_number string, court_name string")
    return retrieve.candidates_by_course(own, COURSES, none, 5).select("slug", "catalog_key", "match_score", "subject_relevance")
