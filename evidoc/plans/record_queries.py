"""Queries over records: reconciliation, confidence, review, uploads, sessions and images' measurements."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidoc.functions.refdata import WEIGHTS
from evidoc.operators import imaging, reconcile, review
from evidoc.operators.mrz import parse, resolve_date
from evidoc.plans import process
from evidoc.plans.bridge import LINES, holders, lines, spread, table
from evidoc.plans.zone_queries import _sql_date
from evidoc.sources import records, samples, uploads
from evidoc.storage import shared_folder
from evidoc.streaming import sessions

c = F.col


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of customers that profiles, images and marks are made from, dealt to all cores."""
    return spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, parsed: every fifth number has a wrong check digit, every eleventh page no zone."""
    wrong = F.concat(F.substring("line2", 1, 9), ((F.substring("line2", 10, 1).cast("int") + 1) % 10).cast("string"), F.substring("line2", 11, 34))
    line2 = F.when(c("doc_id") % 5 == 1, wrong).otherwise(c("line2"))
    parsed = F.when(c("doc_id") % 11 != 0, parse(c("line1"), line2))
    return lines(spark, sf_dir).select("doc_id", parsed.alias("parsed"))


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, field, value, confidence of the visual zone: some values absent, some different."""
    k = c("doc_id")
    day = lambda name, expiry: resolve_date(c(name), expiry).cast("string")
    values = {
        "passport_number": F.when(k % 7 != 2, F.when(k % 3 == 0, F.concat(F.substring("number", 1, 8), F.lit("B"))).otherwise(c("number"))),
        "surname": F.when(k % 2 == 0, F.translate("surname", "A", "Á")).otherwise(c("surname")),
        "given_names": F.when(k % 4 == 3, F.lit("ZELDA")).otherwise(c("given_names")),
        "date_of_birth": day("birth", False),
        "sex": F.when(k % 6 != 0, F.replace(c("sex"), F.lit("<"), F.lit("X"))),
        "date_of_expiry": day("expiry", True),
        "nationality": F.when(k % 2 == 1, c("nationality")).otherwise("LANDIA"),
        "date_of_issue": F.when(k % 13 == 0, F.lit("2199-01-01")).when(k % 2 == 0, F.lit("2015-01-01")),
        "place_of_birth": F.when(k % 3 == 1, F.lit("TOWN")),
        "issuing_authority": F.when(k % 9 != 0, F.lit("OFFICE")),
    }
    each = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in values.items()])
    rows = holders(spark, sf_dir).select("doc_id", F.inline(each)).filter("value is not null")
    return rows.withColumn("confidence", F.round(0.70 + (k % 30) / 100.0, 2))


EVIDENCE = f"""
{LINES}, z AS (
  SELECT *, doc_id % 11 <> 0 AS has, {_sql_date('birth', False)} AS b, {_sql_date('expiry', True)} AS e, CASE WHEN sex = '<' THEN 'X' ELSE sex END AS s FROM lines
), f AS (
  SELECT doc_id, 0 AS k, 'passport_number' AS field, CASE WHEN has THEN number END AS zone, CASE WHEN has THEN doc_id % 5 <> 1 END AS chk,
    CASE WHEN doc_id % 7 = 2 THEN NULL WHEN doc_id % 3 = 0 THEN number[1:8] || 'B' ELSE number END AS visual FROM z
  UNION ALL SELECT doc_id, 1, 'surname', CASE WHEN has THEN surname END, NULL, CASE WHEN doc_id % 2 = 0 THEN replace(surname, 'A', 'Á') ELSE surname END FROM z
  UNION ALL SELECT doc_id, 2, 'given_names', CASE WHEN has THEN given_names END, NULL, CASE WHEN doc_id % 4 = 3 THEN 'ZELDA' ELSE given_names END FROM z
  UNION ALL SELECT doc_id, 3, 'date_of_birth', CASE WHEN has THEN b END, CASE WHEN has THEN true END, b FROM z
  UNION ALL SELECT doc_id, 4, 'sex', CASE WHEN has THEN s END, NULL, CASE WHEN doc_id % 6 <> 0 THEN s END FROM z
  UNION ALL SELECT doc_id, 5, 'expiry_date', CASE WHEN has THEN e END, CASE WHEN has THEN true END, e FROM z
  UNION ALL SELECT doc_id, 6, 'nationality', CASE WHEN has THEN nationality END, NULL, CASE WHEN doc_id % 2 = 1 THEN nationality ELSE 'LANDIA' END FROM z
  UNION ALL SELECT doc_id, 7, 'date_of_issue', NULL, NULL, CASE WHEN doc_id % 13 = 0 THEN '2199-01-01' WHEN doc_id % 2 = 0 THEN '2015-01-01' END FROM z
  UNION ALL SELECT doc_id, 8, 'place_of_birth', NULL, NULL, CASE WHEN doc_id % 3 = 1 THEN 'TOWN' END FROM z
  UNION ALL SELECT doc_id, 9, 'issuing_authority', NULL, NULL, CASE WHEN doc_id % 9 <> 0 THEN 'OFFICE' END FROM z
), g AS (
  SELECT *, round(0.70 + (doc_id % 30) / 100.0, 2)::DOUBLE AS vc, strip_accents(upper(zone)) = strip_accents(upper(visual)) AS same FROM f
), evidence AS (
  SELECT doc_id, k, field,
    CASE WHEN zone IS NULL THEN visual WHEN visual IS NULL THEN zone WHEN same THEN visual ELSE zone END AS value,
    CASE WHEN zone IS NULL AND visual IS NULL THEN 0.0 WHEN zone IS NULL THEN round(vc, 3) WHEN visual IS NULL THEN CASE WHEN chk THEN 0.96 WHEN NOT chk THEN 0.45 ELSE 0.75 END
      WHEN same THEN 0.999 WHEN chk THEN 0.92 ELSE 0.55 END::DOUBLE AS confidence,
    CASE WHEN zone IS NULL AND visual IS NULL THEN 'none' WHEN zone IS NULL THEN 'visual' WHEN same THEN 'both' ELSE 'mrz' END AS source,
    coalesce(same, false) AS matched,
    CASE WHEN zone IS NULL AND visual IS NULL THEN true WHEN zone IS NULL THEN vc < 0.80 WHEN visual IS NULL THEN coalesce(NOT chk, false) WHEN same THEN false ELSE NOT coalesce(chk, false) END AS review,
    CASE WHEN zone IS NULL AND visual IS NULL THEN 'NEEDS REVIEW' WHEN zone IS NULL THEN CASE WHEN vc < 0.80 THEN 'NEEDS REVIEW' ELSE 'VERIFIED' END
      WHEN visual IS NULL THEN CASE WHEN chk THEN 'VERIFIED' WHEN NOT chk THEN 'NEEDS REVIEW' ELSE 'VERIFIED WITH WARNING' END
      WHEN same THEN CASE WHEN NOT chk THEN 'VERIFIED WITH WARNING' ELSE 'VERIFIED' END WHEN chk THEN 'VERIFIED WITH WARNING' ELSE 'NEEDS REVIEW' END AS status,
    (zone IS NULL AND visual IS NULL) OR (zone IS NOT NULL AND visual IS NOT NULL AND NOT same) AS warned
  FROM g
)"""


def reconcile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reconcile.evidence(zones(spark, sf_dir), seen(spark, sf_dir))
    return rows.select("doc_id", "field", "value", "confidence", "source", "matched", "review", "status", c("warning").isNotNull().alias("warned"))


RECONCILE_FIELDS = f"WITH {EVIDENCE} SELECT doc_id, field, value, confidence, source, matched, review, status, warned FROM evidence"


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of pages, from supplied numbers of parts."""
    k = c("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("doc_id"),
        (k % 37 * 50 + 300).cast("int").alias("width"),
        (k % 23 * 40 + 250).cast("int").alias("height"),
        ((k * 7) % 400).cast("double").alias("variance"),
        ((k * 3) % 40 / 100.0).alias("glare_ratio"),
        ((k * 11) % 256).cast("double").alias("brightness"),
        (k % 10 != 0).alias("page_found"),
    )


MEASUREMENTS = """
m AS (
  SELECT p_partkey AS doc_id, p_partkey % 37 * 50 + 300 AS w, p_partkey % 23 * 40 + 250 AS h, (p_partkey * 7) % 400 AS v, ((p_partkey * 3) % 40) / 100.0 AS g,
    (p_partkey * 11) % 256 AS l, p_partkey % 10 <> 0 AS found FROM part
), quality AS (
  SELECT doc_id, w >= 800 AND h >= 600 AS resolution_ok, round(least(1.0, v / 250.0), 3)::DOUBLE AS blur_score, g > 0.08 AS glare, l::DOUBLE AS brightness,
    NOT (v < 35 OR w < 400 OR h < 300 OR g > 0.25) AS acceptable,
    CAST((w < 800 OR h < 600)::INT + (v < 80)::INT + (g > 0.08)::INT + (l < 40 OR l > 230)::INT + (NOT found)::INT AS INTEGER) AS n_feedback
  FROM m
)"""


def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = imaging.quality(measurements(spark, sf_dir))
    state = review.quality_state(c("acceptable"), c("feedback"))
    return rows.select("doc_id", "resolution_ok", "blur_score", "glare", "brightness", "acceptable", F.size("feedback").alias("n_feedback"), state.alias("state"))


QUALITY_FLAGS = f"WITH {MEASUREMENTS} SELECT *, CASE WHEN NOT acceptable THEN 'severe' WHEN n_feedback > 0 THEN 'advisory' ELSE 'pass' END AS state FROM quality"


def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = zones(spark, sf_dir)
    rows = reconcile.documents(reconcile.evidence(zone, seen(spark, sf_dir)), imaging.quality(measurements(spark, sf_dir)), zone)
    return rows.select("doc_id", "passport_number", "surname", "expiry_date", "review", "overall", F.size("warnings").alias("n_warnings"), review.band(c("overall")).alias("band"))


def _overall_sql() -> str:
    weights = ", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items())
    return f"""
WITH {EVIDENCE}, {MEASUREMENTS}, weights(f, w) AS (VALUES {weights}), d AS (
  SELECT doc_id, max(value) FILTER (field = 'passport_number') AS passport_number, max(value) FILTER (field = 'surname') AS surname,
    max(value) FILTER (field = 'expiry_date') AS expiry_date, max(value) FILTER (field = 'date_of_birth') AS b, max(value) FILTER (field = 'date_of_issue') AS i,
    sum(coalesce(w, 0) * confidence) AS s, bool_or(review) AS r, count(*) FILTER (warned) AS n
  FROM evidence LEFT JOIN weights ON f = field GROUP BY doc_id
), o AS (
  SELECT d.*, coalesce(n_feedback, 0) + coalesce((b >= expiry_date)::INT, 0) + coalesce((i >= expiry_date)::INT, 0) + n AS n_warnings,
    r OR coalesce(b >= expiry_date, false) OR coalesce(i >= expiry_date, false) AS review, coalesce(acceptable, true) AS acceptable,
    coalesce(glare OR blur_score < 0.5, false) AS poor, d.doc_id % 11 <> 0 AND d.doc_id % 5 <> 1 AS valid
  FROM d LEFT JOIN quality q ON d.doc_id = q.doc_id
), p AS (
  SELECT *, (CASE WHEN review THEN least(s, 0.60) ELSE s END) * (CASE WHEN NOT acceptable THEN 0.70 WHEN poor THEN 0.88 ELSE 1.0 END) AS t FROM o
), u AS (
  SELECT *, round(least(0.999, CASE WHEN valid THEN least(1.0, t * 1.05) ELSE least(t, 0.75) END) + 1e-9, 3)::DOUBLE AS overall FROM p
)
SELECT doc_id, passport_number, surname, expiry_date, review, overall, CAST(n_warnings AS INTEGER) AS n_warnings,
  CASE WHEN overall >= 0.85 THEN 'high' WHEN overall >= 0.65 THEN 'medium' ELSE 'low' END AS band
FROM u"""


def date_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), c("l_orderkey") == c("o_orderkey"))
    day = lambda name: F.date_format(name, "yyyy-MM-dd")
    odd = reconcile.implausible(day("o_orderdate"), F.when(c("l_linenumber") != 3, F.lit("1999-06-01")), day("l_shipdate"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.size(odd).alias("n_warnings"))


DATE_PLAUSIBILITY = """
SELECT l_orderkey, l_linenumber, l_partkey, CAST((o_orderdate::DATE >= l_shipdate::DATE)::INT + (l_linenumber <> 3 AND l_shipdate::DATE <= DATE '1999-06-01')::INT AS INTEGER) AS n_warnings
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.queue(reconcile.evidence(zones(spark, sf_dir), seen(spark, sf_dir)))
    return rows.select("doc_id", "n", F.array_join("fields", ",").alias("fields"))


REVIEW_QUEUE = f"""
WITH {EVIDENCE}
SELECT doc_id, count(*) AS n, string_agg(field, ',' ORDER BY k) AS fields FROM evidence WHERE review OR value IS NULL GROUP BY doc_id"""


def edit_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order records edited by line items: the last line's flag is the status, a ship date a new key."""
    orders = table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("doc_id"),
        F.inline(F.array(F.struct(F.lit("status").alias("key"), c("o_orderstatus").alias("value")), F.struct(F.lit("issue_date").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value")))),
    )
    edits = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("doc_id"),
        F.when(c("l_linenumber") == 1, F.lit("date_of_issue")).when(c("l_linenumber") == 2, F.lit("note")).otherwise("status").alias("key"),
        F.when(c("l_linenumber") == 1, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(c("l_returnflag")).alias("value"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
    )
    return review.overlay(orders, edits)


EDIT_OVERLAY = """
WITH r AS (
  SELECT o_orderkey AS doc_id, 'status' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'issue_date', strftime(o_orderdate, '%Y-%m-%d') FROM orders
), e AS (
  SELECT l_orderkey AS doc_id, CASE l_linenumber WHEN 1 THEN 'issue_date' WHEN 2 THEN 'note' ELSE 'status' END AS key,
    CASE WHEN l_linenumber = 1 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE l_returnflag END AS value,
    row_number() OVER (PARTITION BY l_orderkey, CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS k
  FROM lineitem
), l AS (SELECT * FROM e WHERE k = 1)
SELECT coalesce(r.doc_id, l.doc_id) AS doc_id, coalesce(r.key, l.key) AS key, CASE WHEN l.doc_id IS NULL THEN r.value ELSE l.value END AS value, l.doc_id IS NOT NULL AS edited
FROM r FULL JOIN l ON r.doc_id = l.doc_id AND r.key = l.key"""


def confirmations_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    own = events.filter("event_type <> 'error'").select(c("user_id").alias("session_id"), c("ts").alias("confirmed_at"), c("event_id").alias("payload"))
    gone = events.filter("event_type = 'error' and event_id % 50 = 0").select(c("user_id").alias("session_id"), c("ts").alias("deleted_at"))
    return review.latest(own, gone).select("session_id", "payload")


CONFIRMATIONS_LATEST = """
WITH o AS (SELECT user_id, max_by(event_id, (ts, event_id)) AS payload, max(ts) AS t FROM events WHERE event_type <> 'error' GROUP BY user_id)
SELECT user_id AS session_id, payload FROM o
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.user_id AND event_type = 'error' AND event_id % 50 = 0 AND ts >= o.t)"""


def magic_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that begin with known signatures, a truncated one and others."""
    heads = ("FFD8FFE000104A4649460001", "89504E470D0A1A0A0000000D", "524946460000000057454250", "255044462D312E370A250000", "000000186674797068656963", "0000001866747970617669660000", "FFD8FF", "474946383961010001000000", "")
    content = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (c("p_partkey") % len(heads) + 1).cast("int")))
    rows = table(spark, sf_dir, "part").select("p_partkey", content.alias("content"))
    return rows.select("p_partkey", uploads.media_type(c("content")).alias("media_type"), uploads.rejection(c("content")).alias("rejection"), uploads.session_id(c("content")).alias("session_id"))


MAGIC_BYTES = """
WITH h AS (
  SELECT p_partkey, p_partkey % 9 AS k, from_hex(['FFD8FFE000104A4649460001', '89504E470D0A1A0A0000000D', '524946460000000057454250', '255044462D312E370A250000', '000000186674797068656963',
    '0000001866747970617669660000', 'FFD8FF', '474946383961010001000000', ''][p_partkey % 9 + 1]) AS content FROM part
)
SELECT p_partkey, CASE k WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'application/pdf' WHEN 4 THEN 'image/heic' END AS media_type,
  CASE WHEN k = 8 THEN 'empty' WHEN k >= 5 THEN 'unknown type' END AS rejection, sha256(content) AS session_id FROM h"""


def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' first events as sessions, purged an hour after them as of each user's last event."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("now"), F.max(F.when(c("event_type") == "click", c("ts"))).alias("created_at"))
    return sessions.purge(rows, c("now")).select("user_id")


SESSION_TTL = """
WITH s AS (SELECT user_id, max(ts) AS now, max(ts) FILTER (event_type = 'click') AS created_at FROM events GROUP BY user_id)
SELECT user_id FROM s WHERE epoch_us(now) - epoch_us(created_at) <= 3600000000"""


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.sessionized(table(spark, sf_dir, "events"))
    return rows.select("user_id", F.unix_micros(c("started").cast("timestamp")).alias("started_us"), F.unix_micros(c("ended").cast("timestamp")).alias("ended_us"), "n_events")


SESSION_WINDOWS = """
WITH e AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, min(t) AS started_us, max(t) + 3600000000 AS ended_us, count(*) AS n_events FROM s GROUP BY user_id, n"""


def record_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = holders(spark, sf_dir).select("doc_id", "number", "surname", "sex")
    return review.exported(rows, "number")


RECORD_EXPORT = f"""
WITH {LINES}
SELECT doc_id, 'passport_' || number || '.json' AS file, '{{"doc_id":' || doc_id || ',"number":"' || number || '","surname":"' || surname || '","sex":"' || sex || '"}}' AS json FROM lines"""


def sample_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample pages of all holders, in four variants, through the whole path."""
    day = lambda name, expiry: F.upper(F.date_format(resolve_date(c(name), expiry), "dd MMM / MMM yyyy"))
    own = holders(spark, sf_dir).withColumns({
        "birth_text": day("birth", False), "expiry_text": day("expiry", True), "issue_text": F.lit("20 AUG / AOU 1990"), "place": F.lit("BURSA"), "authority": F.lit("ANKARA"),
        "variant": F.element_at(F.array(*[F.lit(v) for v in ("clean", "skewed", "blurry", "glare")]), (c("doc_id") % 4 + 1).cast("int")),
    })
    rows = process.process(samples.boxes(own), samples.measurements(own))
    fields = ("passport_number", "surname", "given_names", "date_of_birth", "expiry_date", "sex", "nationality", "date_of_issue", "place_of_birth", "issuing_authority")
    return rows.select("doc_id", *fields, "review", "overall", F.size("warnings").alias("n_warnings"))


# A filler for the sex is printed as such and read as X in the zone alone.
SAMPLE_RECORDS = f"""
WITH {LINES}, d AS (
  SELECT *, {_sql_date('birth', False)} AS b, {_sql_date('expiry', True)} AS e, sex <> '<' AS sexed FROM lines
), w AS (
  SELECT *, 0.25 * 0.999 + 4 * 0.15 * 0.999 + 0.05 * 0.999 + CASE WHEN sexed THEN 0.05 * 0.999 ELSE 0.05 * 0.75 END + 2 * 0.025 * 0.95 AS s FROM d
), t AS (
  SELECT *, s * CASE doc_id % 4 WHEN 2 THEN 0.70 WHEN 3 THEN 0.88 ELSE 1 END * 1.05 AS x FROM w
)
SELECT doc_id, number AS passport_number, surname, given_names, b AS date_of_birth, e AS expiry_date, CASE WHEN sexed THEN sex ELSE 'X' END AS sex, nationality,
  '1990-08-20' AS date_of_issue, 'BURSA' AS place_of_birth, 'ANKARA' AS issuing_authority, false AS review, round(least(0.999, x) + 1e-9, 3)::DOUBLE AS overall,
  CAST(CASE WHEN doc_id % 4 >= 2 THEN 1 ELSE 0 END AS INTEGER) AS n_warnings
FROM t"""


def upload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, types and lengths of files, from parts, before they are sent."""
    endings = ("scan.JPG", "scan.jpeg", "page.heif", "page.pdf", "notes.txt", "noending")
    kinds = ("image/jpeg", "", "application/octet-stream", "text/plain")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(endings, c("p_partkey")).alias("name"), pick(kinds, c("p_partkey")).alias("media_type"), (c("p_partkey") % 7 * 3_000_000).alias("length"))
    return rows.select("p_partkey", uploads.sendable(c("name"), c("media_type"), c("length")).alias("sendable"))


UPLOAD_GATE = """
SELECT p_partkey, p_partkey % 7 BETWEEN 1 AND 5 AND (p_partkey % 6 <= 3 OR p_partkey % 4 = 0) AS sendable FROM part"""


def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small files as data URLs, every fourth one empty."""
    content = F.encode(F.when(c("p_partkey") % 4 == 0, F.lit("")).otherwise(c("p_name")), "UTF-8")
    return table(spark, sf_dir, "part").select("p_partkey", uploads.data_url(content).alias("url"))


DATA_URLS = """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 OR p_name = '' THEN '' ELSE 'data:image/jpeg;base64,' || to_base64(encode(p_name)) END AS url FROM part"""


def review_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Badges of statuses, one of them unknown, and how checks show, some of which were not made."""
    status = F.element_at(F.array(*map(F.lit, ("VERIFIED", "VERIFIED WITH WARNING", "NEEDS REVIEW", "NOT FOUND"))), (c("p_partkey") % 4 + 1).cast("int"))
    check = F.when(c("p_partkey") % 3 < 2, c("p_partkey") % 3 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", review.badge(status).alias("badge"), review.check_label(check).alias("shown"))


REVIEW_MARKS = """
SELECT p_partkey, ['ok', 'warning', 'review', 'n/a'][p_partkey % 4 + 1] AS badge, ['PASS', 'FAIL', 'N/A'][p_partkey % 3 + 1] AS shown FROM part"""


def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' records, confirmed once or several times, written to the store and read back."""
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), c("o_custkey")).alias("session_id"), c("o_orderdate").alias("confirmed_at"), F.to_json(F.struct("o_orderkey")).alias("payload"))
    for part in (0, 1):  # two writers
        records.save(rows.filter(F.pmod(F.xxhash64("payload"), F.lit(2)) == part), path)
    return records.stored(spark, path).select("session_id", F.date_format("confirmed_at", "yyyy-MM-dd").alias("day"), "payload")


STORED_RECORDS = """
WITH r AS (
  SELECT 's' || o_custkey AS session_id, o_orderdate, '{"o_orderkey":' || o_orderkey || '}' AS payload FROM orders
), k AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY o_orderdate DESC, payload DESC) AS n FROM r
)
SELECT session_id, strftime(o_orderdate, '%Y-%m-%d') AS day, payload FROM k WHERE n = 1"""


# --- decisions about images, from measurements that the tables' numbers stand for -----------------


def quad_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    corner = lambda x, y: F.struct((F.lit(x) + k % 17).cast("int").alias("x"), (F.lit(y) + k % 13).cast("int").alias("y"))
    quad = F.array(corner(500, 400), corner(20, 10), corner(15, 390), corner(510, 25))
    rows = table(spark, sf_dir, "part").select("p_partkey", imaging.ordered_quad(quad).alias("q"))
    return rows.select("p_partkey", *[c(f"q.{n}.{a}").alias(f"{n}_{a}") for n in ("tl", "tr", "br", "bl") for a in "xy"])


QUAD_ORDER = "SELECT p_partkey, " + ", ".join(
    f"CAST({x} + p_partkey % 17 AS INTEGER) AS {n}_x, CAST({y} + p_partkey % 13 AS INTEGER) AS {n}_y" for n, x, y in (("tl", 20, 10), ("tr", 510, 25), ("br", 500, 400), ("bl", 15, 390))
) + " FROM part"


def page_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey")
    each = F.transform(
        F.sequence(F.lit(0), F.lit(13)),
        lambda n: F.struct(
            n.alias("ord"), ((k * (n + 7)) % 997 * 100).cast("double").alias("area"), (3 + (k + n) % 3).cast("int").alias("corners"), (1 + (k * (n + 1)) % 100 / 100.0).alias("aspect")
        ),
    )
    rows = customers(spark, sf_dir).select(k.alias("doc_id"), F.inline(each)).withColumn("page_area", F.lit(120_000.0))
    return imaging.page_contour(rows)


PAGE_CONTOUR = """
WITH e AS (
  SELECT c_custkey AS doc_id, n, (c_custkey * (n + 7)) % 997 * 100 AS area, 3 + (c_custkey + n) % 3 AS corners, 1 + (c_custkey * (n + 1)) % 100 / 100.0::DOUBLE AS aspect FROM customer, range(0, 14) r(n)
), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY area DESC, n) AS k FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS first FROM t WHERE k <= 10 AND area >= 42000 AND corners = 4 AND aspect BETWEEN 1.15 AND 1.8)
SELECT doc_id, CAST(n AS INTEGER) AS ord, area::DOUBLE AS area, aspect FROM g WHERE first = 1"""


def zone_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey")
    each = F.array(*[
        F.struct(F.lit(n).alias("ord"), ((k * (n + 3)) % 5000).cast("double").alias("area"), F.lit(40 * n).alias("x"), (F.lit(700) + 10 * n).alias("y"), (F.lit(500) + (k * (7 + n)) % 700).cast("int").alias("w"), (F.lit(20) + (k * (5 + n)) % 60).cast("int").alias("h"))
        for n in range(4)
    ])
    rows = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.inline(each)).withColumns({"page_w": F.lit(1400), "page_h": F.lit(1000)})
    return imaging.zone_contour(rows)


ZONE_CONTOUR = """
WITH e AS (
  SELECT c_custkey AS doc_id, n, (c_custkey * (n + 3)) % 5000 AS area, 40 * n AS x, 700 + 10 * n AS y, 500 + (c_custkey * (7 + n)) % 700 AS w, 20 + (c_custkey * (5 + n)) % 60 AS h
  FROM customer, range(0, 4) r(n)
), g AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY area DESC, n) AS k FROM e WHERE w > 700 AND w > 2.5 * h AND h >= 40
)
SELECT c_custkey AS doc_id, g.doc_id IS NOT NULL AS found, CAST(CASE WHEN g.doc_id IS NULL THEN 0 ELSE greatest(0, x - w * 5 // 100) END AS INTEGER) AS x1,
  CAST(CASE WHEN g.doc_id IS NULL THEN 750 ELSE y - h * 35 // 100 END AS INTEGER) AS y1,
  CAST(CASE WHEN g.doc_id IS NULL THEN 1400 ELSE least(1400, x + w + w * 5 // 100) END AS INTEGER) AS x2,
  CAST(CASE WHEN g.doc_id IS NULL THEN 1000 ELSE least(1000, y + h + h * 35 // 100) END AS INTEGER) AS y2
FROM customer LEFT JOIN g ON g.doc_id = c_custkey AND k = 1"""


def best_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey")
    wide = lambda t: F.when((k + t) % 2 == 0, F.lit(1400)).otherwise(1000)
    each = F.array(*[F.struct(F.lit(t).alias("turn"), wide(t).alias("width"), wide(t + 1).alias("height"), F.when(k % 10 == 0, F.lit(0.0)).otherwise(((k * (t + 3)) % 100) / 100.0).alias("score")) for t in range(4)])
    return imaging.best_turn(table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.inline(each))).select("doc_id", "turn", F.round("score", 6).alias("score"))


BEST_TURN = """
WITH t AS (
  SELECT c_custkey AS doc_id, t, (CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE (c_custkey * (t + 3)) % 100 END) / 100.0::DOUBLE * CASE WHEN (c_custkey + t) % 2 = 0 THEN 1.0 ELSE 0.75 END AS s
  FROM customer, range(0, 4) r(t)
), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, t) AS k FROM t)
SELECT doc_id, CAST(CASE WHEN s > 0 THEN t WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END AS INTEGER) AS turn, round(s, 6)::DOUBLE AS score FROM b WHERE k = 1"""


def skew_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("doc_id"), (c("l_quantity") - 25).alias("angle"))
    return imaging.skew(rows).select("doc_id", "segments", F.round("angle", 6).alias("angle"))


SKEW_ANGLE = """
WITH a AS (SELECT l_orderkey AS doc_id, CASE WHEN abs(l_quantity - 25) < 20 THEN l_quantity - 25 END AS a FROM lineitem),
m AS (SELECT doc_id, count(a) AS segments, quantile_cont(a, 0.5) AS m FROM a GROUP BY doc_id)
SELECT doc_id, segments, round(CASE WHEN segments >= 5 AND abs(m) > 0.5 THEN m ELSE 0 END, 6)::DOUBLE AS angle FROM m"""


def line_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with two bands of text, a hair line, and a gap in the first band for odd pages."""
    k = c("c_custkey")
    gap = lambda i: (k % 2 == 1) & i.between(20, 22)
    on = lambda i: ((i >= 10) & (i < 30 + k % 5) & ~gap(i)) | i.between(50, 74) | (i == 90)
    profile = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.when(on(i), F.lit(100.0)).otherwise(2.0))
    rows = imaging.line_bands(customers(spark, sf_dir).select(k.alias("doc_id"), profile.alias("profile")))
    return rows.select("doc_id", F.array_join(F.transform("bands", lambda b: F.concat(b["a"].cast("string"), F.lit("-"), b["b"].cast("string"))), ",").alias("bands"))


# Seven rows behind the gap are no band.
LINE_BANDS = "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 10 = 5 THEN '10-20' ELSE '10-' || (30 + c_custkey % 5) END || ',50-75' AS bands FROM customer"


def line_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of two bands, of one band with a dip, of hair lines, and of three bands far apart."""
    k, key = c("c_custkey") % 4, c("c_custkey")
    two = lambda i: F.when(i.between(10, 29 + key % 5) | i.between(50, 74), F.lit(100.0)).otherwise(F.lit(2.0))
    dip = lambda i: F.when(i == 44 + key % 7, F.lit(60.0)).when(i.between(5, 94), F.lit(100.0)).otherwise(F.lit(2.0))
    hair = lambda i: F.when(i.isin(20, 70), F.lit(100.0)).otherwise(F.lit(2.0))
    three = lambda i: F.when(i.between(0, 19) | i.between(40, 59) | i.between(80, 99), F.lit(100.0)).otherwise(F.lit(2.0))
    profile = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.when(k == 0, two(i)).when(k == 1, dip(i)).when(k == 2, hair(i)).otherwise(three(i)))
    rows = imaging.line_crops(customers(spark, sf_dir).select(key.alias("doc_id"), profile.alias("profile")))
    return rows.select("doc_id", F.array_join(F.transform("crops", lambda b: F.concat(b["a"].cast("string"), F.lit("-"), b["b"].cast("string"))), ",").alias("crops"))


LINE_CROPS = """
SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN '7-' || (33 + c_custkey % 5) || ',47-78' WHEN 1 THEN '0-' || (49 + c_custkey % 7) || ',' || (39 + c_custkey % 7) || '-100' ELSE '0-100' END AS crops
FROM customer"""


def pixel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 16 by 20 pixels in two greys, one above the other."""
    key, w, h = c("c_custkey"), 16, 20
    half = lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), 3 * w * h // 2)
    data = F.unhex(F.concat(half(key % 100), half(100 + key % 156)))
    image = F.struct(F.lit(h).alias("height"), F.lit(w).alias("width"), F.lit(3).alias("nChannels"), data.alias("data"))
    rows = imaging.measured(customers(spark, sf_dir).select(key.alias("doc_id"), image.alias("image")))
    return rows.select("doc_id", "width", "height", F.round("variance", 6).alias("variance"), F.round("glare_ratio", 6).alias("glare_ratio"), F.round("brightness", 6).alias("brightness"))


# Only the two rows at the edge have a second difference, of equal size and opposite sign.
PIXEL_METRICS = """
WITH g AS (SELECT c_custkey AS doc_id, c_custkey % 100 AS a, 100 + c_custkey % 156 AS b FROM customer)
SELECT doc_id, 16 AS width, 20 AS height, round(2 * (b - a) * (b - a) / 20.0, 6)::DOUBLE AS variance, (CASE WHEN b > 250 THEN 0.5 ELSE 0 END)::DOUBLE AS glare_ratio,
  round((a + b) / 2.0, 6)::DOUBLE AS brightness FROM g"""


def zone_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines of glyphs per page: an even pitch, or an uneven one for odd pages; few for some."""
    k = c("c_custkey")
    each = F.transform(F.sequence(F.lit(0), F.when(k % 5 == 0, F.lit(8)).otherwise(39)), lambda i: F.struct((20 + i * 30 + F.when(k % 2 == 1, (i * i) % 17).otherwise(0)).cast("double").alias("x"), i.alias("i")))
    rows = customers(spark, sf_dir).select(k.alias("doc_id"), F.inline(each)).withColumn("y", F.explode(F.array(F.lit(50.0), F.lit(120.0))))
    return imaging.zone_presence(rows.withColumns({"height": F.lit(30), "area": F.lit(100), "page_w": F.lit(1400), "page_h": F.lit(200)})).select("doc_id", "lines", F.round("presence", 6).alias("presence"))


ZONE_PRESENCE = """
WITH g AS (
  SELECT c_custkey AS doc_id, 20 + i * 30 + CASE WHEN c_custkey % 2 = 1 THEN (i * i) % 17 ELSE 0 END AS x FROM customer, range(0, 40) r(i) WHERE c_custkey % 5 <> 0
), d AS (
  SELECT doc_id, x, x - lag(x) OVER (PARTITION BY doc_id ORDER BY x) AS gap FROM g
), s AS (
  SELECT doc_id, 0.35 * greatest(0, 1 - stddev_pop(gap) / avg(gap) / 0.6) + 0.35 + 0.30 * (max(x) - min(x)) / 1400 AS v FROM d GROUP BY doc_id
)
SELECT c_custkey AS doc_id, CASE WHEN v IS NULL THEN 0 ELSE 2 END::BIGINT AS lines, round(coalesce(v, 0), 6)::DOUBLE AS presence FROM customer LEFT JOIN s ON doc_id = c_custkey"""


def candidate_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey")
    high = (F.lit(60) + k % 1000).cast("int")
    top = F.when(k % 3 == 0, F.floor(high * 0.75)).otherwise(F.floor(high * 0.8))
    rows = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.lit(1400).alias("page_w"), high.alias("page_h"), F.lit(0).alias("x1"), top.alias("y1"), F.lit(1400).alias("x2"), high.alias("y2"))
    return imaging.candidate_crops(rows)


CANDIDATE_CROPS = """
WITH p AS (SELECT c_custkey AS doc_id, 60 + c_custkey % 1000 AS h FROM customer), b AS (
  SELECT doc_id, h, 0 AS ord, CASE WHEN doc_id % 3 = 0 THEN h * 75 // 100 ELSE h * 80 // 100 END AS y1 FROM p
  UNION ALL SELECT doc_id, h, 1, h * 75 // 100 FROM p UNION ALL SELECT doc_id, h, 2, h * 62 // 100 FROM p UNION ALL SELECT doc_id, h, 3, h * 45 // 100 FROM p
)
SELECT doc_id, CAST(min(ord) AS INTEGER) AS ord, CAST(0 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CAST(1400 AS INTEGER) AS x2, CAST(h AS INTEGER) AS y2
FROM b WHERE h - y1 >= 20 GROUP BY doc_id, y1, h"""


def portrait_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey")
    face = lambda n: F.struct(
        F.lit(n).alias("ord"), ((k * (31 + n)) % 1100).cast("int").alias("x"), ((k * (17 + n)) % 500).cast("int").alias("y"), (F.lit(60) + (k * (3 + n)) % 150).cast("int").alias("w"), (F.lit(80) + (k * (5 + n)) % 150).cast("int").alias("h"),
        F.lit(0.85).alias("detection"),
    )
    faces = F.when(k % 9 == 0, F.array().cast("array<struct<ord:int,x:int,y:int,w:int,h:int,detection:double>>")).otherwise(F.array(face(0), face(1), face(2)))
    rows = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.explode_outer(faces).alias("f"))
    rows = rows.select("doc_id", "f.*").withColumns({"page_w": F.lit(1400), "page_h": F.lit(1000)})
    return imaging.portrait(rows)


PORTRAIT_CHOICE = """
WITH f AS (
  SELECT c_custkey AS doc_id, n, (c_custkey * (31 + n)) % 1100 AS x, (c_custkey * (17 + n)) % 500 AS y, 60 + (c_custkey * (3 + n)) % 150 AS w, 80 + (c_custkey * (5 + n)) % 150 AS h
  FROM customer, range(0, 3) r(n) WHERE c_custkey % 9 <> 0
), s AS (
  SELECT *, max(w * h) OVER (PARTITION BY doc_id) AS m FROM f
), t AS (
  SELECT *, w * h / m::DOUBLE + CASE WHEN x / 1400.0 < 0.38 THEN 0.2 WHEN x / 1400.0 > 0.60 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN w / h::DOUBLE BETWEEN 0.60 AND 0.85 THEN 0.1 ELSE 0 END::DOUBLE + 0.15::DOUBLE * 0.85::DOUBLE AS v
  FROM s WHERE w * h >= 0.35 * m
), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, n) AS k FROM t)
SELECT c_custkey AS doc_id, CAST(CASE WHEN x IS NULL THEN 77 ELSE greatest(0, x - w * 22 // 100) END AS INTEGER) AS x1, CAST(CASE WHEN x IS NULL THEN 170 ELSE greatest(0, y - h * 28 // 100) END AS INTEGER) AS y1,
  CAST(CASE WHEN x IS NULL THEN 413 ELSE least(1400, x + w + w * 22 // 100) END AS INTEGER) AS x2, CAST(CASE WHEN x IS NULL THEN 600 ELSE least(1000, y + h + h * 38 // 100) END AS INTEGER) AS y2,
  CASE WHEN x IS NULL THEN 0.82 ELSE round(least(0.99, 0.85 + 0.14 * v), 2) END::DOUBLE AS confidence
FROM customer LEFT JOIN k ON k.doc_id = c_custkey AND k = 1"""

QUERIES = {
    "sample_records": (sample_records, SAMPLE_RECORDS),
    "upload_gate": (upload_gate, UPLOAD_GATE),
    "reconcile_fields": (reconcile_fields, RECONCILE_FIELDS),
    "overall_confidence": (overall_confidence, _overall_sql()),
    "quality_flags": (quality_flags, QUALITY_FLAGS),
    "date_plausibility": (date_plausibility, DATE_PLAUSIBILITY),
    "review_queue": (review_queue, REVIEW_QUEUE),
    "edit_overlay": (edit_overlay, EDIT_OVERLAY),
    "confirmations_latest": (confirmations_latest, CONFIRMATIONS_LATEST),
    "record_export": (record_export, RECORD_EXPORT),
    "magic_bytes": (magic_bytes, MAGIC_BYTES),
    "session_ttl": (session_ttl, SESSION_TTL),
    "session_windows": (session_windows, SESSION_WINDOWS),
    "quad_order": (quad_order, QUAD_ORDER),
    "page_contour": (page_contour, PAGE_CONTOUR),
    "zone_contour": (zone_contour, ZONE_CONTOUR),
    "best_turn": (best_turn, BEST_TURN),
    "skew_angle": (skew_angle, SKEW_ANGLE),
    "line_bands": (line_bands, LINE_BANDS),
    "line_crops": (line_crops, LINE_CROPS),
    "pixel_metrics": (pixel_metrics, PIXEL_METRICS),
    "data_urls": (data_urls, DATA_URLS),
    "review_marks": (review_marks, REVIEW_MARKS),
    "stored_records": (stored_records, STORED_RECORDS),
    "zone_presence": (zone_presence, ZONE_PRESENCE),
    "candidate_crops": (candidate_crops, CANDIDATE_CROPS),
    "portrait_choice": (portrait_choice, PORTRAIT_CHOICE),
}
