import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidoc.operators import imaging, reconcile, review
from evidoc.sources import uploads
from evidoc.streaming import sessions


def reconciled(spark, field, zone, visual, check, confidence=None):
    lit = lambda v, t: F.lit(v).cast(t)
    return spark.range(1).select(reconcile.reconcile(F.lit(field), lit(zone, "string"), lit(visual, "string"), lit(check, "boolean"), lit(confidence, "double")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("args", "want"),
    [
        (("passport_number", "U12345678", "U12345678", True, 0.95), ("U12345678", 0.999, "both", True, False, "VERIFIED")),
        (("passport_number", "U12345678", "U1234567B", True, 0.95), ("U12345678", 0.92, "mrz", False, False, "VERIFIED WITH WARNING")),
        (("surname", "CELIK", "ÇELİK", None, 0.95), ("ÇELİK", 0.999, "both", True, False, "VERIFIED")),
        (("surname", "CELIK", "ÇELİK", False, 0.5), ("ÇELİK", 0.999, "both", True, False, "VERIFIED WITH WARNING")),
        (("place_of_birth", None, "ANKARA", None, 0.75), ("ANKARA", 0.75, "visual", False, True, "NEEDS REVIEW")),
        (("place_of_birth", "", "ANKARA", None, 0.80), ("ANKARA", 0.8, "visual", False, False, "VERIFIED")),
        (("surname", "A", "B", None, 0.9), ("A", 0.55, "mrz", False, True, "NEEDS REVIEW")),
        (("surname", "A", "B", False, 0.9), ("A", 0.55, "mrz", False, True, "NEEDS REVIEW")),
        (("surname", "A", None, True, None), ("A", 0.96, "mrz", False, False, "VERIFIED")),
        (("surname", "A", None, None, None), ("A", 0.75, "mrz", False, False, "VERIFIED WITH WARNING")),
        (("surname", "A", "", False, None), ("A", 0.45, "mrz", False, True, "NEEDS REVIEW")),
        (("surname", None, "", None, None), (None, 0.0, "none", False, True, "NEEDS REVIEW")),
    ],
)
def test_reconcile(spark, args, want):
    r = reconciled(spark, *args)
    assert (r["value"], r["confidence"], r["source"], r["matched"], r["review"], r["status"]) == want
    assert (r["warning"] is not None) == (r["source"] == "none" or (r["source"] == "mrz" and not r["matched"] and bool(args[2])))


def test_implausible_dates(spark):
    got = spark.range(1).select(
        F.size(reconcile.implausible(F.lit("2035-01-01"), F.lit(None).cast("string"), F.lit("2030-01-01"))), F.size(reconcile.implausible(F.lit("2030-01-01"), F.lit("2030-01-01"), F.lit("2030-01-01"))), F.size(reconcile.implausible(F.lit("1990-01-01"), F.lit("2020-01-01"), F.lit("2030-01-01")))
    ).first()
    assert tuple(got) == (1, 2, 0)


def test_overall_confidence(spark):
    b, d = F.lit, lambda v: F.lit(float(v))
    score = lambda *a: spark.range(1).select(reconcile.overall_confidence(*a)).first()[0]
    assert score(d(0.999), b(False), b(True), b(False), d(1), b(True)) == 0.999
    assert score(d(0.999), b(True), b(True), b(False), d(1), b(True)) == 0.63
    assert score(d(0.9), b(False), b(False), b(True), d(1), b(True)) == 0.662
    assert score(d(0.9), b(False), b(True), b(True), d(1), b(True)) == 0.832
    assert score(d(0.9), b(False), b(True), b(False), d(0.499), b(False)) == 0.75
    assert score(d(0), b(True), b(True), b(False), d(1), b(False)) == 0.0


def test_visual_values_fill_a_record_without_a_zone(spark):
    seen = [("passport_number", "U1234567"), ("surname", "SMITH"), ("given_names", "ANNA"), ("date_of_birth", "1990-01-01"), ("sex", "F"), ("date_of_expiry", "2030-01-01"), ("nationality", "UTO")]
    fields = spark.createDataFrame([(1, f, v, 0.95) for f, v in seen], "doc_id long, field string, value string, confidence double")
    parsed = "parsed struct<passport_number:string,surname:string,given_names:string,date_of_birth:date,sex:string,expiry_date:date,nationality:string,number_ok:boolean,birth_ok:boolean,expiry_ok:boolean,valid:boolean>"
    zones = spark.createDataFrame([(1, None)], f"doc_id long, {parsed}")
    quality = spark.createDataFrame([(1, True, False, 0.9, ["dim"])], "doc_id long, acceptable boolean, glare boolean, blur_score double, feedback array<string>")
    r = reconcile.documents(reconcile.evidence(zones, fields), quality, zones).first()
    assert (r["surname"], r["expiry_date"], r["review"], r["overall"]) == ("SMITH", "2030-01-01", True, 0.6)
    assert r["warnings"][0] == "dim" and len(r["warnings"]) == 4


def test_media_types(spark):
    files = {
        b"\xff\xd8\xff" + b"\0" * 9: "image/jpeg", b"\x89PNG\r\n\x1a\n" + b"\0" * 4: "image/png", b"RIFF\0\0\0\0WEBP": "image/webp", b"%PDF-1.7\n\0\0\0": "application/pdf",
        b"\0\0\0\x18ftypheic": "image/heic", b"\0\0\0\x18ftypmsf1": "image/heic", b"\0\0\0\x18ftypavif": None, b"\xff\xd8\xff": None, b"GIF89a\0\0\0\0\0\0": None,
    }
    rows = spark.createDataFrame([(bytearray(k),) for k in files], "b binary").select("b", uploads.media_type(F.col("b")).alias("t"), uploads.rejection(F.col("b"), 12).alias("r")).collect()
    assert {bytes(r["b"]): r["t"] for r in rows} == files
    assert all((r["r"] is None) == (r["t"] is not None) for r in rows)
    got = spark.range(1).select(uploads.rejection(F.lit(bytearray(13)), 12), uploads.rejection(F.lit(bytearray())), uploads.data_url(F.lit(bytearray(b"abc"))), uploads.data_url(F.lit(bytearray()))).first()
    assert tuple(got) == ("too large", "empty", "data:image/jpeg;base64,YWJj", "")


def test_uploads_are_read(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0" * 20)
    (tmp_path / "b.txt").write_bytes(b"just some text")
    rows = uploads.read_uploads(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r["media_type"], r["rejection"]) for r in rows] == [("image/png", None), (None, "unknown type")]


def image(pixels):
    h, w, _ = pixels.shape
    return ("mem", h, w, 3, 16, bytearray(pixels.astype(np.uint8).tobytes()))


def test_image_quality(spark):
    sharp = np.full((800, 1000, 3), 235)
    sharp[::20, :] = sharp[1::20, :] = 0
    flat = np.full((800, 1000, 3), 128)
    glare = np.full((800, 1000, 3), 100)
    y, x = np.mgrid[:800, :1000]
    glare[(y - 400) ** 2 + (x - 500) ** 2 < 220**2] = 255
    small = np.full((200, 200, 3), 200)
    kind = T.StructType([T.StructField("origin", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("nChannels", T.IntegerType()), T.StructField("mode", T.IntegerType()), T.StructField("data", T.BinaryType())])
    rows = spark.createDataFrame([(k, image(p)) for k, p in enumerate((sharp, flat, glare, small))], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("image", kind)]))
    got = {r["doc_id"]: r for r in imaging.quality(imaging.measured(rows).withColumn("page_found", F.lit(True))).collect()}
    assert got[0]["acceptable"] and got[0]["blur_score"] > 0.4 and not got[0]["glare"]
    assert not got[1]["acceptable"] and any("blurry" in f for f in got[1]["feedback"])
    assert got[2]["glare"] and not got[3]["resolution_ok"] and not got[3]["acceptable"]


def test_sessions_end_after_an_hour(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(k, t - dt.timedelta(seconds=3600, microseconds=k)) for k in (-1, 0, 1)]
    left = sessions.purge(spark.createDataFrame(rows, "k int, created_at timestamp"), F.lit(t)).collect()
    assert sorted(r["k"] for r in left) == [-1, 0]


def test_session_states_as_a_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    batches = [[("a", t), ("b", t), ("a", t + dt.timedelta(minutes=5))], [("a", t + dt.timedelta(minutes=30)), ("c", t + dt.timedelta(hours=3))], [("c", t + dt.timedelta(hours=3, minutes=1))]]
    schema = "session_id string, ts timestamp"
    source = str(tmp_path / "in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source) if not spark.createDataFrame(batches[0], schema).coalesce(1).write.mode("append").parquet(source) else None
    query = sessions.track(stream).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        for b in batches[1:]:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
        got = {(r["session_id"], r["state"]) for r in spark.table("states").collect()}
    finally:
        query.stop()
    assert {("a", "created"), ("b", "created"), ("a", "updated"), ("c", "created"), ("a", "expired"), ("b", "expired")} <= got and ("c", "expired") not in got


def test_review_views(spark):
    lit = F.lit
    got = spark.range(1).select(
        review.badge(lit("VERIFIED")), review.badge(lit(None).cast("string")), review.band(lit(0.85)), review.band(lit(0.6499)), review.check_label(lit(None).cast("boolean")), review.check_label(lit(False)),
        review.quality_state(lit(True), F.array(lit("x"))), review.needs_review(lit(None).cast("boolean"), lit("")), review.needs_review(lit(False), lit("v")),
    ).first()
    assert tuple(got) == ("ok", "n/a", "high", "low", "N/A", "FAIL", "advisory", True, False)


def test_edits_of_a_null_value_and_of_renamed_keys(spark):
    record = spark.createDataFrame([(1, "issue_date", "2020-01-01"), (1, "sex", "M")], "doc_id long, key string, value string")
    edits = spark.createDataFrame([(1, "date_of_issue", "2021-01-01", 1), (1, "sex", "F", 1), (1, "sex", None, 2)], "doc_id long, key string, value string, ord int")
    got = {r["key"]: (r["value"], r["edited"]) for r in review.overlay(record, edits).collect()}
    assert got == {"issue_date": ("2021-01-01", True), "sex": (None, True)}


def test_unknown_variants_are_clean(spark):
    from evidoc.sources import samples

    rows = samples.measurements(spark.createDataFrame([(1, "clean"), (2, "blurry"), (3, "torn")], "doc_id long, variant string")).collect()
    assert [(r["variance"], r["glare_ratio"]) for r in rows] == [(400.0, 0.0), (20.0, 0.0), (400.0, 0.0)]


def test_sendable_files(spark):
    lit = F.lit
    cases = [("a.heif", "", 5, True), ("a.txt", "image/png", 5, True), ("a.txt", "text/plain", 5, False), ("a.pdf", "", 0, False), ("a.pdf", "", 15 * 1024 * 1024, True), ("a.pdf", "", 15 * 1024 * 1024 + 1, False)]
    got = spark.range(1).select(*[uploads.sendable(lit(n), lit(m), lit(k)) for n, m, k, _ in cases]).first()
    assert list(got) == [w for *_, w in cases]


def test_store_reads_one_session_from_its_folder(spark, tmp_path):
    from evidoc.sources import records

    rows = [(f"s{k}", k, f"p{k}") for k in range(200)] + [("s3", 500, "again"), ("s4", 1, "older")]
    frame = spark.createDataFrame(rows, "session_id string, confirmed_at int, payload string")
    records.save(frame.limit(150), f"{tmp_path}/store")
    records.save(frame.subtract(frame.limit(150)), f"{tmp_path}/store")
    assert records.one(spark, f"{tmp_path}/store", "s3").first()["payload"] == "again"
    assert records.one(spark, f"{tmp_path}/store", "s4").first()["payload"] == "p4"
    assert records.one(spark, f"{tmp_path}/store", "nobody").count() == 0
    assert records.stored(spark, f"{tmp_path}/store").count() == 200
    gone = spark.createDataFrame([("s3", 600), ("s5", 2)], "session_id string, deleted_at int")
    assert records.stored(spark, f"{tmp_path}/store", gone).count() == 199
    plan = records.one(spark, f"{tmp_path}/store", "s3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
