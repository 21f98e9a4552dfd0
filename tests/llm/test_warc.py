import gzip
import hashlib
import os

from evidoc.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, cell int, shard int"


def pages(spark):
    same, small = "<p>" + "same payload " * 30, "tiny"
    rows = [(5, "http://a/5", same), (3, "http://a/3", same), (9, None, same), (3, "http://a/3", same), (1, "http://a/1", small), (2, "http://a/2", small)]
    rows += [(4, "http://a/4", None), (None, "http://a/null", "no id " * 40), (6, "http://a/%0D\nx", "crlf\r\n\r\nin \x00 payload ünï " * 20)]
    rows += [(k, f"http://b/{k}", f"page {k} " * (k % 90)) for k in range(100, 400)]
    return spark.createDataFrame([(*r, "x", 1, 1) for r in rows], SCHEMA)


def test_report(spark, tmp_path):
    src = pages(spark)
    got = sorted(tuple(r) for r in warc.report(src, f"{tmp_path}/w").collect() if r["page_id"] is not None)
    payload = [(r["page_id"], (r["html"] or "").encode()) for r in src.collect()]
    want = []
    for page, own in payload:
        if page is None:
            continue
        first = min(p for p, x in payload if x == own and p is not None)
        revisit = len(own) >= 100 and page > first
        want.append((page, len(own), hashlib.sha256(own).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2], r[3])) or sorted(map(str, got)) == sorted(map(str, want))


def test_same_bytes_whatever_the_partitions(spark, tmp_path):
    digests = []
    for k in (1, 7):
        folder = f"{tmp_path}/w{k}"
        manifest = warc.write(pages(spark).repartition(k), folder, shard_bytes=20_000, roll_bytes=5_000).collect()
        digests.append(sorted((r["file"], r["sha256"], r["records"]) for r in manifest))
        for r in manifest:
            raw = open(f"{folder}/{r['file']}", "rb").read()
            assert len(raw) == r["bytes"] and hashlib.sha256(raw).hexdigest() == r["sha256"]
        assert not [f for f in os.listdir(folder) if f.endswith(".tmp")]
    assert digests[0] == digests[1] and len(digests[0]) > 3


def test_shards_are_bounded_in_number(spark, tmp_path):
    digests = []
    for k in (1, 7):
        manifest = warc.write(pages(spark).repartition(k), f"{tmp_path}/w{k}", shard_bytes=1_000, most_shards=6).collect()
        digests.append(sorted((r["file"], r["sha256"]) for r in manifest))
        assert 4 <= len({r["shard"] for r in manifest}) <= 7
        assert warc.read(spark, f"{tmp_path}/w{k}").count() == pages(spark).count()
    assert digests[0] == digests[1]


def ranges(spark, folder, manifest):
    """Per file, in the order of names, the first and last (page id, digest)."""
    names = sorted(r["file"] for r in manifest.collect())
    keys = {n: [] for n in names}
    for r in warc.read(spark, folder).collect():
        keys[r["file"]].append((r["page_id"], r["payload_digest"]))
    return [(min(keys[n]), max(keys[n])) for n in names], [len(keys[n]) for n in names]


def test_files_are_in_order_of_ids_beside_an_outlier(spark, tmp_path):
    src = spark.range(3000).selectExpr("IF(id = 7, 1L << 60, id * 3) AS page_id", "CONCAT('http://a/', id) AS url", "REPEAT(CONCAT('page ', id), 20) AS html")
    manifest = warc.write(src.repartition(5), f"{tmp_path}/w", shard_bytes=30_000)
    spans, sizes = ranges(spark, f"{tmp_path}/w", manifest)
    assert len(spans) > 20 and sum(sizes) == 3000 and max(sizes) < 120
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1][0] == 1 << 60


def test_a_hot_id_is_cut_by_digest_and_a_hot_page_by_count(spark, tmp_path):
    many = spark.range(2000).selectExpr("50L AS page_id", "'http://a' AS url", "CONCAT(REPEAT('x', 200), id) AS html")
    same = spark.range(1500).selectExpr("60L AS page_id", "'http://b' AS url", "REPEAT('same ', 50) AS html")
    urls = spark.range(500).selectExpr("60L AS page_id", "CONCAT('http://c/', id) AS url", "REPEAT('same ', 50) AS html")
    rest = spark.range(100).selectExpr("id AS page_id", "'http://d' AS url", "REPEAT('same ', 50) AS html").filter("page_id <> 60")
    src = many.union(same).union(urls).union(rest)
    shards = []
    for k in (1, 6):
        manifest = warc.write(src.repartition(k), f"{tmp_path}/w{k}", shard_bytes=40_000)
        spans, sizes = ranges(spark, f"{tmp_path}/w{k}", manifest)
        assert sum(sizes) == src.count() and len(sizes) > 40 and max(sizes) < 250
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        shards.append(sorted((r["file"], r["sha256"]) for r in manifest.collect()))
        rows = warc.read(spark, f"{tmp_path}/w{k}")
        assert rows.filter("record_type = 'revisit' AND refers_to = 0").count() == 2000 + 98
        assert rows.filter("page_id = 60 AND record_type <> 'revisit'").count() == 0
    assert shards[0] == shards[1]


def test_very_long_payloads(spark, tmp_path):
    src = spark.createDataFrame([(1, "u" * 100_000, "x" * 3_000_000), (2, "v", "x" * 3_000_000), (3, "w", "y")], "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r)[1:] for r in warc.report(src, f"{tmp_path}/w").collect()}
    assert got[1][0] == got[2][0] == 3_000_000 and got[2][2:] == ("revisit", 1) and got[1][2] == "response" and len(got) == 3


def test_files_roll_and_are_plain_gzip(spark, tmp_path):
    manifest = warc.write(pages(spark), f"{tmp_path}/w", roll_bytes=4_000).collect()
    assert len(manifest) > 1 and all(r["records"] >= 1 for r in manifest)
    text = gzip.decompress(open(f"{tmp_path}/w/{manifest[0]['file']}", "rb").read())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and b"WARC-Payload-Digest: sha256:" in text


def test_urls_survive(spark, tmp_path):
    warc.write(pages(spark), f"{tmp_path}/w")
    urls = {r["page_id"]: r["target_uri"] for r in warc.read(spark, f"{tmp_path}/w").collect()}
    assert urls[6] == "http://a/%0D\nx" and urls[9] == ""


def test_only_files_of_the_manifest_are_read(spark, tmp_path):
    warc.write(pages(spark), f"{tmp_path}/w")
    (tmp_path / "w" / "part-99999999-00000.warc.gz").write_bytes(b"left by a task that died")
    assert warc.read(spark, f"{tmp_path}/w").count() == pages(spark).count()


def test_empty(spark, tmp_path):
    assert warc.report(spark.createDataFrame([], SCHEMA), f"{tmp_path}/w").count() == 0
