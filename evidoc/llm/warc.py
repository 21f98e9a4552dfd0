"""A deterministic sharded WARC writer, and a reader.

Records are range-sorted by page id and payload digest. Running byte counts over the sorted keys cut
them into shards of about ``shard_bytes``: shard k begins where k times that many bytes are passed, so
the cut depends on the records alone. A key of more bytes than a shard (one page repeated without end)
takes several shards; its repeated rows travel as one row and a count. The driver sees a key per shard,
of which there are some ``MOST_SHARDS`` at any size: beyond, shards grow with the bytes of all records.
A task writes a shard's records in order, one gzip member each, and starts the next file when the
compressed size reaches ``roll_bytes``. Headers, record ids and digests are made anew from the record
alone, dates come from a parameter and gzip members carry no time, so equal input gives equal bytes
whatever the number of executors. Files are written under temporary names and renamed when complete; a
manifest of names, counts, sizes and SHA-256 commits the whole, and only files it names are read back.
A task that runs again after a lost executor writes the same bytes under the same name.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes that with the smallest page_id is
the response and the others are revisits of it.

Defined results: a null html is an empty payload; a null url has an empty target; a null page_id is
written without one and is always a response; rows that repeat page_id and payload are all
responses, if that page_id is the smallest; smaller payloads are all responses; an empty table gives
an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidoc.llm.common import cut, join_counted, store

MIN_REVISIT = 100
#: What a record's headers count beside its payload.
HEADER_BYTES = 300
SHARD_BYTES = 32 << 20
ROLL_BYTES = 16 << 20
MOST_SHARDS = 10_000
DATE = "2000-01-01T00:00:00Z"
SPACE_OF_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace for URLs
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("records", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("sha256", T.StringType()),
    ]
)

RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("file", T.StringType()),
    ]
)


# --- records -----------------------------------------------------------------------------------


def record_id(page_id: int | None, digest: str, url: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_OF_IDS, f'{page_id}/{digest}/{copy}/{url}')}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}"]
    lines += [f"{k}: {v}" for k, v in headers]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def page_record(page_id: int | None, url: str, payload: bytes, digest: str, copy: int, original: tuple[int, str] | None, date: str) -> bytes:
    """A response, or a revisit of the record of ``original`` (page id and URL)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    headers = [("WARC-Record-ID", record_id(page_id, digest, url, copy)), ("WARC-Target-URI", target)]
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    headers += [] if page_id is None else [("X-Page-ID", str(page_id))]
    if original is None:
        return record("response", headers, http + payload, date)
    page, own = original
    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(page, digest, own, 0)), ("X-Refers-To-Page-ID", str(page))]
    return record("revisit", headers, http, date)


class Roller:
    """Writes the records of one shard to files of a bounded compressed size."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, date: str):
        self.system, self.path = store(folder)
        self.shard, self.roll_bytes, self.date = shard, roll_bytes, date
        self.files, self.out = 0, None

    def add(self, member: bytes) -> Iterator[tuple]:
        if self.out is not None and self.size + len(member) > self.roll_bytes and self.records:
            yield self.close()
        if self.out is None:
            self.name = f"part-{self.shard:08d}-{self.files:05d}.warc.gz"
            self.temporary = f"{self.path}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out = self.system.open_output_stream(self.temporary)
            self.size, self.records, self.hash = 0, 0, hashlib.sha256()
            info = [("WARC-Record-ID", record_id(None, self.name, "", 0)), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self._put(record("warcinfo", info, b"format: WARC File Format 1.1\r\n", self.date))
        self._put(member)
        self.records += 1

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.hash.update(member)
        self.size += len(member)

    def close(self) -> tuple:
        """Give the file its name; a file that is there already came from a task that ran before."""
        self.out.close()
        self.out = None
        self.files += 1
        final = f"{self.path}/{self.name}"
        there = self.system.get_file_info(final)
        if there.type == fs.FileType.File and there.size == self.size and self.digest_of(final) == self.hash.hexdigest():
            self.system.delete_file(self.temporary)
        else:
            self.system.move(self.temporary, final)
        return self.shard, self.name, self.records, self.size, self.hash.hexdigest()

    def digest_of(self, path: str) -> str:
        own = hashlib.sha256()
        with self.system.open_input_stream(path, compression=None) as stream:
            while block := stream.read(1 << 20):
                own.update(block)
        return own.hexdigest()


#: The place of records without a page id in the order.
NO_ID = -(1 << 63)
BOUNDS = T.StructType([T.StructField(c, t) for c, t in (("place", T.LongType()), ("digest", T.StringType()), ("shard", T.LongType()), ("ways", T.LongType()))])


def bounds(keys: DataFrame, shard_bytes: int, most_shards: int = MOST_SHARDS) -> list[tuple[int, str, int, int]]:
    """Where shards begin: (place, digest, shard, ways) of the first key of each shard, and of each key
    that takes ``ways`` shards, in order. ``keys`` has each ``place`` and ``digest`` once with ``weight``,
    its bytes, in sorted partitions. Shards are of ``shard_bytes``, or of more if these were over ``most_shards``."""
    part = keys.select("place", "digest", "weight", F.spark_partition_id().alias("part"))
    at, starts = 0, {}
    for r in part.groupBy("part").agg(F.sum("weight").alias("weight")).orderBy("part").collect():
        starts[r["part"]], at = at, at + r["weight"]
    shard_bytes = max(shard_bytes, -(-at // most_shards))

    def run(batches):
        end = last = None
        for b in batches:
            place, weight, own = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            if not len(place):
                continue
            end = starts[int(own[0])] if end is None else end
            ends = end + np.cumsum(weight)
            first = (ends - weight) // shard_bytes
            ways = np.where(weight > shard_bytes, (ends - 1) // shard_bytes - first + 1, 1)
            new = np.concatenate([[last is None or first[0] != last], first[1:] != first[:-1]]) | (ways > 1)
            new[1:] |= ways[:-1] > 1
            end, last = int(ends[-1]), int(first[-1]) if ways[-1] == 1 else None
            keep = pa.array(new)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(first[new]), pa.array(ways[new].astype(np.int64))], names=BOUNDS.names)

    return sorted(tuple(r) for r in part.mapInArrow(run, BOUNDS).collect())


def finder(cuts: list[tuple[int, str, int, int]]):
    """A column function: the shard of a place and a digest."""
    places, digests, shards = (list(c) for c in zip(*cuts, strict=True))

    @F.pandas_udf("long")
    def shard(place: pd.Series, digest: pd.Series) -> pd.Series:
        known = np.array(places, dtype=np.int64)
        lo, hi = np.searchsorted(known, place, side="left"), np.searchsorted(known, place, side="right")
        at = hi - 1
        for k in np.flatnonzero(lo < hi):  # the place of a bound: digests decide
            at[k] = bisect_right(digests, digest.iat[k], lo[k], hi[k]) - 1
        return pd.Series(np.array(shards, dtype=np.int64)[at])

    return shard


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE, most_shards: int = MOST_SHARDS) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to WARC files in ``folder``; return the manifest, which
    is committed as Parquet in ``folder/_manifest``."""
    spark = pages.sparkSession
    system, path = store(folder)
    system.create_dir(path, recursive=True)
    html = F.coalesce("html", F.lit(""))
    page = F.col("page_id").cast("long")
    rows = pages.select(page.alias("page_id"), F.coalesce(page, F.lit(NO_ID)).alias("place"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    facts = rows.select("page_id", "place", "digest", "url", F.octet_length("html").cast("long").alias("bytes"))
    keys = facts.groupBy("place", "digest").agg(
        F.sum(F.col("bytes") + HEADER_BYTES).alias("weight"), F.max("bytes").alias("bytes"), F.min("page_id").alias("page_id"), F.min("url").alias("url")
    )
    keys = cut(keys.repartitionByRange("place", "digest").sortWithinPartitions("place", "digest"))
    cuts = bounds(keys, shard_bytes, most_shards)
    if not cuts:
        spark.createDataFrame([], MANIFEST).write.mode("overwrite").parquet(f"{folder}/_manifest")
        return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    shard = finder([c[:3] for c in cuts])(F.col("place"), F.col("digest"))
    n_shards = max(c[2] + c[3] for c in cuts)

    # Of each payload of several pages, the smallest page; its URL names its record.
    ids = keys.filter((F.col("bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    firsts = cut(ids.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    again = join_counted(ids.select("page_id", "place", "digest"), firsts, "digest", "n", firsts.agg(F.sum("n")).first()[0] or 0)
    again = again.filter("page_id > original.page_id").select("page_id", "place", "digest", "original")

    one = F.lit(0).cast("long")
    cols = ["shard", "place", "digest", "url", "copy", "page_id", "original", "html"]
    none = F.lit(None).cast("struct<page_id:long,url:string>")
    records = rows.withColumns({"shard": shard, "copy": one, "original": none})
    marks = again.withColumns({"shard": shard, "copy": one, "url": F.lit(""), "html": F.lit(None).cast("string")})
    large = [(p, d, first, ways) for p, d, first, ways in cuts if ways > 1]
    if large:  # fewer than shards
        wide = F.broadcast(spark.createDataFrame(large, "place long, digest string, first long, ways long"))
        on = ["place", "digest"]
        groups = rows.join(wide, on).groupBy("page_id", "url", *on, "first", "ways").agg(F.first("html").alias("html"), F.count(F.lit(1)).alias("n"))
        each = groups.withColumn("copy", F.explode(F.sequence(one, F.col("n") - 1)))
        each = each.withColumns({"shard": F.col("first") + F.pmod(F.xxhash64("url", "copy"), F.col("ways")), "original": none})
        records = records.join(wide, on, "left_anti").select(*cols).unionByName(each.select(*cols))
        more = marks.join(wide, on).withColumn("shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("ways") - 1)))
        marks = marks.join(wide, on, "left_anti").select(*cols).unionByName(more.select(*cols))
    # A revisit's mark is sorted right before the records of its page and payload.
    both = marks.select(*cols).unionByName(records.select(*cols)).repartitionById(n_shards, F.col("shard").cast("int"))
    ordered = both.sortWithinPartitions("shard", "place", "digest", F.col("html").isNotNull(), "url", "copy", "page_id").select("shard", "page_id", "digest", "original", "url", "copy", "html")

    def run(batches):
        roller, mark, last, copy = None, None, None, 0
        for b in batches:
            done = []
            for own, page, digest, original, url, least, html_ in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if roller is None or roller.shard != own:
                    if roller is not None and roller.out is not None:
                        done.append(roller.close())
                    roller = Roller(folder, own, roll_bytes, date)
                if html_ is None:
                    mark = (page, digest, (original["page_id"], original["url"]))
                    continue
                copy = max(copy + 1, least) if last == (page, digest, url) else least
                last = (page, digest, url)
                refers = mark[2] if mark and mark[:2] == last[:2] else None
                done += roller.add(page_record(page, url, html_.encode(), digest, copy, refers, date))
            yield batch(done)
        if roller is not None and roller.out is not None:
            yield batch([roller.close()])

    def batch(done):
        cols = [list(c) for c in zip(*done, strict=True)] or [[] for _ in MANIFEST]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=MANIFEST.names)

    ordered.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def members(stream) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one by one."""
    left = b""
    while True:
        left = left or stream.read(1 << 20)
        if not left:
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not left:
                left = stream.read(1 << 20)
                if not left:
                    raise ValueError("a gzip member ends early")
            parts.append(inflate.decompress(left))
            left = inflate.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, its block digest verified."""
    head, _, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)}
    block = rest[: int(headers["content-length"])]
    if not first.startswith("WARC/1.") or headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("not a WARC record, or a damaged one")
    return headers, block


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every response and revisit record of the files that the manifest names."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")

    def rows(name: str):
        system, path = store(folder)
        with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
            for member in members(stream):
                headers, block = parse(member)
                if headers["warc-type"] not in ("response", "revisit"):
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.decode().rsplit("Content-Length: ", 1)[1])
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                if headers["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{name}: a payload has another digest")
                page, original = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                url = headers["warc-target-uri"].replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                yield page and int(page), size, digest, headers["warc-type"], original and int(original), url, name

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            for name in b.column(0).to_pylist():
                some = []
                for row in rows(name):
                    some.append(row)
                    if len(some) == 2_000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=RECORDS.names)
                        some = []
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=RECORDS.names)

    n = max(1, files.count())
    return files.select("file").repartition(min(n, 2_000)).mapInArrow(run, RECORDS)


def report(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives, then page_id, payload_bytes, payload_digest, record_type and refers_to of
    what they hold."""
    write(pages, folder)
    return read(pages.sparkSession, folder).select(*RECORDS.names[:5])


def sql() -> str:
    """The report by a window over equal payloads."""
    return f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), f AS (
  SELECT page_id, strlen(payload) AS bytes, sha256(payload) AS digest, min(page_id) OVER (PARTITION BY payload) AS original FROM p
)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
  CASE WHEN bytes >= {MIN_REVISIT} AND page_id > original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN bytes >= {MIN_REVISIT} AND page_id > original THEN original END AS refers_to
FROM f
"""
