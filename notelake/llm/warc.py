"""WARC records and the resolution of not-modified revisits.

A revisit record of profile server-not-modified says that a server answered 304: its content is that of an earlier
capture. resolve_revisits() finds it by an as-of join: the latest earlier full response of the same canonical URL. If a
validator of the revisit (ETag by weak comparison, else Last-Modified, else payload digest) contradicts that response, it isn't
used. The headers of the response are kept, and those that a 304 may update are taken from the revisit.

The as-of join cuts time into blocks at quantiles of all capture times. A window within (URL, block) finds earlier responses of the
block; the last response of each block, one row a block, is carried over. So one URL may hold any share of all records.

Defined results: records without a URL or time are orphans; of responses at one time the one with the largest record_id counts, and a response is earlier
only by a smaller time; wholly equal rows count once, and rows that share a record_id (or have none) but differ are records of their own; status is
resolved, mismatch or orphan; an empty table gives no rows, other columns are ignored. read_warc() skips broken records and broken gzip members, and goes on at the next WARC/ line or member.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SEGMENT = 1 << 20
#: Headers that a 304 response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, without fragment, default port, `www.`, an empty query or the slash of an empty path; scheme-free."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(?:80|443)$|^www\.", "")
    rest = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1), r"\?$", "")
    rest = F.regexp_replace(rest, r"^/?(?=\?|$)|/(?=$)", "/")
    return F.when(host != "", F.concat(host, F.regexp_replace(rest, r"^/$", "")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merged_headers(old: Column, new: Column) -> Column:
    """Headers (names in lower case) of the response with the permitted ones of the revisit."""
    may = F.map_filter(new, lambda k, _: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(may, k)), may)


def resolve_revisits(records: DataFrame, blocks: int = 64) -> DataFrame:
    """record_id, url, ts, status, refers_to, headers, payload_digest, payload_length of each revisit. records: record_id, type (response,
    revisit), url, ts, headers (map with lower-case names), payload_digest, payload_length."""
    r = records.select("record_id", "type", "url", "ts", "headers", "payload_digest", "payload_length").where(F.col("type").isin("response", "revisit"))
    entries = F.array_sort(F.map_entries("headers")).alias("headers")
    whole = F.to_json(F.struct("record_id", "type", "url", F.unix_micros("ts").alias("ts"), entries, "payload_digest", "payload_length"))
    r = r.withColumn("row", F.sha2(whole, 256)).dropDuplicates(["row"]).withColumn("canon", canonical(F.col("url")))
    cuts = r.agg(F.percentile_approx(F.unix_micros("ts"), [i / blocks for i in range(1, blocks)], 1000)).first()[0] or []
    micros = F.unix_micros("ts")
    block = reduce_sum([(micros > c).cast("int") for c in sorted(set(cuts))])
    known = r.withColumns({"micros": micros, "blk": block})
    resp = F.when(F.col("type") == "response", F.struct("micros", "record_id", "row"))
    usable = known.where("canon is not null and micros is not null").select("row", "record_id", "type", "canon", "micros", "blk")
    # At one time revisits come first, so that only strictly earlier responses are seen.
    within = W.partitionBy("canon", "blk").orderBy("micros", F.desc("type"), "record_id", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = usable.withColumn("own", F.last(resp, ignorenulls=True).over(within)).where("type = 'revisit'")
    ends = usable.groupBy("canon", "blk").agg(F.max(resp).alias("end"))
    carried = ends.withColumn("carry", F.last("end", ignorenulls=True).over(W.partitionBy("canon").orderBy("blk").rowsBetween(W.unboundedPreceding, -1))).select("canon", "blk", "carry")
    found = seen.join(carried, ["canon", "blk"]).select("row", F.coalesce("own", "carry")["row"].alias("source"))
    old = r.where("type = 'response'").select(F.col("row").alias("source"), F.col("record_id").alias("old_id"), F.col("headers").alias("old"), F.col("payload_digest").alias("old_digest"), "payload_length")
    new = r.where("type = 'revisit'").select("row", "record_id", "url", "ts", F.coalesce("headers", F.expr("map()").cast("map<string,string>")).alias("new"), "payload_digest")
    both = new.join(found, "row", "left").join(old, "source", "left")
    tag, modified = F.col("new")["etag"], F.col("new")["last-modified"]
    agrees = (
        F.when(tag.isNotNull() & F.col("old")["etag"].isNotNull(), _weak(tag) == _weak(F.col("old")["etag"]))
        .when(modified.isNotNull() & F.col("old")["last-modified"].isNotNull(), modified == F.col("old")["last-modified"])
        .when(F.col("payload_digest").isNotNull() & F.col("old_digest").isNotNull(), F.col("payload_digest") == F.col("old_digest"))
        .otherwise(True)
    )
    status = F.when(F.col("source").isNull(), "orphan").when(agrees, "resolved").otherwise("mismatch")
    ok = F.col("status") == "resolved"
    merged = merged_headers(F.coalesce("old", F.expr("map()").cast("map<string,string>")), F.col("new"))
    return both.withColumn("status", status).select(
        "record_id", "url", "ts", "status", F.when(ok, F.col("old_id")).alias("refers_to"), F.when(ok, merged).otherwise(F.col("new")).alias("headers"),
        F.when(ok, F.col("old_digest")).alias("payload_digest"), F.when(ok, F.col("payload_length")).alias("payload_length"),
    )


def reduce_sum(parts: list[Column]) -> Column:
    out = F.lit(0)
    for p in parts:
        out = out + p
    return out


def encode_record(record_id: str, kind: str, url: str | None, date: str, headers: dict[str, str], payload: bytes, refers_to: str | None = None, compress: bool = True) -> bytes:
    """One WARC/1.1 record with an HTTP block, as a gzip member of its own if compress is set."""
    status = "HTTP/1.1 304 Not Modified" if kind == "revisit" else "HTTP/1.1 200 OK"
    block = "\r\n".join([status, *(f"{k}: {v}" for k, v in sorted(headers.items())), "", ""]).encode() + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", *([] if url is None else [f"WARC-Target-URI: {url}"]), f"WARC-Date: {date}", "Content-Type: application/http"]
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified")
    if refers_to:
        lines.append(f"WARC-Refers-To: <{refers_to}>")
    data = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    return gzip.compress(data, 3, mtime=0) if compress else data


def _members(data: bytes) -> Iterator[bytes]:
    """Content of each gzip member, or the data itself; a broken member is skipped, as its checksum can't be tested."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while (at := data.find(b"\x1f\x8b\x08", at)) >= 0:
        z, out, to, step = zlib.decompressobj(31), [], at, 1 << 12
        try:
            while to < len(data) and not z.eof:  # small steps first, as what follows a member is copied
                out.append(z.decompress(data[to : to + step]))
                to, step = to + step, min(2 * step, 1 << 18)
        except zlib.error:
            pass
        if z.eof:
            yield b"".join(out)
            at = min(to, len(data)) - len(z.unused_data)
        else:
            at += 1


def decode_records(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, gzip members or plain, one at a time."""
    for member in _members(data):
        f = io.BytesIO(member)
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                continue
            start, head = f.tell(), _headers(f)
            size = head.get("content-length", "")
            if not (size.isdecimal() and int(size) <= len(member) - f.tell()):
                f.seek(start)  # a broken record: the next may begin within its stated length
                continue
            block = f.read(int(size))
            http, _, payload = block.partition(b"\r\n\r\n")
            yield {
                "record_id": head.get("warc-record-id", "").strip("<>"), "type": head.get("warc-type"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"),
                "headers": _headers(io.BytesIO(http.partition(b"\r\n")[2])), "refers_to": head.get("warc-refers-to", "").strip("<>") or None, "payload": payload,
            }


def _headers(f) -> dict[str, str]:
    out = {}
    while (line := f.readline().strip()) and b":" in line:
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out[k.strip().lower()] = v.strip()
    return out


_READ = "record_id string, type string, url string, date string, headers map<string,string>, refers_to string, payload binary"


def _batch(rows: list[dict]) -> pa.RecordBatch:
    text = lambda k: pa.array([r[k] for r in rows], pa.string())
    headers = pa.array([list(r["headers"].items()) for r in rows], pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays(
        [text("record_id"), text("type"), text("url"), text("date"), headers, text("refers_to"), pa.array([r["payload"] for r in rows], pa.binary())],
        names=["record_id", "type", "url", "date", "headers", "refers_to", "payload"],
    )


def records_of(files: DataFrame) -> DataFrame:
    """record_id, type, url, headers, refers_to, payload, ts of the records in the bytes of `content`, each row a file or a part of one
    that holds whole records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                rows, size = [], 0
                for r in decode_records(x.as_py() or b""):
                    rows.append(r)
                    size += len(r["payload"])
                    if size > _SEGMENT or len(rows) == 1000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.select("content").mapInArrow(run, _READ).withColumn("ts", F.to_timestamp("date")).drop("date")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files below path, read through Spark. A file is one row, which Spark holds to 2 GB (crawlers cut files at 1 GB)."""
    return records_of(spark.read.format("binaryFile").load(path))


def to_warc(records: DataFrame, compress: bool = True) -> DataFrame:
    """content: WARC bytes of about 1 MB a row. records: record_id, type, url, at (seconds since 1970), headers, payload. White space around a URL
    or header value doesn't survive, as in any WARC file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for record_id, kind, url, at, headers, payload in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                date = (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=at)).strftime("%Y-%m-%dT%H:%M:%SZ")
                held.append(encode_record(record_id, kind, url, date, dict(headers or ()), payload or b"", compress=compress))
                size += len(held[-1])
                if size > _SEGMENT:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["content"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["content"])

    return records.select("record_id", "type", "url", "at", "headers", "payload").mapInArrow(run, "content binary")
