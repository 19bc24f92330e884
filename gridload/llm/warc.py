"""WARC archives: write, read back, and merge their indexes into capture histories.

Payloads are deduplicated by SHA-1: of the records with equal payloads of at least ``min_bytes``, the one with
the smallest (page id, url) is a response, the others are revisits that refer to it and carry no payload. Each
distinct payload is shuffled once; revisits are made from ids and digests alone. Archives are gzipped WARC 1.1
files of bounded size (offsets count in the plain stream), written by Spark's committer into the shared folder (a lost executor's task is simply
redone), and are read back by content length, with every response's digest recomputed.

Every archive yields a locally sorted index run. Runs are dealt out by range of (URL key, timestamp, page id), so
one URL with many captures spans several tasks, and in each range a loser tree merges the k run segments.
Ranges are ordered, so the whole is one sorted capture history.

Null html is an empty payload; a null url has no target header and the empty URL key; a null page id gets no id
header, sorts last and reads back as null. Repeated rows (same id, url and html) are separate records: one
response, the others revisits. An empty table gives an empty archive and index. Extra columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridload.llm.common import stage
from gridload.session import scratch_path

ENTRY = ("urlkey string, ts string, page_id string, page_order bigint, record_type string, payload_digest string, "
         "payload_bytes bigint, refers_to string, run string, at bigint, size bigint")
EPOCH = datetime(2024, 1, 1)
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def surt(url: str | None) -> str:
    """Sort-friendly URL key: host labels reversed, then path and query, lower-cased; no scheme, port or fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}".lower()


def _uuid(digest: str, page_id: str | None, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}/{page_id}/{n}')}>"


def record(page_id: str | None, url: str | None, order: int | None, digest_hex: str, n_bytes: int, payload: bytes | None,
           refers_to: str | None, copy: int) -> bytes:
    """One WARC record without its last line end; ``payload`` None makes a revisit."""
    digest = base64.b32encode(bytes.fromhex(digest_hex)).decode()
    date = (EPOCH + timedelta(seconds=(order or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}",
            f"WARC-Record-ID: {_uuid(digest, page_id, copy)}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n_bytes}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if payload is None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: {_uuid(digest, refers_to, 0)}")
            head.append(f"X-Refers-To-Page: {refers_to}")
    block = b"" if payload is None else HTTP + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n"


def _records(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """id, url, ord, digest, n_bytes, payload (null for revisits), refers_to, copy."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
                        F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"))
    rank = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("url").isNull().alias("no_url"),
                    F.col("url").alias("url"))
    shared = rows.where(F.col("n_bytes") >= min_bytes)
    heads = shared.groupBy("digest").agg(F.min(rank).alias("head"))
    bodies = shared.groupBy("digest").agg(F.min(rank).alias("head"), F.first("n_bytes").alias("n_bytes"),
                                          F.first(F.col("payload").cast("binary")).alias("payload"))
    responses = bodies.select("head.id", "head.url", "digest", "n_bytes", "payload",
                              F.lit(None).cast(pages.schema[id_col].dataType).alias("refers_to"), F.lit(0).cast("long").alias("copy"))
    counted = shared.groupBy("digest", "id", "url", "n_bytes").agg(F.count("*").alias("m"))
    is_head = F.col("id").eqNullSafe(F.col("head.id")) & F.col("url").eqNullSafe(F.col("head.url"))
    left = F.col("m") - is_head.cast("long")
    revisits = (counted.join(heads, "digest").where(left > 0)
                .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), left)))
                .select("id", "url", "digest", "n_bytes", F.lit(None).cast("binary").alias("payload"),
                        F.col("head.id").alias("refers_to"), "copy"))
    small = rows.where(F.col("n_bytes") < min_bytes).select(
        "id", "url", "digest", "n_bytes", F.col("payload").cast("binary").alias("payload"),
        F.lit(None).cast(pages.schema[id_col].dataType).alias("refers_to"), F.monotonically_increasing_id().alias("copy"))
    every = responses.unionByName(revisits)
    return every.unionByName(small) if min_bytes > 0 else every


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 0, archive_bytes: int = 8 << 20) -> None:
    """Write one record per row to WARC files under ``path``, about ``archive_bytes`` each (or one longer record)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, size, out, names = TaskContext.get().partitionId(), 0, 0, [], []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                out.append(record(*row))
                names.append(f"{part:05d}-{number:05d}")
                size += len(out[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(out, pa.binary())], names=["archive", "value"])
                    number, size, out, names = number + 1, 0, [], []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(out, pa.binary())], names=["archive", "value"])

    rows = _records(pages, id_col, url_col, html_col, min_bytes).select(
        F.col("id").cast("string"), "url", F.col("id").try_cast("bigint").alias("ord"), "digest", "n_bytes", "payload",
        F.col("refers_to").cast("string"), "copy")
    (rows.mapInArrow(run, "archive string, value binary").select("archive", F.col("value").cast("string").alias("value"))
     .write.partitionBy("archive").option("lineSep", "\r\n").option("compression", "gzip").text(path))


def gunzip(data: bytes | memoryview) -> bytes:
    """The plain bytes of a gzip file, which may have several members."""
    out, data = [], bytes(data)
    while data:
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(data) + member.flush())
        if not member.eof:
            raise ValueError("a gzip member is cut off")
        data = member.unused_data
    return b"".join(out)


def parse(content: bytes | memoryview) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """Records of a WARC file: headers (names lower-cased), offset, length, block."""
    content, at = bytes(content), 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        stop = end + 4 + size
        if content[stop: stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield head, at, stop + 4 - at, content[end + 4: stop]
        at = stop + 4


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives under ``path``, each archive's in order of (URL key, timestamp, page)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split()[0] for x in ENTRY.split(",")]
        types = [pa.int64() if x.strip().endswith("bigint") else pa.string() for x in ENTRY.split(",")]
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for head, at, size, block in parse(gunzip(content.as_buffer())):
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{name}: the payload at byte {at} doesn't have its digest")
                        n_bytes = len(payload)
                    else:
                        n_bytes = int(head["x-payload-length"])
                    page = head.get("x-page-id")
                    order = int(page) if page is not None and re.fullmatch(r"-?\d{1,18}", page) else (1 << 63) - 1
                    rows.append((surt(head.get("warc-target-uri")), re.sub(r"\D", "", head["warc-date"]), page, order,
                                 head["warc-type"], digest, n_bytes, head.get("x-refers-to-page"), name, at, size))
                rows.sort(key=lambda r: (r[0], r[1], r[3], r[2] or "", r[9]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select(F.regexp_extract("path", r"archive=([^/]+)", 1).alias("run"), "content").mapInArrow(run, ENTRY)


def merge_runs(runs: list[list]) -> Iterator[tuple[int, int]]:
    """Loser tree over k sorted lists: yields (list, position) in the lists' common order; ties by list."""
    k = len(runs)
    at = [0] * k

    def less(i: int, j: int) -> bool:  # an exhausted list loses
        if at[i] >= len(runs[i]) or at[j] >= len(runs[j]):
            return at[i] < len(runs[i])
        x, y = runs[i][at[i]], runs[j][at[j]]
        return x < y or (x == y and i < j)

    loser = [-1] * k
    def play(i: int) -> int:  # move list i up from its leaf; losers stay, the winner leaves at the root
        node = (i + k) >> 1
        while node:
            if loser[node] < 0:
                loser[node] = i
                return -1
            if less(loser[node], i):
                loser[node], i = i, loser[node]
            node >>= 1
        return i

    winner = -1
    for i in range(k):
        winner = max(winner, play(i))
    while k and at[winner] < len(runs[winner]):
        yield winner, at[winner]
        at[winner] += 1
        winner = play(winner)


def capture_history(index: DataFrame) -> DataFrame:
    """All entries in global order of (URL key, timestamp, page), range partitioned; ``part`` numbers the ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        keys = list(zip(*(rows.column(c).to_pylist() for c in ("urlkey", "ts", "page_order")), (x or "" for x in rows.column("page_id").to_pylist())))
        names = rows.column("run").to_pylist()
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        order = [cuts[i] + j for i, j in merge_runs([keys[a:b] for a, b in zip(cuts, cuts[1:])])]
        out = rows.take(pa.array(order)).append_column("part", pa.array([TaskContext.get().partitionId()] * len(order), pa.int32()))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    order = ["urlkey", "ts", "page_order", "page_id"]
    return (index.repartitionByRange(*order).sortWithinPartitions("run", *order, "at").mapInArrow(run, ENTRY + ", part int"))


def archive_and_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives (under ``path``, or a new folder in the shared scratch), read them back and
    return the merged capture history; page_id and refers_to have the id column's type."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col, min_bytes)
    index = stage(read_index(spark, path), "warc-index")
    kind = pages.schema[id_col].dataType
    return (capture_history(index).drop("page_order").withColumn("page_id", F.col("page_id").cast(kind))
            .withColumn("refers_to", F.col("refers_to").cast(kind)))
