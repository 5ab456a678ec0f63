"""Operator 7: WARC files, written from pages and read back with segment reassembly.

Writing: one record per page, an HTTP response with chunked transfer framing. Payloads seen before
(same SHA-1 and length) become revisit records that refer to the response of the smallest page id. Blocks
over ``SEGMENT`` bytes are cut into a first segment and continuation records.

Reading: whole files come in as binary, are inflated and walked by Content-Length. Whole records are decoded
in place; the segments of cut ones are grouped by origin id, ordered by number, checked against the
total length, and then decoded. Files hold a bounded number of bounded records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import common  # noqa: F401  (ships this package's functions with the job)
from riskloom.llm.common import stored
from riskloom.session import work_path
from riskloom.sources.tables import read_table

SEGMENT = 32 * 1024        # block bytes of one record
CHUNK = 8 * 1024           # bytes of one transfer chunk
FILE_RECORDS = 2_000       # records of one file
INFLATE = 64 * 1024        # compressed bytes inflated in one call
LEAST_REVISIT = 0          # payloads of fewer bytes are never revisits
END = "\r\n\r\n"           # ends every record; the text writer's line separator
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in base32, as WARC writes it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(body[i: i + size]), body[i: i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """The body of chunked framing; raises ValueError when the framing is broken or cut short."""
    parts, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size line is missing")
        size = int(data[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if data[at + size: at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        parts.append(data[at: at + size])
        at += size + 2


def _record(kind: str, rid: str, block: bytes, **fields) -> bytes:
    """One record without its two closing line ends."""
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block


def page_records(page_id, row: int, url, payload: bytes, first_id, segment: int) -> list[bytes]:
    """The records of one page: a response in one or more segments, or a revisit."""
    name = "" if pd.isna(page_id) else int(page_id)
    rid = f"urn:page:{name}:{row}"
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    shared = {"WARC_Target_URI": uri, "WARC_Date": "1970-01-01T00:00:00Z", "WARC_Payload_Digest": f"sha1:{payload_digest(payload)}"}
    if not pd.isna(first_id):
        block = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
        return [_record("revisit", rid, block, **shared, WARC_Refers_To=f"<urn:page:{int(first_id)}>",
                        WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                        Content_Type="application/http; msgtype=response")]
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    kind = {"Content_Type": "application/http; msgtype=response"}
    if len(block) <= segment:
        return [_record("response", rid, block, **shared, **kind)]
    out = [_record("response", rid, block[:segment], **shared, **kind, WARC_Segment_Number=1)]
    cuts = range(segment, len(block), segment)
    for k, at in enumerate(cuts, 2):
        last = {"WARC_Segment_Total_Length": len(block)} if at + segment >= len(block) else {}
        out.append(_record("continuation", f"{rid}:{k}", block[at: at + segment], **shared,
                           WARC_Segment_Origin_ID=f"<{rid}>", WARC_Segment_Number=k, **last))
    return out


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               least_revisit: int = LEAST_REVISIT, segment: int = SEGMENT) -> None:
    """Write ``pages`` as gzip-compressed WARC files under ``path``.

    Of equal payloads of at least ``least_revisit`` bytes the row(s) with the smallest id are
    responses, the others revisits; null ids refer to the smallest id that is not null, and stay
    responses when there is none. A null html is an empty payload.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    x = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("html"),
                     F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("size"))
    firsts = stored(x.where(F.col("size") >= least_revisit).groupBy("sha", "size").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "firsts")
    x = x.join(firsts, ["sha", "size"], "left").withColumn(
        "first_id", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, held = [], 0
            for r in zip(pdf["page_id"], pdf["row"], pdf["url"], pdf["html"], pdf["first_id"]):
                records = page_records(r[0], r[1], r[2], r[3].encode("utf-8", "surrogatepass"), r[4], segment)
                out += records
                held += sum(map(len, records))
                if held > 4_000_000:
                    yield pd.DataFrame({"record": out})
                    out, held = [], 0
            if out:
                yield pd.DataFrame({"record": out})

    records = x.withColumn("row", F.monotonically_increasing_id()).select("page_id", "row", "url", "html", "first_id").mapInPandas(work, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option(
        "compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def inflated(content: bytes) -> bytes:
    """All gzip members of a file, one after the other; a cut member or a rest that is no member raises."""
    view, at, parts = memoryview(content), 0, []
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = view[at: at + INFLATE]
            if not piece:
                raise ValueError("gzip member is cut short")
            parts.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
    return b"".join(parts)


def walk(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of an inflated file; field names in lower case."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        size = int(fields["content-length"])
        block = data[end + 4: end + 4 + size]
        if len(block) != size:
            raise ValueError("record is cut short")
        yield fields, block
        at = end + 4 + size + 4


def _decoded(kind: str, rid: str, uri: str | None, refers: str | None, digest: str, block: bytes, with_payload: bool) -> tuple:
    head, _, rest = block.partition(b"\r\n\r\n")
    name = rid.split(":")[2]
    page = int(name) if name else None
    if kind == "revisit":
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        return page, uri, size, digest, kind, int(refers.split(":")[2]), None
    payload = dechunked(rest) if b"Transfer-Encoding: chunked" in head else rest
    if payload_digest(payload) != digest:
        raise ValueError(f"payload of {rid} differs from its digest")
    return page, uri, len(payload), digest, kind, None, payload if with_payload else None


PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
RAW = PAGE + ", origin string, number int, total long, block binary"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The pages of all WARC files under ``path``: one row per response or revisit.

    Segments are put together by origin id in order of their number; a missing number or a length
    other than the recorded total raises, as do broken chunk framing and a wrong payload digest.
    """
    names = [c.split()[0] for c in RAW.split(", ")]
    pages = names[:7]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                data = inflated(content) if content[:2] == b"\x1f\x8b" else content
                out = []
                for f, block in walk(data):
                    rid = f.get("warc-segment-origin-id", f["warc-record-id"])[1:-1]
                    refers = f["warc-refers-to"][1:-1] if "warc-refers-to" in f else None
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    if "warc-segment-number" in f:
                        total = int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None
                        out.append((None, f.get("warc-target-uri"), None, digest, None, None, None, rid, int(f["warc-segment-number"]), total, block))
                    else:
                        out.append((*_decoded(f["warc-type"], rid, f.get("warc-target-uri"), refers, digest, block, with_payload), None, None, None, None))
                    if len(out) >= 1000:
                        yield _frame(out, names)
                        out = []
                if out:
                    yield _frame(out, names)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        if list(pdf["number"]) != list(range(1, len(pdf) + 1)):
            raise ValueError(f"segments of {pdf['origin'].iloc[0]} are not complete")
        block = b"".join(pdf["block"])
        if len(block) != int(pdf["total"].iloc[-1]):
            raise ValueError(f"segments of {pdf['origin'].iloc[0]} do not add up to the total length")
        first = pdf.iloc[0]
        return _frame([_decoded("response", first["origin"], first["url"], None, first["payload_digest"], block, with_payload)], pages)

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RAW)
    raw = stored(raw, "warc-records")
    whole = raw.where("origin is null").select(*pages)
    cut = raw.where("origin is not null").select("url", "payload_digest", "origin", "number", "total", "block")
    return whole.union(cut.groupBy("origin").applyInPandas(joined, PAGE))


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=names)
    return pdf.astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to", "number", "total") if c in names})


def roundtrip(pages: DataFrame, with_payload: bool = True, **names) -> DataFrame:
    """Write ``pages`` to WARC files in the shared folder and read them back.

    One row per page row. Null urls come back null, null html as an empty payload. Repeated rows
    (same id and payload) are responses each. Columns other than id, url and html are ignored; an
    empty table gives no rows.
    """
    spark = pages.sparkSession
    path = work_path(spark, "llm", f"warc-{uuid.uuid4().hex}")
    write_warc(pages, path, **names)
    return read_warc(spark, path, with_payload)


def q_op7_warc(spark, sf_dir: str) -> DataFrame:
    x = roundtrip(read_table(spark, sf_dir, "pages", "page_id", "url", "html"), with_payload=False)
    return x.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {"op7_warc": """
WITH b AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     f AS (SELECT h, min(page_id) AS first_id FROM b GROUP BY h),
     d AS (SELECT b.page_id, b.h, f.first_id, sha1(b.h) AS x FROM b JOIN f ON b.h = f.h),
     g AS (SELECT *, [strpos('0123456789abcdef', substr(x, i::INT, 1)) - 1 FOR i IN range(1, 41)] AS n FROM d),
     bits AS (SELECT *, list_reduce([''] || [lpad(bin(v), 4, '0') FOR v IN n], lambda a, c: a || c) AS s FROM g)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       list_reduce([''] || [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (16 * substr(s, 5 * i + 1, 1)::INT + 8 * substr(s, 5 * i + 2, 1)::INT + 4 * substr(s, 5 * i + 3, 1)::INT
          + 2 * substr(s, 5 * i + 4, 1)::INT + substr(s, 5 * i + 5, 1)::INT + 1)::INT, 1) FOR i IN range(0, 32)],
         lambda a, c: a || c) AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM bits
"""}
