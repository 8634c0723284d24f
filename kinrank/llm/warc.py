"""WARC archives: writing captures, reading records back, assembling transactions.

A capture becomes three records: the response (or a revisit, when an earlier
capture holds an equal payload), the request and a metadata record; the latter
two name the first one in WARC-Concurrent-To.  Archives are gzip files made by
Spark's text writer, whose line separator is the blank line that ends a
record, with a bounded number of records each.  The reader takes whole files
(`binaryFile`) and walks them record by record along Content-Length.

Assembly joins request, response and metadata records through their
concurrent-to identifiers and gives one nested row per capture.  A record that
names several others belongs to each; requests and metadata that name no known
response form a row without a response.  A capture's own requests and metadata
records are gathered in arrays (a handful by nature).

Defined cases: a null html is an empty payload; a null url is written as an
empty target; a page without page_id is always a response and nobody refers to
it; of repeated rows one is the response and the rest revisit it; very long payloads
are written whole (files are cut by their number of records, so payloads of many
MB want a smaller `captures_per_file`: the reader takes files of up to 2 GB); an
empty table gives no captures; extra columns are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinrank.llm.shared import shared_dir, text_batches

MIN_REVISIT_BYTES = 0
CAPTURES_PER_FILE = 2000
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"        # the tables carry no capture time

RECORD = ("record_id string, type string, date string, target_uri string, concurrent_to array<string>, "
          "refers_to string, content_type string, block_bytes bigint, status int, payload_bytes bigint, "
          "payload_digest string, fields map<string,string>, payload binary")


def record_id(page_id, sha1: str, serial: int, kind: str) -> str:
    import uuid
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{sha1}/{serial}/{kind}')}>"


def _record(kind: str, own: str, headers: list[tuple[str, str]], block: str) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}",
             *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(lines) + END + block


def roles(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, sha1 (hex) and: serial of a repeated row, first (the response's page_id), is_revisit."""
    hashed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    ids = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).where("page_id is not null")
    ids = ids.where(F.octet_length("html") >= min_bytes).select("page_id", F.sha1("html").alias("sha1")).distinct()
    firsts = ids.groupBy("sha1").agg(F.min("page_id").alias("first"))
    known = ids.join(firsts, "sha1")           # narrow rows; a hot payload is split by the skew join
    row = Window.partitionBy("page_id", "sha1").orderBy("url")
    return (hashed.join(known, ["page_id", "sha1"], "left")
            .withColumn("serial", F.row_number().over(row))
            .withColumn("is_revisit", F.col("first").isNotNull()
                        & ((F.col("first") != F.col("page_id")) | (F.col("serial") > 1))))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES,
                  captures_per_file: int = CAPTURES_PER_FILE) -> str:
    """Write the request, response or revisit, and metadata records of every page; returns the folder."""
    def run(batches):
        import base64

        import pyarrow as pa
        for b in batches:
            rest = b.drop_columns(["html"]).to_pylist()
            out, size, at = [], 0, 0
            for texts in text_batches(b, "html", 64):
                for row, html in zip(rest[at:at + len(texts)], texts):
                    out += _capture(row, html, base64.b32encode(bytes.fromhex(row["sha1"])).decode())
                    size += len(html)
                at += len(texts)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
                    out, size = [], 0
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    (roles(pages, min_bytes).select("page_id", "url", "html", "sha1", "first", "serial", "is_revisit")
     .mapInArrow(run, "value string").write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", 3 * captures_per_file).text(path))
    return path


def _capture(row: dict, html: str, digest: str) -> list[str]:
    page, url = row["page_id"], _header_value(row["url"])
    name = lambda kind: record_id(page, row["sha1"], row["serial"], kind)
    own = name("response")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html.encode())}{END}"
    headers = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"),
               ("Content-Type", "application/http; msgtype=response")]
    if row["is_revisit"]:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", record_id(row["first"], row["sha1"], 1, "response"))]
        main = _record("revisit", own, headers, http)
    else:
        main = _record("response", own, headers, http + html)
    linked = [("WARC-Target-URI", url), ("WARC-Concurrent-To", own)]
    get = f"GET {url} HTTP/1.1\r\nAccept: */*{END}"
    about = f"page_id: {'' if page is None else page}\r\n"
    return [_record("request", name("request"),
                    [*linked, ("Content-Type", "application/http; msgtype=request")], get),
            main,
            _record("metadata", name("metadata"),
                    [*linked, ("Content-Type", "application/warc-fields")], about)]


def _header_value(text: str | None) -> str:
    return " ".join((text or "").split())


def parse_archive(data: bytes):
    """The records of one archive (gzip or plain) as dictionaries, one after the other."""
    import base64
    import gzip
    import hashlib
    import io
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        one = lambda k: headers.get(k, [None])[0]
        block = stream.read(int(one("content-length") or 0))
        kind = one("warc-type")
        out = {"record_id": one("warc-record-id"), "type": kind, "date": one("warc-date"),
               "target_uri": one("warc-target-uri"), "concurrent_to": headers.get("warc-concurrent-to", []),
               "refers_to": one("warc-refers-to"), "content_type": one("content-type"), "block_bytes": len(block),
               "status": None, "payload_bytes": None, "payload_digest": None, "fields": None, "payload": None}
        if kind in ("response", "revisit"):
            head, _, payload = block.partition(b"\r\n\r\n")
            status, *fields = head.decode("latin-1").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (f.partition(":") for f in fields)}
            code = (status.split() + ["", ""])[1]
            out["status"], out["fields"] = int(code) if code.isdigit() else None, fields
            if kind == "response":
                out["payload"], out["payload_bytes"] = payload, len(payload)
                out["payload_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            else:
                out["payload_bytes"] = int(fields.get("content-length") or 0)
                out["payload_digest"] = (one("warc-payload-digest") or "").removeprefix("sha1:") or None
        elif one("content-type") == "application/warc-fields":
            lines = [x.partition(":") for x in block.decode(errors="replace").splitlines() if ":" in x]
            out["fields"] = {k.strip().lower(): v.strip() for k, _, v in lines}
        yield out


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every record of the archives below `path`; without `payload` the bodies stay in the reader."""
    def run(batches):
        import pyarrow as pa
        fields = [(c, pa.string()) for c in ("record_id", "type", "date", "target_uri")]
        schema = pa.schema([*fields, ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()),
                            ("content_type", pa.string()), ("block_bytes", pa.int64()), ("status", pa.int32()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for b in batches:
            for content in b.column(0):
                out, size = [], 0
                for r in parse_archive(content.as_py()):
                    size += len(r["payload"] or b"")
                    out.append(r | ({} if payload else {"payload": None})
                               | {"fields": None if r["fields"] is None else list(r["fields"].items())})
                    if size > 8_000_000 or len(out) >= 4096:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture (its response's record id), response, requests, metadata."""
    main = F.col("type").isin("response", "revisit")
    linked = records.select(
        F.explode(F.when(main | (F.size("concurrent_to") == 0), F.array("record_id"))
                  .otherwise(F.col("concurrent_to"))).alias("capture"),
        F.struct(*[c for c in records.columns]).alias("record"), main.alias("main"), "type")
    return linked.groupBy("capture").agg(
        F.first(F.when(F.col("main"), F.col("record")), ignorenulls=True).alias("response"),
        F.collect_list(F.when(F.col("type") == "request", F.col("record"))).alias("requests"),
        F.collect_list(F.when(F.col("type") == "metadata", F.col("record"))).alias("metadata"))


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write all pages, read the archives back and assemble the captures (payloads stay in the reader)."""
    spark = pages.sparkSession
    path = write_archive(pages, shared_dir(spark), min_bytes)
    return assemble(read_records(spark, path, payload=False))


def page_id_of(metadata: Column) -> Column:
    return F.element_at(F.element_at(metadata, 1)["fields"], "page_id")
