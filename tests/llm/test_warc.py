import base64
import hashlib

from kinrank.llm import warc as W
from kinrank.llm.shared import shared_dir

HTML = ["<p>a</p>", "", None, "x\r\n\r\nWARC/1.1\r\n\r\ny", "<p>a</p>", "é漢🙂\n" * 50, "", "<p>a</p>", "z" * 300_000]


def pages(spark, html=HTML):
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 2 else None, h, "e", 1) for i, h in enumerate(html)]
    rows += [rows[3], (None, "u", "<p>a</p>", "e", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, type string, serial int").repartition(3)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    df = pages(spark)
    path = W.write_archive(df, shared_dir(spark), captures_per_file=2)
    records = W.read_records(spark, path)
    assert records.count() == 3 * df.count()
    captures = W.assemble(records).collect()
    assert len(captures) == df.count()
    ids = {c.capture: c for c in captures}
    got = []
    for c in captures:
        assert len(c.requests) == len(c.metadata) == 1 and c.response is not None
        page = c.metadata[0].fields["page_id"]
        page = int(page) if page else None
        target = ids[c.response.refers_to].metadata[0].fields["page_id"] if c.response.refers_to else None
        got.append((page, c.response.payload_bytes, c.response.payload_digest, c.response.type, target and int(target)))
        if c.response.type == "response":
            assert hashlib.sha1(c.response.payload).digest() == base64.b32decode(c.response.payload_digest)
    first = {}
    for i, h in enumerate(HTML):
        first.setdefault(h or "", i)
    want = [(i, len((h or "").encode()), digest(h), *(("response", None) if first[h or ""] == i else ("revisit", first[h or ""])))
            for i, h in enumerate(HTML)]
    want += [(3, len(HTML[3].encode()), digest(HTML[3]), "revisit", 3), (None, 8, digest("<p>a</p>"), "response", None),
             (None, 0, digest(""), "response", None)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_small_payloads_need_no_revisit(spark):
    got = W.round_trip(pages(spark, ["ab", "ab", "abcdef", "abcdef"]).where("page_id is not null"), min_bytes=4).collect()
    kinds = sorted((c.response.payload_bytes, c.response.type) for c in got)
    assert kinds.count((2, "response")) == 2 and kinds.count((6, "response")) == 1 and (6, "revisit") in kinds


def test_records_without_partner_and_empty_table(spark):
    rows = [("r1", "response", []), ("q1", "request", ["r1", "r2"]), ("m9", "metadata", ["r9"]), ("w", "warcinfo", [])]
    df = spark.createDataFrame([(i, t, None, None, c, None, None, 0, None, None, None, None, None) for i, t, c in rows], W.RECORD)
    got = {c.capture: (c.response is not None, len(c.requests), len(c.metadata)) for c in W.assemble(df).collect()}
    assert got == {"r1": (True, 1, 0), "r2": (False, 1, 0), "r9": (False, 0, 1), "w": (False, 0, 0)}
    assert W.round_trip(pages(spark).where("false")).count() == 0
