import base64
import hashlib
from collections import Counter

from plantloom.llm.warc import op8_warc_revisits, read_archives, resolved, write_archives
from plantloom.session import scratch_path


def plain(rows, least=0):
    first = {}
    for i, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, html in rows:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        f = first.get(html or "")
        again = len(raw) >= least and f is not None and f != i
        out.append((i, len(raw), digest, "revisit" if again else "response", f if again else None))
    return Counter(out)


def test_pages(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert Counter(map(tuple, op8_warc_revisits(spark, sf).collect())) == plain(rows)


def test_odd_pages(spark):
    rows = [(5, "u", "same"), (3, None, "same"), (3, None, "same"), (9, "a\r\nb: c", "same"),
            (1, "u", None), (2, "u", ""), (4, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (6, "u", "é" * 200_000),
            (None, "u", "same"), (None, "u", "alone")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    for least in (0, 5):
        path = scratch_path(spark, "warc-test")
        write_archives(df, path, min_bytes=least, records_per_file=3)
        found = read_archives(spark, path)
        got = [(int(r.id) if r.id else None, r.payload_bytes, r.payload_digest, r.record_type,
                int(r.refers_to) if r.refers_to else None) for r in resolved(found).collect()]
        assert Counter(got) == plain([(i, h) for i, _, h in rows], least)
        pages = {(r.id, r.page) for r in found.collect() if r.record_type == "response"}
        assert ("4", rows[6][2]) in pages and ("6", rows[7][2]) in pages
    path = scratch_path(spark, "warc-test")
    write_archives(df.limit(0), path)
    assert read_archives(spark, path).count() == 0
