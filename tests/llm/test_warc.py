import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from facetry.llm.warc import key_ranges, op8_warc, read_archives, write_archives
from tests.llm import fixtures

PAGES = "page_id long, url string, html string"


def expected(rows):
    top = {}
    for i, _, html in rows:
        k = -(2**63) if i is None else i
        top[html or ""] = max(top.get(html or "", k), k)
    out, used = [], set()
    for i, _, html in rows:
        data = (html or "").encode()
        k, t = -(2**63) if i is None else i, top[html or ""]
        first = k == t and html not in used
        used |= {html} if first else set()
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first or t == -(2**63) else t))
    return sorted(out, key=str)


ROWS = [(5, "http://a/x y", "<p>é</p>"), (7, None, "<p>é</p>"), (7, None, "<p>é</p>"), (1, "u", None), (2, "u", ""), (None, "u", "lost"), (None, "u\n", "lost"), (3, "u", "\r\n\r\nWARC/1.1\r\n"), (4, "u", "z" * 300_000), (2**62, "u", "far"), (-(2**62), "u", "far")]


def test_query_round_trip(spark, tmp_path):
    folder = fixtures.write(spark, tmp_path, pages=spark.createDataFrame(ROWS, PAGES).withColumn("payload", F.lit(1)))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in op8_warc(spark, folder).collect()]
    assert sorted(got, key=str) == expected(ROWS)
    assert op8_warc(spark, fixtures.write(spark, tmp_path / "e", pages=spark.createDataFrame([], PAGES))).count() == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_files_roll_and_are_the_same_for_any_partitioning(spark, tmp_path, parts):
    rows = [(i, f"http://h/{i}", hashlib.sha256(str(i % 90).encode()).hexdigest() * 20) for i in range(120)]
    df = spark.createDataFrame(rows, PAGES)
    names = []
    for at, frame in (("a", df), ("b", df.orderBy(F.rand(3)).repartition(parts))):
        m = write_archives(frame, str(tmp_path / at), roll_bytes=1500, shard_bytes=40_000)
        names.append(sorted((r["name"], r["sha256"], r["records"]) for r in m.collect()))
        back = read_archives(spark, str(tmp_path / at), m)
        assert sorted((r["page_id"], bytes(r["payload"]).decode() if r["record_type"] == "response" else None) for r in back.collect()) == sorted((i, h if i >= 30 else None) for i, _, h in rows)
    assert names[0] == names[1] and len({n for n, *_ in names[0]}) > 5
    assert len({n[5:10] for n, *_ in names[0]}) > 1


def test_heavy_keys_are_split(spark):
    df = spark.createDataFrame([(i if i % 3 else 77, 10) for i in range(3000)] + [(2**63 - 1, 1), (-(2**63), 1)], "key long, size long")
    cuts = key_ranges(df, "key", "size", 1000)
    assert dict(cuts)[77] == 11 and len(cuts) >= 20 and cuts == sorted(cuts)
