import hashlib
import random

from pyspark.sql import functions as F

from epochal.llm.warc import archived, captures, history, merge_runs


def test_merge_runs():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.choices(range(50), k=rng.randrange(20))) for _ in range(k)]
        assert list(merge_runs(runs)) == sorted(x for r in runs for x in r)


def test_round_trip(spark):
    bodies = [None, "", "é" * 400, "a" * 1000, "a" * 1000, "b\r\n\r\nWARC/1.1\r\n" * 90, "x\r\n", "x\r\n\r\n", "\r\n\r\n", "c" * 999, "c" * 999, "b\r\n\r\nWARC/1.1\r\n" * 90, "a" * 1000]
    rows = [(i, None if i == 3 else f"http://h{i % 3}.example.com/p{i}", b, 1) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, run int")
    got = history(captures(spark, archived(df))).collect()
    assert [(r.url_key, r.captured, r.page_id) for r in got] == sorted((r.url_key, r.captured, r.page_id) for r in got)
    want = []
    for i, b in enumerate(bodies):
        p = (b or "").encode()
        last = max(k for k, x in enumerate(bodies) if (x or "").encode() == p)
        again = len(p) >= 1000 and last != i
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", last if again else None))
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert history(captures(spark, archived(df))).count() == 0


def test_last_payload_ends_in_line_ends(spark):
    for tail in ("\r\n", "\r\n\r\n", "\r\n\r\n\r\n", "\r", "\n", ""):
        df = spark.createDataFrame([(1, "http://h/a", "<p>x</p></html>" + tail)], "page_id long, url string, html string")
        assert [(r.page_id, r.payload_bytes) for r in captures(spark, archived(df)).collect()] == [(1, 15 + len(tail))], repr(tail)


def test_null_page_ids(spark):
    rows = [(None, "http://h/a", "a" * 1000), (0, "http://h/a", "a" * 1000), (None, "http://h/a", "a" * 1000), (None, None, None)]
    df = spark.createDataFrame(rows * 2, "page_id long, url string, html string").repartition(3)
    got = history(captures(spark, archived(df))).collect()
    assert [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got] == [(None, "response", None, 0)] * 2 + [(None, "response", None, 1000)] * 4 + [(0, "response", None, 1000)] * 2


def test_records_are_found_by_their_places(spark):
    import gzip
    from urllib.parse import urlparse

    rows = [(i, f"http://h/{i % 4}", f"body {i}\r\n\r\n" * (i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    bodies = {i: b for i, _, b in rows}
    for r in captures(spark, archived(df, 7)).collect():
        record = gzip.open(urlparse(r.run).path).read()[r.at : r.at + r.record_bytes]
        assert record.startswith(b"WARC/1.1\r\n") and record.split(b"\r\n\r\n", 1)[1] == bodies[r.page_id].encode()


def test_many_copies_of_one_payload(spark):
    df = spark.createDataFrame([(i, "http://h/a", "a" * 2000) for i in range(300)], "page_id long, url string, html string")
    got = history(captures(spark, archived(df))).collect()
    assert sum(r.record_type == "response" for r in got) == 1 and {r.refers_to for r in got} == {None, 299}


def test_payloads_with_many_separators_take_time_in_proportion():
    import hashlib
    import time

    from epochal.llm.warc import END, parsed

    took = []
    for n in (4000, 16000):
        body = ("x" + END) * n + "\r\n"
        head = "\r\n".join(["WARC/1.1", "WARC-Type: response", "WARC-Record-ID: <urn:page:7>", "WARC-Date: d", "WARC-Target-URI: http://a.b/c", f"WARC-Payload-Digest: sha1:{hashlib.sha1(body.encode()).hexdigest()}", f"Payload-Length: {len(body)}", f"Content-Length: {len(body)}"])
        archive = (head + END + body + END) * 3
        began = time.process_time()
        rows = list(parsed([p.encode() for p in archive.split(END)], "run"))
        took.append(time.process_time() - began)
        assert [(r[2], r[3], r[8], r[9]) for r in rows] == [(7, len(body), k * (len(head) + len(body) + 8), len(head) + len(body) + 4) for k in range(3)]
    assert took[1] < 8 * took[0] + 0.1


def test_ranges_are_bounded_where_all_keys_are_equal(spark):
    df = spark.createDataFrame([(None, "http://h/a", f"body {i}") for i in range(4000)], "page_id long, url string, html string").repartition(4)
    got = history(captures(spark, archived(df, 300)), 250)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and sum(sizes) == 4000 and max(sizes) <= 750


def test_many_ranges_are_in_global_order(spark):
    df = spark.createDataFrame([(i * 7919 % 3000, f"http://h{i % 13}.org/{i % 5}", "x") for i in range(3000)], "page_id long, url string, html string").repartition(5)
    got = [(r.url_key, r.captured, r.page_id) for r in history(captures(spark, archived(df, 100)), 170).collect()]
    assert got == sorted(got) and sorted(g[2] for g in got) == list(range(3000))


def test_runs_whose_blocks_come_out_of_order(spark):
    df = spark.createDataFrame([(i, f"http://h{i % 7}.org/", "x") for i in range(900)], "page_id long, url string, html string").repartition(2)
    index = captures(spark, archived(df, 300))
    torn = index.orderBy(F.xxhash64("page_id"))
    got = [(r.url_key, r.captured, r.page_id) for r in history(torn, 200).collect()]
    assert got == sorted(got) and len(got) == 900
