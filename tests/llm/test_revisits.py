from pyspark.sql import functions as F

from demandlake.llm import revisits

SCHEMA = "record_id long, url string, time long, kind string, status int, headers map<string,string>, payload string, resolution string, note string"


def resolved(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "clash", f"n{r[0]}") for r in rows], SCHEMA)
    out = revisits.resolve(docs, **kw)
    assert out.columns == ["record_id", "url", "canonical_url", "time", "kind", "resolution", "ref_id", "status", "headers", "payload", "note"]
    return {r.record_id: r for r in out.collect()}


def test_canonical_urls(spark):
    rows = [("http://WWW.Example.org:80/a/b/?utm_source=x&z=1&b=2#top", "example.org/a/b?b=2&z=1"), ("https://example.org", "example.org"),
            ("example.org/", "example.org"), ("  ", None), (None, None), ("https://m.Example.org/P?page=2&ref=x", "m.example.org/P?page=2&ref=x")]
    d = spark.createDataFrame(rows, "u string, want string")
    for r in d.select("want", revisits.canonical_url(F.col("u")).alias("got")).collect():
        assert r.got == r.want


def test_cases(spark):
    h = {"ETag": '"a"', "Last-Modified": "d1", "Content-Type": "text/html", "Date": "1"}
    url, other = "http://x.org/p", "https://www.x.org/p/#f"
    rows = [
        (1, url, 100, "response", 200, h, "one"),
        (2, other, 200, "revisit", 304, {"etag": 'W/"a"', "Date": "2", "Content-Type": "nope", "X-Own": "no"}, None),
        (3, url, 10 ** 6, "response", 200, {"ETag": '"b"'}, "two"),
        (4, url, 10 ** 6, "revisit", 304, {"ETag": '"b"'}, None),               # same time: not earlier; refers to 1
        (5, url, 2 * 10 ** 6, "revisit", 304, {"ETag": '"b"'}, None),
        (6, url, 3 * 10 ** 6, "revisit", 304, {"Last-Modified": "d9"}, None),
        (7, url, 3 * 10 ** 6, "revisit", 304, None, None),
        (8, "http://y.org/", 50, "revisit", 304, {"ETag": '"a"'}, None),
        (9, None, 60, "revisit", 304, {}, None), (10, url, None, "revisit", 304, {}, None), (11, url, 70, None, None, None, None),
        (12, "http://z.org", 5, "response", 203, None, ""), (13, "http://z.org/", 6, "revisit", 304, {"Expires": "e"}, None),
        (14, url, 150, "revisit", 304, {"Last-Modified": "d1"}, None), (15, url, None, "response", 200, h, "lost"),
        (16, "http://t.org", 5, "response", 200, {"ETag": "1"}, "x"), (17, "http://t.org", 5, "response", 201, {"ETag": "2"}, "y"),
        (18, "http://t.org", 6, "revisit", 304, {"ETag": "2"}, None),
    ]
    for width in (3600, 10, 10 ** 9):
        r = resolved(spark, rows, block_seconds=width)
        assert {i: x.resolution for i, x in r.items()} == {
            1: "response", 2: "resolved", 3: "response", 4: "validator_mismatch", 5: "resolved", 6: "validator_mismatch",
            7: "no_validators", 8: "no_earlier_response", 9: "no_url", 10: "no_time", 11: "other", 12: "response", 13: "resolved",
            14: "resolved", 15: "response", 16: "response", 17: "response", 18: "resolved"}
        assert {i: x.ref_id for i, x in r.items() if x.ref_id} == {2: 1, 5: 3, 13: 12, 14: 1, 18: 17}
        assert (r[2].payload, r[2].status) == ("one", 200)
        assert r[2].headers == {"etag": 'W/"a"', "last-modified": "d1", "content-type": "text/html", "date": "2"}
        assert (r[13].payload, r[13].status, r[13].headers) == ("", 203, {"expires": "e"})
        assert r[7].headers == {} and r[4].payload is None and r[18].status == 201 and r[5].note == "n5"


def test_one_url_with_most_records_and_empty_table(spark):
    rows = [(i, "http://hot.org/", i * 40, "response" if i % 7 == 0 else "revisit", 200 if i % 7 == 0 else 304,
             {"ETag": str(i // 7)}, f"p{i}" if i % 7 == 0 else None) for i in range(1400)]
    r = resolved(spark, rows)
    for i in range(1400):
        if i % 7:
            assert r[i].ref_id == i - i % 7 and r[i].payload == f"p{i - i % 7}"
    docs = spark.createDataFrame([], SCHEMA)
    assert revisits.resolve(docs).count() == 0


def test_repeated_header_names(spark):
    d = spark.createDataFrame([({"ETag": "1", "etag": "2", "A": None},), (None,)], "h map<string,string>")
    got = [r.h for r in d.select(revisits.plain_headers(F.col("h")).alias("h")).collect()]
    assert got[0] == {"etag": "2", "a": None} and got[1] == {}


def test_repeated_and_null_ids_and_long_payloads(spark):
    long = "x" * 3_000_000
    rows = [(1, "http://a.org", 10, "response", 200, {"ETag": "1"}, long, "n")] * 2 + [
        (2, "http://a.org", 20, "revisit", 304, {"ETag": "1"}, None, "n"), (None, "http://a.org", 15, "response", 200, {"ETag": "1"}, "own", "n"),
        (None, "http://a.org", 16, "response", 200, {"ETag": "1"}, "other", "n"), (3, "http://b.org", 5, "response", 200, {}, "one", "n"),
        (3, "http://b.org", 5, "response", 200, {}, "two", "n"), (4, "http://b.org", 6, "revisit", 304, {}, None, "n")]
    docs = spark.createDataFrame([(*r[:-1], "clash", r[-1]) for r in rows], SCHEMA)
    out = revisits.resolve(docs).collect()
    assert len(out) == len(rows)
    assert sorted((r.record_id or 0, r.resolution, r.ref_id or 0, len(r.payload), r.payload[:3]) for r in out) == [
        (0, "response", 0, 3, "own"), (0, "response", 0, 5, "oth"), (1, "response", 0, len(long), "xxx"), (1, "response", 0, len(long), "xxx"),
        (2, "resolved", 1, len(long), "xxx"), (3, "response", 0, 3, "two"), (3, "response", 0, 3, "two"), (4, "resolved", 3, 3, "two")]
