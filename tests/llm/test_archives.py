import base64
import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from barweave.llm.warc import LoserTree, merge_runs, read_archives, url_key, write_archives


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), max_size=8), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert url_key("https://www.Example.com:443/A?b=1#x") == "com,example)/a?b=1"
    assert url_key("http://user@example.com:8080") == "com,example:8080)/"
    assert url_key(None) == url_key("") == ""
    assert url_key("http://[bad") == "http://[bad"


def pages(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 5}.example.com/p{i % 3}", rng.choice(["<p>same</p>", "<p>é</p>", f"<p>{i}</p>"])) for i in range(80)]
    rows += [(200, None, None), (201, "", ""), (None, "http://x.example.com", "<p>same</p>"), (None, None, "alone"), (7, "http://a.example.com", "<p>twice</p>"), (7, "http://a.example.com", "<p>twice</p>"), (300, "u\r\nv", "z" * 300000)]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, position string, file string").repartition(6)


def test_archives_round_trip(spark, scratch):
    rows, df = pages(spark)
    got = read_archives(merge_runs(write_archives(df, scratch, archive_bytes=4000), scratch)).collect()
    assert len(got) == len(rows)
    first = {}
    for k, _, h in rows:
        if k is not None:
            first[h or ""] = min(k, first.get(h or "", k))
    want = []
    for k, u, h in rows:
        body = (h or "").encode()
        f = first.get(h or "")
        kind = "response" if f is None or k == f else "revisit"
        want.append((str(k), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, str(f if kind == "revisit" else None), body if kind == "response" else None))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"]), bytes(r["payload"]) if r["payload"] is not None else None) for r in got) == sorted(want)
    order = [r for r in sorted(got, key=lambda r: r["position"])]
    assert [r["position"] for r in order] == list(range(len(rows)))
    keys = [(url_key(r["url"]), r["page_id"] or 0, str(r["page_id"])) for r in order]
    assert keys == sorted(keys)


def test_small_payloads_are_never_referred_to(spark, scratch):
    df = spark.createDataFrame([(1, "a", "xx"), (2, "a", "xx"), (3, "a", "long enough"), (4, "a", "long enough")], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in read_archives(merge_runs(write_archives(df, scratch, min_bytes=5), scratch)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_no_pages(spark, scratch):
    _, df = pages(spark)
    assert read_archives(merge_runs(write_archives(df.limit(0), scratch), scratch)).count() == 0
