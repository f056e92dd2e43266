"""Revisit resolution against a brute-force version, on random records with ties, nulls and one hot URL."""

import random

import duckdb
import pytest

from sparkloom.llm import revisits

SCHEMA = "record_id long, url string, ts long, kind string, headers map<string,string>, canonical string, revisit string, span string"


def canonical(spark, *urls):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    return [r.c for r in df.select(revisits.canonical_url(df.url).alias("c")).collect()]


def test_canonical_url(spark):
    got = canonical(spark, "HTTP://WWW.Example.com:80/a/b/?b=2&utm_source=x&a=1#f", "https://example.com/a/b?a=1&b=2", "example.com", "http://example.com/?ref=z", "http://h.org/A?q", None, "")
    assert got == ["example.com/a/b?a=1&b=2", "example.com/a/b?a=1&b=2", "example.com", "example.com?ref=z", "h.org/A?q", None, None]


def records(n=600):
    rnd = random.Random(3)
    out = []
    for k in range(n):
        url = rnd.choice(["http://hot.org/x", "https://www.hot.org/x/", f"http://h{rnd.randint(0, 9)}.org/{rnd.randint(0, 4)}", None if k % 50 == 0 else "http://solo.org"])
        tag = rnd.choice(["a", "b", None])
        headers = {"Date": str(k), "X-Own": "1", "Cache-Control": f"max-age={k}"} | ({"ETag": rnd.choice(["", "W/"]) + tag} if tag else {}) | ({"Last-Modified": rnd.choice("pq")} if rnd.random() < 0.6 else {})
        out.append((k, url, rnd.randint(0, 400) if k % 70 else None, rnd.choice(["response", "revisit"]), headers if k % 31 else None, "c", "r", "s"))
    return out


def brute(rows, canon):
    out = []
    for rid, url, ts, kind, headers, *_ in rows:
        if kind != "revisit":
            continue
        low = {k.lower(): v for k, v in (headers or {}).items()}
        best = None
        for oid, ourl, ots, okind, oh, *_ in rows:
            if okind == "response" and None not in (url, ourl, ts, ots) and canon[url] == canon[ourl] and ots < ts and (best is None or (ots, oid) > best[:2]):
                best = (ots, oid, {k.lower(): v for k, v in (oh or {}).items()})
        status, merged = "missing", None
        if best:
            status = "unvalidated"
            for key in ("etag", "last-modified"):
                mine, theirs = low.get(key), best[2].get(key)
                if mine is not None and theirs is not None:
                    same = mine.removeprefix("W/") == theirs.removeprefix("W/") if key == "etag" else mine == theirs
                    status = "resolved" if same else "mismatch"
                    break
            if status == "resolved":
                merged = best[2] | {k: v for k, v in low.items() if k in revisits.PERMITTED}
        out.append((rid, best and best[1], best and best[0], status, merged))
    return sorted(out, key=repr)


@pytest.mark.parametrize("span", [1, 7, 10_000])
def test_resolution(spark, span):
    rows = records()
    urls = sorted({r[1] for r in rows if r[1]})
    canon = dict(zip(urls, canonical(spark, *urls), strict=True))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [(r.record_id, r.source_id, r.source_ts, r.status, r.merged) for r in revisits.resolve(df, span).collect()]
    assert sorted(got, key=repr) == brute(rows, canon)
    assert {r[3] for r in got} == {"resolved", "mismatch", "unvalidated", "missing"}


def test_empty_and_repeated(spark):
    assert revisits.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
    one = (1, "http://a.org", 5, "response", {"ETag": "t", "etag": "u"}, None, None, None)
    two = (2, "http://a.org/", 9, "revisit", {"etag": "W/u"}, None, None, None)
    out = revisits.resolve(spark.createDataFrame([one, two, two], SCHEMA)).collect()
    assert [(r.source_id, r.status, r.merged) for r in out] == [(1, "resolved", {"etag": "W/u"})] * 2


def test_empty_addresses_match_nothing(spark):
    rows = [(1, "", 1, "response", {"etag": "t"}), (2, "http://", 2, "revisit", {"etag": "t"}), (3, "https://www./#x", 3, "revisit", {"etag": "t"})]
    out = revisits.resolve(spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>")).collect()
    assert sorted((r.record_id, r.status, r.source_id) for r in out) == [(2, "missing", None), (3, "missing", None)]


def test_payload(spark):
    df = spark.createDataFrame([(1, "a.org", 1, "response", {"etag": "t"}, b"body"), (2, "a.org", 2, "revisit", {"etag": "t"}, None), (3, "b.org", 2, "revisit", {}, None)], "record_id long, url string, ts long, kind string, headers map<string,string>, payload binary")
    out = {r.record_id: r.payload for r in revisits.with_payload(revisits.resolve(df), df).collect()}
    assert out == {2: b"body", 3: None}


def test_query(spark, sf, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = [tuple(r) for r in revisits.op4_revisits(spark, sf).collect()]
    want = con.execute(revisits.ORACLE_SQL["op4_revisits"]).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    spark.createDataFrame([(1, None, None, 5), (2, "http://a.org", "x", 6)], "page_id long, url string, html string, ts long").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.status for r in revisits.op4_revisits(spark, str(tmp_path)).collect()) == ["missing", "resolved"]
