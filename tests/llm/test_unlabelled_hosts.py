"""Hosts without labelled pages, and registered domains under suffixes of two labels."""

from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from lodestone.llm import hosts
from lodestone.llm.queries import ORACLES, QUERIES


def test_unlabelled_hosts_take_the_nearest_prior(spark):
    labelled = [(f"h{k}.bad.com", 1) for k in range(40) for _ in range(20)] + [(f"h{k}.good.com", 0) for k in range(40) for _ in range(20)]
    labelled += [("shop.evil.co.uk", 1)] * 400 + [("shop.fine.co.uk", 0)] * 400
    urls = [(k, f"http://{h}/") for k, (h, _) in enumerate(labelled)]
    outcomes = spark.createDataFrame([(k, b) for k, (_, b) in enumerate(labelled)], "page_id long, bad int")
    new = ["new.bad.com", "new.good.com", "new.other.com", "new.evil.co.uk", "new.fine.co.uk", "nowhere.xyz"]
    pages = spark.createDataFrame(urls + [(10_000 + k, f"http://{h}/") for k, h in enumerate(new)], "page_id long, url string")
    got = hosts.judge_urls(pages, outcomes, []).collect()
    assert len(got) == len(urls) + len(new)
    verdicts = {r.host: (r.verdict, r.host_pages, r.host_bad) for r in got}
    assert {h: verdicts[h] for h in new} == {
        "new.bad.com": ("block", 0, 0), "new.good.com": ("allow", 0, 0), "new.other.com": ("allow", 0, 0),
        "new.evil.co.uk": ("block", 0, 0), "new.fine.co.uk": ("allow", 0, 0), "nowhere.xyz": ("allow", 0, 0),
    }


def test_registered_domains(spark):
    given = ["a.b.example.co.uk", "example.com.au", "co.uk", "a.example.com", "com", ""]
    frame = spark.createDataFrame([(h,) for h in given], "host string")
    got = {r.host: (r.domain, r.suffix) for r in frame.select("host", hosts.domain_of(F.col("host")).alias("domain"), hosts.suffix_of(F.col("host")).alias("suffix")).collect()}
    assert got == {
        "a.b.example.co.uk": ("example.co.uk", "co.uk"), "example.com.au": ("example.com.au", "com.au"), "co.uk": ("co.uk", "co.uk"),
        "a.example.com": ("example.com", "com"), "com": ("com", "com"), "": ("", ""),
    }


def test_sql_judges_unlabelled_hosts_alike(spark, tmp_path):
    labelled = [(f"h{k}.bad.com", 1) for k in range(40) for _ in range(20)] + [(f"h{k}.good.com", 0) for k in range(40) for _ in range(20)]
    labelled += [("shop.evil.co.uk", 1)] * 400 + [("shop.fine.co.uk", 0)] * 400
    new = ["new.bad.com", "new.good.com", "new.other.com", "new.evil.co.uk", "new.fine.co.uk", "nowhere.xyz", "co.uk", ""]
    urls = [(k, f"http://{h}/") for k, (h, _) in enumerate(labelled)] + [(10_000 + k, f"http://{h}/") for k, h in enumerate(new)]
    urls += [(20_000, None), (20_001, "no scheme")]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    outcomes = [(k, None if b else 1, b) for k, (_, b) in enumerate(labelled)]
    spark.createDataFrame(outcomes, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op6_host_reputation"](spark, str(tmp_path))
    with duckdb.connect() as connection:
        for name in ("pages", "labels"):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        columns = sorted(got.columns)
        want = connection.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES['op6_host_reputation']})").fetchall()
    rows = got.select(*columns).collect()
    assert Counter(map(tuple, rows)) == Counter(want)
    assert {r.host for r in rows if r.verdict == "block" and not r.host_pages} == {"new.bad.com", "new.evil.co.uk"}
