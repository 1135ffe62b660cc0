"""Links of pages: linear in the html's length, and the same as one pattern over the whole page."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from tabassay.llm import url_filter as U

LINK = re.compile(r"<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", re.I | re.A)
REFRESH = re.compile(r"<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", re.I | re.A)
HREF = re.compile(r"\bhref\s*=\s*[\"']?([^\"'\s>]+)", re.I | re.A)
TO = re.compile(r"\bcontent\s*=\s*[\"']?[^\"'>;]*;\s*url\s*=\s*[\"']?([^\"'\s>]+)", re.I | re.A)


def plain(html):
    out = []
    for tag, place in ((LINK, HREF), (REFRESH, TO)):
        found = tag.search(html or "")
        inner = found and place.search(found.group(0))
        out.append(inner.group(1) if inner else "")
    return tuple(out)


def found(df):
    html = F.col("html")
    at = F.coalesce(F.regexp_extract(U._tag(html, "link", U._CANONICAL), U._HREF, 1), F.lit("")), F.coalesce(U._refresh_url(U._tag(html, "meta", U._REFRESH)), F.lit(""))
    return {r[0]: (r[1], r[2]) for r in df.select("i", *at).collect()}


def test_same_as_one_pattern(spark):
    rng = random.Random(1)
    bits = ["<link", "<LINK ", "<meta ", "<linked ", " rel=canonical ", ' rel = "canonical" ', " relx=canonical", ' href="a/b" ', " href=c>", ">", " http-equiv=refresh ", ' content="5; url=x/y" ', " content=", "5;", " url=z", ";url='q'", '"', "'", " ", "\n", "text"]
    pages = [(i, "".join(rng.choices(bits, k=rng.randrange(14)))) for i in range(4000)] + [(9000, None), (9001, "")]
    pages += [(i + 10_000, rng.choice(["<meta ", "<link "]) + "".join(rng.choices(bits[4:9] + bits[10:16], k=rng.randrange(9))) + ">") for i in range(4000)]
    got = found(spark.createDataFrame(pages, "i int, html string"))
    assert all(got[i] == plain(h) for i, h in pages) and sum(g != ("", "") for g in got.values()) > 500


def test_long_pages_take_linear_time(spark):
    long = ["<link " * 350_000, "<meta http-equiv=refresh " + "content= " * 230_000 + '">', "<link " * 300_000 + "rel=canonical href=x>", "<meta " * 300_000 + ">"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(long)], "i int, html string").repartition(4).cache()
    df.count()
    found(df.limit(1))
    began = time.time()
    assert found(df)[2] == ("x", "") and time.time() - began < 20
