"""Registered queries of fetched pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.plans.catalogue import query, table
from foliant.sources import fetch


@query("""WITH p AS (SELECT page_id AS id, page_id % 9 AS hops, html FROM pages),
    ends AS (SELECT *, CASE WHEN id % 13 = 0 THEN 'http://127.0.0.1/x' ELSE 'http://site' || id % 5 || '.example/' || id || '/0' END AS url,
             CASE WHEN id % 13 = 0 THEN 'address not allowed'
                  WHEN id % 11 = 0 AND hops BETWEEN 1 AND 5 THEN 'redirect not allowed'
                  WHEN id % 7 = 0 AND hops BETWEEN 1 AND 5 THEN 'redirect loop'
                  WHEN hops > 5 THEN 'HTTP 302' WHEN id % 10 = 3 THEN 'HTTP 404' WHEN id % 10 = 4 THEN 'content type image/png' WHEN id % 10 = 6 THEN 'no response' END AS error FROM p)
    SELECT DISTINCT url, CASE WHEN error IS NULL THEN sha256(html) END AS sha, error,
           CAST(CASE WHEN id % 13 = 0 THEN 0 WHEN error = 'HTTP 302' THEN 5 ELSE hops END AS BIGINT) AS n_redirects FROM ends""")
def fetched_pages(spark, d):
    """Addresses over chains of stored responses: up to eight redirects, loops, private hosts, missing pages, images."""
    i, hop = F.col("page_id"), F.col("hop")
    at = lambda n: F.concat(F.lit("http://site"), (i % 5).cast("string"), F.lit(".example/"), i.cast("string"), F.lit("/"), n.cast("string"))
    pages = table(spark, d, "pages").select("page_id", "html", F.expr("int(page_id % 9)").alias("hops"))
    rows = pages.select("*", F.explode(F.sequence(F.lit(0), "hops")).alias("hop"))
    last_hop = hop == F.col("hops") - 1
    location = F.when(last_hop & (i % 11 == 0), "http://10.0.0.8/admin").when(last_hop & (i % 7 == 0), F.concat(F.lit("/"), i.cast("string"), F.lit("/0"))).otherwise(F.concat(F.lit("../"), i.cast("string"), F.lit("/"), (hop + 1).cast("string")))
    moved = hop < F.col("hops")
    responses = rows.where(moved | (i % 10 != 6)).select(
        at(hop).alias("url"), F.when(moved, 302).when(i % 10 == 3, 404).otherwise(200).alias("status"), F.when(moved, location).alias("location"),
        F.when(i % 10 == 4, "image/png").when(i % 10 == 5, F.lit(None)).otherwise("text/html; charset=utf-8").alias("content_type"), F.concat(F.lit("﻿"), F.col("html")).alias("body"),
    )
    asked = pages.select(F.when(i % 13 == 0, "http://127.0.0.1/x").otherwise(at(F.lit(0))).alias("url"))
    got = fetch.fetch_pages(asked, fetch.stored(responses))
    return got.select("url", F.when(F.col("error").isNull(), F.sha2(F.col("html").cast("binary"), 256)).alias("sha"), "error", F.col("n_redirects").cast("long").alias("n_redirects"))
