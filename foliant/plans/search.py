"""Registered queries of the substring index, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import search
from foliant.plans.catalogue import query, table, tables


@query("""WITH n AS (SELECT DISTINCT substr(p_name, 2, 5) AS needle FROM part UNION SELECT DISTINCT substr(p_brand, 7, 1) FROM part UNION SELECT DISTINCT substr(p_type, 2, 2) FROM part)
    SELECT needle, p_partkey FROM n JOIN part ON contains(p_name, needle) OR contains(p_brand, needle) OR contains(p_type, needle) WHERE needle <> ''""")
def search_parts(spark, d):
    """Rows of which one of three columns contains a search text, for every search text of a table."""
    part = table(spark, d, "part")
    columns = [F.col(c) for c in ("p_name", "p_brand", "p_type")]
    needles = part.select(F.explode(F.array(F.substring("p_name", 2, 5), F.substring("p_brand", 7, 1), F.substring("p_type", 2, 2))).alias("needle")).distinct()
    index = search.TrigramIndex.over(part, "p_partkey", *columns)
    return search.containing(needles, index, part, "p_partkey", *columns).withColumnRenamed("key", "p_partkey")


@query("""WITH n AS (SELECT DISTINCT lower(upper(substr(text, 21, 12))) AS needle FROM benchmark)
    SELECT needle, doc_id FROM n JOIN documents ON contains(lower(text), needle) WHERE needle <> ''""")
def search_documents(spark, d):
    """Documents that contain a search text in whichever case."""
    benchmark, documents = tables(spark, d, "benchmark", "documents")
    needles, body = benchmark.select(F.lower(F.upper(F.substring("text", 21, 12))).alias("needle")), F.lower("text")
    return search.containing(needles, search.TrigramIndex.over(documents, "doc_id", body), documents, "doc_id", body).withColumnRenamed("key", "doc_id")


@query(r"""WITH stored AS (SELECT page_id AS id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang="(\w+)"', 1) AS author,
                                  substr(html, 1, 400) AS description, page_id % 97 AS updated_at FROM pages),
         new AS (SELECT id AS page_id, url, CASE WHEN id % 2 = 0 THEN title ELSE substr(title, 1, 2 + id % 5) END AS title FROM stored),
         held AS (SELECT n.title, s.id, s.url, s.title AS full_title, row_number() OVER (PARTITION BY n.title ORDER BY updated_at DESC, id DESC) AS r
                  FROM (SELECT DISTINCT title FROM new WHERE title <> '') n
                  JOIN stored s ON contains(s.title, n.title) OR contains(s.author, n.title) OR contains(s.description, n.title))
    SELECT page_id, (SELECT min_by(h.id, h.r) FROM held h WHERE h.title = new.title AND h.r <= 100 AND (h.url = new.url OR h.full_title = new.title)) AS match FROM new""")
def match_contained_parents(spark, d):
    """New rows against the hundred latest rows that contain their title: the address counts only there."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    stored = table(spark, d, "pages").select(
        F.col("page_id").alias("id"), "url", title.alias("title"), F.regexp_extract("html", r'lang="(\w+)"', 1).alias("author"), F.substring("html", 1, 400).alias("description"),
        (F.col("page_id") % 97).alias("updated_at"),
    )
    cut = F.when(F.col("id") % 2 == 0, F.col("title")).otherwise(F.expr("substring(title, 1, 2 + int(id % 5))"))
    return search.match_contained(stored.select(F.col("id").alias("page_id"), "url", cut.alias("title")), stored).select("page_id", "match")
