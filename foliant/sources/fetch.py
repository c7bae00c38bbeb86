"""Fetching addresses of a table: redirects, retries and what counts as a page, over stored responses or a fetch function.

All addresses advance together, a request a round: a round asks for what each chain has come to, over a join with a table
of responses, or by a function on the executors, where the addresses of a host are one task's, one after the other.
Redirects are then followed by Columns: at most five, none to an address that isn't safe or was asked before.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.rules import RETRY_CODES
from foliant.functions.urls import host_of, is_safe_url, resolve_url
from foliant.runtime import checkpointed

MOST_REDIRECTS = 5
MOST_CHARS = 10 * 1024 * 1024
RESPONSE = "current string, status int, location string, content_type string, body string, failure string"

#: (status, headers with lower-case names, body) of an address.
Fetch = Callable[[str], tuple[int, dict[str, str], str]]
#: Takes the distinct addresses of a round (current), gives them with the columns of RESPONSE.
Ask = Callable[[DataFrame], DataFrame]


class Stored:
    """Answers of a table (url, status, location, content_type, body), of several of one address the one of least status; an
    address it lacks fails. Rounds only ask where an address leads: the bodies, and what they are, are read once, of the addresses
    that chains end at."""

    def __init__(self, responses: DataFrame) -> None:
        self.responses = responses

    def __call__(self, current: DataFrame) -> DataFrame:
        known = self.responses.groupBy("url").agg(F.min(F.struct("status", "location")).alias("r"))
        got = current.join(known, current["current"] == known["url"], "left")
        nothing = F.lit(None).cast("string")
        return got.select("current", F.col("r.status").cast("int").alias("status"), "r.location", nothing.alias("content_type"), nothing.alias("body"), F.when(F.col("r").isNull(), "no response").alias("failure"))

    def bodies(self, rows: DataFrame) -> DataFrame:
        """rows (current, status, ...) with the content type and the body of each success (of one without a status, too); others need none."""
        rows = rows.drop("content_type", "body")
        page = "error IS NULL AND failure IS NULL AND coalesce(status BETWEEN 200 AND 299, true)"
        ended = rows.where(page).select(F.col("current").alias("url")).distinct()
        success = self.responses.where(F.coalesce(F.col("status").cast("int").between(200, 299), F.lit(True)))
        answer = F.min_by(F.struct("content_type", "body"), F.struct("status", "location", "body")).alias("r")
        known = success.join(ended, "url", "left_semi").groupBy("url").agg(answer)
        on = (F.col("current") == F.col("url_")) & F.expr(page)
        return rows.join(known.withColumnRenamed("url", "url_"), on, "left").select(*rows.columns, "r.content_type", "r.body")


def stored(responses: DataFrame) -> Ask:
    """Answers of a table of responses, for fetch_pages."""
    return Stored(responses)


def attempts(url: str, fetch: Fetch, retries: int, base: float, most: float, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """The last answer, after up to `retries` further tries on failures and on the statuses that may pass, with doubled waits."""
    for n in range(retries + 1):
        try:
            status, headers, body = fetch(url)
            answer = (url, status, headers.get("location"), headers.get("content-type"), body, None)
            if status not in RETRY_CODES:
                return answer
        except Exception as e:  # noqa: BLE001  whatever the function raises is the address's failure
            answer = (url, None, None, None, None, f"{type(e).__name__}: {e}"[:500])
        if n < retries:
            sleep(min(base * 2**n, most) * (0.5 + random.random() / 2))
    return answer


def asking(fetch: Fetch, partitions: int = 64, retries: int = 3, base: float = 1.0, most: float = 15.0) -> Ask:
    """Answers of a function; a host's addresses are asked by one task, in their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([attempts(u, fetch, retries, base, most) for u in b["current"]], columns=["current", "status", "location", "content_type", "body", "failure"]).astype({"status": "Int32"})

    def ask(current: DataFrame) -> DataFrame:
        host = host_of(F.col("current"))
        return current.repartition(partitions, host).sortWithinPartitions(host, "current").mapInPandas(run, RESPONSE)

    return ask


def fetch_pages(addresses: DataFrame, ask: Ask) -> DataFrame:
    """(url, html, final_url, status_code, n_redirects, error) of each distinct address (url). html is null where there is an error:
    an address, or one it was sent on to, that isn't safe; a redirect to an address of its own chain; a status that isn't a
    success, a sixth redirect among them; content that isn't text; a body over 10 MiB; or a failed request."""
    ahead = addresses.select("url").where("url IS NOT NULL").distinct().select("url", F.col("url").alias("current"), F.array("url").alias("visited"), F.lit(None).cast("string").alias("error"))
    ahead = ahead.withColumn("error", F.when(~is_safe_url(F.col("current")), "address not allowed"))
    done = []
    for n in range(MOST_REDIRECTS + 1):
        asked = ask(ahead.where("error IS NULL").select("current").distinct())
        got = checkpointed(ahead.join(asked, "current", "left").withColumn("n_redirects", F.lit(n)))
        moved = F.coalesce(F.col("error").isNull() & F.col("status").between(300, 399) & F.col("location").isNotNull(), F.lit(False)) if n < MOST_REDIRECTS else F.lit(False)
        done.append(got.where(~moved))
        onward = got.where(moved).withColumn("next", resolve_url(F.col("current"), F.col("location")))
        refused = F.when(~is_safe_url(F.col("next")), "redirect not allowed").when(F.array_contains("visited", F.col("next")), "redirect loop")
        ahead = checkpointed(onward.select("url", F.col("next").alias("current"), F.array_append("visited", F.col("next")).alias("visited"), refused.alias("error")))
        if ahead.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, done)
    if isinstance(ask, Stored):
        rows = ask.bodies(rows)
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    text = (kind == "") | reduce(lambda a, b: a | b, [kind.contains(k) for k in ("text", "html", "json", "xml")])
    body = F.regexp_replace(F.coalesce("body", F.lit("")), "^﻿", "")
    error = F.coalesce("error", "failure", F.when(~F.col("status").between(200, 299), F.concat(F.lit("HTTP "), F.col("status").cast("string"))), F.when(~text, F.concat(F.lit("content type "), kind)), F.when(F.length(body) > MOST_CHARS, "body too large"))
    return rows.select("url", F.when(error.isNull(), body).alias("html"), F.col("current").alias("final_url"), F.col("status").alias("status_code"), "n_redirects", error.alias("error"))
