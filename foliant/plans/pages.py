"""Registered queries of the text and page layers, and of the limits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import markup, text, urls
from foliant.operators import crawl, spread
from foliant.plans.catalogue import query, table
from foliant.sources import pages as sources
from foliant.streaming import limits

_WS = r"[ \t\n\x0B\f\r\x{00A0}\x{3000}\x{FEFF}]"


def _trim_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _normal_sql(x: str) -> str:
    for pattern, by in ((r"\r\n", "chr(10)"), (r"\t", "'  '"), (r"[ \t]+", "' '"), (r" *\n *", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)")):
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return _trim_sql(x)


_ADS = ("Licensed", "All rights", "the")


def _ad_sql(column: str, patterns: tuple[str, ...]) -> str:
    tests = " OR ".join(f"(contains(l, '{p}') AND length({_trim_sql(f'''regexp_replace(l, '{p}', '', 'gi')''')}) < 10)" for p in patterns)
    return f"array_to_string(list_filter(string_split({column}, chr(10)), lambda l: NOT ({tests})), chr(10))"


def _docs(spark, d):
    return table(spark, d, "documents")


def _digest(c):
    return F.sha2(c.cast("binary"), 256)


@query(f"SELECT doc_id, sha256({_ad_sql('text', _ADS)}) AS cleaned FROM documents")
def ad_line_filter(spark, d):
    return _docs(spark, d).select("doc_id", _digest(text.drop_ad_lines(F.col("text"), _ADS)).alias("cleaned"))


@query(f"SELECT doc_id, sha256({_normal_sql('text')}) AS cleaned FROM documents")
def whitespace_normalize(spark, d):
    return _docs(spark, d).select("doc_id", _digest(text.normalize_space(F.col("text"))).alias("cleaned"))


_OWN = ("Licensed", "All rights")
_REMOVED = f"regexp_replace(substring({_ad_sql('text', (*text.AD_PATTERNS, *_OWN))}, 1, 500000), '[0-9]+', '', 'gi')"


@query("SELECT doc_id, sha256(" + _normal_sql(_REMOVED) + ") AS cleaned FROM documents")
def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", _digest(text.clean_text(F.col("text"), list(_OWN), ["[0-9]+", "(a+)+"])).alias("cleaned"))


@query(f"SELECT doc_id, substring({_trim_sql('''regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')''')}, 1, 200) AS cleaned FROM documents")
def sanitize_field(spark, d):
    return _docs(spark, d).select("doc_id", text.sanitize(F.col("text"), 200).alias("cleaned"))


@query("""SELECT doc_id, CASE WHEN contains(text, '完') OR contains(text, '结局') OR contains(text, 'end') OR text = 'completed' THEN 'completed'
    WHEN contains(text, '断') OR contains(text, '暂停') OR contains(text, 'hiatus') THEN 'hiatus' ELSE 'ongoing' END AS status FROM documents""")
def status_mapping(spark, d):
    return _docs(spark, d).select("doc_id", text.status_of(F.col("text")).alias("status"))


@query(f"SELECT doc_id, len(ps) AS n, coalesce(ps[1], '') AS first FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: {_trim_sql('p')} <> '') AS ps FROM documents)")
def paragraphs(spark, d):
    ps = text.paragraphs(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(ps).cast("long").alias("n"), F.coalesce(F.get(ps, F.lit(0)), F.lit("")).alias("first"))


@query(f"SELECT page_id, {_trim_sql('''regexp_extract(html, '<title>([^<]*)</title>', 1)''')} AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


@query("SELECT page_id, len(m) AS n, array_to_string(m, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, 'href=\"[^\"]*\"') AS m FROM pages)")
def regex_links(spark, d):
    m = text.all_matches(F.col("html"), 'href="[^"]*"')
    return table(spark, d, "pages").select("page_id", F.size(m).cast("long").alias("n"), F.array_join(m, " ").alias("links"))


@query("""SELECT page_id, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS raw_title, regexp_extract(html, 'href="([^"]*)"', 1) AS first_link FROM pages""")
def css_extract(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", markup.css_source(html, "css", "article h1").alias("raw_title"), markup.css_one(html, "css", "nav li > a[href]").alias("first_link"))


@query("SELECT page_id, array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' ') AS links FROM pages")
def xpath_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(markup.css_many(F.col("html"), "xpath", "//nav//li/a/@href"), " ").alias("links"))


_LINKS = r"""SELECT page_id, url AS base, unnest(regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text,
             unnest(range(len(regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 1)))) AS "at" FROM (SELECT *, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages)"""


@query(f"""SELECT page_id, "at", text AS title, CASE WHEN href LIKE '/%' THEN regexp_extract(base, '^https?://[^/?#]+') || href ELSE href END AS url FROM ({_LINKS})""")
def list_links(spark, d):
    found = markup.link_rows(F.col("html"), F.col("url"), ("css", "nav li"), ("css", "a"), ("css", "a"))
    return table(spark, d, "pages").select("page_id", F.posexplode(found).alias("at", "link")).select("page_id", F.col("at").cast("long").alias("at"), "link.title", "link.url")


@query()
def clean_html(spark, d):
    plain = text.clean_text(markup.plain_text(F.col("html")))
    return table(spark, d, "pages").select("page_id", F.length(plain).cast("long").alias("n_chars"), plain.alias("text"))


@query(f"""SELECT page_id, "at", 'a' AS tag, trim(text[:100]) AS text, href[:100] AS href FROM ({_LINKS}) WHERE "at" < 100""")
def selector_tester(spark, d):
    found = markup.inspect(F.col("html"), "css", "nav a[href]")
    return table(spark, d, "pages").select("page_id", F.explode(found).alias("m")).select("page_id", F.col("m.at").cast("long").alias("at"), "m.tag", "m.text", F.col("m.attrs")["href"].alias("href"))


@query(r"""SELECT doc_id, "at", trim(m[:100]) AS text FROM (
           SELECT doc_id, unnest(ms[:100]) AS m, unnest(range(least(100, len(ms)))) AS "at" FROM (
               SELECT doc_id, regexp_extract_all(translate(text, '<>&', '   ')[:100000], '[A-Z][a-z]+[,.]\s[A-Z]\w*', 0) AS ms FROM documents))""")
def tester_matches(spark, d):
    """A tester's expression over texts as pages."""
    page = F.concat(F.lit("<body>"), F.translate("text", "<>&", "   "), F.lit("</body>"))
    found = markup.inspect(page, "regex", r"[A-Z][a-z]+[,.]\s[A-Z][0-9A-Za-z_]*")
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("m")).select("doc_id", F.col("m.at").cast("long").alias("at"), "m.text")


@query("""SELECT page_id, 'b' || page_id || CASE WHEN page_id % 3 = 0 THEN '|d' ELSE '' END AS second, CAST(CASE WHEN page_id % 3 = 0 THEN 4 ELSE 3 END AS BIGINT) AS items,
          CASE WHEN page_id % 2 = 0 THEN 'c' || page_id ELSE '' END AS marked FROM pages""")
def xpath_positions(spark, d):
    """Positions among equal names, with other elements between them."""
    i = F.col("page_id").cast("string")
    last = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<li class=k>c"), i, F.lit("</li>"))).otherwise("<li>c</li>")
    more = F.when(F.col("page_id") % 3 == 0, "<ol><p>q</p><li>x</li><i>r</i><li>d</li></ol>").otherwise("<ol></ol>")
    html = F.concat(F.lit("<ul><p>x</p><li>a</li><p>y</p><li>b"), i, F.lit("</li><i>z</i>"), last, F.lit("</ul>"), more)
    paths = {"second": "//li[2]/text()", "items": "//ul/li | //ol/li[last()]", "marked": "//li[@class='k' and position() = last()]"}
    got = {n: markup.css_many(html, "xpath", path) for n, path in paths.items()}
    return table(spark, d, "pages").select("page_id", F.array_join(got["second"], "|").alias("second"), F.size(got["items"]).cast("long").alias("items"), F.array_join(got["marked"], "|").alias("marked"))


_OFFERS = (
    ("title", "h1", "<h1[ >]"), ("content", "article", "<article[ >]"), ("chapters", '[class*="chapter"]', 'class="[^"]*chapter'), ("chapters", '[class*="list"]', 'class="[^"]*list'),
    ("content", ".content", 'class="(?:[^" ]* )*content[" ]'), ("content", "#content", 'id="content"'), ("link", "a[href]", "<a [^>]*href="), ("image", "img[src]", "<img [^>]*src="),
)


@query(" UNION ALL ".join(f"SELECT page_id, '{f}' AS field, '{c}' AS selector, len(regexp_extract_all(bare, '{p}')) AS matches FROM bare WHERE len(regexp_extract_all(bare, '{p}')) > 0" for f, c, p in _OFFERS).join(
    ("WITH bare AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g') AS bare FROM pages) ", "")))
def selector_suggestions(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(markup.suggest(F.col("html"))).alias("s")).select("page_id", "s.field", "s.selector", F.col("s.matches").cast("long").alias("matches"))


@query("SELECT page_id, length(html) > 50000 AS truncated, length(substring(html, 1, 50000)) AS n_chars FROM pages")
def page_preview(spark, d):
    pages = table(spark, d, "pages")
    return sources.preview(pages).select("page_id", "truncated", F.length("html").cast("long").alias("n_chars"))


_HOSTS = ("http://127.0.0.1/a", "http://10.1.2.3/", "https://example.com/x", "http://169.254.169.254/latest", "ftp://example.com/", "http://localhost:80/", "http://a.local/", "http://0x7f.0.0.1/", "http://2130706433/", "http://[::1]/", "https://x.nip.io/", "http://192.168.1.1/", "http://8.8.8.8/", "http://172.20.0.1/", "http://172.32.0.1/")
_SAFE = {"https://example.com/x", "http://8.8.8.8/", "http://172.32.0.1/"}


@query("SELECT url, url LIKE 'http%' AS safe FROM (SELECT DISTINCT url FROM pages) UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{u}', {str(u in _SAFE).lower()})" for u in _HOSTS) + ")")
def safe_url(spark, d):
    given = spark.createDataFrame([(u,) for u in _HOSTS], "url string")
    return table(spark, d, "pages").select("url").distinct().unionByName(given).select("url", urls.is_safe_url(F.col("url")).alias("safe"))


@query("SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || regexp_extract(html, 'href=\"([^\"]*)\"', 1) AS resolved FROM pages WHERE regexp_extract(html, 'href=\"([^\"]*)\"', 1) <> ''")
def resolve_urls(spark, d):
    linked = table(spark, d, "pages").withColumn("link", F.regexp_extract("html", 'href="([^"]*)"', 1)).where("link <> ''")
    return linked.select("page_id", urls.resolve_url(F.col("url"), F.col("link")).alias("resolved"))


@query("""WITH RECURSIVE chain AS (SELECT page_id AS first, page_id AS id, CAST(0 AS BIGINT) AS page_no FROM pages WHERE page_id % 5 = 0
          UNION ALL SELECT first, p.page_id, page_no + 1 FROM chain JOIN pages p ON p.page_id = chain.id + 1 WHERE chain.id % 5 <> 4 AND page_no < 9)
          SELECT CAST(first AS VARCHAR) AS start, CAST(id AS VARCHAR) AS url, page_no FROM chain""")
def paginated_chain(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("url"), F.when(F.col("page_id") % 5 != 4, (F.col("page_id") + 1).cast("string")).alias("next_url"))
    return crawl.follow_pages(pages.where("url % 5 = 0").select("url"), pages, 10).withColumn("page_no", F.col("page_no").cast("long"))


@query("""SELECT page_id, u.url, CASE WHEN u.url LIKE 'http%' THEN 200 ELSE 404 END AS status_code FROM pages u""")
def stored_source(spark, d):
    pages = table(spark, d, "pages")
    sources.register_source("stored", sources.stored_pages(pages))
    found = sources.source("no such source")(spark, pages.select("page_id", "url"))
    return found.select("page_id", "url", F.col("status_code").cast("int").alias("status_code"))


_EVENTS = limits.Events("user_id", "ts", "event_id", "event_type")


def _fold_sql(first: str, following: str, result: str) -> str:
    """A step of each user's state after the other; `first` and `following` give the state from at, label (and the state before)."""
    return f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, epoch_us(ts) / 1e6 AS sec, event_type AS label,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        f AS (SELECT key, n, id, {first} FROM e WHERE n = 1
              UNION ALL SELECT e.key, e.n, e.id, {following} FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)
        SELECT id, {result} FROM f"""


_W1, _W2 = "(used1 = 0 OR sec - start1 > 86400)", "(used2 = 0 OR sec - start2 > 604800)"
_OK = f"(CASE WHEN {_W1} THEN 0 ELSE used1 END < 5 AND CASE WHEN {_W2} THEN 0 ELSE used2 END < 15)"


@query(_fold_sql("sec AS start1, 1 AS used1, sec AS start2, 1 AS used2, true AS allowed",
    f"CASE WHEN {_W1} THEN sec ELSE start1 END, CASE WHEN {_W1} THEN 0 ELSE used1 END + CAST({_OK} AS INT), CASE WHEN {_W2} THEN sec ELSE start2 END, CASE WHEN {_W2} THEN 0 ELSE used2 END + CAST({_OK} AS INT), {_OK}",
    "allowed, CAST(used1 AS DOUBLE) AS value"))
def rate_limit_fixed_window(spark, d):
    return limits.run_batch(table(spark, d, "events"), _EVENTS, limits.fixed_windows(((5, 86_400.0), (15, 7 * 86_400.0)))).select("id", "allowed", "value")


_REFILLED = "least(3.0::DOUBLE, tokens + (sec - last) * (1::DOUBLE / 86400))"


@query(_fold_sql("2.0::DOUBLE AS tokens, sec AS last, true AS allowed", f"CASE WHEN {_REFILLED} >= 1 THEN {_REFILLED} - 1 ELSE {_REFILLED} END, sec, {_REFILLED} >= 1",
    "allowed, CASE WHEN allowed THEN 0.0::DOUBLE ELSE -floor((tokens - 1) / (1::DOUBLE / 86400)) END AS value"))
def token_bucket(spark, d):
    return limits.run_batch(table(spark, d, "events"), _EVENTS, limits.token_bucket(3.0, 1 / 86_400)).select("id", "allowed", "value")


_OPEN = "(opened >= 0 AND sec - opened < 86400)"


@query(_fold_sql("CAST(label = 'error' AS INT) AS failed, -1.0::DOUBLE AS opened, true AS allowed",
    f"CASE WHEN {_OPEN} THEN failed WHEN label = 'error' THEN failed + 1 ELSE 0 END, CASE WHEN {_OPEN} THEN opened WHEN label = 'error' AND (failed + 1 >= 2 OR opened >= 0) THEN sec ELSE -1 END, NOT {_OPEN}",
    "allowed, CAST(failed AS DOUBLE) AS value"))
def circuit_breaker(spark, d):
    return limits.run_batch(table(spark, d, "events"), _EVENTS, limits.circuit_breaker(2, 86_400.0)).select("id", "allowed", "value")


@query(_fold_sql("sec AS last, true AS allowed", "CASE WHEN label = 'purchase' OR sec - last >= 86400 THEN sec ELSE last END, label = 'purchase' OR sec - last >= 86400", "allowed, last AS value"))
def progress_throttle(spark, d):
    return limits.run_batch(table(spark, d, "events"), _EVENTS, limits.throttle(86_400.0, ("purchase",))).select("id", "allowed", "value")


_TIMES = "SELECT {key} AS key, epoch_us(ts) // 1000 AS ms, event_id AS id, row_number() OVER (PARTITION BY {key} ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events"


@query(f"""WITH RECURSIVE e AS ({_TIMES.format(key="event_type")}),
           f AS (SELECT key, n, ms, id, ms + 1800000 AS full_at, true AS allowed, 0 AS retry_after FROM e WHERE n = 1
                 UNION ALL
                 SELECT e.key, e.n, e.ms, e.id, CASE WHEN full_at - e.ms <= 29 * 1800000 THEN greatest(e.ms, full_at) + 1800000 ELSE full_at END,
                        full_at - e.ms <= 29 * 1800000, greatest(0, CAST(ceil((full_at - e.ms - 29 * 1800000) / 1000.0) AS BIGINT))
                 FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)
           SELECT id, key, allowed, CAST(retry_after AS BIGINT) AS retry_after FROM f""")
def token_bucket_hot(spark, d):
    """A bucket per kind of event, five keys for all rows: 30 events, one more each half hour."""
    by_kind = limits.Events("event_type", "ts", "event_id", "event_type")
    return spread.decide(table(spark, d, "events"), by_kind, spread.TokenBucket(30, 1_800_000)).select("id", "key", "allowed", "retry_after")


def _windows_sql(key: str, most: int, length: int, locked: int) -> str:
    """The chain of windows of each key, one recursion a window; locked 0: none."""
    lock = f"(SELECT min(x.ms) FROM e x WHERE x.key = w.key AND x.n = w.n + {most} AND x.ms <= w.ms + {length})" if locked else "NULL"
    after = f"x.ms >= w.lock_at + {locked}" if locked else "false"
    return f"""WITH RECURSIVE e AS ({_TIMES.format(key=key)}),
        w AS (SELECT key, n, ms, {lock.replace("w.", "o.")} AS lock_at FROM e o WHERE n = 1
              UNION ALL
              SELECT key, n, ms, {lock} FROM (
                  SELECT w.key, min(x.n) AS n, min(x.ms) AS ms FROM w JOIN e x ON x.key = w.key AND CASE WHEN w.lock_at IS NULL THEN x.ms > w.ms + {length} ELSE {after} END
                  GROUP BY w.key) w)
        SELECT e.id, e.key, e.n - w.n < {most} AS allowed,
               CAST(CASE WHEN e.n - w.n < {most} THEN 0 ELSE ceil((coalesce(w.lock_at + {locked}, w.ms + {length}) - e.ms) / 1000.0) END AS BIGINT) AS retry_after
        FROM e ASOF JOIN w ON e.key = w.key AND e.n >= w.n"""


@query(_windows_sql("user_id % 3", 40, 86_400_000, 0).replace("e.key,", "CAST(e.key AS VARCHAR) AS key,", 1))
def windows_hot(spark, d):
    """Three keys for all rows: 40 events in a day, which begins with the first one after the last day's end."""
    events = table(spark, d, "events").withColumn("third", F.col("user_id") % 3)
    return spread.decide(events, limits.Events("third", "ts", "event_id", "event_type"), spread.Windows(40, 86_400_000)).select("id", "key", "allowed", "retry_after")


@query(_windows_sql("'all'", 50, 3 * 3_600_000, 15 * 3_600_000))
def global_lockout(spark, d):
    """One key for all rows: more than 50 events in three hours lock it for fifteen."""
    events = table(spark, d, "events").withColumn("everyone", F.lit("all"))
    return spread.decide(events, limits.Events("everyone", "ts", "event_id", "event_type"), spread.Windows(50, 3 * 3_600_000, 15 * 3_600_000)).select("id", "key", "allowed", "retry_after")
