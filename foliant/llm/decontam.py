"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

The index stores one posting (term, doc, mark, pos) per training token, and one of the empty term per document. When the test set is known, it is read in parts:
first the lists of the rarest terms, then those of the other terms, for the documents that may hold a match. A
test set that changes often is matched against an index of all terms, built once (`build_index` without `terms`).

Every run of ten test words is a window. Its terms are ranked by their frequency in the index. The list of the rarest
term, moved by the term's offset, gives the possible starts; they are intersected with the moved list of the second
rarest, with a slack. For what is left, the lists of all terms of the window are intersected at their places, again with the slack: a start
whose terms all stand at their exact places is an exact phrase, one at which at least NEAR of the terms stand
within the slack a proximity match. (A window that lost one of its two rarest terms there isn't looked at; its neighbours
without the term are.) A window with terms that the index lacks can only be a proximity match.

Postings of one position hold one term, so each intersection after the first is one row against at most one. The
first joins on the term; windows are broadcast only if their bytes are counted to be few, and otherwise Spark's skew join may
split a frequent term.

Defined results: null has no words; a document without words has no hits; items without words or without item_id
match nothing, and without any item nothing is hit; items shorter than ten words are one window; equal items count each; rows
that repeat a doc_id are told apart by their text, and full repeats each get the result; a very long text is so many postings; an
empty documents table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import body, lower_ascii, materialise, settled, small_or_not, text_digest

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Words that a term of a proximity match may stray from its place, and the share of terms that a proximity match needs.
SLACK = 4
NEAR = 0.8
BUCKET = 16


def words(text: Column) -> Column:
    """The words of a text; splitting between them takes a fifth of the time of matching each."""
    return F.array_remove(F.split(lower_ascii(text), BETWEEN, -1), "")


def named_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, doc, mark, text): doc and mark name a text within the index."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body(text).alias("text")).withColumn("mark", F.xxhash64("text"))
    return rows.withColumn("doc", F.coalesce("doc_id", F.bitwise_not("mark"))).select("doc_id", "doc", "mark", "text")


def postings(rows: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, doc, mark, pos, doc_id, text_sha256) of the tokens of named rows, or of those among `terms` (a small column `term`).
    One posting of the empty term per row has the number of words as its position, and the row's name."""
    rows = rows.select("doc_id", "doc", "mark", text_digest(), words(F.col("text")).alias("w"))
    none = F.lit(None).cast("string").alias("text_sha256")
    length = F.struct(F.lit("").alias("term"), F.size("w").alias("pos"), F.col("doc_id"), F.col("text_sha256"))
    tokens = F.transform("w", lambda t, i: F.struct(t.alias("term"), i.alias("pos"), F.lit(None).cast("long").alias("doc_id"), none))
    found = rows.select("doc", "mark", F.explode(F.concat(F.array(length), tokens)).alias("p"))
    found = found.select(F.col("p.term").alias("term"), "doc", "mark", F.col("p.pos").alias("pos"), F.col("p.doc_id").alias("doc_id"), F.col("p.text_sha256").alias("text_sha256"))
    return found if terms is None else found.join(small_or_not(terms), "term", "left_semi")


def build_index(docs: DataFrame, text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """The postings of a corpus, written to the shared folder."""
    return materialise(postings(named_rows(docs, text), terms), "postings")


def test_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(window, item_id, words): the windows of each item, `window` the digest of its words."""
    rows = items.where(F.col("item_id").isNotNull()).select("item_id", words(body()).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(width - 1)))
    runs = rows.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(width)))).alias("words"))
    return runs.select(F.substring(F.unhex(F.sha2(F.array_join("words", " ").cast("binary"), 256)), 1, 16).alias("window"), "item_id", "words").distinct()


def term_counts(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, n): how often the corpus holds each term of the test set. Counts are summed before the shuffle."""
    tokens = rows.select(F.explode(words(F.col("text"))).alias("term"))
    return tokens.join(small_or_not(vocabulary), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def ranked_terms(seen: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, size, term, off, rank, missing): terms of each window that the index holds, the rarest first, and how many
    it lacks."""
    terms = windows.select("window", "words").distinct().select("window", F.size("words").alias("size"), F.posexplode("words").alias("off", "term"))
    found = terms.join(small_or_not(seen), "term", "left")
    by_rarity = Window.partitionBy("window").orderBy(F.col("n").asc_nulls_last(), "term", "off")
    lacking = F.count(F.when(F.col("n").isNull(), 1)).over(Window.partitionBy("window"))
    ranked = found.withColumn("rank", F.row_number().over(by_rarity)).withColumn("missing", lacking)
    return ranked.where("n IS NOT NULL").select("window", "size", "term", "off", "rank", "missing")


def needed(size: Column, share: float = NEAR) -> Column:
    """Terms that a proximity match of a window needs."""
    return F.ceil(size * F.lit(share) - F.lit(1e-9))


def first_starts(lists: DataFrame, ranked: DataFrame, slack: int = SLACK) -> DataFrame:
    """(window, size, doc, mark, start): where the rarest term stands and the second rarest within the slack of its place."""
    r = F.col("rank")
    starts = lists.join(small_or_not(ranked.where(r == 1)), "term").select("window", "size", "doc", "mark", (F.col("pos") - F.col("off")).alias("start"))
    single = starts.where("size = 1")
    second = ranked.where(r == 2)
    wanted = starts.join(small_or_not(second.select("window", "term", "off")), "window").withColumn("place", F.col("start") + F.col("off"))
    wanted = wanted.select("window", "size", "doc", "mark", "start", "place", "term", F.explode(near_buckets(F.col("place"), slack)).alias("bucket"))
    others = lists.join(small_or_not(second.select("term").distinct()), "term", "left_semi")
    others = others.select("term", "doc", "mark", "pos", bucket(F.col("pos")).alias("bucket"))
    pairs = wanted.join(others, ["term", "doc", "mark", "bucket"]).where(F.abs(F.col("pos") - F.col("place")) <= slack)
    return pairs.select("window", "size", "doc", "mark", "start").unionByName(single).distinct()


def bucket(pos: Column) -> Column:
    return F.floor(pos / BUCKET)


def near_buckets(place: Column, slack: int) -> Column:
    return F.array_distinct(F.array(bucket(place - slack), bucket(place + slack)))


def confirmed(starts: DataFrame, lists: DataFrame, ranked: DataFrame, slack: int = SLACK) -> DataFrame:
    """(window, size, doc, mark, start, exact): the starts that the lists of all their terms confirm as matches."""
    asked = starts.join(small_or_not(ranked.select("window", "term", "off")), "window").withColumn("place", F.col("start") + F.col("off"))
    asked = asked.select("window", "size", "doc", "mark", "start", "term", "off", "place", F.explode(near_buckets(F.col("place"), slack)).alias("bucket"))
    held = lists.withColumn("bucket", bucket(F.col("pos")))
    met = asked.join(held, ["doc", "mark", "bucket", "term"]).withColumn("stray", F.abs(F.col("pos") - F.col("place"))).where(F.col("stray") <= slack)
    best = met.groupBy("window", "size", "doc", "mark", "start", "off").agg(F.min("stray").alias("stray"))
    told = best.groupBy("window", "size", "doc", "mark", "start").agg(F.count(F.lit(1)).alias("close"), F.count(F.when(F.col("stray") == 0, 1)).alias("right"))
    exact = F.col("right") == F.col("size")
    return told.where(exact | (F.col("close") >= needed(F.col("size")))).withColumn("exact", exact).drop("close", "right")


def matches(rows: DataFrame, windows: DataFrame, slack: int = SLACK, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(window, size, doc, mark, start, exact) of the phrases and proximity matches in named rows, and the rows' length
    postings. Lists come from an index of all terms, if there is one; else those needed are built."""
    vocabulary = materialise(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    seen = term_counts(rows, vocabulary) if index is None else index.join(small_or_not(vocabulary), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked_terms(materialise(seen, "counts"), windows)
    ranked = materialise(ranked.where(F.col("size") - F.col("missing") >= needed(F.col("size"))), "ranked")

    def lists(of: DataFrame, terms: DataFrame) -> DataFrame:
        return postings(of, terms) if index is None else index.join(small_or_not(terms), "term", "left_semi")

    least = ranked.where("rank <= 2").select("term").union(rows.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    posted = materialise(lists(rows, materialise(least, "rare")), "postings")
    rare = posted.where("term <> ''").select("term", "doc", "mark", "pos")
    starts = materialise(first_starts(rare, ranked, slack), "starts")
    held = materialise(starts.select("doc", "mark").distinct(), "held")
    inside = rows.join(small_or_not(held), ["doc", "mark"], "left_semi")
    rest = lists(inside, materialise(ranked.select("term").distinct(), "all-terms"))
    if index is not None:
        rest = rest.join(small_or_not(held), ["doc", "mark"], "left_semi")
    return confirmed(starts, rest.select("term", "doc", "mark", "pos"), ranked, slack), posted.where("term = ''")


@settled("decontaminated")
def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", width: int = WINDOW, slack: int = SLACK, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_sha256, n_words, n_hit, items, n_near) of every row; items are the sorted ids of the items with occurring windows,
    n_near counts the windows with a proximity match but no exact one. `index` may be an index of all terms of docs."""
    windows = materialise(test_windows(items, width), "windows")
    found, lengths = matches(named_rows(docs, text), windows, slack, index)
    found = materialise(found, "matches")
    exact = found.where("exact")
    covered = exact.select("doc", "mark", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos"))
    hits = covered.groupBy("doc", "mark").agg(F.countDistinct("pos").alias("n_hit"))
    ids = materialise(windows.select("window", "item_id").distinct(), "ids")
    named = exact.select("doc", "mark", "window").distinct().join(small_or_not(ids), "window").groupBy("doc", "mark").agg(F.collect_set("item_id").alias("items"))
    each = found.groupBy("doc", "mark", "window").agg(F.max("exact").alias("exact"))
    close = each.where("NOT exact").groupBy("doc", "mark").agg(F.count(F.lit(1)).alias("n_near"))
    told = materialise(hits.join(named, ["doc", "mark"], "full").join(close, ["doc", "mark"], "full"), "told")
    rows = lengths.select("doc_id", "doc", "mark", "text_sha256", F.col("pos").cast("long").alias("n_words"))
    none = F.array().cast(dict(told.dtypes)["items"])
    return rows.join(small_or_not(told), ["doc", "mark"], "left").select(
        "doc_id",
        "text_sha256",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def digest(found: DataFrame) -> DataFrame:
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
