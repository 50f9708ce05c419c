"""Benchmark passages in training documents, by a positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from freshet.llm.base import ascii_lower, checkpointed, stored

_GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Most rows of a narrow table that are sent to every executor, 30 bytes each; beyond it the join shuffles.
SENT_ROWS = 500_000
#: Stands in the index behind a document's last word, so its place is the number of words.
END = -6148914691236517206
#: Rarest terms whose posting lists are intersected before the words themselves are compared.
RAREST = 3


def terms_of(text: Column) -> Column:
    """The words of a text after lower-casing A-Z, as 64-bit hashes; none for NULL."""
    words = F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAPS), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def test_windows(benchmark: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(windows, items): each different window (window, terms), and (window, item_id) for the items that have it.

    A window is ``size`` terms in a row; an item of fewer terms, but not none, is
    one window.
    """
    rows = benchmark.select("item_id", terms_of(F.col("text")).alias("t")).filter(F.size("t") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("t") - size + 1, F.lit(1)))
    each = rows.select("item_id", "t", F.explode(starts).alias("i")).select("item_id", F.slice("t", F.col("i"), size).alias("terms"))
    each = each.withColumn("window", F.xxhash64("terms"))
    return each.select("window", "terms").dropDuplicates(["window"]), each.select("window", "item_id").distinct()


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The index (term, row, doc_id, pos), stored: postings of the test vocabulary in all documents, and document ends.

    A posting of a term that no test has can take part in no match, so only the
    vocabulary's are kept.  ``row`` tells documents apart.  The index lies in
    segments, one for each task that read documents, so building it shuffles
    nothing.
    """
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    terms = F.concat(terms_of(F.col("text")), F.array(F.lit(END)))
    postings = numbered.select("doc_id", "row", F.posexplode(terms).alias("pos", "term"))
    wanted = vocabulary.union(vocabulary.sparkSession.range(1).select(F.lit(END).alias("term")))
    return stored(_among(postings, wanted, "term").select("term", "row", "doc_id", "pos"), "postings")


def _among(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is among the keys; few keys are sent to every task, many meet the rows in a shuffle."""
    return df.join(_sized(keys), column, "left_semi")


def _sized(table: DataFrame) -> DataFrame:
    few = table.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    return F.broadcast(table) if few else table


def rank_terms(windows: DataFrame, postings: DataFrame) -> DataFrame:
    """(window, size, rank, offset, term): each window's places from the rarest term on; windows with an absent term are left out."""
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    places = windows.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    by_window = W.partitionBy("window")
    return (places.join(counts, "term").withColumn("_there", F.count(F.lit(1)).over(by_window)).filter("_there = size")
            .withColumn("rank", F.row_number().over(by_window.orderBy("n", "offset")))
            .select("window", "size", "rank", "offset", "term"))


def intersect(postings: DataFrame, ranked: DataFrame, slop: int = 0) -> DataFrame:
    """(window, row, start, gap): where the rarest terms of a window stand as the window has them.

    The posting list of the rarest term, moved back by its place in the window,
    gives the starts; the lists of the next terms are moved likewise and
    intersected with them.  With a ``slop`` a later term may stand that many
    words away from its place; ``gap`` is the farthest one's distance, 0 where
    all stand exactly.
    """
    first = ranked.filter("rank = 1").select("window", "term", "offset")
    found = (postings.join(_sized(first), "term")
             .select("window", "row", (F.col("pos") - F.col("offset")).alias("start"), F.lit(0).alias("gap")))
    for rank in range(2, RAREST + 1):
        term = ranked.filter(F.col("rank") == rank).select("window", "term", "offset")
        lists = _among(postings, term.select("term").distinct(), "term").select("term", "row", F.col("pos").alias("at"))
        probes = found.join(_sized(term), "window", "left")
        moves = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
        moved = (probes.filter("term IS NOT NULL").withColumn("move", moves)
                 .withColumn("at", F.col("start") + F.col("offset") + F.col("move")))
        met = moved.join(lists, ["row", "at", "term"]).groupBy("window", "row", "start").agg(
            F.min(F.greatest("gap", F.abs("move"))).alias("gap"))
        # A window of fewer terms than this is decided already.
        found = met.union(probes.filter("term IS NULL").select("window", "row", "start", "gap"))
    return found


def exact_matches(postings: DataFrame, ranked: DataFrame, found: DataFrame) -> DataFrame:
    """(window, row, start, size): the candidates whose every term stands in its place, by the same index."""
    found = found.filter("gap = 0").select("window", "row", "start")
    there = _among(postings, found.select("row").distinct(), "row").select("term", "row", F.col("pos").alias("at"))
    places = ranked.select("window", "size", "offset", "term")
    probes = found.join(_sized(places), "window").withColumn("at", F.col("start") + F.col("offset"))
    return (probes.join(there, ["row", "at", "term"]).groupBy("window", "row", "start", "size")
            .agg(F.count(F.lit(1)).alias("_n")).filter("_n = size").drop("_n"))


def find_passages(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, phrases, proximities) of all documents.

    ``documents``: (row, doc_id, n_words), a row number for every document.
    ``phrases``: (window, row, start, size), every standing of a benchmark window,
    in words.  ``proximities``: (window, row, start, gap), standings of a window's
    rarest terms within ``slop`` words of their places that are no phrase.
    :func:`test_windows` leads from windows to items.

    Terms meet as 64-bit hashes.  Every text is read once, for the index, and no
    text is shuffled; all matching works on postings.  The posting lists of
    frequent terms are touched only where rarer terms of the window have met, so
    a common word or passage costs its own postings.  Repeated and NULL doc_ids
    are documents of their own; NULL texts have no words; an empty benchmark
    gives no matches.
    """
    windows, _ = test_windows(benchmark, size)
    windows = checkpointed(windows)
    index = build_index(docs, windows.select(F.explode("terms").alias("term")).distinct())
    postings = index.filter(F.col("term") != END)
    ranked = checkpointed(rank_terms(windows, postings))
    found = checkpointed(intersect(postings, ranked, slop))
    phrases = checkpointed(exact_matches(postings, ranked, found))
    near = found.join(phrases, ["window", "row", "start"], "left_anti")
    documents = index.filter(F.col("term") == END).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    return documents, phrases, near


def covered_words(hits: Column) -> Column:
    """Words inside any of the hits, (start, size) sorted by start."""
    blank = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(hits, blank, lambda a, h: F.struct(
        F.greatest(a["end"], h["start"] + h["size"]).alias("end"),
        (a["n"] + F.greatest(h["start"] + h["size"] - F.greatest(a["end"], h["start"]), F.lit(0))).alias("n")))["n"].cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 2) -> DataFrame:
    """``find_passages`` summed up: words hit, items found and their digest, and proximity matches, for every document."""
    documents, phrases, near = find_passages(docs, benchmark, size, slop)
    _, items = test_windows(benchmark, size)
    hits = phrases.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("hits"))
    listed = (phrases.select("row", "window").distinct().join(_sized(items), "window")
              .select("row", F.col("item_id").cast("string").alias("item")).distinct()
              .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")))
    close = near.groupBy("row").agg(F.count(F.lit(1)).alias("n_near"))
    none = F.array().cast("array<string>")
    out = documents.join(hits, "row", "left").join(listed, "row", "left").join(close, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce(covered_words(F.col("hits")), F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        F.col("hits").isNotNull().alias("contaminated"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))
