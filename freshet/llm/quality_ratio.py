"""Documents by the likelihood ratio of their hashed n-grams between trusted texts and the raw corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from freshet.llm.base import bind, blank_words, stored

#: Buckets of the n-gram hash: the size of both multinomials, whatever the corpus.
BUCKETS = 1 << 20
#: Without a threshold, this share of the trusted documents would be turned away.
LOWEST = 0.01
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Most trusted ids sent to every executor, 8 bytes each.
SENT_IDS = 1_000_000


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(h: Column, n: int) -> Column:
    """The hash of every ``n`` hashes in a row."""
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (n - 1), F.lit(0))),
                       lambda x, i: F.xxhash64(x, *[h[i + k] for k in range(1, n)]))


def gram_buckets(hashes: Column, n_max: int = 2, buckets: int = BUCKETS) -> Column:
    """The bucket of every n-gram of 1 to ``n_max`` words, with repeats, from the words' hashes."""
    parts = [hashes] + [_windows(hashes, n) for n in range(2, n_max + 1)]
    return F.transform(F.concat(*parts), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that stand in the text twice or more, every standing counted.

    Takes the words' hashes.  Windows are told apart by a 64-bit hash.  Equal
    hashes meet by sorting, so a text costs n log n; texts without a repeated
    window skip that.
    """
    def covered(hashes):
        by_hash = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s):
            return F.sort_array(F.transform(F.filter(
                F.transform(s, lambda x, j: F.struct(
                    x["i"].alias("i"),
                    _near(s, x, j).alias("again"))),
                lambda x: x["again"]), lambda x: x["i"]))

        def total(at):
            # Each start adds the words up to the next one, a whole window at most.
            return F.aggregate(F.transform(at, lambda x, j: F.least(
                F.lit(window), F.coalesce(F.get(at, j + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            bind(bind(by_hash, starts), total))

    return bind(_windows(hashes, window), covered).cast("long")


def _near(s: Column, x: Column, j: Column) -> Column:
    before = F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
    return before | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _text_signals(text: Column) -> dict[str, Column]:
    return {"word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": duplicate_lines(text)}


def bucket_counts(docs: DataFrame, trusted: DataFrame, n_max: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-grams in all documents, and in those whose doc_id ``trusted`` has.

    Buckets without any n-gram are left out, so these are at most ``buckets``
    rows.  Texts are shuffled only to meet more than ``SENT_IDS`` trusted ids;
    after that only one row per bucket and task moves.
    """
    ids = stored(trusted.select("doc_id").filter("doc_id IS NOT NULL").distinct().withColumn("_t", F.lit(1)), "trusted")
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    marked = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "doc_id", "left")
    hashes = _word_hashes(blank_words(F.col("text")))
    grams = marked.select("_t", F.explode(bind(hashes, lambda h: gram_buckets(h, n_max, buckets))).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_t").alias("target"))


def bucket_weights(counts: pa.Table, buckets: int = BUCKETS, smoothing: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """For every bucket the log ratio of its probability in the trusted and in all documents, and that without one trusted n-gram.

    Both multinomials are smoothed by adding ``smoothing`` to each bucket.  The
    second is what a trusted document's n-gram would weigh if it weren't trusted.
    """
    raw, target = np.full(buckets, smoothing), np.full(buckets, smoothing)
    at = counts["bucket"].to_numpy()
    raw[at] += counts["raw"].to_numpy()
    target[at] += counts["target"].to_numpy()
    shift = np.log(raw.sum()) - np.log(target.sum()) - np.log(raw)
    return np.log(target) + shift, np.log(np.maximum(target - 1, smoothing)) + shift


def score_documents(docs: DataFrame, trusted: DataFrame, threshold: float | None = None, n_max: int = 2,
                    buckets: int = BUCKETS) -> DataFrame:
    """Each document's ``doc_id``, base signals, ``score`` and ``kept``.

    ``score`` is the mean weight of the document's n-grams, that is the
    log-likelihood ratio between the trusted and the raw multinomial over its
    length.  A document is kept when it passes the base rules and its score is
    ``threshold`` or more.  Scores shrink as buckets fill, so without a threshold
    it is the ``LOWEST`` quantile of the scores of all trusted documents that pass
    the base rules, each n-gram weighed as if it weren't trusted there.  A
    document without words scores NULL and fails the base rules.  Where nothing
    is trusted, or no trusted document passes them, the scores say nothing and
    only the base rules decide.

    Every row is judged by its own text, so repeated or NULL doc_ids each get
    their row (an n-gram counts for the target if its row's doc_id is trusted).
    NULL texts have no words.  Whole texts and all documents are counted.  The
    weights, ``buckets`` numbers whatever the corpus, come to the driver and are
    sent to tasks as the value of a subquery; scoring shuffles no texts.
    """
    spark = docs.sparkSession
    counts = bucket_counts(docs, trusted, n_max, buckets).toArrow()
    any_trusted = bool(np.any(counts["target"].to_numpy()))
    tables = [pa.array([w], pa.list_(pa.float64())) for w in bucket_weights(counts, buckets)]
    weights = stored(spark.createDataFrame(pa.table(tables, ["w", "loo"])), "weights")
    text = F.coalesce(F.col("text"), F.lit(""))

    def mean(at: Column, table: Column) -> Column:
        return F.try_divide(F.aggregate(at, F.lit(0.0), lambda a, b: a + table[b]), F.size(at))

    def judged(h, w):
        return bind(gram_buckets(h, n_max, buckets), lambda at: F.struct(
            F.size(h).cast("long").alias("n"), repeated_words(h).alias("r"), mean(at, w["w"]).alias("score"), mean(at, w["loo"]).alias("loo")))

    # The optimizer puts the subquery where its one reference is, so its value is never part of a row.
    both = weights.select(F.struct("w", "loo")).scalar()
    out = docs.select("doc_id", "text", both.alias("_b")).select("doc_id", "text", bind(F.col("_b"), lambda w: bind(_word_hashes(blank_words(text)), lambda h: judged(h, w))).alias("_w")).select(
        "doc_id", F.col("_w.n").alias("n_words"), *[c.alias(k) for k, c in _text_signals(text).items()],
        F.col("_w.r").alias("n_repeat_words"), F.when(F.col("_w.n") > 0, F.col("_w.score")).alias("score"), F.col("_w.loo").alias("_loo"))
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    if any_trusted and threshold is None:
        out = stored(out, "scores")
        known = out.filter("NOT base_failed").join(trusted.select("doc_id").distinct(), "doc_id", "left_semi")
        threshold = known.agg(F.percentile_approx("_loo", LOWEST, 10_000)).first()[0]
    judge = any_trusted and threshold is not None
    clean = F.coalesce(F.col("score") >= threshold, F.lit(False)) if judge else F.lit(True)
    return out.drop("_loo").withColumn("kept", ~F.col("base_failed") & clean)
