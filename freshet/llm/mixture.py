"""A mixture of sources to target weights, drawn block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from freshet.llm.base import bind, checkpointed, stored

BLOCK_WORDS = 16
SHARD_SLOTS = 1 << 14
#: Most times the mix goes over a source.
PASSES = 3
_ROUNDS = 8
_GUIDES = 4096
_NUMBERED = 4_000


def source_targets(sizes: DataFrame, weights: int = 3, passes: int = PASSES) -> DataFrame:
    """(source, rank, source_size, weight, target) from (source, size) rows.

    Sources by code point, NULL last, weigh 1, 2, ... ``weights``, repeating, and
    share the total size.  A target stops at ``passes`` times its source's size
    and the excess goes to the others by weight, until none is above.  Sources
    that stop are those with the least size for their weight, so they are found
    in one pass along that order: a source stops if its share of what those
    before it leave would be above its limit.  The windows run over one row per
    source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("rank", rank).withColumn("weight", ((F.col("rank") - 1) % weights + 1).cast("long"))
    limit = F.col("source_size") * passes
    by_room = W.orderBy((F.col("source_size") * passes) / F.col("weight"), "rank")
    before, after = by_room.rowsBetween(W.unboundedPreceding, -1), by_room.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    per = per.withColumn("left", left).withColumn("room", F.sum("weight").over(after))
    per = per.withColumn("stops", F.col("left") * F.col("weight") > limit * F.col("room"))
    rest = W.partitionBy()
    shared = F.sum("source_size").over(rest) - F.coalesce(F.sum(F.when(F.col("stops"), limit)).over(rest), F.lit(0))
    of = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(rest)
    target = F.when(F.col("stops"), limit.cast("double")).otherwise(shared * F.col("weight") / of)
    return per.select("source", "rank", "source_size", "weight", target.alias("target"))


def _parts(dealt: DataFrame) -> DataFrame:
    """(rank, _part, _start, _s): the words of each part of a source, and those of the parts before."""
    sums = dealt.groupBy("rank", "_part").agg(F.sum("size").alias("_s"))
    before = W.partitionBy("rank").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return checkpointed(sums.select("rank", "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"), "_s"))


def _started(dealt: DataFrame, parts: DataFrame) -> DataFrame:
    """Documents with the place of their first word among their source's."""
    inside = W.partitionBy("rank", "_part").orderBy("key", "row").rowsBetween(W.unboundedPreceding, 0)
    return (dealt.withColumn("_end", F.sum("size").over(inside)).join(parts.select("rank", "_part", "_start"), ["rank", "_part"])
            .withColumn("start", F.col("_start") + F.col("_end") - F.col("size")).drop("_start", "_end"))


def _cut(block_words: int, words: Column | None = None) -> Column:
    """The pieces of a document at ``start``: (block, at, n), ``at`` the first of its ``n`` words there, and these words."""
    b, start, size = F.lit(block_words).cast("long"), F.col("start"), F.col("size")

    def piece(block):
        at = F.greatest(block * b - start, F.lit(0).cast("long"))
        n = F.least((block + 1) * b - start, size) - at
        own = [] if words is None else [F.array_join(F.slice(words, (at + 1).cast("int"), n.cast("int")), " ").alias("words")]
        return F.struct(block.alias("block"), at.alias("at"), n.alias("n"), *own)
    return F.transform(F.sequence(_div(start, block_words), _div(start + size - 1, block_words)), piece)


def pack(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Where each document's words lie once the words of its source stand in blocks of ``block_words``.

    One row for every document and block it reaches: (rank, start, block, at, n),
    ``at`` the first of its ``n`` words there.
    """
    return placed.filter("size > 0").select("rank", "start", F.inline(_cut(block_words)))


def _div(x: Column, by: int) -> Column:
    return F.floor((x - F.pmod(x, F.lit(by))) / by).cast("long")


def draw(sources: DataFrame, seed: int, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, passes: int = PASSES) -> DataFrame:
    """(shard, slot, rank, block): the output's slots, each with the block that fills it.

    Every output shard draws the sources of its slots independently, so its
    counts are multinomial.  The n-th slot of a source over all shards takes the
    n-th block of a pseudorandom permutation of the source's blocks, a new one in
    every pass.  A slot drawn after the last pass stays empty.  A slot finds its
    source by a guide: the unit interval in equal cells, each listing the
    sources that reach into it.
    """
    blocks = F.ceil(F.col("source_size") / block_words)
    reach = sources.filter("source_size > 0").withColumn("blocks", blocks).withColumn(
        "expected", F.col("target") * F.col("blocks") / F.col("source_size"))
    total = F.sum("expected").over(W.partitionBy())
    upto = F.sum("expected").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    spans = checkpointed(reach.select("rank", "blocks", ((upto - F.col("expected")) / total).alias("low"), (upto / total).alias("high"),
                                      (F.row_number().over(W.orderBy(F.desc("rank"))) == 1).alias("last"), total.alias("total")))
    row = spans.agg(F.max("total")).first()
    slots = round(row[0] or 0)
    cells = F.sequence(F.floor(F.col("low") * _GUIDES), F.least(F.floor(F.col("high") * _GUIDES), F.lit(_GUIDES - 1).cast("long")))
    guide = spans.select("rank", "blocks", "low", F.when(F.col("last"), F.lit(2.0)).otherwise(F.col("high")).alias("high"),
                         F.explode(cells).alias("cell"))
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    drawn = (sources.sparkSession.range(slots).withColumn("u", u).withColumn("cell", F.floor(F.col("u") * _GUIDES))
             .join(guide, "cell").filter("u >= low AND u < high")
             .select(_div(F.col("id"), shard_slots).alias("shard"), F.col("id").alias("slot"), "rank", "blocks"))
    counts = drawn.groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("rank", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.row_number().over(W.partitionBy("rank", "shard").orderBy("slot"))
    numbered = (drawn.withColumn("_number", number).join(starts, ["rank", "shard"])
                .withColumn("index", F.col("_start") + F.col("_number") - 1).filter(F.col("index") < F.col("blocks") * passes))
    turn = numbered.withColumn("_key", F.xxhash64("rank", F.floor(F.col("index") / F.col("blocks")), F.lit(seed)))
    return _permuted_rows(turn, F.pmod("index", "blocks"), "blocks", "_key", "block").select("shard", "slot", "rank", "block")


def permuted(x: Column, size: Column, key: Column) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0 .. size - 1 given by ``key``.

    Swap-or-not: in every round x and its mirror image about a round's point
    change places or not, by a bit that the larger of them decides.
    """
    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), x, lambda at, r: bind(_mirror(at, size, key, r), lambda m: _swapped(at, m, key, r)))


def _mirror(at: Column, size: Column, key: Column, r: Column) -> Column:
    # Never NULL, and known not to be: no test for it is pushed down through the rounds, doubling in each.
    return F.coalesce(F.pmod(F.pmod(F.xxhash64(key, r), size) - at, size), F.lit(0).cast("long"))


def _swapped(at: Column, mirror: Column, key: Column, r: Column) -> Column:
    return F.when(F.xxhash64(key, r, F.lit("swap"), F.greatest(at, mirror)) % 2 == 0, mirror).otherwise(at)


def _permuted_rows(rows: DataFrame, x: Column, size: str, key: str, name: str) -> DataFrame:
    """The rows with :func:`permuted` as ``name``, round by round in columns, which Spark compiles; functions of arrays it doesn't.

    To be joined by ``name`` or written, not filtered by it in the same plan: a filter is pushed down and doubles in every round.
    """
    rows = rows.withColumn(name, F.coalesce(x, F.lit(0).cast("long")))
    for r in range(1, _ROUNDS + 1):
        rows = rows.withColumn("_mirror", _mirror(F.col(name), F.col(size), F.col(key), F.lit(r)))
        rows = rows.withColumn(name, _swapped(F.col(name), F.col("_mirror"), F.col(key), F.lit(r)))
    return rows.drop("_mirror")


def _n_words(words: Column) -> Column:
    """How many words stand in ``words``, one blank between any two."""
    return F.when(words == "", 0).otherwise(F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("long")


def measure(docs: DataFrame, keep_words: bool = False) -> DataFrame:
    """(row, doc_id, source, size, key) of every document, and its words, a blank between, if they are to be mixed; stored."""
    kept = ["words"] if keep_words else []
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.xxhash64("doc_id", F.lit("order")).alias("key"), words.alias("words"))
    return stored(rows.select("row", "doc_id", "source", _n_words(F.col("words")).alias("size"), "key", *kept), "measured", "zstd")


def mix(rows: DataFrame, seed: int = 8, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(mixture, sources) of measured documents.

    ``mixture`` has the pieces that fill the slots: (shard, slot, rank, block, start,
    at, n), ``start`` the place of a document's first word in its source; if the
    documents have their words, the blocks that fill the slots, stored:
    (shard, slot, rank, parts), the parts' words in order being the block's.
    ``sources`` is :func:`source_targets`.

    Slots without words meet pieces on (source, block), a key of a few rows; with
    them they go to the parts that hold their words.  So a source that holds most
    of the words is spread like others.  Draws and permutations are hashes of
    positions, so reruns agree.
    """
    mixture, sources, _ = _mixed(rows, seed, block_words, shard_slots)
    return mixture, sources


def _mixed(rows: DataFrame, seed: int, block_words: int, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`mix`, and the measured documents, without words, with their ``rank`` and ``start``, stored."""
    measured = rows.drop("words")
    sources = checkpointed(source_targets(measured.select("source", "size")))

    # The documents of a source stand in an order by hash, in parts that are numbered from the words of the parts before.
    count = max(1, -(-measured.count() // _NUMBERED))

    def dealt(df: DataFrame) -> DataFrame:
        ranks = sources.select(F.col("source").alias("_source"), "rank")
        return df.join(ranks, F.expr("source <=> _source")).drop("source", "_source").withColumn("_part", F.pmod("key", F.lit(count)))

    parts = _parts(dealt(measured).filter("size > 0"))
    empty = dealt(measured).filter("size = 0").select("doc_id", "size", "rank", F.lit(None).cast("long").alias("start"))
    placed = stored(_started(dealt(measured).filter("size > 0"), parts).select("doc_id", "size", "rank", "start").union(empty), "placed")
    slots = draw(sources, seed, block_words, shard_slots)
    if "words" not in rows.columns:
        return slots.join(pack(placed, block_words), ["rank", "block"]), sources, placed
    return token_blocks(dealt(rows).filter("size > 0"), parts, slots, block_words), sources, placed


def token_blocks(dealt: DataFrame, parts: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(shard, slot, rank, parts): the slots with their blocks, as (start, words) in the order of ``start``; stored.

    Slots are sent to the words, not words to the slots: each goes to the part of
    its source that its block lies in, found by a guide that lists the parts
    reaching into equal spans of blocks.  There documents are numbered, cut, and
    put together with the slots on (source, part, block), in the one exchange in
    which words move.  A block that lies in several parts is written in pieces,
    few of all, and these are put together afterwards.
    """
    first, last = _div(F.col("_start"), block_words), _div(F.col("_start") + F.col("_s") - 1, block_words)
    reach = parts.select("rank", "_part", first.alias("_first"), last.alias("_last"))
    width = reach.groupBy("rank").agg((F.floor(F.max("_last") / F.count(F.lit(1))) + 1).alias("_width"))
    spans = F.sequence(F.floor(F.col("_first") / F.col("_width")), F.floor(F.col("_last") / F.col("_width")))
    guide = checkpointed(reach.join(width, "rank").withColumn("_span", F.explode(spans)))
    sent = (slots.join(guide.select("rank", "_width").distinct(), "rank")
            .withColumn("_span", F.coalesce(F.floor(F.col("block") / F.col("_width")), F.lit(0).cast("long")))
            .join(guide.drop("_width"), ["rank", "_span"]).filter("block BETWEEN _first AND _last"))
    none = lambda kind: F.lit(None).cast(kind)
    both = dealt.select("rank", "_part", "key", "row", "size", "words", none("long").alias("shard"), none("long").alias("slot"), none("long").alias("block")).union(
        sent.select("rank", "_part", none("long"), none("long"), F.lit(0).cast("long"), none("string"), "shard", "slot", "block"))
    # Slots have no key and no size: they come first in their part and count for nothing in its sums.
    at_start = _started(both.withColumnRenamed("block", "_of"), parts)
    pieces = F.when(F.col("words").isNull(), F.array(F.struct(F.col("_of").alias("block"), none("long").alias("at"), none("long").alias("n"), none("string").alias("words")))).otherwise(
        bind(F.split("words", " "), lambda w: _cut(block_words, w)))
    cut = at_start.select("rank", "_part", "start", "shard", "slot", F.inline(pieces))
    piece, slot = F.struct("start", "words"), F.struct("shard", "slot")
    whole = cut.groupBy("rank", "_part", "block").agg(F.sort_array(F.collect_list(F.when(F.col("words").isNotNull(), piece))).alias("parts"),
                                                      F.collect_list(F.when(F.col("slot").isNotNull(), slot)).alias("_slots"), F.coalesce(F.sum("n"), F.lit(0)).alias("_n"))
    # Short of words is also the last block of a source.
    filled = whole.select("rank", "parts", (F.col("_n") < block_words).alias("short"), F.inline("_slots")).select("shard", "slot", "rank", "parts", "short")
    written = stored(filled, "blocks", "zstd")
    mended = written.filter("short").groupBy("shard", "slot", "rank").agg(F.sort_array(F.flatten(F.collect_list("parts"))).alias("parts"))
    return written.filter("NOT short").drop("short").union(stored(mended, "mended", "zstd"))


def mix_documents(docs: DataFrame, seed: int = 8, block_words: int = BLOCK_WORDS, write_blocks: bool = True) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken``.

    The blocks of words are written to shared storage and ``taken`` is counted
    from what was written.  Without ``write_blocks`` the mix is drawn alike but
    only its index is made, for a caller that takes whole documents by it.

    ``taken`` counts the words of the document in the mix, repeats included; it is
    at most ``PASSES`` times its size.  Sizes are words (runs without blanks),
    0 for a NULL text.  A NULL source is a source.  Rows with one doc_id are
    documents of their own.  An empty table gives no rows.
    """
    mixture, sources, placed = _mixed(measure(docs, keep_words=write_blocks), seed, block_words)
    if write_blocks:
        mixture = mixture.select("rank", F.inline("parts")).select("rank", "start", _n_words(F.col("words")).alias("n"))
    taken = mixture.groupBy("rank", "start").agg(F.sum("n").alias("taken"))
    facts = sources.select("rank", "source", "source_size", "target")
    return (placed.join(taken, ["rank", "start"], "left").join(facts, "rank")
            .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")))
