"""Shards by a k-d tree over metadata: every split at a weighted quantile of the widest dimension."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from freshet.llm.base import stored

#: Bins of one histogram, a power of two; a cut is searched by histograms in histograms.
_BIN_BITS = 10
#: A cut may leave this share of its node's weight on the wrong side.
_TOLERANCE = 1 / 4000
_STATE = {"_node": "int", "measured": "int", "low": "long", "high": "long", "bits": "int", "dimension": "int", "value": "long"}
#: Rows numbered together when slots are given out.
_NUMBERED = 4_000


@dataclass
class Node:
    """``shards`` shards from ``first`` on; a node of several is cut in two."""
    first: int
    shards: int
    dimension: str | None = None
    value: int = 0
    tie: int = 0
    children: list[Node] = field(default_factory=list)

    def below(self) -> Column:
        """Whether a row goes to the first child."""
        by_tie = F.col("_tie") < self.tie
        if self.dimension is None:
            return by_tie
        d = F.col(self.dimension)
        return (d < self.value) | ((d == self.value) & by_tie)

    def place(self) -> Column:
        """The ``first`` of the leaf a row falls into, as the tree stands."""
        if not self.children:
            return F.lit(self.first)
        return F.when(self.below(), self.children[0].place()).otherwise(self.children[1].place())

    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]


def text_code(text: Column) -> Column:
    """The first seven bytes of a text as a number that sorts like them; NULL sorts first."""
    padded = F.substring(F.concat(F.encode(text, "UTF-8"), F.lit(bytes(7))), 1, 7)
    return F.coalesce(F.conv(F.hex(padded), 16, 10).cast("long"), F.lit(-1))


@dataclass
class _Search:
    """Where the cut of a node lies: values in [low, high], ``before`` weight under them."""
    node: Node
    dimension: str | None
    low: int
    high: int
    goal: float
    weight: int
    before: int = 0
    value: int | None = None  # of the dimension, once ties are being cut

    def bits(self) -> int:
        return max((self.high - self.low).bit_length() - _BIN_BITS, 0)

    def state(self, dimensions: list[str]) -> tuple:
        """What a row of the node is measured by, between which values, in which bins, and the value it must have."""
        of = dimensions.index(self.dimension) + 1 if self.dimension else 1
        return (self.node.first, len(dimensions) + 1 if self.measuring_tie() else of, self.low, self.high, self.bits(), of, self.value)

    def narrow(self, bins: dict[int, int]) -> bool:
        """Take in a histogram; True when the cut is found and noted in the node."""
        at = self.before
        for k in sorted(bins):
            if at + bins[k] >= self.goal:
                break
            at += bins[k]
        step = self.bits()
        low = self.low + (k << step)
        high = min(self.high, low + (1 << step) - 1)
        if bins[k] <= _TOLERANCE * self.weight or (step == 0 and self.measuring_tie()):
            cut = high + 1 if at + bins[k] - self.goal < self.goal - at else low
            self.node.dimension = self.dimension
            if self.measuring_tie():
                self.node.value, self.node.tie = self.value or 0, cut
            else:
                self.node.value, self.node.tie = cut, 0
            return True
        if step == 0:  # one value holds too much: cut it by the tie
            self.value, self.low, self.high, self.before = low, 0, (1 << 63) - 1, at
        else:
            self.low, self.high, self.before = low, high, at
        return False

    def measuring_tie(self) -> bool:
        return self.value is not None or self.dimension is None


def _table(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    """A few rows as a table made in the JVM."""
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(*[F.lit(v).cast(kind).alias(n) for v, (n, kind) in zip(row, columns.items())]) for row in rows])))


def grow_tree(rows: DataFrame, dimensions: list[str], weight: str, shards: int) -> Node:
    """The tree of ``shards`` leaves over rows with long ``dimensions`` and a long ``_tie`` of 0 or more.

    All nodes of a level are cut together.  One job finds their weights and
    ranges; a node's widest dimension is the one that spans the largest part of
    its range over all rows.  Further jobs count weights in 1024 bins each around
    the cuts until the bin of a cut is small.  A node of an odd number of leaves
    is cut in proportion.  The driver sees at most 1024 numbers for each node.
    """
    root, whole = Node(0, shards), None
    while open_nodes := [x for x in root.leaves() if x.shards > 1]:
        placed = rows.withColumn("_node", root.place())
        found = {r["_node"]: r for r in placed.groupBy("_node").agg(
            F.sum(weight).alias("_weight"), *[f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        if whole is None:
            whole = found.get(0)
        searches = []
        for node in open_nodes:
            r = found.get(node.first)
            if r is not None and r["_weight"]:
                spans = {d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / max(whole[f"hi_{d}"] - whole[f"lo_{d}"], 1) for d in dimensions}
                d = max(spans, key=spans.get)  # the first of equally wide ones
                goal = r["_weight"] * (node.shards // 2) / node.shards
                searches.append(_Search(node, d, r[f"lo_{d}"], r[f"hi_{d}"], goal, r["_weight"]) if spans[d] > 0
                                else _Search(node, None, 0, (1 << 63) - 1, goal, r["_weight"]))
        while searches:
            # The cuts being searched are a table of a row for each node, so all rounds run the same code.
            states = _table(rows.sparkSession, [s.state(dimensions) for s in searches], _STATE)
            values = F.array(*dimensions, "_tie")
            at = F.element_at(values, F.col("measured"))
            fits = at.between(F.col("low"), F.col("high")) & (F.col("value").isNull() | (F.element_at(values, F.col("dimension")) == F.col("value")))
            inside = placed.join(F.broadcast(states), "_node").filter(fits)
            counted = inside.select("_node", F.call_function("shiftright", at - F.col("low"), F.col("bits")).alias("_bin"), weight).groupBy(
                "_node", "_bin").agg(F.sum(weight).alias("w"))
            by_node: dict[int, dict[int, int]] = {}
            for r in counted.collect():
                by_node.setdefault(r["_node"], {})[r["_bin"]] = r["w"]
            searches = [s for s in searches if not s.narrow(by_node[s.node.first])]
        for node in open_nodes:
            left = node.shards // 2
            node.children = [Node(node.first, left), Node(node.first + left, node.shards - left)]
    return root


def with_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2 ... within each shard, without one task numbering a shard.

    Every shard is dealt over parts by the tie; a part's rows are numbered from
    the number of rows in the parts before it.
    """
    total = rows.count()
    parts = max(1, -(-total // _NUMBERED))
    dealt = rows.withColumn("_part", F.pmod("_tie", F.lit(parts)))
    sizes = dealt.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(shard).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.row_number().over(W.partitionBy(shard, "_part").orderBy(*order))
    return (dealt.withColumn("_number", number).join(starts, [shard, "_part"])
            .withColumn("slot", (F.col("_start") + F.col("_number") - 1).cast("long")).drop("_part", "_number", "_start"))


def _measures(docs: DataFrame) -> dict[str, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    number = F.coalesce(F.col("n_chars").cast("long"), F.lit(-1)) if "n_chars" in docs.columns else F.length(text).cast("long")
    out = {"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(F.encode(text, "UTF-8")),
           "_d_chars": number, "_d_id": F.coalesce("doc_id", F.lit(-1))}
    out |= {f"_d_{c}": text_code(F.col(c)) if c in docs.columns else F.lit(-1).cast("long") for c in ("source", "lang")}
    return out | {"_tie": F.shiftrightunsigned(F.xxhash64("doc_id", out["text_crc32"], out["_d_source"]), 1)}


#: Copies of a row written out together.
_COPIES = 1_000


def _told_apart(rows: DataFrame) -> DataFrame:
    """The same rows with a ``_tie`` of its own for every copy of equal ones.

    Equal rows are counted and written out again by their number, in runs of
    ``_COPIES`` that are dealt over the tasks, so no task holds all copies of a row
    and a rerun gives the same ties.
    """
    columns = [c for c in rows.columns if c != "_tie"]
    counted = stored(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies")), "counted")
    runs = counted.filter("_copies > 1").withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(_COPIES).cast("long"))))
    copy = F.explode(F.sequence("_from", F.least(F.col("_from") + _COPIES, F.col("_copies")) - 1))
    copies = runs.repartition("_tie", "_from").withColumn("_copy", copy)
    apart = F.shiftrightunsigned(F.xxhash64("_tie", "_copy"), 1)
    return stored(counted.filter("_copies = 1").select(*columns, "_tie").union(copies.select(*columns, apart.alias("_tie"))), "apart")


DIMENSIONS = ["_d_source", "_d_lang", "_d_chars", "_d_id"]


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    The law is ``bytes``: shards of near equal size, in UTF-8 bytes of the text
    plus 8.  The dimensions are source, language, characters and doc_id; NULLs
    sort before all values, and a NULL text is empty.  A value that holds too
    much of a node, such as a hot source, is cut by a hash of the row, in which
    rows that are equal have numbers, so any two rows can be parted.  Slots go by
    doc_id within parts dealt by that hash.
    ``grown_shard`` is NULL under this law.  An empty table gives no rows.
    """
    rows = _told_apart(docs.select("doc_id", *[c.alias(n) for n, c in _measures(docs).items()]))
    tree = grow_tree(rows, DIMENSIONS, "size", shards)
    placed = rows.withColumn("shard", tree.place())
    return with_slots(placed, "shard", ["doc_id", "text_crc32", "size", "_tie"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The documents with all their columns, and ``shard`` and ``slot``, which replace columns of these names.

    Rows equal in doc_id, text and source stay together here.
    """
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    docs = docs.select(*columns)
    measures = _measures(docs)
    tree = grow_tree(stored(docs.select(*[c.alias(n) for n, c in measures.items()]), "measured"), DIMENSIONS, "size", shards)
    # The measures go in a column of their own beside the documents, so that no name can clash.
    rows = docs.select(F.struct(*columns).alias("document"), F.col("doc_id").alias("_id"), *[c.alias(n) for n, c in measures.items()])
    placed = with_slots(rows.withColumn("shard", tree.place()), "shard", ["_id", "text_crc32", "size"])
    return placed.select("document.*", "shard", "slot")
