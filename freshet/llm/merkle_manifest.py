"""A Merkle manifest of a dataset: a tree per group, a tree over the groups' roots, and proofs that fold.

A node is the SHA-256 of its children's digests as lowercase hex, ``arity``
consecutive children to a parent, a last run with fewer, even a single one.  A
parent keeps a copy of its hash state before each child slot.  A changed child
is folded by resuming the state of its slot with the replacement and the
siblings to its right; what stands left of it is not hashed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from freshet.llm.base import shipped_by_value, stored

shipped_by_value(__name__)

ARITY = 2
#: Most nodes that a task holds of one tree at once; their paths meet the rest of the tree by a join.
BLOCK_NODES = 4096
#: A level on the way up: the digests left and right of the node, concatenated.
_PATH = "array<struct<left:string,right:string>>"
#: Copies of the table of groups that the leaves meet.
_SALTS = 64
_PROVED = "row string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(*values: Column) -> Column:
    """H of the values: ``-`` for NULL, else the UTF-8 byte count, ``:`` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
             for v in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The rows with ``pos``, their place from 0 within their group, and ``size``, the rows of the group.

    Rows are dealt by ranges of (group, order), equal ones too, and sorted there.
    A range's rows get their places from the counts of the ranges before, a table
    with a row for each range and group in it, so no group goes through one task.
    """
    ranked = [*[F.col(g).asc_nulls_first() for g in group], *order]
    dealt = rows.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(*ranked, "_any")
    kept = (dealt.sortWithinPartitions(*ranked, "_any").drop("_any")
            .withColumn("_range", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    kept = stored(kept, "ranges")
    sizes = kept.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_c"), F.min("_i").alias("_first"))
    whole = W.partitionBy(*group)
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g_{g}") for g in group],
                         (before - F.col("_first")).alias("_shift"), F.sum("_c").over(whole).alias("size"))
    same = F.col("_range") == F.col("_r")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return kept.join(sizes, same).withColumn("pos", F.col("_i") + F.col("_shift")).select(*rows.columns, "pos", "size")


def levels_of(size: int, arity: int) -> int:
    """Levels above the leaves of a tree of ``size`` leaves."""
    n = 0
    while size > 1:
        size, n = -(-size // arity), n + 1
    return n


def climb(digests: list[str], levels: int, arity: int) -> tuple[list[list[str]], list[list[list]]]:
    """All digests level by level, and for every parent its copied hash states, one before each child slot."""
    nodes, states = [digests], []
    for _ in range(levels):
        below, above, kept = nodes[-1], [], []
        for first in range(0, len(below), arity):
            state, slots = hashlib.sha256(), []
            for child in below[first:first + arity]:
                slots.append(state.copy())
                state.update(child.encode())
            kept.append(slots)
            above.append(state.hexdigest())
        nodes.append(above)
        states.append(kept)
    return nodes, states


def resumed(state, replacement: str, right: bytes) -> str:
    """The parent's digest: its state before the slot goes on with the replacement and the siblings to the right."""
    state = state.copy()
    state.update(replacement.encode())
    state.update(right)
    return state.hexdigest()


def path_in(nodes: list[list[str]], at: int, arity: int) -> list[tuple[str, str]]:
    """The siblings left and right of node ``at`` and of its ancestors."""
    path = []
    for below in nodes[:-1]:
        first, slot = at - at % arity, at % arity
        run = below[first:first + arity]
        path.append(("".join(run[:slot]), "".join(run[slot + 1:])))
        at //= arity
    return path


def _by_block(rows: DataFrame, look, schema: str) -> DataFrame:
    """Apply ``look`` to the rows of every (tree, block) in the order of ``pos``; a block is bounded, so its rows are held."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for batch in batches:
            batch = batch if left is None else pd.concat([left, batch], ignore_index=True)
            if not len(batch):
                continue
            new = (batch[["tree", "block"]] != batch[["tree", "block"]].shift()).any(axis=1).to_numpy().nonzero()[0]
            found = [look(batch.iloc[a:b]) for a, b in zip(new, new[1:])]
            left = batch.iloc[new[-1]:]
            if found:
                yield pd.concat(found, ignore_index=True)
        if left is not None and len(left):
            yield look(left)

    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInPandas(run, schema)


def _placed(nodes: DataFrame, wide: int, levels: int) -> DataFrame:
    """Nodes (tree, pos, digest, height) with their block and the levels it climbs; ``height`` levels are left above them."""
    return nodes.withColumn("block", F.floor(F.col("pos") / wide).cast("long")).withColumn("up", F.least("height", F.lit(levels)))


class Forest:
    """The trees over nodes (tree, pos, digest, height): their roots, and the path from every block of leaves up.

    Whole blocks of nodes become their tops, the tops are the next round's nodes,
    until every tree has one block.  Then the paths come down: a node's path is
    the one inside its block, followed by its block's.  Every round has the rows
    of the one below divided by the block's width.
    """

    def __init__(self, nodes: DataFrame, arity: int, block: int):
        self.arity, self.levels, self.wide = arity, 1, arity
        while self.wide * arity <= block:
            self.wide, self.levels = self.wide * arity, self.levels + 1
        self.rounds = [nodes]
        tallest = nodes.agg(F.max("height")).first()[0] or 0
        while tallest > 0:
            self.rounds.append(stored(self._tops(self.rounds[-1]), "tops"))
            tallest -= self.levels

    def _tops(self, nodes: DataFrame) -> DataFrame:
        arity = self.arity

        def top(rows: pd.DataFrame) -> pd.DataFrame:
            up = int(rows["up"].iloc[0])
            made, _ = climb(rows["digest"].tolist(), up, arity)
            return pd.DataFrame({"tree": rows["tree"].iloc[:1], "pos": rows["block"].iloc[:1], "digest": made[-1][:1],
                                 "height": rows["height"].iloc[:1] - up})

        # A tree that is done stays as it is: its root is its only node.
        return _by_block(_placed(nodes.select("tree", "pos", "digest", "height"), self.wide, self.levels), top,
                         "tree long, pos long, digest string, height int")

    def roots(self) -> DataFrame:
        """(tree, root)"""
        return self.rounds[-1].select("tree", F.col("digest").alias("root"))

    def paths(self, down_to: int) -> DataFrame:
        """(tree, pos, path) of the nodes of round ``down_to``, up to their tree's root."""
        last = len(self.rounds) - 1
        found = self.rounds[last].select("tree", "pos", F.array().cast(_PATH).alias("path"))
        arity = self.arity
        for r in range(last - 1, down_to - 1, -1):
            def inside(rows: pd.DataFrame) -> pd.DataFrame:
                made, _ = climb(rows["digest"].tolist(), int(rows["up"].iloc[0]), arity)
                return pd.DataFrame({"tree": rows["tree"], "pos": rows["pos"], "block": rows["block"],
                                     "inner": [path_in(made, i, arity) for i in range(len(rows))]})

            nodes = _placed(self.rounds[r].select("tree", "pos", "digest", "height"), self.wide, self.levels)
            inner = _by_block(nodes, inside, f"tree long, pos long, block long, inner {_PATH}")
            found = inner.join(found.withColumnsRenamed({"pos": "block"}), ["tree", "block"]).select(
                "tree", "pos", F.concat("inner", "path").alias("path"))
        return found


def prove(leaves: DataFrame, arity: int = ARITY, block: int = BLOCK_NODES) -> DataFrame:
    """Fold every leaf, as it is now, to the root of the manifest over the leaves as they were.

    ``leaves`` has (row, group, at, leaf, now): ``row`` a text the caller knows
    the row by, ``group`` the tree it belongs to, ``at`` its order there, the
    digest as the manifest has it and the digest to check.  Trees take their
    leaves by ``at`` (NULL first, ties by digests, repeated rows each a leaf of
    their own); the groups' roots, by group in code-point order with NULL first,
    are the leaves of the last tree.  Returns ``row``, ``leaf``, ``subroot``,
    ``root``, ``proof_sha256`` (H of all siblings on the way, from below, each
    level from left to right), ``folded_root`` and ``verified``.  An empty table
    gives no rows.  Texts of any length count by their digests only; columns
    other than the five are left out.
    """
    rows = numbered(leaves.select("row", "group", "at", "leaf", "now"), ["group"],
                    [F.col("at").asc_nulls_first(), F.col("leaf"), F.col("now")])
    groups = numbered(rows.filter("pos = 0").select("group", F.col("size").alias("n")), [], [F.col("group").asc_nulls_first()])
    groups = stored(groups.select(F.col("group").alias("_g"), F.col("pos").alias("tree"),
                                  _height(F.col("n"), arity).alias("height")), "groups")
    # The groups' numbers reach the leaves over a salt, as one group may have most rows.
    salts = F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))
    salted = groups.withColumn("_s", F.explode(salts))
    rows = rows.withColumn("_salt", F.col("pos") % _SALTS)
    nodes = stored(rows.join(salted, F.col("group").eqNullSafe(F.col("_g")) & (F.col("_salt") == F.col("_s")))
                   .select("row", "tree", "pos", F.col("leaf").alias("digest"), "now", "height"), "leaves")

    trees = Forest(nodes, arity, block)
    subroots = trees.roots()
    n = groups.count()
    whole = Forest(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("root").alias("digest"),
                                   F.lit(levels_of(n, arity)).cast("int").alias("height")), arity, block)
    above = subroots.join(whole.paths(0).select(F.col("pos").alias("tree"), F.col("path").alias("over")), "tree")
    top = whole.roots().first()

    # What a block of leaves needs of the rest: a row that stands before its leaves.
    blocks = trees.paths(1) if len(trees.rounds) > 1 else nodes.select("tree", "pos", F.array().cast(_PATH).alias("path"))
    blocks = blocks.join(above, "tree").select(
        "tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", "over", "root",
        F.lit(top.root if top else None).alias("whole"))
    placed = _placed(nodes, trees.wide, trees.levels)
    both = placed.unionByName(blocks, allowMissingColumns=True)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        head, rows = rows.iloc[0], rows.iloc[1:]
        nodes, states = climb(rows["digest"].tolist(), int(rows["up"].iloc[0]), arity)
        # The block's way up is the same for all its leaves: its states are made once and resumed by each.
        up = [(s["left"], s["right"]) for s in (*head["path"], *head["over"])]
        over = [(hashlib.sha256(left.encode()), right.encode()) for left, right in up]
        rest = "".join(left + right for left, right in up)
        out = []
        for i, (row, leaf, now) in enumerate(zip(rows["row"], rows["digest"], rows["now"])):
            digest, at = now, i
            for below, kept in zip(nodes, states):
                parent, slot = divmod(at, arity)
                digest = resumed(kept[parent][slot], digest, "".join(below[at + 1:(parent + 1) * arity]).encode())
                at = parent
            for state, right in over:
                digest = resumed(state, digest, right)
            proof = "".join(left + right for left, right in path_in(nodes, i, arity)) + rest
            out.append((row, leaf, head["root"], head["whole"], hashlib.sha256(proof.encode()).hexdigest(), digest,
                        digest == head["whole"]))
        return pd.DataFrame(out, columns=["row", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return _by_block(both, fold, _PROVED)


def _height(n: Column, arity: int) -> Column:
    """``levels_of`` for a column of sizes below 2^62."""
    powers = [arity ** k for k in range(1, 63) if arity ** k < 1 << 62]
    return sum((F.when(n > p, 1).otherwise(0) for p in powers), F.when(n > 1, 1).otherwise(0)).cast("int")


def prove_documents(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` by language, checked against documents of which some were tampered with.

    A leaf is the digest of doc_id, source, lang, n_chars and text.  Rows whose
    doc_id, as text, has a crc32 that 7 divides count one character more now
    (a NULL count or doc_id stays).  NULLs in any column count as ``-``; repeated
    rows are leaves of their own; further columns, of whatever name, are not in
    the digest.
    """
    digest = lambda n: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    leaves = docs.select(F.col("doc_id").cast("string").alias("row"), F.col("lang").alias("group"), F.col("doc_id").alias("at"),
                         digest(F.col("n_chars")).alias("leaf"), struck.alias("_struck"),
                         F.when(struck, digest(F.col("n_chars") + 1)).alias("_now"))
    leaves = leaves.select("row", "group", "at", "leaf", F.coalesce("_now", "leaf").alias("now"))
    kind = dict(docs.dtypes)["doc_id"]
    return prove(leaves).select(F.col("row").cast(kind).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
