"""What the corpus operators share: words, shared storage, salted joins, components."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shipped_by_value(module: str) -> None:
    """Send the module's functions to tasks with the plan, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def blank_words(text: Column) -> Column:
    """The runs of characters other than blanks (0x20, 0x09-0x0D); none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def bind(value: Column, then) -> Column:
    """Work out ``value`` once per row and hand it to ``then`` under a name."""
    return F.transform(F.array(value), then)[0]


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Rows of a batch that plans made inside, and run there, send to Python: few where rows are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session.

    Read from ``spark.checkpoint.dir``.  Only a session on one machine may go
    without: it gets a temporary folder, since driver and tasks share the disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="freshet-llm-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Run the plan and keep its rows, a narrow table, in shared storage.

    Written by two tasks for each core of the cluster, so that the folder doesn't
    fill with tiny files.  A written table also tells the optimizer its true size;
    a checkpoint would hand on an estimate that grows with every round of a loop.
    """
    return stored(df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism), "narrow")


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Run the plan into a Parquet table in shared storage, for large tables read by column; ``codec`` as Parquet's, the session's by default."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SALTS = 16


def salted_join(df: DataFrame, per_key: DataFrame, keys: list[str], spread: str, how: str = "inner") -> DataFrame:
    """Join one row per key onto many rows, the rows of a key spread over ``SALTS`` pieces by the column ``spread``."""
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    left = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread), F.lit("salt")), F.lit(SALTS)))
    return left.join(per_key.withColumn("_salt", F.explode(salts)), [*keys, "_salt"], how).drop("_salt")


def in_blocks(rows: DataFrame, look, schema: str) -> DataFrame:
    """Apply ``look`` to the rows of every (key, lo, hi), as a dict of arrays; it returns a frame of ``schema``.

    The rows of a block stand together in a task, which takes block after block
    from its batches; most blocks are tiny, so this spares a call of Spark's for
    each.
    """
    names = ["key", "lo", "hi"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for batch in batches:
            batch = batch if left is None else pd.concat([left, batch], ignore_index=True)
            ids = batch[names].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)])) if len(ids) else []
            columns = {c: batch[c].to_numpy() for c in batch.columns}
            found = [look({c: v[a:b] for c, v in columns.items()}) for a, b in zip(starts, starts[1:])]
            left = batch.iloc[starts[-1]:] if len(starts) else batch
            found = [f for f in found if len(f)]
            if found:
                yield pd.concat(found, ignore_index=True)
        if left is not None and len(left):
            found = look({c: left[c].to_numpy() for c in left.columns})
            if len(found):
                yield found

    return rows.repartition(*names).sortWithinPartitions(*names).mapInPandas(run, schema)


#: Rows of one side of a comparison block.
BLOCK = 256


def comparison_blocks(placed: DataFrame) -> DataFrame:
    """Members (key, rep, comp and more) of buckets, each row once for every block it has to be compared with.

    Buckets whose members are all of one component are left out.  The columns
    ``own``, ``lo`` and ``hi`` name the row's block and the two of the comparison.
    A component with many rows in a bucket has blocks of its own, which need no
    comparison among themselves; the rows of the small components share blocks.
    Every block has about ``BLOCK`` rows, so no task holds a bucket.
    """
    settled = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
    members = checkpointed(placed.join(settled, "key"))
    columns = members.columns
    sizes = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    large = F.when(F.col("c") >= BLOCK, F.col("comp"))
    parts = (sizes.groupBy("key", large.alias("pure")).agg(F.sum("c").alias("c"))
             .withColumn("k", F.ceil(F.col("c") / BLOCK)))
    blocks = (parts.select("key", "pure", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"))
              .select("key", F.col("pure").alias("_pure"), F.xxhash64("pure", "i", F.col("pure").isNull()).alias("_block")))
    own = (members.join(sizes.select("key", "comp", large.alias("pure")), ["key", "comp"])
           .join(parts.select(F.col("key").alias("_key"), F.col("pure").alias("_p"), "k"), F.expr("key = _key AND pure <=> _p"))
           .withColumn("own", F.xxhash64("pure", F.pmod(F.xxhash64("rep"), F.col("k")), F.col("pure").isNull())))
    spread = own.select(*columns, "pure", "own").join(blocks, "key").filter("pure IS NULL OR NOT pure <=> _pure")
    return spread.select(*columns, "own", F.least("own", "_block").alias("lo"), F.greatest("own", "_block").alias("hi"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of the edges reaches.

    Alternates two rewritings of the edge list until it no longer changes: every
    node's larger neighbours are tied to its smallest neighbour, then every
    node's smaller neighbours likewise.  Each is one grouped minimum and one
    join; a chain halves in each round, so rounds grow with the logarithm of its
    length.  The neighbours of one node are never gathered, and each round is
    checkpointed so that a lost executor costs one round.  Nodes are longs.
    """
    pairs = checkpointed(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        # Large star: the larger neighbours of every node go to its smallest neighbour or itself.
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _star(both, low).filter("v > u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of these.
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (_star(down, least).select(F.col("m").alias("u"), "v").filter("u <> v")
                 .union(least.select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct())
        pairs = checkpointed(small)
        row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if row == seen:
            break
        seen = row
    return (pairs.select(F.col("v").alias("node"), F.col("u").alias("component"))
            .union(pairs.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()))


def _star(pairs: DataFrame, low: DataFrame) -> DataFrame:
    """Each pair with the smallest neighbour of its first node."""
    return salted_join(pairs, low, ["u"], "v").select("u", "v", "m")
