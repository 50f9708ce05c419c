import contextlib
import io
import random

from pyspark.sql import functions as F

from freshet.llm import mixture


def rows_of(rng, n):
    rows = [(k, "  ".join(f"{k}.{j}" for j in range(rng.randint(0, 30))) + "\n", None, rng.choice(["a", "a", "b", None])) for k in range(n)]
    return rows + [(3, rows[3][1], None, rows[3][3]), (3, "another text", None, "a"), (None, None, None, "b")]


def test_words_move_once(documents, monkeypatch):
    """Of the plan that writes the blocks only one exchange has the words, as they are or as what a list of them is gathered in."""
    plans, real = {}, mixture.stored

    def seen(df, name, *more):
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            df.explain("formatted")
        plans[name] = plan.getvalue()
        return real(df, name, *more)

    monkeypatch.setattr(mixture, "stored", seen)
    mixture.mix_documents(documents(rows_of(random.Random(1), 50))).count()
    steps = plans["blocks"].split("\n\n")
    assert sum(") Exchange" in step and ("words#" in step or "buf#" in step) for step in steps) == 1


def test_blocks_across_parts(documents, monkeypatch):
    """Blocks that lie in several parts are whole, each slot is filled once, and the index alone gives the same mix."""
    monkeypatch.setattr(mixture, "_NUMBERED", 5)
    docs = documents(rows_of(random.Random(2), 60))
    mix, sources = mixture.mix(mixture.measure(docs, keep_words=True), block_words=8, shard_slots=16)
    filled = mix.collect()
    assert len({(b.shard, b.slot) for b in filled}) == len(filled)
    blocks = [(b["rank"], tuple(" ".join(p.words for p in b.parts).split(" "))) for b in filled]
    sizes = {r["rank"]: r.source_size for r in sources.collect()}
    short = {b for b in blocks if len(b[1]) < 8}
    assert all(len(b[1]) <= 8 for b in blocks) and len({rank for rank, _ in short}) == len(short)
    assert all(len(words) == sizes[rank] % 8 for rank, words in short)
    for b in filled:  # a part's words are those of one document, in order
        for p in b.parts:
            x = [w.split(".") for w in p.words.split(" ") if "." in w]
            assert all(u[0] == v[0] and int(v[1]) == int(u[1]) + 1 for u, v in zip(x, x[1:]))
    one, two = (sorted(map(tuple, mixture.mix_documents(docs, write_blocks=w).collect()), key=repr) for w in (True, False))
    assert one == two and sum(r[-1] for r in one) > 0


def test_permutation_by_rows(spark):
    rows = spark.range(100).select("id", F.lit(100).cast("long").alias("n"), F.lit(5).cast("long").alias("k"))
    by_rows = {r.id: r.x for r in mixture._permuted_rows(rows, F.col("id"), "n", "k", "x").collect()}
    assert by_rows == {r.id: r.x for r in rows.select("id", mixture.permuted(F.col("id"), F.col("n"), F.col("k")).alias("x")).collect()}
    assert sorted(by_rows.values()) == list(range(100))
