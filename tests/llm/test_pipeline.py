"""The pipeline's stages against brute force, each on its own input."""

import random

import pytest

import brute
import corpus_pipeline as pipeline
from test_corpus_operators import changed, plain_hits, prose
from test_text_operators import spoken


@pytest.fixture
def tables(spark, landing):
    """A folder with a benchmark of three items."""
    rng = random.Random(21)
    items = [(k, prose(rng, 25)) for k in range(3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{landing}/benchmark.parquet")
    return landing, items


CLASHING = ("doc_id long, text string, lang string, source string, n_chars long, shard string, key string, document string, "
            "row int, size int, slot string, id string, n string, copies int")


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, l, s, None, "a", "b", "c", 1, 2, "d", "e", "f", 9) for i, t, l, s in rows], CLASHING)


def rows_of(rng, items):
    rows = [(k, spoken(rng.choice(["en", "de"]), rng, 60), rng.choice(["en", "de"]), rng.choice("abc")) for k in range(80)]
    rows += [(100 + k, changed(rng, rows[k % 5][1], .01), "en", "a") for k in range(20)]
    rows += [(200 + k, rows[7][1], "en", None) for k in range(10)]
    rows += [(300 + k, prose(rng, 20) + " " + items[k % 3][1] + " " + prose(rng, 10), "en", "b") for k in range(6)]
    return rows + [(400, None, "en", "a"), (401, "", None, None), (402, "12 -- 7", "de", "a"), (7, rows[7][1], "en", "a"), (None, "a text alone", "en", "c")]


def test_stages(spark, tables):
    folder, items = tables
    rng = random.Random(22)
    rows = rows_of(rng, items)
    docs = clashing(spark, rows)
    text = {i: t for i, t, _, _ in rows}

    known = pipeline.keep_languages(spark, docs, folder)
    assert known.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in known.collect()) == sorted(i or -1 for i, t, _, _ in rows if t and any(c.isalpha() for c in t))

    one = pipeline.drop_near_copies(spark, docs, folder)
    assert one.columns == docs.columns
    want = brute.near_copies([(i, t) for i, t in text.items() if i is not None], 5, 80)
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == sorted(i for i, (_, c) in want.items() if i == c)
    assert sum(r.doc_id is None for r in one.collect()) == 1

    clean = pipeline.drop_benchmark_passages(spark, docs, folder)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in clean.collect()) == sorted(i or -1 for i, t, _, _ in rows if not plain_hits(t, items)[1])

    mixed = pipeline.mix_sources(spark, docs, folder)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    times = {}
    for r in got:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(n <= 3 * (2 if i == 7 else 1) for i, n in times.items()) and times[400] == 1
    assert sorted(map(str, got)) == sorted(map(str, pipeline.mix_sources(spark, docs, folder).collect()))

    placed = pipeline.shard(spark, docs, folder)
    assert sorted(placed.columns) == sorted(docs.columns)
    got = placed.collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.text == text[r.doc_id]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_stages_of_no_documents(spark, tables):
    folder, _ = tables
    none = clashing(spark, [])
    for name, stage in pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.collect() == [] and set(out.columns) >= set(none.columns), name


def test_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = pipeline.run(spark, folder)
    assert out.columns == [*docs.columns, "shard", "slot"]
    got = out.collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert got and all(r.text == text[r.doc_id] for r in got)
    want = brute.near_copies([(i, text[i]) for i in {r.doc_id for r in got}], 5, 80)
    assert all(i == c for i, (_, c) in want.items())
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_copies", "benchmark", "mixture", "shards"]
