"""The corpus queries against their SQL, and what every query owes its contract."""

import hashlib
import zlib

import pytest

from compare import compare, connect
from freshet.llm import queries

NAMES = sorted(queries.QUERIES)


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, con, folder, name):
    assert compare(spark, con, folder, name, queries.QUERIES[name], queries.SQL[name]) is None


@pytest.mark.parametrize("name", ["op2_likelihood_ratio", "op4_fuzzy_lines", "op6_string_kernel", "op7_kd_tree",
                                  "op8_multinomial_mix", "op9_secret_spans"])
def test_row_per_document(spark, folder, name):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in queries.QUERIES[name](spark, folder).select("doc_id").collect()) == ids


def test_entry_has_all(spark):
    import __spark_entry__ as entry
    have = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in have if n.startswith("op")} == set(range(1, 14)) and "pipeline" in have
    assert set(entry.oracle_sql()) <= set(have)


def test_shards_of_query(spark, folder):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.QUERIES["op7_kd_tree"](spark, folder).collect():
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)


def test_planted_conversation(spark, folder):
    row = queries.QUERIES["op1_prefix_targets"](spark, folder).filter("conv_id = -7").first()
    text = r"\### Assistant: </turn> ok"
    said = "".join(f"{role}\n{text}\n" for role in ("user", "assistant"))
    assert row.n_turns == 2 and row.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.loss_chars == len(text) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
