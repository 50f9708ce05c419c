"""Faults found in earlier rounds, each by a small case."""

import pytest

from freshet.llm import language_id, line_dedup, secret_scan


@pytest.mark.parametrize("run", ["a-" * 100_000 + "1", "a/=" * 50_000, "password=" + "x" * 10 ** 5])
def test_long_runs_are_scanned(spark, documents, run):
    got = secret_scan.summary(secret_scan.scan_secrets(documents([(1, run, "en", "web")]).select("doc_id", "text"))).first()
    assert got.n_assign == run.startswith("password=")


def test_lines_that_mirror_each_other_are_two(spark, documents):
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    words = " ".join(("moon", "sun")[bin(i).count("1") % 2] for i in range(1024))
    other = words.replace("moon", "MOON").replace("sun", "moon").replace("MOON", "sun")
    lines = [bits, bits.translate(str.maketrans("ab", "ba")), words, other]
    out = line_dedup.drop_near_lines(documents([(i, t, "en", "web") for i, t in enumerate(lines)])).collect()
    assert sorted(r.doc_id for r in out if r.n_dropped == 0) == [0, 1, 2, 3]


def test_repeated_rows_leave_the_sample_bounded(spark, documents):
    rows = [(i, f"some words of text number {i}", "en", "web") for i in range(50)] + [(7, "the one that repeats itself", "en", "web")] * 3000
    docs = documents(rows)
    assert language_id.training_rows(docs).count() <= 50
    assert language_id.train(docs) is not None
