"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest

from freshet.llm import merkle_manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows, arity):
    """(row, leaf, subroot, root, proof, folded root) by whole trees; rows are (row, group, at, leaf, now)."""
    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([h("".join(below[i:i + arity])) for i in range(0, len(below), arity)])
        return levels

    groups = sorted({r[1] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    members = {g: sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[3], r[4])) for g in groups}
    trees = {g: tree([r[3] for r in members[g]]) for g in groups}
    top = tree([trees[g][-1][0] for g in groups])
    out = []
    for k, g in enumerate(groups):
        for i, (row, _, _, leaf, now) in enumerate(members[g]):
            digest, proof = now, ""
            for levels, at in ((trees[g], i), (top, k)):
                for below in levels[:-1]:
                    first = at - at % arity
                    run = list(below[first:first + arity])
                    proof += "".join(run[:at - first] + run[at - first + 1:])
                    run[at - first] = digest
                    digest, at = h("".join(run)), at // arity
            out.append((row, leaf, trees[g][-1][0], top[-1][0], h(proof), digest, digest == top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("arity,block", [(2, 4), (3, 27), (2, 4096)])
def test_proofs(spark, arity, block):
    rng = random.Random(arity)
    rows = []
    for group, n in ((None, 1), ("", 2), ("é", 3), ("z", 77), ("a", 130)):
        for i in range(n):
            leaf = h(f"{group}{i}")
            rows.append((f"{group}-{i}", group, i, leaf, leaf if rng.random() < .8 else h("changed")))
    rows += [("same", "a", 5, h("same"), h("same"))] * 3 + [("none", "a", None, h("none"), h("else"))]
    df = spark.createDataFrame(rows, "row string, group string, at long, leaf string, now string").repartition(5)
    got = sorted(tuple(r) for r in merkle_manifest.prove(df, arity, block).collect())
    assert got == plain(rows, arity)


def test_documents(spark, documents):
    rows = [(i, f"text {i}" if i % 5 else None, None if i % 7 == 0 else "en", "web") for i in range(40)] + [(None, "", "en", None)] * 2
    docs = documents(rows + [(3, "text 3", "en", "web")])
    got = merkle_manifest.prove_documents(docs).collect()
    assert len(got) == 43 and len({r.root for r in got}) == 1 and len({r.subroot for r in got}) == 2
    for r in got:
        counted = r.doc_id is not None and r.doc_id % 5 != 0
        assert r.verified == (not (counted and zlib.crc32(str(r.doc_id).encode()) % 7 == 0))
    first = next(r for r in got if r.doc_id == 1)
    assert first.leaf == h("1:1" + "3:web" + "2:en" + "1:6" + "6:text 1")


def test_one_leaf_and_none(spark, documents):
    only = merkle_manifest.prove_documents(documents([(1, "x" * 3_000_000, "en", "web")])).collect()
    assert len(only) == 1 and only[0].leaf == only[0].subroot == only[0].root == only[0].folded_root and only[0].proof_sha256 == h("")
    assert merkle_manifest.prove_documents(documents([])).collect() == []
