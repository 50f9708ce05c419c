"""Deduplication, decontamination, mixing, sharding, archives: small cases against brute force."""

import base64
import collections
import hashlib
import os
import random

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

import brute
from freshet.llm import base, decontaminate, kd_shards, line_dedup, minhash_dedup, mixture, warc

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "to") for b in ("ba", "de", "fu", "go", "hi", "jo", "ku", "la")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def changed(rng, text, share):
    return " ".join("X%d" % rng.randrange(10 ** 6) if rng.random() < share else w for w in text.split())


def copies(rng):
    """Texts with exact copies, near copies of many degrees, a large near group and a shared passage."""
    rows = [prose(rng, rng.randint(30, 200)) for _ in range(40)]
    rows += [rows[0]] * 30
    rows += [changed(rng, rows[k % 10], rng.choice([.005, .01, .02, .03, .05])) for k in range(120)]
    rows += [changed(rng, rows[20], .02) for _ in range(60)]
    passage = prose(rng, 60)
    rows += [prose(rng, 40) + " " + passage + " " + prose(rng, 40) for _ in range(40)]
    return rows + [None, "", "  \n", "one", "one two", "one two three", "ONE two  three", "x " * 500]


@pytest.mark.parametrize("n", [4, 5])
def test_near_copies(documents, n):
    rng = random.Random(n)
    texts = copies(rng)
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    got = minhash_dedup.near_duplicates(documents([(i, t, "en", "s") for i, t in rows]), n, 80).collect()
    want = brute.near_copies(rows, n, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_copies_of_odd_rows(documents):
    rng = random.Random(9)
    a, b = prose(rng, 50), prose(rng, 50)
    rows = [(7, a), (7, a), (7, b), (3, b), (9, a), (None, a), (None, None), (5, None), (1, prose(rng, 30))]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(
        documents([(i, t, None, None) for i, t in rows])).collect()), key=repr)
    assert got == sorted([(7, 46, 3, False)] * 3 + [(3, 46, 3, True), (9, 46, 3, False), (None, 46, None, True), (None, 0, None, True),
                                                     (5, 0, 5, True), (1, 26, 1, True)], key=repr)
    assert minhash_dedup.near_duplicates(documents([])).collect() == []


def test_hot_group_in_blocks(documents, monkeypatch):
    """Blocks far smaller than a bucket give the same links."""
    monkeypatch.setattr(base, "BLOCK", 4)
    rng = random.Random(5)
    root = prose(rng, 120)
    rows = [(k, changed(rng, root, .015)) for k in range(150)]
    got = minhash_dedup.near_duplicates(documents([(i, t, None, None) for i, t in rows]), 4, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_copies(rows, 4, 80)


def test_similarity_is_estimated():
    rng = np.random.default_rng(1)
    x = rng.integers(-2 ** 62, 2 ** 62, 1000)
    for shared in (200, 500, 900):
        y = np.concatenate([x[:shared], rng.integers(-2 ** 62, 2 ** 62, 1000 - shared)])
        _, bits = minhash_dedup.signature([x, y])
        rows = minhash_dedup._rows(bits)
        assert rows.shape == (2, minhash_dedup.BANDS * minhash_dedup.ROWS * minhash_dedup.BITS // 8)
        assert abs(minhash_dedup._similarity(minhash_dedup._agreeing(rows[0], rows[1])) - shared / (2000 - shared)) < .11


def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1200)] + [(-5, 7), (3, 3)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in base.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute.groups(sorted(nodes), [e for e in edges if e[0] != e[1]])
    assert base.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_edit_distance():
    rng = random.Random(7)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == brute.levenshtein(a, b)


def test_near_lines(documents):
    """Against plain edit similarity of all pairs: nothing else goes, and nine tenths of what should go does."""
    rng = random.Random(8)
    lines = [prose(rng, rng.randint(8, 60)) for _ in range(60)]
    lines += [line.upper() + "!" for line in lines[:10]] + [changed(rng, rng.choice(lines), .02) for _ in range(150)] + ["--", "", "a"]
    lines += [changed(rng, line, .005) for line in [prose(rng, 150) for _ in range(40)] for _ in range(4)]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n--"), (None, lines[3] + "\nnew line"), (503, lines[4] + " " + "long " * 4000), rows[5]]
    comp, links = brute.near_lines(rows, line_dedup.normal, 90, line_dedup.edit_distance)
    docs = documents([(i, t, None, None) for i, t in rows])
    got = line_dedup.drop_near_lines(docs, 90).collect()
    assert len(links) > 20 and len(got) == len(rows)
    places = sorted(((i is None, i or 0, k, line_dedup.normal(x)) for i, t in dict(rows).items() if t for k, x in enumerate(t.split("\n"))))
    first = {}
    for none, i, k, norm in places:
        first.setdefault(comp.get(norm), (none, i, k))
    due = sum(1 for none, i, k, norm in places if norm and first[comp[norm]] != (none, i, k))
    gone = 0
    for r in {x.doc_id: x for x in got}.values():
        if r.text is None:
            assert dict(rows)[r.doc_id] is None and r.n_lines == r.n_dropped == 0
            continue
        whole = dict(rows)[r.doc_id].split("\n")
        stays = [x for k, x in enumerate(whole)
                 if not line_dedup.normal(x) or first[comp[line_dedup.normal(x)]] == (r.doc_id is None, r.doc_id or 0, k)]
        left = r.text.split("\n") if r.n_dropped < r.n_lines else []
        assert r.n_lines == len(whole) and len(left) == r.n_lines - r.n_dropped
        assert not collections.Counter(stays) - collections.Counter(left)  # the first line of a group never goes
        gone += r.n_dropped
    assert .9 * due <= gone <= due
    assert line_dedup.drop_near_lines(documents([])).collect() == []


def test_near_lines_recall(documents):
    """One changed letter, by the length of the line; lines of scripts without blanks; short and unlike lines."""
    rng = random.Random(9)
    least = {6: .75, 10: .95, 20: .99, 40: 1}
    lines = [(words, prose(rng, words)) for words in least for _ in range(300)]
    rows = []
    for k, (words, line) in enumerate(lines):
        at = rng.choice([k for k in range(len(line)) if line[k] != " "])
        edited = line[:at] + "z" + line[at + 1:]
        assert line_dedup.similar(line, edited, 90)
        rows += [(k, line), (10_000 + k, edited)]
    wide, other = ("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40)) for _ in range(2))
    rows += [(20_001, wide), (20_002, wide[:20] + "\u4e00" + wide[21:]), (20_003, other), (20_004, "of the"), (20_005, "of them"),
             (20_006, ""), (20_007, None)]
    got = line_dedup.drop_near_lines(documents([(i, t, None, None) for i, t in rows]), 90).filter("n_dropped > 0").collect()
    ids = {r.doc_id for r in got}
    assert all(10_000 <= i < 20_000 for i in ids - {20_002}) and 20_002 in ids
    found = collections.Counter(lines[i - 10_000][0] for i in ids if i < 20_000)
    assert all(found[words] >= share * 300 for words, share in least.items()), found


def plain_hits(text, items, size=10):
    import re
    words = brute.TERMS.findall((text or "").translate(brute.LOWER))
    hit, found = set(), set()
    for item, t in items:
        w = brute.TERMS.findall((t or "").translate(brute.LOWER))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for s in range(len(words) - n + 1):
                if words[s:s + n] == w[k:k + n]:
                    hit.update(range(s, s + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_passages(spark, documents):
    rng = random.Random(10)
    items = [(k, prose(rng, rng.randint(12, 30))) for k in range(6)] + [(6, "short, item"), (7, None), (8, "--"), (11, prose(rng, 10))]
    items += [(9, items[0][1]), (9, items[0][1])]
    texts = [prose(rng, 80) for _ in range(20)] + [None, "", "..."]
    for k in range(20):
        w = rng.choice(items[:6])[1].split()
        cut = w[rng.randint(0, 3):][:rng.choice([9, 10, 11, 30])]
        texts.append(prose(rng, 20) + ". " + ", ".join(cut).upper() + " " + prose(rng, 5) + (" Short: ITEM" if k % 3 == 0 else ""))
    texts.append(items[1][1] + " " + items[1][1])
    docs = documents([(k, t, None, None) for k, t in enumerate(texts)] + [(3, texts[-1], None, None), (None, texts[-1], None, None), (None, "x", None, None)])
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, row int")
    got = decontaminate.contamination(docs, bench).collect()
    want = sorted(((i, *plain_hits(t, items)) for i, t in [*enumerate(texts), (3, texts[-1]), (None, texts[-1]), (None, "x")]), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=repr) == sorted(
        ((i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for i, n, h, x in want), key=repr)
    assert all(not r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())
    assert decontaminate.contamination(docs.limit(0), bench).collect() == []


def test_proximity(spark, documents):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    near = item.replace("delta", "delta extra")
    docs = documents([(1, item, None, None), (2, "so " + near + " end", None, None), (3, "alpha beta gamma", None, None)])
    got = {r.doc_id: r for r in decontaminate.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert (got[1].n_hit, got[1].n_near) == (10, 0) and (got[2].n_hit, got[3].n_hit) == (0, 0)
    assert (got[2].n_near, got[3].n_near) == (1, 0)


def mixed_documents(documents, rng):
    rows = [(k, prose(rng, rng.randint(1, 60)), None, rng.choice(["a", "a", "a", "a", "b", "c", "Z", "é", None])) for k in range(600)]
    return rows + [(1000, None, None, "a"), (1001, "", None, "only empty"), (3, rows[3][1], None, rows[3][3]), (None, "five words are in here", None, "b"),
                   (1002, "w " * 5000, None, "long")]


def test_mixture(documents):
    rng = random.Random(11)
    rows = mixed_documents(documents, rng)
    docs = documents(rows)
    got = [tuple(r) for r in mixture.mix_documents(docs, block_words=4).collect()]
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.BLANKS.findall(t or ""))
    goal = brute.targets(sizes)
    assert len(got) == len(rows)
    taken = {}
    for _, source, size, source_size, target, took in got:
        assert source_size == sizes[source] and abs(target - goal[source]) < 1e-6 and 0 <= took <= 3 * size
        taken[source] = taken.get(source, 0) + took
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= .12 * goal[s] + 40, s
    assert sorted(got, key=repr) == sorted((tuple(r) for r in mixture.mix_documents(docs, block_words=4).collect()), key=repr)
    assert mixture.mix_documents(documents([])).collect() == []


def test_blocks_hold_the_words(documents):
    rng = random.Random(12)
    rows = [(k, " ".join(f"{k}.{j}" for j in range(rng.randint(0, 30))), None, rng.choice("ab")) for k in range(60)]
    measured = mixture.measure(documents(rows), keep_words=True)
    mix, sources = mixture.mix(measured, block_words=8, shard_slots=16)
    filled = mix.collect()
    blocks = [[w for p in b.parts for w in p.words.split(" ")] for b in filled]
    total = sum(len(t.split()) for _, t, _, _ in rows)
    assert abs(sum(len(b) for b in blocks) - total) < .2 * total
    assert all(len(b) <= 8 for b in blocks) and sum(len(b) < 8 for b in blocks) <= 2 * 3
    real = {w for _, t, _, _ in rows for w in t.split()}
    assert all(w in real for b in blocks for w in b)
    for b in blocks:  # a document's words stand in order
        for x, y in zip(b, b[1:]):
            assert x.split(".")[0] != y.split(".")[0] or int(y.split(".")[1]) == int(x.split(".")[1]) + 1
    slots = [(b.shard, b.slot) for b in filled]
    assert len(set(slots)) == len(slots)


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixture.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n)) and (n < 100 or [r.x for r in got] != list(range(n)))


def test_shards(documents):
    rng = random.Random(13)
    rows = [(k, prose(rng, rng.randint(1, 80)), rng.choice(["en", "de", None]), rng.choice(["s"] * 5 + ["t", None, "longer than seven"])) for k in range(3000)]
    rows += [(9000 + k, "same text", "en", "hot") for k in range(1500)] + [(9999, None, None, None), (None, "x", None, None), (3, rows[3][1], rows[3][2], rows[3][3])]
    got = kd_shards.shard_documents(documents(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    sizes = [sum(r.size for r in by[s]) for s in range(24)]
    assert max(sizes) - min(sizes) < .03 * sum(sizes) / 24 + 2 * max(r.size for r in got)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    again = {(r.doc_id, r.slot): r.shard for r in kd_shards.shard_documents(documents(rows[::-1])).collect()}
    assert sum(again.get((r.doc_id, r.slot)) == r.shard for r in got) > .99 * len(got)
    assert kd_shards.shard_documents(documents([])).collect() == []
    few = kd_shards.shard_documents(documents(rows[:3])).collect()
    assert len({r.shard for r in few}) == 3 and all(r.slot == 0 for r in few)


def test_shards_of_equal_rows(documents):
    rng = random.Random(15)
    rows = [(k, prose(rng, 3), "en", "s") for k in range(200)] + [(None, "equal text here", "en", "s")] * 2300 + [(7, "b", None, None)] * 30
    got = kd_shards.shard_documents(documents(rows)).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(got) == len(rows) and len(sizes) == 24
    assert max(sizes.values()) - min(sizes.values()) < .03 * sum(sizes.values()) / 24 + 2 * max(r.size for r in got)
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in sizes)
    again = kd_shards.shard_documents(documents(rows[::-1])).collect()
    assert collections.Counter(got) == collections.Counter(again)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, shard string")


def test_archives(spark, landing):
    rng = random.Random(14)
    rows = [(k * 7, f"http://h/{k}", "<p>" + prose(rng, rng.randint(0, 40)) + "é😀") for k in range(200)]
    rows += [(5000 + k, "http://same", "<p>copy</p>") for k in range(90)] + [(6000, "u\r\nWARC-Type: x", None), (6001, None, ""), (None, "no id", "<p>copy</p>"),
                                                                             (6002, "big", "y" * 400_000), (6002, "big", "y" * 400_000), (6003, "crlf", "a\r\n\r\nWARC/1.1\r\n")]
    rows += [((1 << 60) + 1, "far", "<p>copy</p>")]
    folder = f"{landing}/one"
    manifest = warc.write_archives(pages(spark, rows), folder, roll_bytes=4000).collect()
    got = warc.read_archives(spark, folder).collect()
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        first = min(j for j, _, x in rows if (x or "") == (h or "") and j is not None)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "response" if i == first else "revisit", None if i == first else first))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(r.records for r in manifest) == len(rows) and len({r.file for r in manifest}) == len(manifest)
    for r in manifest:
        data = open(f"{folder}/{r.file}", "rb").read()
        assert (len(data), hashlib.sha1(data).hexdigest()) == (r.bytes, r.sha1)
    assert not os.path.exists(f"{folder}/_temporary")
    # Written again from rows in another order: the same files, byte for byte.
    other = warc.write_archives(pages(spark, rows[::-1]).repartition(5), f"{landing}/two", roll_bytes=4000).collect()
    assert sorted(manifest) == sorted(other)


def test_archives_least_bytes_and_none(spark, landing):
    rows = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long text"), (4, "d", "long text")]
    warc.write_archives(pages(spark, rows), f"{landing}/x", least_bytes=5)
    assert {r.page_id: r.record_type for r in warc.read_archives(spark, f"{landing}/x").collect()} == {
        1: "response", 2: "response", 3: "response", 4: "revisit"}
    warc.write_archives(pages(spark, []), f"{landing}/none")
    assert warc.read_archives(spark, f"{landing}/none").collect() == []


def test_damage_is_seen(spark, landing):
    manifest = warc.write_archives(pages(spark, [(1, "a", "some text")]), f"{landing}/x").collect()
    data = warc._member(warc.response(1, "a", b"some text").replace(b"some text", b"same text"))
    with pafs.LocalFileSystem().open_output_stream(f"{landing}/x/{manifest[0].file}", compression=None) as out:
        out.write(data)
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, f"{landing}/x").collect()
