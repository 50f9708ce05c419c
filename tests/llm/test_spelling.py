"""Spelling variants against all pairs of a small vocabulary."""

import random
import zlib
from collections import Counter

from freshet.llm import spelling_variants


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(count):
    out = {}
    for w, n in count.items():
        near = [x for x in count if abs(len(x) - len(w)) <= 1 and edits(w, x) == 1]
        best = min(near, key=lambda x: (-count[x], x), default=None)
        out[w] = (best if best and count[best] >= 2 * n else None, n, len(near))

    def root(w):
        return root(out[w][0]) if out[w][0] else w
    return sorted((w, form or "", root(w), n, k, count.get(form) or 0) for w, (form, n, k) in out.items())


def vocabulary(rng):
    words = {"".join(rng.choice("abeé") for _ in range(rng.randint(1, 7))) for _ in range(250)}
    words |= {"".join(rng.sample("aaaabbbbcccc", 12)) for _ in range(300)}  # anagrams: one leaf
    words |= {"".join(rng.choice("dxyz") + w for w in ("aa", "bb")) for _ in range(30)}
    words |= {"x" * 700, "x" * 701, "x" * 300 + "y" + "x" * 400, "Ωmega", "Ωmeg", "ωmega", "a😀b", "ab"}
    return {w: rng.choice([3, 4, 4, 9, 20, 50, 50]) for w in sorted(words)}


def rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_all_pairs(spark, monkeypatch):
    count = vocabulary(random.Random(1))
    df = spark.createDataFrame([(w, n, "c") for w, n in count.items()] + [(None, 4, "c")], "word string, n long, cell string").repartition(4)
    want = plain(count)
    assert rows(spelling_variants.spelling_variants(df)) == want
    # Many cells, leaves of a few words, most lengths outside the sample.
    monkeypatch.setattr(spelling_variants, "CELL_WORDS", 20)
    monkeypatch.setattr(spelling_variants, "SAMPLE", 150)
    monkeypatch.setattr(spelling_variants, "LEAF_WORDS", 3)
    assert rows(spelling_variants.spelling_variants(df)) == want


def test_count_words(spark, documents):
    texts = ["Hello, hello HELLO wörld WÖRLD don't été×÷", None, "", "aaaaaaa " * 50, "b" * 200_000] + ["words here again " * 3] * 60
    docs = documents([(i, t, "en", "web") for i, t in enumerate(texts)] + [(None, "words again", None, None)])
    seen = Counter()
    for i, t in [*enumerate(texts), ("", "words again")]:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for run in "".join(c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in low).split(" "):
            if run:
                h = zlib.crc32(f"{i}:{run}".encode())
                k = h % len(run)
                seen[run[:k] + run[k + 1:] if h % 97 == 0 else run] += 1
    got = {r.word: r.n for r in spelling_variants.count_words(docs).collect()}
    assert got == {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3} and any(w not in texts[5] for w in got)


def test_empty(spark):
    assert spelling_variants.spelling_variants(spark.createDataFrame([], "word string, n long")).collect() == []
