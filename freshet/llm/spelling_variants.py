"""Spelling variants of a vocabulary: words one edit apart, grouped under their most frequent neighbour.

A word is a point: how often it has each letter.  One edit moves the point by one
letter more, one letter less, or both, so at most two in L1.  The words of every
length are divided by a k-d tree; a search for a word one edit away visits the
boxes that such a step can reach and no others, in the tree of its own length
(one up and one down) and of the next length (one up).  The order of letters is
verified on what the boxes hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from freshet.llm.base import ascii_lower, shipped_by_value, stored

shipped_by_value(__name__)

LEAST_CHARS, LEAST_COUNT = 5, 3
#: Code points count by this remainder; a step in letters is a step in remainders, or none.
DIMENSIONS = 96
#: Words that the upper trees, one a length, are cut from; every word is placed and searched, however the cuts lie.
SAMPLE = 1 << 16
#: Longest words of the sample; longer ones have a cell for each length.
LONGEST = 64
#: Words that a cell, the work of a task, is to have, and words that a leaf inside a cell has at most, unless all are anagrams.
CELL_WORDS, LEAF_WORDS = 1 << 14, 16
#: Pairs of words that are laid side by side at once.
_PAIRS = 1 << 18
_DEALT = "cell long, role int, word string, n long"
_NEAR = "word string, n_near long, best_n long, best string"
_MEMBER, _SAME, _SHORTER = 0, 1, 2


def letters(words: list[str]) -> np.ndarray:
    """The code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def points(codes: np.ndarray) -> np.ndarray:
    """Letter counts, up to 255, where one more or less is still at most one step."""
    out = np.empty((len(codes), DIMENSIONS), np.uint8)
    for a in range(0, len(codes), 8192):
        part = codes[a:a + 8192] % DIMENSIONS + np.arange(len(codes[a:a + 8192]), dtype=np.uint32)[:, None] * DIMENSIONS
        found = np.bincount(part.ravel(), minlength=len(codes[a:a + 8192]) * DIMENSIONS)
        out[a:a + 8192] = np.minimum(found, 255).reshape(-1, DIMENSIONS)
    return out


class Box:
    """A node of a k-d tree: a cut with its two sides, or a leaf with what it holds."""

    __slots__ = ("dim", "cut", "low", "high", "holds")

    def __init__(self, dim=None, cut=0, low=None, high=None, holds=None):
        self.dim, self.cut, self.low, self.high, self.holds = dim, cut, low, high, holds


def grow(at: np.ndarray, rows: np.ndarray, most: float) -> Box:
    """The tree of the points ``at[rows]``: halves along the widest dimension until a box has ``most`` or its points are equal."""
    if len(rows) > most:
        here = at[rows]
        dim = int(here.var(axis=0).argmax())
        column = here[:, dim]
        middle = int(np.median(column))
        share = [(abs(float((column <= cut).mean()) - 0.5), cut) for cut in (middle - 1, middle) if cut >= 0]
        off, cut = min(share)
        if off < 0.5:
            low = column <= cut
            return Box(dim, cut, grow(at, rows[low], most), grow(at, rows[~low], most))
    return Box(holds=rows)


def reached(box: Box, at: np.ndarray, up: bool, down: bool) -> Iterator[tuple[Box, np.ndarray]]:
    """The leaves that the points reach when one count may grow by one (``up``) and one shrink by one (``down``)."""
    todo = [(box, np.arange(len(at)), np.full(len(at), up), np.full(len(at), down))]
    while todo:
        box, rows, more, less = todo.pop()
        if not len(rows):
            continue
        if box.dim is None:
            yield box, rows
            continue
        here = at[rows, box.dim].astype(np.int16)
        low = here <= box.cut
        rises, falls = more & (here == box.cut), less & (here == box.cut + 1)
        to_low, to_high = low | falls, ~low | rises
        todo.append((box.low, rows[to_low], more[to_low], (less & ~falls)[to_low]))
        todo.append((box.high, rows[to_high], (more & ~rises)[to_high], less[to_high]))


def _one_edit(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which rows of ``q`` and ``m`` are one replacement apart or, with ``m`` a letter longer, one insertion."""
    if q.shape[1] == m.shape[1]:
        return (q != m).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(q == m[:, :-1], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((q == m[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= q.shape[1]


def _candidates(q: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``q`` and ``m`` to compare.

    A leaf with many words holds anagrams.  These meet by their first half or
    their last half, one of which an edit leaves as it was, not all with all.
    """
    if len(m) <= 4 * LEAF_WORDS:
        step = max(1, _PAIRS // (len(m) * max(q.shape[1], 1)))
        for a in range(0, len(q), step):
            n = min(step, len(q) - a)
            yield np.repeat(np.arange(a, a + n), len(m)), np.tile(np.arange(len(m)), n)
        return
    half = q.shape[1] // 2
    for side, (x, y) in enumerate(((q[:, :half], m[:, :half]), (q[:, half:], m[:, m.shape[1] - q.shape[1] + half:]))):
        _, key = np.unique(np.concatenate([x, y]), axis=0, return_inverse=True)
        kq, km = key[:len(q)], key[len(q):]
        order = np.argsort(km, kind="stable")
        first, last = np.searchsorted(km[order], kq), np.searchsorted(km[order], kq, side="right")
        for a in range(0, len(q), 256):
            n = (last - first)[a:a + 256]
            i = np.repeat(np.arange(a, a + len(n)), n)
            j = order[np.repeat(first[a:a + 256] - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())]
            if side:  # met before by the first half
                new = (q[i, :half] != m[j, :half]).any(axis=1)
                i, j = i[new], j[new]
            yield i, j


class Cell:
    """The words of a cell in a k-d tree."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = np.array(words, object), n
        self.codes = letters(words)
        self.tree = grow(points(self.codes), np.arange(len(words)), LEAF_WORDS)

    def near(self, words: list[str], n: np.ndarray, shorter: bool) -> pd.DataFrame:
        """For each of ``words``, and if they are the shorter ones for the cell's too, what is near: how many, and the best."""
        codes = letters(words)
        found = []
        for leaf, rows in reached(self.tree, points(codes), True, not shorter):
            for i, j in _candidates(codes[rows], self.codes[leaf.holds]):
                i, j = rows[i], leaf.holds[j]
                good = _one_edit(codes[i], self.codes[j])
                if good.any():
                    found.append((i[good], j[good]))
        if not found:
            return pd.DataFrame({"word": [], "n_near": [], "best_n": [], "best": []})
        i, j = (np.concatenate(x) for x in zip(*found))
        words = np.array(words, object)
        out = [_best(words, i, self.words, self.n, j)]
        if shorter:
            out.append(_best(self.words, j, words, n, i))
        return pd.concat(out, ignore_index=True)


def _best(words: np.ndarray, i: np.ndarray, others: np.ndarray, n: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """Of the pairs (i, j): for every i the number of j and the one with the largest n, by code point if tied."""
    used, at = np.unique(j, return_inverse=True)
    rank = np.empty(len(used), np.int64)
    rank[sorted(range(len(used)), key=lambda k: others[used[k]])] = np.arange(len(used))
    order = np.lexsort((rank[at], -n[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    return pd.DataFrame({"word": words[i[first]], "n_near": np.diff(np.concatenate([first, [len(i)]])),
                         "best_n": n[j[first]], "best": others[j[first]]})


def _by_length(words: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    lengths = words.str.len().to_numpy()
    for n in np.unique(lengths):
        yield int(n), np.flatnonzero(lengths == n)


def upper_trees(vocabulary: DataFrame) -> dict[int, Box]:
    """A tree for each length in a sample of the words, its leaves numbered as cells of about ``CELL_WORDS`` words."""
    total = vocabulary.count()
    thin = max(1.0, total / SAMPLE)
    drawn = F.pmod(F.xxhash64("word", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) / thin)
    sample = vocabulary.filter(drawn & (F.length("word") <= LONGEST)).select("word").limit(SAMPLE).toPandas()["word"]
    trees, cells = {}, 0
    for length, rows in _by_length(sample):
        at = points(letters(sample.iloc[rows].tolist()))
        trees[length] = grow(at, np.arange(len(at)), CELL_WORDS / thin)
        todo = [trees[length]]
        while todo:
            box = todo.pop()
            if box.dim is None:
                box.holds, cells = cells, cells + 1
            else:
                todo += [box.low, box.high]
    return trees


def _deal(trees: dict[int, Box]):
    """Every word to its cell, and to all cells it has to be searched in."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for length, rows in _by_length(batch["word"]):
                part = batch.iloc[rows]
                at = points(letters(part["word"].tolist()))
                for role, of, up, down in ((_MEMBER, length, False, False), (_SAME, length, True, True),
                                           (_SHORTER, length + 1, True, False)):
                    # A length that the sample lacks is one cell, numbered by the length.
                    tree = trees.get(of) or Box(holds=-of)
                    out += [part.iloc[some].assign(cell=leaf.holds, role=role) for leaf, some in reached(tree, at, up, down)]
            if out:
                yield pd.concat(out, ignore_index=True)[["cell", "role", "word", "n"]]
    return run


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The searches of every cell: its words come first and make the tree, then come the words to search for, batch by batch."""
    now, members, cell = None, [], None
    for batch in batches:
        ids = batch[["cell", "role"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)])) if len(ids) else []
        for a, b in zip(starts, [*starts[1:], len(ids)]):
            number, role = ids[a]
            if number != now:
                now, members, cell = number, [], None
            part = batch.iloc[a:b]
            if role == _MEMBER:
                members.append(part)
                continue
            if not members:
                continue
            if cell is None:
                whole = pd.concat(members)
                cell = Cell(whole["word"].tolist(), whole["n"].to_numpy())
            found = cell.near(part["word"].tolist(), part["n"].to_numpy(), role == _SHORTER)
            if len(found):
                yield found


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): the words with others one edit away, how many, and the most frequent of them."""
    dealt = vocabulary.select("word", "n").mapInPandas(_deal(upper_trees(vocabulary)), _DEALT)
    found = dealt.repartition("cell").sortWithinPartitions("cell", "role").mapInPandas(_search, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best")))


def spelling_variants(vocabulary: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary of distinct (word, n).

    Two words are near if one code point inserted, deleted or replaced makes one
    the other.  ``form`` is the near word with the largest n, the first by code
    point among equals, if that n is at least twice the word's own, else NULL;
    ``root`` is where following forms ends.  NULL words are left out.  An empty
    vocabulary gives no rows; words of any length and script count, further
    columns are dropped.

    Roots are handed down from words without a form: each round reaches the words
    whose form was reached in the round before.  A form has at least twice the
    count of its word, so rounds are bounded by the logarithm of the largest count,
    and each word is the form of a bounded number of words.
    """
    vocabulary = vocabulary.filter("word IS NOT NULL")
    near = vocabulary.select("word", "n").join(near_words(vocabulary), "word", "left")
    takes = F.col("best_n") >= 2 * F.col("n")
    words = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")), "forms")
    links = words.filter("form IS NOT NULL").select("word", "form")
    reached_now = words.filter("form IS NULL").select("word", F.col("word").alias("root"))
    roots = None
    while True:
        reached_now = stored(links.join(reached_now.select(F.col("word").alias("form"), "root"), "form").select("word", "root"), "roots")
        if reached_now.isEmpty():
            break
        roots = reached_now if roots is None else roots.unionByName(reached_now)
    if roots is None:
        roots = reached_now
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): what ``documents`` write, with slips.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are
    lower-cased.  A run of a document slips where 97 divides h, the crc32 of
    ``<doc_id>:<run>``: it loses its code point h % length.  Of the distinct
    results those with ``LEAST_CHARS`` code points and ``LEAST_COUNT``
    occurrences count.  A NULL text has no words, a NULL doc_id is empty text;
    repeated rows count as often as they stand; texts are taken whole.
    """
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit("[a-z\\u00C0-\\u00FF]+"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.filter(F.length("run") >= LEAST_CHARS)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    rows = rows.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % 97 == 0, slipped).otherwise(F.col("run")).alias("word"))
    return (words.filter(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= LEAST_COUNT))
