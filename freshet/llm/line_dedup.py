"""Near-equal lines over a corpus by SimHash, confirmed by edit distance; one of each group stays."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from freshet.llm.base import (arrow_rows, checkpointed, comparison_blocks, components, in_blocks, salted_join,
                              shipped_by_value, stored)

shipped_by_value(__name__)

#: Blocks of a SimHash.  Every feature votes in one block only, so few changed features leave most blocks as they were.
BLOCKS = 6
#: Bits of a block.
WIDTH = 32
#: Lines meet where two of their blocks are equal.
_TABLES = tuple(combinations(range(BLOCKS), 2))
#: Characters that the words behind two blocks have at least; fewer say little about a line ("of the").
LEAST = 8
#: From here on a letter is a word by itself: scripts written without blanks.
WIDE = 0x2E80
_SIGS, _SIZES = [f"s{k}" for k in range(BLOCKS)], [f"c{k}" for k in range(BLOCKS)]
#: Documents handed to Python at a time.
BATCH = 256
#: Most keys sent to every executor, 8 bytes each.
SENT_IDS = 1_000_000
_STEP = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """Stirs fresh numbers in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every segment of ``values``: the sum of a random number for each value at its place in the segment."""
    lengths = ends - starts
    last = np.cumsum(lengths)
    place = np.arange(last[-1] if len(last) else 0) - np.repeat(last - lengths, lengths)
    of_place = _mix(np.arange(lengths.max(initial=0), dtype=np.uint64) + np.uint64(_STEP))
    each = values[place + np.repeat(starts, lengths)] * np.uint64(_STEP)
    each += of_place[place]
    each = _mix(each)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
    return _mix(sums[last] - sums[last - lengths] + lengths.astype(np.uint64))


def _alphabet(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every code point up to the largest here: its lower case, if that is one character, and whether it counts."""
    lower, counts = np.arange(codes.max() + 1, dtype=np.uint32), np.zeros(codes.max() + 1, bool)
    for k in np.flatnonzero(np.bincount(codes)):
        counts[k] = chr(k).isalnum()
        small = chr(k).lower()
        if len(small) == 1:
            lower[k] = ord(small)
    return lower, counts


def normal(line: str) -> str:
    """Letters and digits in lower case, everything else one blank."""
    return " ".join("".join((s if len(s := c.lower()) == 1 else c) if c.isalnum() else " " for c in line).split())


def line_signatures(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Of every line with a letter or digit: ``text`` and ``line`` (its place), ``n`` characters when normalised, ``h``,
    ``sig`` (``BLOCKS`` blocks of a SimHash) and ``size`` (characters of the words that voted in each block).

    The different words of a line are its features; counted as often as they stand
    there, the commonest words would make all lines of a language alike.  A word's
    hash says which block it votes in and how.  All lines of the batch are worked
    on together.
    """
    codes = [np.frombuffer((t + "\n" if t else "\n").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    c = np.concatenate(codes)
    lower, counts = _alphabet(c)
    inside, ends_line = counts[c], c == 10
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    opens, closes = inside & ~before, inside & ~after
    if len(lower) > WIDE:
        wide = inside & (c >= WIDE)
        opens, closes = opens | wide, closes | wide
        opens[1:] |= inside[1:] & wide[:-1]
        closes[:-1] |= inside[:-1] & wide[1:]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    line_at = np.cumsum(ends_line) - ends_line
    words = _segment_hashes(lower[c].astype(np.uint64) + np.uint64(1), starts, ends)
    of_line, apart, letters = line_at[starts], ~before[starts], ends - starts
    first = np.flatnonzero(np.concatenate([[True], of_line[1:] != of_line[:-1]])) if len(words) else np.zeros(0, np.int64)
    stop = np.append(first[1:], len(words)).astype(np.int64) if len(first) else first
    sig, size = _votes(words, np.repeat(np.arange(len(first)), stop - first), letters, len(first))
    text = row[starts[first]]
    lines_before = np.concatenate([[0], np.cumsum(np.bincount(row[ends_line], minlength=len(texts)))])
    width, blanks = (np.concatenate([[0], np.cumsum(x)]) for x in (letters, apart))
    return {"text": text, "line": of_line[first] - lines_before[text],
            "n": width[stop] - width[first] + blanks[stop] - blanks[first] - 1,
            "h": _segment_hashes(words + apart.astype(np.uint64), first, stop).view(np.int64), "sig": sig, "size": size}


def _votes(words: np.ndarray, line: np.ndarray, letters: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """(lines, BLOCKS) arrays: the blocks of each line's SimHash and the characters of its different words behind them."""
    sig, size = np.zeros((lines * BLOCKS, WIDTH // 8), np.uint8), np.zeros(lines * BLOCKS, np.int64)
    if lines:
        place = line * BLOCKS + (words % np.uint64(BLOCKS)).astype(np.int64)
        order = np.lexsort((words, place))
        one, at, letters = words[order], place[order], letters[order]
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (one[1:] != one[:-1])])
        one, at, letters = one[new], at[new], letters[new]
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        total = np.diff(np.append(begin, len(one)))
        # Bits are summed as bytes, eight to a machine word, in runs of at most 255 words.
        pieces = -(-total // 255)
        head = np.cumsum(pieces) - pieces
        runs = np.repeat(begin, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(head, pieces))
        votes = (one >> np.uint64(64 - WIDTH)).astype(np.uint32).view(np.uint8).reshape(-1, WIDTH // 8)
        bits = np.unpackbits(votes, axis=1).view(np.uint64)
        ones = np.add.reduceat(bits, runs, axis=0).view(np.uint8)
        if len(runs) > len(begin):
            ones = np.add.reduceat(ones.astype(np.int32), head, axis=0)
        sig[at[begin]] = np.packbits(ones > (total // 2).astype(ones.dtype)[:, None], axis=1)
        size[at[begin]] = np.add.reduceat(letters, begin)
    return sig.view(np.int32).reshape(lines, BLOCKS), size.reshape(lines, BLOCKS)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            found = line_signatures(batch["text"].tolist())
            yield pd.DataFrame({"key": batch["key"].to_numpy()[found["text"]], "order": batch["order"].to_numpy()[found["text"]],
                                "line": found["line"], "n": found["n"], "h": found["h"],
                                **dict(zip(_SIGS, found["sig"].T)), **dict(zip(_SIZES, found["size"].T))})


def _pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The wanted lines of documents, normalised."""
    for batch in batches:
        rows = []
        for text, lines, reps in zip(batch["text"], batch["lines"], batch["reps"]):
            split = text.split("\n")
            rows += [(rep, normal(split[k])) for k, rep in zip(lines, reps)]
        yield pd.DataFrame(rows, columns=["rep", "norm"])


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time in the bits of one number (Myers)."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for k, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << k)
    full, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for ch in b:
        match = where.get(ch, 0)
        vertical = match | down
        diagonal = ((((match & up) + up) ^ up) | match) & full
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        if right & top:
            distance += 1
        elif left & top:
            distance -= 1
        right, left = ((right << 1) | 1) & full, (left << 1) & full
        up, down = left | (full & ~(vertical | right)), right & vertical
    return distance


def _common(a: str, b: str) -> int:
    """The length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def similar(a: str, b: str, percent: int) -> bool:
    """Whether 100 * (1 - distance / longer length) is ``percent`` or more."""
    most = (100 - percent) * max(len(a), len(b)) // 100
    if abs(len(a) - len(b)) > most:
        return False
    k = _common(a, b)  # what both begin and end with doesn't count
    a, b = a[k:], b[k:]
    k = _common(a[::-1], b[::-1])
    a, b = a[:len(a) - k], b[:len(b) - k]
    if max(len(a), len(b)) <= most:
        return True
    # An edit takes one letter away at most, and adds one at most.
    n = Counter(a)
    n.subtract(b)
    if max(sum(v for v in n.values() if v > 0), -sum(v for v in n.values() if v < 0)) > most:
        return False
    return edit_distance(a, b) <= most


def _similar(percent: int):
    @F.pandas_udf(T.BooleanType())
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y, percent) for x, y in zip(a, b)], dtype=bool)
    return test


def _near_length(a: str, b: str, percent: int) -> Column:
    """Whether two lengths are so near that lines of them can be similar."""
    return 100 * F.abs(F.col(a) - F.col(b)) <= (100 - percent) * F.greatest(a, b)


def _partners(percent: int):
    """For every row of two blocks of a bucket: the rows of other components it may be similar to, once per pair."""
    none = pd.DataFrame(columns=["key", "lo", "hi", "rep", "partners"])

    def look(block: dict[str, np.ndarray]) -> pd.DataFrame:
        own, comp, rep, n = block["own"], block["comp"], block["rep"], block["n"].astype(np.int64)
        if len(rep) < 2 or (comp == comp[0]).all():
            return none
        sig, size = (np.stack([block[c] for c in names], axis=1) for names in (_SIGS, _SIZES))
        one, two = (np.array(x) for x in zip(*_TABLES))
        full = size[:, one].astype(np.int64) + size[:, two] >= LEAST
        lo, hi, band = block["lo"][0], block["hi"][0], block["band"][0]
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        lists, wanted = {}, set()
        for i in left:
            there = right[right > i] if lo == hi else right
            there = there[(comp[there] != comp[i]) & (100 * np.abs(n[there] - n[i]) <= (100 - percent) * np.maximum(n[there], n[i]))]
            if not len(there):
                continue
            equal = sig[there] == sig[i]
            met = equal[:, one] & equal[:, two] & full[there] & full[i]
            there = there[met[:, band] & (met.argmax(axis=1) == band)]  # the first table the pair shares
            if len(there):
                lists[i] = rep[there].tolist()
                wanted.update((i, *there.tolist()))
        if not wanted:
            return none
        rows = np.array(sorted(wanted), np.int64)
        return pd.DataFrame({**{c: block[c][rows] for c in ("key", "lo", "hi", "rep")},
                             "partners": pd.Series([lists.get(i, []) for i in rows], dtype=object)})
    return look


def _links(percent: int):
    def confirm(block: dict[str, np.ndarray]) -> pd.DataFrame:
        text = dict(zip(block["rep"], block["norm"]))
        found = [(a, b) for a, partners in zip(block["rep"], block["partners"]) for b in partners
                 if b in text and similar(text[a], text[b], percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")
    return confirm


def _texts_of(keyed: DataFrame, lines: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, norm): the normalised texts of some distinct lines, from a document that has each."""
    wanted = lines.join(reps, "rep").groupBy("key").agg(F.collect_list(F.struct("line", "rep")).alias("w"))
    wanted = checkpointed(wanted.select("key", F.col("w.line").alias("lines"), F.col("w.rep").alias("reps")))
    few = wanted.limit(SENT_IDS + 1).count() <= SENT_IDS
    docs = keyed.join(F.broadcast(wanted) if few else wanted, "key").select("text", "lines", "reps")
    with arrow_rows(keyed.sparkSession, BATCH):
        return stored(docs.mapInPandas(_pick, "rep long, norm string").dropDuplicates(["rep"]), "texts")


def _keyed(docs: DataFrame) -> DataFrame:
    last = F.lit((1 << 63) - 1)
    return docs.select("doc_id", "text", F.coalesce("doc_id", last).alias("order"), F.xxhash64("doc_id", "text", F.col("text").isNull()).alias("key"))


def line_groups(docs: DataFrame, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(occurrences, groups) of the lines of all documents.

    ``occurrences``: (key, order, line, n, h) of every line with a letter or
    digit, with its signature, ``key`` telling documents apart and ``order`` their
    doc_id, NULL last.  ``groups``: (h, component) of the lines that a link ties to
    another.  Two different lines are linked when two blocks of their SimHashes are
    equal, the words behind these have ``LEAST`` characters or more, and their edit
    similarity is ``percent`` or more; all on normalised lines (:func:`normal`), whole.

    Equal lines meet first and go on as one.  A changed word touches two of six
    blocks at most, that of the old and that of the new word, so four stay and any
    two of them are a key the lines share; of four changed features two blocks stay
    for certain.  A bucket's members are tied to its smallest; buckets left with
    several components are compared in blocks, and only confirmed links leave a block.
    """
    keyed = _keyed(docs)
    blocks = [*_SIGS, *_SIZES]
    schema = "key long, order long, line int, n int, h long, " + ", ".join(f"{c} int" for c in blocks)
    with arrow_rows(docs.sparkSession, BATCH):
        occurrences = stored(keyed.drop("doc_id").mapInPandas(_sign, schema), "lines")
    lines = occurrences.groupBy(F.col("h").alias("rep")).agg(
        F.min(F.struct("key", "line")).alias("at"), *[F.first(c).alias(c) for c in ["n", *blocks]])
    lines = stored(lines.select("rep", "at.key", "at.line", "n", *blocks), "distinct")
    tables = F.array(*[F.when(F.col(f"c{i}") + F.col(f"c{j}") >= LEAST, F.xxhash64(F.lit(k), f"s{i}", f"s{j}"))
                       for k, (i, j) in enumerate(_TABLES)])
    keys = lines.select("rep", F.posexplode(tables).alias("band", "key")).filter("key IS NOT NULL")
    # Most keys are had by one line; those of several are found first, from keys alone.
    shared = checkpointed(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key"))
    few = shared.limit(SENT_IDS + 1).count() <= SENT_IDS
    met = keys.join(F.broadcast(shared) if few else shared, "key", "left_semi")
    members = stored(met.join(lines.select("rep", "n"), "rep"), "members")
    leaders = members.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("leader")).select(
        "key", F.col("leader.rep").alias("first"), F.col("leader.n").alias("first_n"))
    led = salted_join(members.select("key", "rep", "n"), leaders, ["key"], "rep")
    pairs = checkpointed(led.filter(_near_length("n", "first_n", percent) & (F.col("rep") != F.col("first")))
                         .select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct())
    places = lines.select("rep", "key", "line")
    texts = _texts_of(keyed, places, pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct())
    one, two = (texts.select(F.col("rep").alias(c), F.col("norm").alias(f"n{c}")) for c in "ab")
    tied = stored(pairs.join(one, "a").join(two, "b").filter(_similar(percent)("na", "nb")).select("a", "b"), "tied")
    by_node = components(tied).withColumnsRenamed({"node": "rep", "component": "_comp"})
    placed = members.select("key", "band", "rep").join(by_node, "rep", "left").withColumn("comp", F.coalesce("_comp", "rep")).drop("_comp")
    signed = comparison_blocks(placed).join(lines.select("rep", "n", *blocks), "rep")
    listed = checkpointed(in_blocks(signed, _partners(percent), "key long, lo long, hi long, rep long, partners array<long>"))
    more = _texts_of(keyed, places, listed.select("rep").distinct())
    links = stored(in_blocks(listed.join(more, "rep"), _links(percent), "a long, b long"), "links")
    return occurrences, components(tied.union(links)).withColumnRenamed("node", "h")


def drop_near_lines(docs: DataFrame, percent: int = 90) -> DataFrame:
    """One row per document: ``doc_id``, ``n_lines``, ``n_dropped`` and the ``text`` without the dropped lines.

    Of all lines of one group (equal lines and lines that links reach) the first
    stays, by doc_id, NULL last, and place; the others are dropped from their
    texts.  Lines without a letter or digit stay.  ``n_lines`` counts all lines, 0
    for a NULL text, which stays NULL; a text whose lines are all dropped becomes
    empty.  Rows equal in doc_id and text are one document and come out alike.
    """
    occurrences, groups = line_groups(docs, percent)
    counts = occurrences.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("order", "key", "line")).alias("first"))
    grouped = counts.join(groups, "h", "left").filter("m > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "h"))
    keepers = grouped.groupBy("component").agg(F.min("first").alias("keeper"))
    of_line = salted_join(grouped.select("h", "component"), keepers, ["component"], "h").select("h", "keeper.key", "keeper.line")
    of_line = of_line.withColumnsRenamed({"key": "_key", "line": "_line"})
    dropped = salted_join(occurrences.select("h", "key", "line"), of_line, ["h"], "key").filter("key <> _key OR line <> _line")
    per_doc = dropped.groupBy("key").agg(F.collect_set("line").alias("_dropped"))
    rows = _keyed(docs).join(per_doc, "key", "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_dropped", i)), "\n")
    return rows.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
                       F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                       F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(kept).alias("text"))
