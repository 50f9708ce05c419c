"""Secrets in texts: keyed patterns, and runs of characters whose sliding-window entropy is high."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from freshet.llm.base import bind

#: kind, pattern, the group whose length counts, least length; failing matches still use up their text.
BASE_KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: Patterns of kinds whose short matches may be skipped by the search without changing the long ones.
_LONG_ONLY = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}


@dataclass(frozen=True)
class CharacterClass:
    """A candidate is a longest run of ``alphabet`` of ``window`` characters or more; ``bits`` is the entropy to reach."""
    kind: str
    alphabet: str
    window: int
    bits: float


HEX = CharacterClass("hex_entropy", "0123456789abcdefABCDEF", 24, 3.0)
BASE64 = CharacterClass("base64_entropy", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 4.0)
#: Candidates that match one of these in full are no secrets: numbers, plain words, words with hyphens or slashes.
ALLOWED = (r"[0-9]+", r"[A-Za-z][A-Za-z\-_/=+]*")

_SCALE = 1 << 20
_CHUNK = 256


def _running_sum(lengths: Column) -> Column:
    """Prefix sums of an array of longs, in pieces so that long arrays don't copy themselves at every step."""
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / _CHUNK).cast("int") - 1),
                         lambda k: F.slice(lengths, k * _CHUNK + 1, _CHUNK))
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("long")

    def piece(total, values):
        return F.aggregate(values, F.struct(total.alias("total"), none.alias("sums")), lambda a, x: F.struct(
            (a["total"] + x).alias("total"), F.concat(a["sums"], F.array(a["total"] + x)).alias("sums")))

    start = F.struct(zero.alias("total"), F.array().cast("array<array<bigint>>").alias("parts"))
    summed = F.aggregate(pieces, start, lambda a, values: bind(piece(a["total"], values), lambda p: F.struct(
        p["total"].alias("total"), F.concat(a["parts"], F.array(p["sums"])).alias("parts"))))
    return F.when(F.size(lengths) > 0, F.flatten(summed["parts"])).otherwise(none)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost matches that don't overlap: an array of (start, end, text, part), in code points.

    What lies between the matches and the matches themselves, laid end to end,
    give the places.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
                     F.split(text, pattern, -1).alias("between"))

    def placed(f):
        lengths = F.transform(f["whole"], lambda m, i: (F.length(m) + F.length(f["between"][i])).cast("long"))
        return bind(_running_sum(lengths), lambda ends: F.transform(f["whole"], lambda m, i: F.struct(
            (ends[i] - F.length(m)).alias("start"), ends[i].alias("end"), m.alias("text"), f["part"][i].alias("part"))))

    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string,part:string>>")
    return F.when(text.rlike(pattern), bind(found, placed)).otherwise(none)


def hot_stretch(run: Column, cls: CharacterClass) -> Column:
    """(first, last): where windows of the run reach the entropy, first start and last end; NULL where none does.

    One step per character: the character that comes in and the one that goes
    out change two counts, and the sum of c*log2(c) changes by the difference of
    two table entries.  The table is in whole millionths of a bit, so the sum
    stays exact however long the run is.
    """
    w = cls.window
    worth = F.array(*[F.lit(round(k * math.log2(k) * _SCALE) if k else 0) for k in range(w + 1)])
    most = int((math.log2(w) - cls.bits) * w * _SCALE)  # the sum may be this at most
    # Classes that hold both cases count them apart, except hex digits.
    text, alphabet = (F.lower(run), "0123456789abcdef") if cls.alphabet == HEX.alphabet else (run, cls.alphabet)
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    blank = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0).alias("sum"),
                     F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(codes):
        def inner(acc, i):
            new, old = codes[i], F.when(i >= w, codes[F.greatest(i - w, F.lit(0))])
            gone = F.when(i >= w, acc["counts"][old]).otherwise(1)
            there = acc["counts"][new] - F.when(new == old, 1).otherwise(0)
            total = acc["sum"] - worth[gone] + worth[gone - 1] + worth[there + 1] - worth[there]
            counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == new, 1).otherwise(0) - F.when(k == old, 1).otherwise(0))
            return bind(total, lambda s: F.struct(
                counts.alias("counts"), s.alias("sum"),
                F.when((i >= w - 1) & (s <= most), F.coalesce(acc["first"], i - w + 1)).otherwise(acc["first"]).alias("first"),
                F.when((i >= w - 1) & (s <= most), i + 1).otherwise(acc["last"]).alias("last")))
        return inner

    return bind(codes, lambda cs: bind(F.aggregate(F.sequence(F.lit(0), F.size(cs) - 1), blank, step(cs)),
                                       lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last"))))


def _class_pattern(cls: CharacterClass) -> str:
    return "[" + cls.alphabet.replace("-", "\\-") + "]{" + str(cls.window) + ",}"


def _span(start: Column, rank: int, kind: str, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))


def _base_spans(found: Column, rank: int, kind: str, least: int) -> Column:
    return F.transform(F.filter(found, lambda m: F.length(m["part"]) >= least),
                       lambda m: _span(m["start"], rank, kind, m["end"]))


def _entropy_spans(runs: Column, rank: int, cls: CharacterClass) -> Column:
    hot = F.transform(runs, lambda m: F.struct(m["start"].alias("start"), hot_stretch(m["text"], cls).alias("at")))
    return F.transform(F.filter(hot, lambda h: h["at"]["first"].isNotNull()),
                       lambda h: _span(h["start"] + h["at"]["first"], rank, cls.kind, h["start"] + h["at"]["last"]))


def _add_clear(spans: Column, found: Column) -> Column:
    """``spans`` and those of ``found`` that overlap none of them."""
    return bind(spans, lambda old: F.concat(old, F.filter(
        found, lambda s: ~F.exists(old, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))))


def scan_secrets(docs: DataFrame, classes=(HEX, BASE64), allowed=ALLOWED) -> DataFrame:
    """Each document with ``base_spans`` and ``spans``: arrays of (start, rank, kind, end) by start and kind.

    Base spans are the matches of :data:`BASE_KINDS`.  An entropy span covers, in
    a longest run of a class, from the first to the last window whose entropy
    reaches the class's bits, unless an allowed pattern matches the whole run or
    the span overlaps a base span or one of an earlier class.  Places are code
    points, ends exclusive.

    A NULL text has no spans.  Whole texts are searched.  Rows are worked on one
    by one, without a shuffle; repeated rows give repeated results, and the
    columns ``base_spans`` and ``spans`` replace ones of that name.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = []
    for rank, (kind, pattern, group, least) in enumerate(BASE_KINDS):
        base.append(_base_spans(matches(text, _LONG_ONLY.get(kind, pattern), group), rank, kind, least))
    out = docs.withColumn("base_spans", F.sort_array(F.concat(*base)))
    spans = F.col("base_spans")
    banned = "^(?:" + "|".join(f"(?:{p})" for p in allowed) + ")$" if allowed else "$^"
    for extra, cls in enumerate(classes, len(BASE_KINDS)):
        name = f"_spans{extra}"
        found = _entropy_spans(F.filter(matches(text, _class_pattern(cls)), lambda m: ~m["text"].rlike(banned)), extra, cls)
        out = out.withColumn(name, F.when(text.rlike(_class_pattern(cls)), _add_clear(spans, found)).otherwise(spans))
        spans = F.col(name)
    return out.withColumn("spans", F.sort_array(spans)).drop(*[f"_spans{k}" for k in range(len(BASE_KINDS), len(BASE_KINDS) + len(classes))])


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text."""
    def count(kind):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *[count(kind) for kind, *_ in BASE_KINDS],
                          F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
