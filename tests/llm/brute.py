"""What the operators compute, said plainly."""

import collections
import math
import re

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def shingle_set(text, n):
    w = BLANKS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + n]) for k in range(max(len(w) - n + 1, min(len(w), 1))))


def near_copies(rows, n, percent):
    """{doc_id: (shingles, component)} for rows with distinct doc_ids."""
    sets = {i: shingle_set(t, n) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k]
             if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = groups(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def quality_base(text):
    text = text or ""
    w, seen, dup = BLANKS.findall(text), set(), 0
    for line in text.split("\n"):
        if BLANKS.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
    count, hit = collections.Counter(windows), set()
    for k, x in enumerate(windows):
        if count[x] > 1:
            hit.update(range(k, k + 8))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def targets(sizes):
    """{source: target} from {source: size}, sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        rest = sum(weight[s] for s in order if s not in stopped)
        goal = {s: 3 * sizes[s] if s in stopped else left * weight[s] / rest for s in order}
        over = {s for s in order if s not in stopped and goal[s] > 3 * sizes[s]}
        if not over:
            return goal
        stopped |= over


def secret_spans(text, kinds, classes, allowed):
    text, spans = text or "", []
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        spans += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    base = sorted(spans)
    for rank, c in enumerate(classes, len(kinds)):
        old = list(spans)
        for m in re.finditer("[" + re.escape(c.alphabet) + "]{%d,}" % c.window, text):
            run = m.group().lower() if set(c.alphabet) == set("0123456789abcdefABCDEF") else m.group()
            hot = [k for k in range(len(run) - c.window + 1) if entropy(run[k:k + c.window]) >= c.bits - 1e-7]
            if hot and not any(re.fullmatch(a, m.group()) for a in allowed):
                a, b = m.start() + hot[0], m.start() + hot[-1] + c.window
                if not any(x[0] < b and a < x[3] for x in old):
                    spans.append((a, rank, c.kind, b))
    return [",".join(f"{k}:{a}:{b}" for a, _, k, b in x) for x in (base, sorted(spans))]


def entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in collections.Counter(window).values())


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near_lines(rows, normal, percent, distance):
    """({different normalised line: its group}, links): plain edit similarity of every two different lines."""
    names = list(dict.fromkeys(n for _, t in rows if t for n in map(normal, t.split("\n")) if n))
    letters = [collections.Counter(n) for n in names]
    links = []
    for k, a in enumerate(names):
        for j, b in enumerate(names[:k]):
            most = (100 - percent) * max(len(a), len(b))
            # An edit takes at most one letter away and adds one.
            if 100 * max(sum((letters[k] - letters[j]).values()), sum((letters[j] - letters[k]).values())) <= most:
                if 100 * distance(a, b) <= most:
                    links.append((a, b))
    return groups(names, links), links
