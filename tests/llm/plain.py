"""Plain versions of the operators, and small tables with awkward rows."""

import re
from collections import defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark, rows, ddl="doc_id long, text string"):
    return spark.createDataFrame(rows, ddl)


def awkward_texts():
    """(id, text): null, empty, blank, repeated, tied and very long texts, and a null id."""
    long = " ".join(f"w{k % 997}" for k in range(60_000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a b c d e f g"), (5, "a b c d e f g"),
        (6, "A B C D E F G"), (None, "a b c d e f g"), (None, None), (7, long), (8, long + " more"),
        (9, "é" * 3000), (10, "x" * 300_000),
    ]


def groups(nodes, links):
    """Smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, size):
    words = SPACED.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def near_duplicates(rows, size, percent):
    """{id: (set size, component)} by comparing all pairs; ids are distinct."""
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            u, v = sets[a], sets[b]
            if u and v and percent * max(len(u), len(v)) <= 100 * min(len(u), len(v)):
                both = len(u & v)
                if 100 * both >= percent * (len(u) + len(v) - both):
                    links.append((a, b))
    found = groups(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def contamination(text, items, length=13):
    """(words, hit words, sorted ids of found items) of one text."""
    words = SYMBOLED.findall(lower(text))
    hit, found = set(), set()
    for item, item_text in items:
        theirs = SYMBOLED.findall(lower(item_text))
        size = min(length, len(theirs))
        windows = {tuple(theirs[k : k + size]) for k in range(len(theirs) - size + 1)} if size else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def unigram(training, text):
    """(tokens, known tokens, training tokens, log10 probability)."""
    from math import log10

    counts = defaultdict(int)
    for t in training:
        for w in [*SPACED.findall(lower(t)), None]:
            counts[w] += 1
    total, tokens = sum(counts.values()), [*SPACED.findall(lower(text)), None]
    score = sum(log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in tokens)
    return len(tokens), sum(w in counts for w in tokens), total, score
