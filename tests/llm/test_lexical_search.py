import re
from collections import Counter
from math import floor, log

import numpy as np
import plain
import pytest
from ludoscope.llm import lexical_search as ls
from ludoscope.llm import queries
from ludoscope.llm.common import prepare, table

SMALL = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(TERM.findall(plain.lower(text)))


def expected(docs, items, top=10):
    """Sorted (item, rank, id, score) by scoring all documents for all items."""
    held = [(i, c, sum(c.values())) for i, c in ((i, terms(t)) for i, t in docs) if c]
    n, total = len(held), sum(size for *_, size in held)
    df = Counter(term for _, c, _ in held for term in c)
    out = []
    for item, wanted in {(item, tuple(sorted(terms(t).items()))) for item, t in items}:
        scores = []
        for i, c, size in held:
            m = 100 - 75 + 75 * size * n // total
            score = sum(
                times * floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, times in wanted
                if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, ddl="doc_id long, text string", **settings):
    prepare(spark)
    found = ls.search(plain.documents(spark, docs, ddl), spark.createDataFrame(items, "item_id string, text string"), **settings)
    assert [str(t) for _, t in found.dtypes] == ["string", "int", "bigint", "bigint"]
    return sorted([tuple(r) for r in found.collect()], key=repr)


def test_query_equals_scoring_all_pairs(spark):
    docs = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    got = queries.queries()["op12_lexical_search"](spark, SMALL).collect()
    assert sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got], key=repr) == expected(docs, items)


def made(seed, n, hot=0):
    """Documents of a skewed vocabulary, the last ``hot`` of them equal or nearly so."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)]
    chances = 1 / np.arange(1, 61)
    chances /= chances.sum()
    docs = [(k, " ".join(rng.choice(words, rng.integers(1, 80), p=chances))) for k in range(n)]
    copy = " ".join(words[:30])
    return docs + [(n + k, copy + (" w59" if k % 7 == 0 else "")) for k in range(hot)]


ITEMS = [("a", "w1 W7 w33"), ("b", "w0 w0 w0 w59, w58"), ("c", " ".join(f"w{k}" for k in range(0, 60, 3))), ("d", "unknown words")]


@pytest.mark.parametrize("leaf, documents", [(32, 20_000), (2, 37), (1, 5)])
def test_blocks_and_leaves_of_any_size_give_the_same(spark, monkeypatch, leaf, documents):
    monkeypatch.setattr(ls, "LEAF", leaf)
    monkeypatch.setattr(ls, "DOCUMENTS", documents)
    docs = made(3, 150, 120)
    assert run(spark, docs, ITEMS) == expected(docs, ITEMS)
    assert run(spark, docs, ITEMS, top=3) == expected(docs, ITEMS, 3)


def test_items_go_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ls, "ITEM_TERMS", 5)
    docs = made(4, 60)
    assert run(spark, docs, ITEMS) == expected(docs, ITEMS)


def test_subtrees_bound_every_score_below_them(monkeypatch):
    monkeypatch.setattr(ls, "LEAF", 4)
    rng = np.random.default_rng(9)
    ranks = [np.flatnonzero(rng.random(40) < np.append(np.full(39, 0.3), 0.03)) for _ in range(200)]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in ranks])])
    counts = rng.integers(1, 9, starts[-1])
    trie = ls.Trie(np.arange(200), rng.integers(25, 300, 200), starts, np.concatenate(ranks), counts)
    weights = rng.integers(0, 9000, 40)
    scores = ls._sums(weights[trie.ranks] * trie.adds, trie.starts)
    for node in range(len(trie.low)):
        run = slice(trie.bounds[node], trie.bounds[node + 1])
        assert (weights[trie.terms[run]] * trie.most[run]).sum() >= scores[trie.low[node] : trie.high[node]].max()
    # Neighbours in the trie share their beginnings: no other order of the documents has fewer nodes.
    paths = [tuple(trie.ranks[a:b]) for a, b in zip(trie.starts, trie.starts[1:], strict=False)]
    assert paths == sorted(paths)
    # The search leaves subtrees out: it bounds and scores less than there is.
    scored, sums = [], ls._sums
    monkeypatch.setattr(ls, "_sums", lambda v, b: scored.append(len(b) - 1) or sums(v, b))
    weights[:] = 0
    weights[[1, 39]] = (10, 9000)
    best, ids = trie.best(weights, 3)
    all_scores = sums(weights[trie.ranks] * trie.adds, trie.starts)
    order = np.lexsort((trie.ids, -all_scores))[:3]
    assert best.tolist() == all_scores[order].tolist() and ids.tolist() == trie.ids[order].tolist()
    assert sum(scored) < (len(trie.low) + 200) / 2


def test_awkward_rows(spark):
    docs = plain.awkward_texts() + [(11, "W1-w2_w1"), (12, "é 漢字 É"), (13, "b a"), (14, "a b"), (None, "solo"), (15, "solo")]
    items = [("1", "a b c"), ("2", None), ("3", ""), ("4", "!?"), ("5", "w1 w2 more"), ("6", "é 漢字"), (None, "one"), ("7", "solo"),
             ("1", "a b c"), ("1", "C b, a"), ("1", "w3")]
    assert run(spark, docs, items) == expected(docs, [x for x in items])
    assert [r[2] for r in run(spark, docs, [("7", "solo")])] == [15, None]


def test_equal_scores_by_id_and_terms_that_weigh_nothing(spark):
    docs = [(k, "same words here") for k in range(40, 0, -1)]
    got = run(spark, docs, [("q", "same words")])
    assert got == expected(docs, [("q", "same words")])
    rare = docs + [(k, "other") for k in range(50, 150)]
    assert [r[2] for r in sorted(run(spark, rare, [("q", "same words")]), key=lambda r: r[1])] == list(range(1, 11))


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, [], ITEMS) == [] and run(spark, made(1, 5), []) == []
    ddl = "place long, terms string, rank int, item string, doc_id long, text string"
    docs = [(1, "t", 2, "i", 7, "w1"), (1, "t", 2, "i", 8, "zz")]
    assert run(spark, docs, ITEMS, ddl) == expected([(7, "w1"), (8, "zz")], ITEMS)
