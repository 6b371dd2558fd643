import random

import plain
import pytest
from ludoscope.llm import near_duplicates as nd
from ludoscope.llm import queries
from ludoscope.llm.common import prepare, table

SMALL = "/root/testdata/sf0.001"


def found(spark, rows, **settings):
    out = nd.near_duplicates(plain.documents(prepare(spark), rows), **settings).collect()
    return sorted([(r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out], key=repr)


def test_query_equals_comparing_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    expected = plain.near_duplicates(rows, 2, 80)
    got = {
        r["doc_id"]: (r["n_shingles"], r["component_id"])
        for r in queries.queries()["op2_minhash_near_dedup"](spark, SMALL).collect()
    }
    assert got == expected


@pytest.mark.parametrize(("words", "seed"), [(2, 1), (5, 2)])
def test_families_with_edits_of_every_size(spark, words, seed, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    rng = random.Random(seed)
    rows = []
    for family in range(6):
        base = [f"f{family}w{k}" for k in range(120)]
        for copy in range(25):
            text = list(base)
            for _ in range(copy // 3):
                text[rng.randrange(len(text))] = f"x{rng.random()}"
            rows.append((len(rows) + 1, " ".join(text)))
    expected = plain.near_duplicates(rows, words, 80)
    got = {i: (n, c) for i, n, c, _ in found(spark, rows, words=words)}
    assert got == expected


def test_similarity_of_exactly_the_limit_links(spark):
    words = [f"w{k}" for k in range(60)]
    # Single words as shingles: 8 of 10 shared, then 79 of 100.
    rows = [(1, " ".join(words[:9])), (2, " ".join(words[1:10])), (3, " ".join(words[:45])), (4, " ".join(words[:36]))]
    got = {i: c for i, _, c, _ in found(spark, rows, words=1)}
    assert got == {i: c for i, (_, c) in plain.near_duplicates(rows, 1, 80).items()}
    assert got[2] == 1 and got[4] == 3


def test_awkward_rows(spark):
    got = found(spark, plain.awkward_texts(), words=2)
    by_id = {i: (n, c, k) for i, n, c, k in got if i is not None}
    assert len(got) == len(plain.awkward_texts())
    assert by_id[1] == (0, 1, True) and by_id[2] == (0, 2, True) and by_id[3] == (0, 3, True)
    assert by_id[4] == (1, 4, True)
    assert by_id[5] == (6, 5, True) and by_id[6] == (6, 5, False)
    assert [x for x in got if x[0] is None] == [(None, 0, None, True), (None, 6, 5, False)]
    assert by_id[8][1] == 7


def test_empty_table_and_clashing_columns(spark):
    prepare(spark)
    assert found(spark, []) == []
    ddl = "doc_id long, text string, id long, key string, component string, row_id int, n_shingles string"
    docs = plain.documents(spark, [(2, "a b c d e f", 9, "k", "c", 1, "n"), (1, "a b c d e f", 8, "k", "c", 1, "n")], ddl)
    assert [tuple(r) for r in nd.one_of_each_group(docs).collect()] == [(1, "a b c d e f", 8, "k", "c", 1, "n")]


def test_one_of_each_group_keeps_one_of_repeated_rows(spark):
    prepare(spark)
    rows = [(1, "a b c d e f")] * 3 + [(2, "a b c d e f"), (3, None), (3, None), (4, "z"), (None, "q r s t u v"), (9, "q r s t u v")]
    kept = sorted((tuple(r) for r in nd.one_of_each_group(plain.documents(spark, rows)).collect()), key=repr)
    assert kept == sorted([(1, "a b c d e f"), (3, None), (3, None), (4, "z"), (None, "q r s t u v")], key=repr)


def test_posterior_is_that_of_a_uniform_prior():
    """Against the beta density itself, summed on a fine grid."""
    import numpy as np

    grid = (np.arange(200_000) + 0.5) / 200_000
    for n, m in ((32, 20), (32, 32), (96, 70), (192, 140)):
        log = m * np.log(grid) + (n - m) * np.log1p(-grid)
        density = np.exp(log - log.max())
        exact = density[grid >= 0.8].sum() / density.sum()
        assert abs(nd.posterior(n, np.array([m]), 0.8)[0] - exact) < 1e-4


def test_pairs_are_given_up_at_one_level_of_the_posterior():
    """Whatever the batch: just below the bound the posterior is under the level, at the bound it is not."""
    import numpy as np

    bounds = nd.fewest_matches(0.8)
    batches = range(nd.BATCH, nd.HASHES + 1, nd.BATCH)
    below = max(nd.posterior(n, np.array([bounds[n] - 1]), 0.8)[0] for n in batches)
    at = min(nd.posterior(n, np.array([bounds[n]]), 0.8)[0] for n in batches)
    assert 0 < below < at < nd.MISS
    assert all(bounds[n] < bounds[n + nd.BATCH] for n in list(batches)[:-1])


def test_components_of_a_long_path(spark):
    from ludoscope.llm.components import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(301)}, 500: 500, 501: 500}


@pytest.mark.parametrize("similarity", [0.8, 0.5, 0.95])
def test_all_batches_together_prune_a_pair_at_the_limit_with_miss_at_most(similarity):
    from math import comb

    bounds, alive = nd.fewest_matches(similarity), {0: 1.0}
    for n in range(nd.BATCH, nd.HASHES + 1, nd.BATCH):
        after = {}
        for m, p in alive.items():
            for k in range(nd.BATCH + 1):
                q = p * comb(nd.BATCH, k) * similarity**k * (1 - similarity) ** (nd.BATCH - k)
                after[m + k] = after.get(m + k, 0.0) + q
        alive = {m: p for m, p in after.items() if m >= bounds[n]}
    assert 0 < 1 - sum(alive.values()) <= nd.MISS * (1 + 1e-6)
