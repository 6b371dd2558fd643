import numpy as np
import plain
import pytest
from ludoscope.llm import queries
from ludoscope.llm import vector_duplicates as vd
from ludoscope.llm.common import prepare, table

DDL = "vec_id long, embedding array<float>"


def expected(rows):
    """{id: (links, component)} by all cosines in double precision; ids are distinct."""
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links = {i: 0 for i, _ in rows}
    edges = []
    for k, (i, u) in enumerate(good):
        for j, v in good[k + 1 :]:
            x, y = u / np.abs(u).max(), v / np.abs(v).max()
            if len(u) == len(v) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
                links[i] += 1
                links[j] += 1
                edges.append((i, j))
    found = plain.groups([i for i, _ in rows], edges)
    return {i: (links[i], found[i]) for i, _ in rows}


def found(spark, rows, ddl=DDL):
    out = vd.near_duplicate_vectors(plain.documents(prepare(spark), rows, ddl)).collect()
    return {r["id"]: (r["n_links"], r["component_id"]) for r in out}


def test_query_equals_all_pairs(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    got = queries.queries()["op7_embedding_near_dedup"](spark, "/root/testdata/sf0.01").collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == expected(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("block", [16, 512])
def test_a_large_group_is_split_and_links_counted_once(spark, monkeypatch, block):
    monkeypatch.setattr(vd, "BLOCK", block)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(32)
    near = centre + rng.standard_normal((120, 32)) * 0.12
    rows = [(k, [float(x) for x in np.float32(v)]) for k, v in enumerate([*near, *[near[0]] * 40, *rng.standard_normal((60, 32))])]
    got, plainly = found(spark, rows), expected(rows)
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in plainly.items()}
    # Pairs at the very limit may share no bucket; nothing below it is linked.
    missed = sum(n for n, _ in plainly.values()) - sum(n for n, _ in got.values())
    assert 0 <= missed <= 0.002 * sum(n for n, _ in plainly.values())


def test_recall_just_above_the_limit(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(400):
        u, w = rng.standard_normal((2, 48))
        u /= np.linalg.norm(u)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        rows += [(2 * k, list(map(float, u))), (2 * k + 1, list(map(float, 0.951 * u + (1 - 0.951**2) ** 0.5 * w)))]
    got = found(spark, rows, "vec_id long, embedding array<double>")
    assert sum(n for n, _ in got.values()) >= 0.99 * 800


def test_unusable_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]),
            (9, [-1.0, -2.0]), (10, [1.0, 2.0, 0.0]), (11, [0.0, 0.0]), (12, [-0.0, 1.0]), (13, [0.0, 1.0]), (14, [1e-40, 2e-40])]
    got = found(spark, rows)
    assert got == {**{k: (0, k) for k in range(1, 15)}, 7: (2, 7), 8: (2, 7), 14: (2, 7), 12: (1, 12), 13: (1, 12)}


def test_repeats_null_ids_empty_tables_and_clashing_columns(spark):
    prepare(spark)
    ddl = DDL + ", class int, n_links string, vector string"
    rows = [(4, [1.0, 1.0], 1, "a", "b")] * 2 + [(None, [1.0, 1.0], 1, "a", "b"), (9, [1.0, 1.01], 1, "a", "b"), (None, None, 1, "a", "b")]
    out = vd.near_duplicate_vectors(plain.documents(spark, rows, ddl)).collect()
    assert sorted([tuple(r) for r in out], key=repr) == sorted(
        [(4, 3, 4, True)] * 2 + [(None, 3, 4, False), (9, 3, 4, False), (None, 0, None, True)], key=repr
    )
    assert found(spark, []) == {}


def test_any_finite_vector_takes_part(spark):
    rows = [(1, [1e160, 2e160]), (2, [1e160, 2.0001e160]), (3, [1.7e308, -1.7e308, 1.0]), (4, [1.6e308, -1.7e308, 0.0]),
            (5, [5e-324, 1e-323]), (6, [1.0, 2.0]), (7, [-1e160, -2e160])]
    got = found(spark, rows, "vec_id long, embedding array<double>")
    assert got == {1: (3, 1), 2: (3, 1), 3: (1, 3), 4: (1, 3), 5: (3, 1), 6: (3, 1), 7: (0, 7)}


def test_long_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((30, 3000))
    rows = [(k, list(map(float, v))) for k, v in enumerate([*base, *(base[:10] + rng.standard_normal((10, 3000)) * 0.1)])]
    assert found(spark, rows, "vec_id long, embedding array<double>") == expected(rows)


@pytest.mark.parametrize("n", [2, 300, 10_000, 10**9])
def test_signs_follow_the_vectors_and_tables_the_signs(n):
    bits, tables = vd.tables_for(n, 0.95)
    assert bits == max(8, int(np.ceil(np.log2(n)))) and n / 2**bits <= 1 or n < 256
    missed = (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables
    assert missed <= vd.MISS < (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** (tables - 1)


def test_pairs_at_the_limit_are_decided_alike_in_blocks_of_any_size():
    """A pair whose product is the limit up to the last bit: shifting rows and a matrix product agree."""
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((40, 64))
    vectors /= np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    limit = float(np.einsum("ij,ij->i", vectors[3:4], vectors[17:18])[0])
    large = {(int(a), int(b)) for a, b in zip(*vd._near_pairs(vectors, np.array([0]), np.array([40]), limit), strict=True)}
    small = {(int(a), int(b)) for a, b in zip(*vd._near_pairs(vectors[:18], np.array([0]), np.array([18]), limit), strict=True)}
    assert (3, 17) in large and (3, 17) in small and small == {p for p in large if p[1] < 18}
