import numpy as np
import plain
import pytest
from ludoscope.llm import queries, whitening
from ludoscope.llm.common import prepare, table

SMALL = "/root/testdata/sf0.01"
DDL = "vec_id long, embedding array<double>"


def plainly(vectors, count=32):
    """(deviations, whitened, explained) in doubles, with exact deviations."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64)
    n = len(x)
    d = (n * x - x.sum(axis=0)).astype(object)
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    some = values[:count] > 1e-9 * values[0]
    values, axes = values[:count][some], axes[:, :count][:, some]
    return (d * d).sum(axis=1), centred @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def run(spark, rows, ddl=DDL, **settings):
    return whitening.whiten(plain.documents(prepare(spark), rows, ddl), **settings).collect()


def agree(got, ids, vectors, count=32):
    deviations, white, explained = plainly(vectors, count)
    by_id = {r["id"]: r for r in got}
    assert sorted(by_id) == sorted(ids)
    mine = np.array([by_id[i]["whitened"] for i in ids])
    assert mine.shape == white.shape
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-6
    assert [int(by_id[i]["deviation"]) for i in ids] == deviations.tolist()
    assert np.allclose(got[0]["explained"], explained, rtol=1e-9) and got[0]["identity_error"] < 1e-9
    assert {r["n"] for r in got} == {len(ids)}


def test_query_equals_plain_components(spark):
    rows = table(spark, SMALL, "embeddings").collect()
    ids, vectors = [r["vec_id"] for r in rows], [list(r["embedding"]) for r in rows]
    deviations, white, explained = plainly(vectors)
    got = queries.queries()["op13_embedding_whitening"](spark, SMALL).toPandas().sort_values(["vec_id", "component"])
    assert got.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.component.tolist() == [*range(1, 33)] * len(ids)
    order = np.argsort(ids)
    mine = got.whitened.to_numpy().reshape(len(ids), 32)
    assert np.abs(mine * np.sign((mine * white[order]).sum(axis=0)) - white[order]).max() < 1e-8
    assert got.deviation.tolist() == np.repeat(deviations[order].astype(np.int64), 32).tolist()
    assert np.allclose(got.explained.to_numpy()[:32], explained, rtol=1e-12) and got.identity_error.max() < 1e-10


def leverrier(matrix):
    """Coefficients of det(x - matrix), of x**0 first, in Python's integers."""
    d = len(matrix)
    one, power, out = np.array([[int(i == j) for j in range(d)] for i in range(d)], object), np.zeros((d, d), object), [0] * d + [1]
    for k in range(1, d + 1):
        power = matrix.dot(power) + out[d - k + 1] * one
        out[d - k] = -sum(matrix.dot(power).diagonal()) // k
    return out


def integers(seed, rows, columns, most=50):
    x = np.random.default_rng(seed).integers(-most, most, (rows, columns)).astype(object)
    return x.T.dot(x)


@pytest.mark.parametrize("matrix", [integers(1, 30, 7), integers(2, 3, 6), np.diag([5, 5, 3, 3, 3, 0, 0, 1]).astype(object), integers(3, 9, 1), integers(4, 40, 5, 10**9)])
def test_polynomial_is_exact(spark, matrix):
    assert whitening.characteristic_polynomial(spark, matrix) == leverrier(matrix)


def test_roots_that_lie_close_or_coincide():
    close = np.diag([10**12, 10**12 - 1, 10**12 - 1, 7, 3, 3, 1]).astype(object)
    polynomial = leverrier(close)
    found = [whitening.root(polynomial, k, sum(close.diagonal())) for k in range(1, 8)]
    assert [m / (1 << s) for m, s, _, _ in found] == pytest.approx([10**12, 10**12 - 1, 10**12 - 1, 7, 3, 3, 1], rel=1e-15)
    assert [(first, count) for _, _, first, count in found] == [(1, 1), (2, 2), (2, 2), (4, 1), (5, 2), (5, 2), (7, 1)]
    vectors = np.array([whitening.null_vectors(close, m, s, count)[k - first] for k, (m, s, first, count) in enumerate(found, 1)])
    assert np.abs(vectors @ vectors.T - np.eye(7)).max() < 1e-15
    assert np.abs(np.abs(vectors[[0, 3, 6]]).max(axis=1) - 1).max() < 1e-15


def test_products_are_exact_at_any_size():
    for most in (100, 2**30, 2**62):
        x = np.random.default_rng(5).integers(-most, most, (50, 4))
        big = x.astype(object)
        assert (whitening._gram(x) == big.T.dot(big)).all()
        assert whitening._squares(x) == (big * big).sum(axis=1).tolist()


def test_large_and_small_entries(spark):
    rng = np.random.default_rng(6)
    for scale in (0.02, 1.0, 1e9):
        vectors = (rng.standard_normal((80, 5)) * scale * [5, 4, 3, 2, 1]).tolist()
        agree(run(spark, list(enumerate(vectors))), list(range(80)), vectors)
    got = run(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.5])])
    assert len(got) == 3 and all(len(r["whitened"]) == 2 for r in got) and got[0]["identity_error"] < 1e-4


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((30, 4)).tolist()
    out = [(100, None), (101, []), (102, [nan, 0.0, 0.0, 0.0]), (103, [inf, 0.0, 0.0, 0.0]), (104, [None, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [-inf] * 4)]
    agree(run(spark, [*enumerate(vectors), *out]), list(range(30)), vectors)
    agree(run(spark, list(enumerate(vectors)), components=2), list(range(30)), vectors, 2)


def test_without_variance_components_are_left_out(spark):
    same = run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])
    assert sorted([tuple(r) for r in same], key=repr) == sorted([(i, 3, "0", [], [], 0.0) for i in (1, 2, None)], key=repr)
    line = [(k, [k / 64, 2 * k / 64, 5.0]) for k in range(4)]
    got = sorted(run(spark, line), key=lambda r: r["id"])
    assert [len(r["whitened"]) for r in got] == [1] * 4 and got[0]["explained"] == [1.0]
    assert np.abs(np.abs([r["whitened"][0] for r in got]) - np.abs((np.arange(4) - 1.5) / np.sqrt(1.25))).max() < 1e-14


def test_repeats_empty_tables_and_clashing_columns(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
    ddl = "n int, id string, vector string, vec_id string, embedding array<float>"
    rows = [(1, "i", "v", k, v) for k, v in [("a", [0.5, 0.0]), ("a", [0.5, 0.0]), (None, [0.0, 0.25])]]
    got = run(spark, rows, ddl)
    assert sorted([r["id"] or "" for r in got]) == ["", "a", "a"] and {r["n"] for r in got} == {3}
    assert len({tuple(r["whitened"]) for r in got if r["id"]}) == 1
