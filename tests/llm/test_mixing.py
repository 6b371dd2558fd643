import plain
from ludoscope.llm import mixing
from ludoscope.llm.common import prepare

DDL = "doc_id long, text string, source string"


def mixed(spark, rows, ddl=DDL):
    return [tuple(r) for r in mixing.mix(plain.documents(prepare(spark), rows, ddl)).collect()]


def targets(sizes):
    """Plain reading of the rule: sizes by source in their order."""
    weights = [mixing.WEIGHTS[k % 3] for k in range(len(sizes))]
    total, capped, out = 1.5 * sum(sizes), set(), [0.0] * len(sizes)
    while True:
        rest = total - sum(2 * sizes[k] for k in capped)
        share = sum(w for k, w in enumerate(weights) if k not in capped)
        out = [2 * sizes[k] if k in capped else rest * weights[k] / share for k in range(len(sizes))]
        above = {k for k in range(len(sizes)) if k not in capped and out[k] > 2 * sizes[k]}
        if not above:
            return out
        capped |= above


def test_targets_stop_at_twice_the_size_and_null_is_last(spark):
    sizes = {"B": 400, "a": 30, "é": 500, "z": 5, None: 1000}
    rows = [(k, "w " * 5, s) for s, n in sizes.items() for k in range(n // 5)]
    got = {r[1]: (r[3], r[4]) for r in mixed(spark, rows)}
    order = ["B", "a", "z", "é", None]  # by code point
    expected = targets([sizes[s] for s in order])
    for s, t in zip(order, expected, strict=True):
        assert got[s][0] == sizes[s] and abs(got[s][1] - t) < 1e-6


def test_what_is_taken_comes_near_the_targets(spark):
    rows = [(k, "w " * (k % 37 + 1), f"s{k * k % 5}") for k in range(3000)]
    got = mixed(spark, rows)
    assert sorted(got, key=repr) == sorted(mixed(spark, rows), key=repr)
    taken, target = {}, {}
    for _, source, size, _, t, times, n in got:
        assert n == size * times and 0 <= times <= 2
        taken[source], target[source] = taken.get(source, 0) + n, t
    assert all(abs(taken[s] - target[s]) <= 19 for s in taken)  # half of the longest row


def test_awkward_rows(spark):
    rows = [(i, t, None if k % 3 else "s") for k, (i, t) in enumerate(plain.awkward_texts())]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    for doc, _, size, *_ in got:
        texts = {len(plain.SPACED.findall(t or "")) for i, t, _ in rows if i == doc}
        assert size in texts
    assert mixed(spark, []) == []
    assert {r[4:] for r in mixed(spark, [(1, None, "a"), (2, "", None)])} == {(0.0, 0, 0)}


def test_repeated_rows_are_taken_alike(spark):
    rows = [(1, "a b c", "s")] * 50 + [(k, "a b", "t") for k in range(2, 40)]
    assert len({r[5] for r in mixed(spark, rows) if r[1] == "s"}) == 1


def test_rows_keep_their_columns_whatever_they_are_called(spark):
    ddl = DDL + ", size int, number string, document long, target int, times string"
    docs = plain.documents(prepare(spark), [(k, "a b c", "s", 1, "n", 2, 3, "x") for k in range(20)], ddl)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert sum(r["times"] for r in out.collect()) == 30
