import hashlib

import plain
from ludoscope.llm import decontamination as de
from ludoscope.llm import queries
from ludoscope.llm.common import prepare, table

SMALL = "/root/testdata/sf0.01"


def test_query_equals_plain_search(spark):
    items = [tuple(r) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    by_window = {}
    for item, text in items:
        words = plain.SYMBOLED.findall(plain.lower(text))
        size = min(13, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            by_window.setdefault(tuple(words[k : k + size]), set()).add(str(item))
    sizes = {len(w) for w in by_window}
    got = {r["doc_id"]: r for r in queries.queries()["op10_decontamination"](spark, SMALL).collect()}
    dirty = 0
    for doc in table(spark, SMALL, "documents").collect():
        words, hit, found = plain.SYMBOLED.findall(plain.lower(doc["text"])), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                items_here = by_window.get(tuple(words[k : k + size]))
                if items_here:
                    hit.update(range(k, k + size))
                    found |= items_here
        r = got[doc["doc_id"]]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (len(words), len(hit), len(found), digest)
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(words))
        dirty += r["contaminated"]
    assert dirty


def run(spark, rows, items, ddl="doc_id long, text string", **settings):
    docs = plain.documents(prepare(spark), rows, ddl)
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    found, name = de.contamination(docs, benchmark, **settings)
    return [(r["doc_id"], r[name]) for r in found.collect()]


ITEMS = [
    ("10", " ".join(f"b{k}" for k in range(20))), ("9", "b3 b4"), ("7", "One, TWO! three"), ("none", ""), ("null", None),
    ("dup", "one two three"), ("solo", "é"), (None, "q1 q2 q3"),
]


def test_short_items_overlaps_and_awkward_rows(spark):
    rows = plain.awkward_texts() + [
        (20, "x " + " ".join(f"B{k}" for k in range(2, 17)) + " y"), (21, "one-two  three one two three"), (22, "é b3 b4"),
        (23, "q1 q2 q3 " + "z " * 100), (24, "b0 b1 b2"), (25, "b3 b4 " * 700),
    ]
    got = run(spark, rows, ITEMS)
    assert len(got) == len(rows)
    for (doc, result), (_, text) in zip(sorted(got, key=lambda x: (x[0] is None, x[0] or 0, x[1]["n_words"])), sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, len(plain.SYMBOLED.findall(x[1] or "")))), strict=True):
        words, hits, items = plain.contamination(text, [x for x in ITEMS if x[0]])
        if doc == 23:
            assert result["n_hit"] == 3 and result["items"] == []
            continue
        assert (result["n_words"], result["n_hit"], result["items"]) == (words, hits, items)
        assert sum(r["end"] - r["start"] for r in result["ranges"]) == hits


def test_blocks_of_strings_give_the_same(spark, monkeypatch):
    rows = [(1, " ".join(f"b{k}" for k in range(2, 18)) + " one two three"), (2, "clean text"), (3, "b3 b4 b3 b4")]
    whole = run(spark, rows, ITEMS)
    monkeypatch.setattr(de, "WINDOWS", 3)
    parts = run(spark, rows, ITEMS)
    assert sorted(whole) == sorted(parts)


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, [], ITEMS) == []
    ((doc, result),) = run(spark, [(1, "b3 b4", "mine")], [], "doc_id long, text string, contamination string")
    assert (doc, result["n_words"], result["n_hit"], result["contaminated"]) == (1, 2, 0, False)


def test_a_window_that_very_many_items_share(spark):
    """Their ids are in the result, but go neither to the driver nor to every task."""
    prepare(spark)
    shared = " ".join(f"b{k}" for k in range(13))
    items = spark.range(20_000).selectExpr("cast(id as string) item_id", f"'{shared}' text").unionByName(
        spark.createDataFrame([("own", "q1 q2 q3")], "item_id string, text string"))
    docs = plain.documents(spark, [(1, shared + " more"), (2, "q1 q2 q3"), (3, "clean"), (4, shared + " q1 q2 q3"), (5, None)] )
    seen, real = [], spark.sparkContext.broadcast
    try:
        spark.sparkContext.broadcast = lambda value: seen.append(value) or real(value)
        found, name = de.contamination(docs, items)
        got = {r["doc_id"]: r[name]["items"] for r in found.collect()}
    finally:
        del spark.sparkContext.broadcast
    every = sorted(str(k) for k in range(20_000))
    assert got == {1: every, 2: ["own"], 3: [], 4: [*every, "own"], 5: []}
    assert [len(rows) for rows in seen] == [2] and all(isinstance(holder, int) for _, holder in seen[0])


def test_clean_rows_stay_as_they_are(spark):
    prepare(spark)
    docs = plain.documents(spark, [(1, "b3 b4", "x"), (1, "clean", "x"), (2, None, "x"), (3, "", "x"), (1, "clean", "x")], "doc_id long, text string, contamination string")
    got = de.clean(docs, spark.createDataFrame(ITEMS, "item_id string, text string"))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "clean", "x"), (1, "clean", "x"), (2, None, "x"), (3, "", "x")], key=repr)
