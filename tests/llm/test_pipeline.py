import corpus_pipeline
import plain
from ludoscope.llm.common import prepare, stored, table

SMALL = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_keeps_what_its_plain_version_keeps(spark):
    prepare(spark)
    docs, seen = table(spark, SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stored(stage(spark, docs, SMALL), name)
        seen[name] = (docs.collect(), kept.collect(), kept.columns)
        docs = kept
    assert all(seen[n][2] == COLUMNS for n, _ in corpus_pipeline.STAGES[:-1])
    assert seen["mix_sources"][2] == [*COLUMNS, "times"]

    truth = {r["doc_id"]: r["quality"] for r in table(spark, SMALL, "labels").collect()}
    before, after, _ = seen["quality"]
    kept = {r["doc_id"] for r in after}
    good = [r["doc_id"] for r in before if truth.get(r["doc_id"]) == 1]
    bad = [r["doc_id"] for r in before if truth.get(r["doc_id"]) == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in bad) <= 0.05 * len(bad)

    before, after, _ = seen["near_dedup"]
    expected = plain.near_duplicates([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert {r["doc_id"] for r in after} == {i for i, (_, c) in expected.items() if i == c}

    before, after, _ = seen["decontaminate"]
    items = [tuple(r) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    clean = set()
    for r in before[::7]:
        n, hit, _ = plain.contamination(r["text"], items)
        if not (hit and 20 * hit >= n):
            clean.add(r["doc_id"])
    assert {r["doc_id"] for r in after} & {r["doc_id"] for r in before[::7]} == clean

    before, after, _ = seen["mask_secrets"]
    texts = {r["doc_id"]: r for r in after}
    masked = [r for r in before if texts[r["doc_id"]]["text"] != r["text"]]
    assert len(before) == len(after) and masked
    assert all(texts[r["doc_id"]]["n_chars"] == len(texts[r["doc_id"]]["text"]) for r in masked)

    before, after, _ = seen["mix_sources"]
    words = {r["doc_id"]: len(plain.SPACED.findall(r["text"])) for r in before}
    share = sum(words[r["doc_id"]] * r["times"] for r in after) / sum(words.values())
    assert 1.3 < share < 1.7 and {r["times"] for r in after} <= {1, 2}
    assert {r["doc_id"]: r["text"] for r in after}.items() <= {r["doc_id"]: r["text"] for r in before}.items()


def test_stages_take_empty_tables(spark):
    prepare(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, SMALL, "documents").limit(0), SMALL).collect() == []


def test_stages_take_awkward_rows(spark):
    prepare(spark)
    rows = [(i, t, "en", None, len(t or "")) for i, t in plain.awkward_texts()]
    docs = plain.documents(spark, rows, plain.DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert len(stage(spark, docs, SMALL).collect()) <= len(rows), name
