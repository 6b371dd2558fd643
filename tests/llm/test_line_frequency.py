import re
from collections import Counter, defaultdict

import plain
import pytest
from helpers import plan_of
from ludoscope.llm import line_frequency as lf
from ludoscope.llm import queries
from ludoscope.llm.common import prepare, table

SMALL = "/root/testdata/sf0.01"
DDL = "doc_id long, text string, source string"


def base(text):
    """(words, characters in words, symbols, repeated lines, words in repeated passages) of one text."""
    text = text or ""
    words = plain.SPACED.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for k, window in enumerate(windows):
        if times[window] > 1:
            covered.update(range(k, k + 5))
    lines = [line for line in text.split("\n") if plain.SPACED.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def normal(line):
    line = re.sub(r"[.,;:!?'\"()\[\]-]", "", re.sub("[0-9]", "0", line.lower()))
    return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ")


def expected(rows, most_documents, most_share):
    """[(id, base counts, removed characters, failed, kept)] of (id, text, host) rows."""
    contents = {(host, text or "") for _, text, host in rows}
    holders, size = defaultdict(set), Counter(host for host, _ in contents)
    for host, text in contents:
        for line in text.split("\n"):
            if plain.SPACED.search(line):
                holders[host, normal(line)].add(text)
    gone = {k for k, v in holders.items() if len(v) > most_documents and len(v) > most_share * size[k[0]]}
    out = []
    for i, text, host in rows:
        lines = (text or "").split("\n")
        removed = sum(len("".join(plain.SPACED.findall(x))) for x in lines if (host, normal(x)) in gone)
        counts = base(text)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        out.append((i, counts, removed, failed, not failed and not counts[1] - removed < 0.2 * counts[1]))
    return sorted(out, key=repr)


def found(df):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return sorted(
        [(r["id"], tuple(r[c] for c in names), r["removed_chars"], r["base_failed"], r["kept"]) for r in df.collect()], key=repr
    )


def run(spark, rows, ddl=DDL, **settings):
    return found(lf.quality_rules(plain.documents(prepare(spark), rows, ddl), **settings))


def test_query_equals_plain_counting(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text", "source").collect()]
    got = queries.queries()["op11_quality_rules"](spark, SMALL).withColumnRenamed("doc_id", "id")
    assert found(got) == expected(rows, 20, 0.001)
    # With lower limits some lines go, and some documents with them.
    limits = {"most_documents": 2, "most_share": 0.05}
    want = expected(rows, **limits)
    assert run(spark, rows, **limits) == want
    assert any(removed for _, _, removed, _, _ in want)


def words(n, start):
    """Distinct words without digits, which normalised lines would not tell apart."""
    return " ".join("".join(chr(97 + (k // 26**j) % 26) for j in range(4)) for k in range(start, start + n))


def boilerplate(n, host="a"):
    """Documents that share two lines in several spellings; of every tenth little else is left."""
    rows = []
    for k in range(n):
        shared = f"All rights   reserved {k % 10}.\nSee OUR terms, of use and privacy of the site\n"
        own = words(3, 20 * k) if k % 10 == 0 else "\n".join(words(5, 100 * k + 10 * j) for j in range(9))
        rows.append((k, shared + own, host))
    return rows


@pytest.mark.parametrize("heavy", [1, 10**12])
def test_lines_above_the_limits_go_and_deplete(spark, monkeypatch, heavy):
    monkeypatch.setattr(lf, "HEAVY", heavy)
    rows = boilerplate(60) + [(k + 100, t, "b") for k, t, _ in boilerplate(20)] + [(k + 200, t, None) for k, t, _ in boilerplate(60)]
    got = run(spark, rows, fewest_words=3, most_documents=20, most_share=0.1)
    want = expected(rows, 20, 0.1)
    assert [(i, c, removed) for i, c, removed, _, _ in got] == [(i, c, removed) for i, c, removed, _, _ in want]
    removed = {i: removed for i, _, removed, _, _ in got}
    kept = {i: kept for i, *_, kept in got}
    assert removed[5] > 0 and kept[5] and removed[0] > 0 and not kept[0]
    assert removed[105] == 0 and kept[105]  # twenty documents of a host are not above the limit
    assert removed[205] == removed[5]
    assert got == want


def test_copies_are_one_document(spark):
    text = "\n".join(words(6, 10 * k) for k in range(8))
    rows = [(k, text, "a") for k in range(300)] + [(400 + k, f"{text}\nand {k * 'z'} at its end", "a") for k in range(19)]
    assert not any(removed for _, _, removed, _, _ in run(spark, rows, most_share=0.0))
    assert all(removed for _, _, removed, _, _ in run(spark, rows + [(500, text + "\nlast", "a")], most_share=0.0))


def test_the_share_spares_what_few_of_many_documents_hold(spark):
    rows = [(k, ("common line of some documents here\n" if k < 30 else "") + words(12, 20 * k), "a") for k in range(300)]
    assert not any(r[2] for r in run(spark, rows, most_share=0.2))
    assert sum(r[2] > 0 for r in run(spark, rows, most_share=0.05)) >= 30


def test_awkward_rows(spark):
    lines = "\n".join(f"line {k} é" for k in range(50_000))
    rows = [(i, text, "s") for i, text in plain.awkward_texts()] + [
        (20, "a b c d e f g h i j\r\na b c d e f g h i j\r\n", None), (21, "\n\n \n", "s"), (22, "a b c d e a b c d e", "s"),
        (23, "x y 漢字 #*$%&|<>", None), (24, lines, "s"), (25, "a b c d e f\na b c d e f\n a b c d e f", ""),
    ]
    assert run(spark, rows) == expected(rows, 20, 0.001)
    got = {r[0]: r for r in run(spark, rows)}
    assert got[1][1] == (0, 0, 0, 0, 0) and not got[1][4]
    assert got[22][1][4] == 10 and got[23][1][2] == 8


def test_empty_tables_clashing_columns_and_other_ids(spark):
    assert run(spark, []) == []
    ddl = "content string, host string, lines string, id int, doc_id string, text string, source int, removed string"
    text = " ".join(f"w{k}" for k in range(12))
    ((i, counts, removed, failed, kept),) = run(spark, [("c", "h", "l", 1, "d", text, 3, "r")], ddl)
    assert (i, counts[0], removed, failed, kept) == ("d", 12, 0, False, True)


def test_texts_without_frequent_lines(spark):
    prepare(spark)
    rows = [(i, t, h, "mine") for i, t, h in boilerplate(60)] + [(90, None, "a", "mine"), (91, "", "a", "mine"), (92, "other\ttext\n", "a", "mine")]
    docs = plain.documents(spark, rows, DDL + ", content string")
    got = lf.without_frequent_lines(docs, most_documents=20, most_share=0.1)
    assert got.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert len(texts) == len(rows) and {r["content"] for r in got.collect()} == {"mine"}
    assert texts[90] is None and texts[91] == "" and texts[92] == "other\ttext\n"
    assert texts[5] == rows[5][1].split("\n", 2)[2] and texts[10] == words(3, 200)


def test_no_python_in_the_plan(spark):
    docs = plain.documents(prepare(spark), boilerplate(3), DDL)
    for df in (lf.quality_rules(docs), lf.without_frequent_lines(docs), lf._digest(docs, [], "text", "source")):
        assert not re.search("Python|Pandas|Arrow", plan_of(df))
