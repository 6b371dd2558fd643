"""Catalogue pages, normalisation and the bands over prices, scores and reviews."""

import json

from helpers import column, frame, rows
from ludoscope.functions import labels, text
from ludoscope.operators import normalize
from ludoscope.sources import catalogs
from pyspark.sql import functions as F


def test_price_tier_bands_and_gaps(spark):
    want = {
        None: "unknown", -1.0: "unknown", 0.0: "free", 0.005: "unknown", 0.01: "cheap", 9.99: "cheap",
        9.995: "unknown", 10.0: "medium", 29.99: "medium", 30.0: "premium", 59.99: "premium",
        60.0: "unknown", 60.01: "aaa",
    }
    df = frame(spark, "p double", [(p,) for p in want]).select("p", labels.price_tier(F.col("p")).alias("t"))
    assert dict(rows(df)) == want


def test_review_label(spark):
    cases = [
        (None, 0, "no_reviews"), (95.0, 499, "very_positive"), (95.0, 500, "overwhelmingly_positive"),
        (85.0, 1, "very_positive"), (70.0, 1, "mostly_positive"), (40.0, 1, "mixed"),
        (20.0, 1, "mostly_negative"), (19.9, 1, "very_negative"),
    ]
    df = frame(spark, "s double, n int, want string", cases)
    assert df.filter(labels.review_label(F.col("s"), F.col("n")) != F.col("want")).count() == 0


def test_popularity_tier(spark):
    cases = [(100.0, "superstar"), (99.99, "hit"), (70.0, "hit"), (40.0, "mid"), (10.0, "niche"),
             (9.99, "unknown"), (None, "unknown")]
    df = frame(spark, "s double, want string", cases)
    assert df.filter(labels.popularity_tier(F.col("s")) != F.col("want")).count() == 0


def test_owners_midpoint(spark):
    cases = [("100,000 .. 200,000", 150_000), ("0 .. 20,000", 10_000), ("1 .. 2", 1), ("", 0), (None, 0),
             ("a .. b", 0), ("5", 0), ("1.5 .. 2", 0), ("1 .. ", 0)]
    df = frame(spark, "v string, want bigint", cases)
    assert df.filter(text.owners_midpoint(F.col("v")) != F.col("want")).count() == 0


def test_cents_to_dollars(spark):
    cases = [("999", 9.99), ("0", 0.0), ("", 0.0), (None, 0.0), ("x", 0.0), ("1234.5", 12.35)]
    df = frame(spark, "v string, want double", cases)
    assert df.filter(text.cents_to_dollars(F.col("v")) != F.col("want")).count() == 0


def test_tags_to_string(spark):
    cases = [
        ('{"RPG": 5, "Indie": 3}', "RPG, Indie"), ('["a", "b"]', "a, b"), ("[]", ""), ("{}", ""),
        (None, ""), ("plain", "plain"), ("[1, 2]", "1, 2"), (' {"x": 1}', "x"),
    ]
    df = frame(spark, "v string, want string", cases)
    assert df.filter(text.tags_to_string(F.col("v")) != F.col("want")).count() == 0


def test_split_csv(spark):
    df = frame(spark, "v string", [(" a, ,b,c , d",), ("",), (None,)])
    got = [r[0] for r in df.select(text.split_csv(F.col("v"), 3)).collect()]
    assert got == [["a", "b", "c"], [], []]
    assert df.select(F.size(text.split_csv(F.col("v")))).first()[0] == 4


def test_flatten_nested_record(spark, tmp_path):
    record = {
        "id": 1, "name": "Game", "rating": 80.5, "rating_count": 3, "first_release_date": 86_399,
        "genres": [{"name": "RPG"}, {"name": ""}, {"id": 3}, {"name": "Indie"}], "themes": [],
        "involved_companies": [
            {"company": {"name": "A"}, "developer": True, "publisher": False},
            {"company": {"name": "B"}, "developer": True, "publisher": True},
            {"company": {}, "developer": True}, {"developer": True}, {"company": {"name": "C"}},
        ],
    }
    (tmp_path / "page.json").write_text(json.dumps([record, {"id": 2, "first_release_date": -1}]))
    flat = normalize.flatten_catalog_a(catalogs.read_catalog_a(spark, str(tmp_path))).orderBy("igdb_id")
    first, second = flat.collect()
    assert (first.genres, first.themes, first.platforms) == ("RPG, Indie", "", "")
    assert (first.developer, first.publisher, str(first.release_date)) == ("A, B", "B", "1970-01-01")
    assert (second.developer, second.rating, str(second.release_date)) == ("", None, "1969-12-31")


def test_top_rated_skips_unrated_and_breaks_ties(spark):
    df = frame(spark, "id bigint, rating double", [(3, 9.0), (1, 9.0), (2, None), (4, 10.0)])
    assert column(catalogs.top_rated(df, 2), "id", F.col("rating").desc()) == [4, 1]
    assert rows(catalogs.top_rated(df).select("id")) == [(1,), (3,), (4,)]


def test_all_pages_count(spark, tmp_path):
    pages = {
        0: {"10": {"name": "ten", "tags": {"a": 1}, "positive": 3, "negative": 1, "price": "999"}},
        1: {"20": {"name": "twenty", "tags": ["b"], "owners": "0 .. 20,000"}, "bad": {"name": "no id"}},
        2: {},
        3: {"30": {"name": "thirty"}},
    }
    for number, page in pages.items():
        (tmp_path / f"{number}.json").write_text(json.dumps(page))
    raw = catalogs.read_catalog_b_pages(spark, str(tmp_path))
    records = catalogs.explode_pages(raw)
    assert sorted(rows(records.select("page", "appid")), key=str) == [(0, 10), (1, 20), (1, None), (3, 30)]
    assert catalogs.rejected_pages(raw).count() == 0
    assert catalogs.explode_pages(raw, max_pages=1).count() == 1
    flat = {r.appid: r for r in normalize.flatten_catalog_b(records).collect()}
    assert (flat[10].review_score, flat[10].price_usd, flat[10].tags, flat[10].ccu) == (75.0, 9.99, "a", 0)
    assert (flat[20].review_score, flat[20].owners_estimate, flat[20].tags) == (None, 10_000, "b")


def test_unreadable_page_is_set_apart(spark):
    pages = frame(spark, "page int, body string", [(0, '{"1": {"name": "a"}}'), (1, "<html>"), (2, '{"2": {}}')])
    assert rows(catalogs.explode_pages(pages).select("appid")) == [(1,), (2,)]
    assert rows(catalogs.rejected_pages(pages)) == [(1, "<html>")]


def test_enrich_details_overwrites_only_with_values(spark):
    games = frame(spark, "appid int, tags string, languages string, genre string",
                  [(1, "t1", "l1", "g1"), (2, "t2", "l2", "g2"), (3, "t3", "l3", "g3")])
    details = frame(spark, "appid int, tags string, languages string, genre string",
                    [(1, "new", "", None), (3, "new", "new", "new")])
    assert rows(normalize.enrich_details(games, details, first=2)) == [
        (1, "new", "l1", "g1"), (2, "t2", "l2", "g2"), (3, "t3", "l3", "g3")]
    assert rows(normalize.enrich_details(games, details))[2] == (3, "new", "new", "new")
