"""The registered queries in DuckDB's SQL, over the same test tables.

Written from the definitions, not from the Spark code: sums and roundings of money and shares are
done on whole numbers here. ``_PARTS`` are named sub-queries; a statement carries those it uses.
"""

from __future__ import annotations

import re

from ..functions.labels import POPULARITY_TIERS

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
# Games the single-game queries look up: in the catalogue, with neighbours, with events.
GAME_ID, LINKED_GAME_ID, PLAYED_GAME_ID = 300, 114, 510


# -- rounding --------------------------------------------------------------------------------------


def _round(value: str, digits: int) -> str:
    """Half-up rounding of a double."""
    return f"CAST(round(CAST({value} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def _share(part: str, whole: str, digits: int = 2) -> str:
    """100 * part / whole for whole numbers, rounded half-up."""
    scale = 10**digits
    ratio = f"(200 * {scale} * CAST({part} AS HUGEINT) + ({whole})) // nullif(2 * ({whole}), 0)"
    return f"(CAST({ratio} AS DOUBLE) / {scale}e0)"


def _mean(units: str, count: str, scale: int, digits: int) -> str:
    """Mean of values given as a sum of 10**-scale units, rounded half-up to digits."""
    up, down = 10**digits, 10**scale
    ratio = (
        f"(2 * {up} * CAST({units} AS HUGEINT) + {down} * ({count})) // nullif(2 * {down} * ({count}), 0)"
    )
    return f"(CAST({ratio} AS DOUBLE) / {up}e0)"


def _units(column: str, scale: int) -> str:
    """Sum of a column in whole 10**-scale units."""
    return f"sum(CAST(round({column} * {10**scale}) AS BIGINT))"


def _mean_of(column: str, scale: int, digits: int = 2) -> str:
    return _mean(_units(column, scale), f"count({column})", scale, digits)


def _avg(column: str) -> str:
    """Average that does not depend on the order of addition; values count to eight decimals."""
    return f"CAST(sum(CAST({column} AS DECIMAL(25,8))) AS DOUBLE) / nullif(count({column}), 0)"


# -- named sub-queries -----------------------------------------------------------------------------

_PARTS: dict[str, str] = {}

_PARTS["ev"] = """
    SELECT *, CAST((CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) * 17) % 1000 AS INTEGER) AS game_id
    FROM events"""

_TOPIC_HEAD = "CAST(event_id AS VARCHAR) AS event_id, {kind} AS event_type, ts AS event_time, {extra}CAST(user_id AS VARCHAR) AS user_id, game_id"
_PARTS["purchases"] = f"""
    SELECT {_TOPIC_HEAD.format(kind="'purchase'", extra="")},
        CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS price_usd,
        CASE WHEN event_id % 97 <> 0 THEN CAST(event_id % 4 * 25 AS INTEGER) END AS discount_pct,
        'method_' || (event_id % 4) AS payment_method, 'country_' || (user_id % 10) AS country
    FROM ev WHERE event_type = 'purchase'"""
_PARTS["reviews"] = f"""
    SELECT {_TOPIC_HEAD.format(kind="'review'", extra="")},
        CAST(1 + event_id % 10 AS INTEGER) AS rating, 1 + event_id % 10 >= 7 AS recommended,
        value AS hours_played, CAST(floor(value) AS INTEGER) AS review_length_chars,
        'lang_' || (user_id % 5) AS language, CAST(event_id % 20 AS INTEGER) AS helpful_votes
    FROM ev WHERE event_type = 'view'"""
_PARTS["sessions"] = f"""
    SELECT {_TOPIC_HEAD.format(
        kind="CASE WHEN event_type = 'signup' THEN 'session_start' WHEN event_id % 5 = 0 THEN 'session_heartbeat' ELSE 'session_end' END",
        extra="'s' || user_id AS session_id, ")},
        CASE event_type WHEN 'signup' THEN 'platform_' || (user_id % 3) END AS platform,
        CASE event_type WHEN 'signup' THEN 'device_' || (user_id % 2) END AS device,
        CASE WHEN event_type = 'error' AND event_id % 5 <> 0 THEN CAST(floor(value * 60) AS INTEGER) END AS duration_seconds
    FROM ev WHERE event_type IN ('signup', 'error')"""
_PARTS["wishlist"] = f"""
    SELECT {_TOPIC_HEAD.format(kind="'wishlist_update'", extra="")},
        CASE WHEN event_id % 7 = 0 THEN 'removed' ELSE 'added' END AS action,
        'source_' || (event_id % 3) AS source
    FROM ev WHERE event_type = 'click'"""

_MEASURES = {
    "purchases": """CAST(count(*) AS BIGINT) AS num_purchases,
        CAST(sum(CAST(round(price_usd * 10000) AS BIGINT) * (100 - discount_pct)) AS DOUBLE) / 1e6 AS revenue_net_usd""",
    "reviews": """CAST(count(*) AS BIGINT) AS num_reviews, avg(rating) AS avg_rating,
        CAST(count(*) FILTER (recommended) AS DOUBLE) * 1e2 / count(*) AS recommend_pct""",
    "sessions": """CAST(count(*) FILTER (event_type = 'session_start') AS BIGINT) AS num_starts,
        CAST(count(*) FILTER (event_type = 'session_end') AS BIGINT) AS num_ends,
        avg(duration_seconds) FILTER (event_type = 'session_end') AS avg_duration_sec""",
    "wishlist": """CAST(count(*) FILTER (action = 'added') AS BIGINT) AS num_added,
        CAST(count(*) FILTER (action = 'removed') AS BIGINT) AS num_removed,
        CAST(count(*) FILTER (action = 'added') - count(*) FILTER (action = 'removed') AS BIGINT) AS net_added""",
}
TOPICS = tuple(_MEASURES)
for _t, _m in _MEASURES.items():
    _PARTS[f"short_{_t}"] = f"""
    SELECT CAST(time_bucket(INTERVAL '30 seconds', event_time) AS TIMESTAMP) AS window_start, game_id, {_m}
    FROM {_t} GROUP BY 1, 2"""
    _PARTS[f"day_{_t}"] = f"""
    SELECT CAST(date_trunc('day', event_time) AS TIMESTAMP) AS window_start, game_id, {_m}
    FROM {_t} GROUP BY 1, 2"""
    _PARTS[f"intime_{_t}"] = f"""
    SELECT CAST(date_trunc('day', event_time) AS TIMESTAMP) AS window_start, game_id, {_m}
    FROM {_t} WHERE NOT (event_time < TIMESTAMP '2024-01-10' AND CAST(event_id AS BIGINT) % 50 = 0) GROUP BY 1, 2"""

_FLAGS = {
    "purchases": f"""{_mean("CAST(round(revenue_net_usd * 1e6) AS BIGINT)", "num_purchases", 6, 2)} AS avg_price_per_purchase,
        num_purchases >= 2 AS is_viral""",
    "reviews": """(num_reviews >= 2 AND avg_rating < 4) OR (num_reviews >= 2 AND recommend_pct < 30) AS is_review_bomb""",
    "sessions": f"""{_round("avg_duration_sec / 60e0", 1)} AS avg_duration_min, num_starts >= 2 AS is_ccu_spike""",
    "wishlist": "net_added >= 2 AS is_viral_wishlist",
}
for _t, _f in _FLAGS.items():
    _PARTS[f"staged_{_t}"] = f"""
    SELECT window_start, window_start + INTERVAL '1 day' AS window_end, game_id AS steam_app_id,
        day_{_t}.* EXCLUDE (window_start, game_id), {_f}
    FROM day_{_t}"""

_PARTS["sold"] = """
    SELECT l_partkey AS p_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
        CAST(count(*) AS INTEGER) AS ccu,
        CAST(count(*) FILTER (l_returnflag <> 'R') AS INTEGER) AS positive,
        CAST(count(*) FILTER (l_returnflag = 'R') AS INTEGER) AS negative
    FROM lineitem GROUP BY 1"""
_PARTS["priced"] = """
    SELECT p.*, p_name || ' ' || p_partkey AS title, coalesce(quantity, 0)
            * (CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 10 WHEN 3 THEN 1000 ELSE 100000 END) AS owners,
        CAST(CAST(p_retailprice - 900 AS DECIMAL(10,2)) AS DOUBLE) AS price,
        coalesce(s.ccu, 0) AS ccu, coalesce(s.positive, 0) AS positive, coalesce(s.negative, 0) AS negative
    FROM part p LEFT JOIN sold s USING (p_partkey)"""
_PARTS["cat_b"] = f"""
    SELECT CAST(p_partkey AS INTEGER) AS appid, title AS name, 'Studio ' || (p_partkey % 40) AS developer,
        p_brand AS publisher, '' AS score_rank, owners || ' .. ' || owners AS owners_range,
        CAST(owners AS BIGINT) AS owners_estimate, p_size * 37 AS average_forever, p_size * 7 AS average_2weeks,
        p_size * 29 AS median_forever, p_size * 3 AS median_2weeks, ccu, price AS price_usd,
        price AS initialprice_usd, CAST(p_partkey % 3 * 25 AS INTEGER) AS discount_pct, positive, negative,
        {_share("positive", "positive + negative", 1)} AS review_score,
        p_type || ', ' || p_brand || ', size ' || p_size || ', ' || split_part(p_name, ' ', 1) AS tags,
        'English' AS languages, p_type AS genre
    FROM priced"""
_PARTS["cat_a"] = """
    SELECT CAST(p_partkey * 10 + copy AS INTEGER) AS igdb_id, '  ' || upper(p_name || ' ' || p_partkey
            || CASE WHEN p_partkey % 3 <> 0 THEN ' remastered' ELSE '' END) || ' ' AS name,
        'About ' || p_name AS summary,
        CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 100 AS DOUBLE) + 0.5e0 END AS rating,
        CAST(p_partkey % 500 + copy AS INTEGER) AS rating_count,
        CAST(DATE '2000-01-01' + CAST(p_partkey % 9000 AS INTEGER) AS DATE) AS release_date,
        p_type || ', ' || p_brand AS genres, replace(p_name, ' ', ', ') AS themes, 'size ' || p_size AS platforms,
        p_type AS keywords, 'Single player' AS game_modes,
        CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'Team ' || (p_partkey % 30) || ', Inc.' END AS developer,
        CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS publisher
    FROM part CROSS JOIN (VALUES (0), (1)) AS c(copy)
    WHERE copy = 0 OR p_partkey % 50 = 0"""
_PARTS["stg_a"] = f"""
    SELECT igdb_id AS game_id, name AS game_name, summary, rating, {_round("rating / 10e0", 2)} AS rating_normalized,
        rating_count, release_date, genres, trim(split_part(genres, ',', 1)) AS primary_genre, themes, platforms,
        keywords, game_modes, developer, publisher, {AS_OF} AS loaded_at
    FROM cat_a"""
_PARTS["stg_b"] = f"""
    SELECT appid AS steam_app_id, name AS game_name, developer, publisher, owners_range, owners_estimate,
        ccu AS concurrent_users, price_usd, initialprice_usd AS initial_price_usd, discount_pct,
        positive AS positive_reviews, negative AS negative_reviews, review_score,
        {_round("average_forever / 60e0", 1)} AS avg_playtime_hours,
        {_round("average_2weeks / 60e0", 1)} AS avg_playtime_2weeks_hours,
        {_round("median_forever / 60e0", 1)} AS median_playtime_hours,
        CASE WHEN price_usd = 0 THEN 'free' WHEN price_usd >= 0.01e0 AND price_usd <= 9.99e0 THEN 'cheap'
             WHEN price_usd >= 10 AND price_usd <= 29.99e0 THEN 'medium'
             WHEN price_usd >= 30 AND price_usd <= 59.99e0 THEN 'premium'
             WHEN price_usd > 60 THEN 'aaa' ELSE 'unknown' END AS price_tier,
        CASE WHEN review_score IS NULL THEN 'no_reviews'
             WHEN review_score >= 95 AND positive + negative >= 500 THEN 'overwhelmingly_positive'
             WHEN review_score >= 85 THEN 'very_positive' WHEN review_score >= 70 THEN 'mostly_positive'
             WHEN review_score >= 40 THEN 'mixed' WHEN review_score >= 20 THEN 'mostly_negative'
             ELSE 'very_negative' END AS review_label,
        tags, languages, genre AS steam_genre, {AS_OF} AS loaded_at
    FROM cat_b"""


def _games_from(a: str) -> str:
    score = _round(
        "(CASE WHEN owners_estimate > 0 THEN ln(CAST(owners_estimate AS DOUBLE)) ELSE 0e0 END) * 5e0"
        " + coalesce(review_score, 0e0) * 0.3e0"
        " + (CASE WHEN concurrent_users > 0 THEN ln(CAST(concurrent_users AS DOUBLE)) ELSE 0e0 END) * 2e0",
        2,
    )
    return f"""
    SELECT *, CASE WHEN popularity_score >= 100 THEN 'superstar' WHEN popularity_score >= 70 THEN 'hit'
            WHEN popularity_score >= 40 THEN 'mid' WHEN popularity_score >= 10 THEN 'niche'
            ELSE 'unknown' END AS popularity_tier
    FROM (SELECT *, {score} AS popularity_score FROM (
        SELECT b.steam_app_id, b.game_name, b.developer AS steam_developer, b.publisher AS steam_publisher,
            b.owners_estimate, b.owners_range, b.concurrent_users, b.price_usd, b.initial_price_usd, b.discount_pct,
            b.price_tier, b.positive_reviews, b.negative_reviews, b.review_score, b.review_label,
            b.avg_playtime_hours, b.avg_playtime_2weeks_hours, b.median_playtime_hours, b.tags, b.languages,
            b.steam_genre, a.game_id AS igdb_id, a.summary AS igdb_summary, a.rating AS igdb_rating,
            a.rating_normalized AS igdb_rating_norm, a.rating_count AS igdb_rating_count, a.release_date,
            a.genres AS igdb_genres, a.primary_genre, a.themes, a.platforms, a.keywords, a.game_modes,
            a.developer AS igdb_developer, a.publisher AS igdb_publisher,
            coalesce(nullif(a.developer, ''), b.developer) AS developer,
            coalesce(nullif(a.publisher, ''), b.publisher) AS publisher,
            coalesce(nullif(a.primary_genre, ''), b.steam_genre) AS primary_genre_final
        FROM stg_b b LEFT JOIN {a} a ON lower(trim(b.game_name)) = lower(trim(a.game_name))))"""


_PARTS["games_all"] = _games_from("stg_a")
_PARTS["best_a"] = """
    SELECT * FROM stg_a
    QUALIFY row_number() OVER (PARTITION BY lower(trim(game_name)) ORDER BY rating_count DESC NULLS LAST, game_id) = 1"""
_PARTS["games"] = _games_from("best_a")

_AUDIENCE = f"""CAST(count(*) AS BIGINT) AS num_games, CAST(sum(owners_estimate) AS BIGINT) AS total_owners,
        {_mean_of("owners_estimate", 0, 0)} AS avg_owners,
        CAST(sum(positive_reviews) AS BIGINT) AS total_positive_reviews,
        CAST(sum(negative_reviews) AS BIGINT) AS total_negative_reviews,
        {_mean_of("review_score", 1)} AS avg_review_score, {_mean_of("price_usd", 2)} AS avg_price_usd,
        {_mean_of("popularity_score", 2)} AS avg_popularity_score"""
_RATE = _share("total_positive_reviews", "total_positive_reviews + total_negative_reviews") + " AS positive_rate_pct"


def _ranks(key: str) -> str:
    return f"""CAST(row_number() OVER (ORDER BY total_owners DESC, {key}) AS BIGINT) AS rank_by_owners,
        CAST(row_number() OVER (ORDER BY num_games DESC, {key}) AS BIGINT) AS rank_by_games"""


_PARTS["per_genre"] = f"""
    SELECT primary_genre_final AS genre, {_AUDIENCE} FROM games WHERE primary_genre_final <> '' GROUP BY 1"""
_PARTS["genre_stats"] = f"""
    SELECT genre, num_games, {_share("num_games", "t.games_all")} AS market_share_pct, total_owners, avg_owners,
        total_positive_reviews, total_negative_reviews, {_RATE}, avg_review_score, avg_price_usd,
        avg_popularity_score, {_ranks("genre")}
    FROM per_genre CROSS JOIN (SELECT sum(num_games) AS games_all FROM per_genre) t"""
_PARTS["per_publisher"] = f"""
    SELECT publisher, CAST(count(DISTINCT primary_genre_final) AS BIGINT) AS num_distinct_genres, {_AUDIENCE}
    FROM games WHERE publisher <> '' GROUP BY 1"""
_PARTS["publisher_stats"] = f"""
    SELECT publisher, num_games, num_distinct_genres, {_share("num_games", "t.games_all")} AS market_share_games_pct,
        total_owners, {_share("total_owners", "t.owners_all")} AS market_share_owners_pct, avg_owners, {_RATE},
        avg_review_score, avg_price_usd, avg_popularity_score, {_ranks("publisher")}
    FROM per_publisher
    CROSS JOIN (SELECT sum(num_games) AS games_all, sum(total_owners) AS owners_all FROM per_publisher) t"""
_PARTS["week_sales"] = f"""
    SELECT steam_app_id, sum(num_purchases) AS purchases,
        sum(CAST(round(revenue_net_usd * 1e6) AS BIGINT)) AS micros
    FROM staged_purchases WHERE window_start >= {AS_OF} - INTERVAL '168 hours' GROUP BY 1"""
_PARTS["per_tier"] = f"""
    SELECT price_tier, {_AUDIENCE}, CAST(coalesce(sum(purchases), 0) AS BIGINT) AS total_purchases_24h,
        (coalesce(sum(micros), 0) + 5000) // 10000 AS cents
    FROM games LEFT JOIN week_sales USING (steam_app_id) GROUP BY 1"""
_PARTS["price_analysis"] = f"""
    SELECT price_tier, num_games, avg_price_usd, total_owners, avg_owners,
        {_share("total_owners", "t.owners_all")} AS owners_share_pct, avg_review_score, avg_popularity_score,
        total_purchases_24h, CAST(cents AS DOUBLE) / 1e2 AS total_revenue_24h_usd,
        {_share("cents", "t.cents_all")} AS revenue_share_pct_24h
    FROM per_tier CROSS JOIN (SELECT sum(total_owners) AS owners_all, sum(cents) AS cents_all FROM per_tier) t"""
_PARTS["review_analysis"] = f"""
    SELECT steam_app_id, game_name, developer, publisher, primary_genre_final AS primary_genre,
        CAST(30 AS INTEGER) AS lookback_days, positive_reviews AS historical_positive,
        negative_reviews AS historical_negative, review_score AS historical_review_score,
        review_label AS historical_label, CAST(coalesce(n, 0) AS BIGINT) AS stream_reviews_period,
        r AS stream_avg_rating_period, c AS stream_recommend_pct_period,
        CAST(coalesce(bombs, 0) AS BIGINT) AS review_bomb_windows_period,
        coalesce(bomb, false) AS had_review_bomb_period,
        CAST(round(CAST(c AS DECIMAL(18,8)) - CAST(review_score AS DECIMAL(18,8)), 2) AS DOUBLE) AS sentiment_drift_pct
    FROM games LEFT JOIN (
        SELECT steam_app_id, sum(num_reviews) AS n, {_avg('avg_rating')} AS r, {_avg('recommend_pct')} AS c,
            count(*) FILTER (is_review_bomb) AS bombs, bool_or(is_review_bomb) AS bomb
        FROM staged_reviews WHERE window_start >= {AS_OF} - INTERVAL '30 days' GROUP BY 1) USING (steam_app_id)
    WHERE coalesce(n, 0) > 0 OR coalesce(bomb, false)"""
_PARTS["session_analysis"] = f"""
    SELECT steam_app_id, game_name, developer, primary_genre_final AS primary_genre, owners_estimate,
        concurrent_users AS steam_concurrent_users, avg_playtime_hours AS historical_avg_playtime_hours,
        CAST(30 AS INTEGER) AS lookback_days, CAST(coalesce(s, 0) AS BIGINT) AS total_starts_period,
        CAST(coalesce(e, 0) AS BIGINT) AS total_ends_period,
        CAST(round(CAST(dur / 60e0 AS DECIMAL(20,8)), 1) AS DOUBLE) AS avg_session_duration_min_period,
        CAST(coalesce(spikes, 0) AS BIGINT) AS ccu_spike_windows_period,
        coalesce(spike, false) AS had_ccu_spike_period, CAST(coalesce(peak, 0) AS BIGINT) AS peak_starts_in_window_period,
        {_share("coalesce(e, 0)", "coalesce(s, 0)")} AS completion_rate_pct
    FROM games LEFT JOIN (
        SELECT steam_app_id, sum(num_starts) AS s, sum(num_ends) AS e, {_avg('avg_duration_sec')} AS dur,
            count(*) FILTER (is_ccu_spike) AS spikes, bool_or(is_ccu_spike) AS spike, max(num_starts) AS peak
        FROM staged_sessions WHERE window_start >= {AS_OF} - INTERVAL '30 days' GROUP BY 1) USING (steam_app_id)
    WHERE coalesce(s, 0) > 0 OR coalesce(spike, false)"""


def _trending(days: int) -> str:
    def recent(topic: str, aggregates: str) -> str:
        return f"""(SELECT steam_app_id, {aggregates} FROM staged_{topic}
            WHERE window_start >= {AS_OF} - INTERVAL '{days} days' GROUP BY 1)"""

    return f"""
    SELECT *, total_purchases_period * 5 + total_reviews_period * 3 + total_sessions_period
            + wishlist_net_added_period * 2 AS trending_score
    FROM (SELECT steam_app_id, game_name, developer, publisher, primary_genre_final AS primary_genre,
            owners_estimate, popularity_score, popularity_tier, CAST({days} AS INTEGER) AS lookback_days,
            CAST(coalesce(p.n, 0) AS BIGINT) AS total_purchases_period,
            CAST(coalesce(p.micros, 0) AS DOUBLE) / 1e6 AS total_revenue_period_usd,
            CAST(coalesce(r.n, 0) AS BIGINT) AS total_reviews_period, r.rating AS avg_rating_period,
            r.recommend AS recommend_pct_period, CAST(coalesce(s.n, 0) AS BIGINT) AS total_sessions_period,
            s.duration AS avg_session_duration_sec_period,
            CAST(coalesce(w.net, 0) AS BIGINT) AS wishlist_net_added_period,
            coalesce(p.flag, false) AS had_viral_purchases_period, coalesce(r.flag, false) AS had_review_bomb_period,
            coalesce(s.flag, false) AS had_ccu_spike_period, coalesce(w.flag, false) AS had_viral_wishlist_period
        FROM games g
        LEFT JOIN {recent("purchases", "sum(num_purchases) AS n, sum(CAST(round(revenue_net_usd * 1e6) AS BIGINT)) AS micros, bool_or(is_viral) AS flag")} p USING (steam_app_id)
        LEFT JOIN {recent("reviews", f"sum(num_reviews) AS n, {_avg('avg_rating')} AS rating, {_avg('recommend_pct')} AS recommend, bool_or(is_review_bomb) AS flag")} r USING (steam_app_id)
        LEFT JOIN {recent("sessions", f"sum(num_starts) AS n, {_avg('avg_duration_sec')} AS duration, bool_or(is_ccu_spike) AS flag")} s USING (steam_app_id)
        LEFT JOIN {recent("wishlist", "sum(net_added) AS net, bool_or(is_viral_wishlist) AS flag")} w USING (steam_app_id))
    WHERE total_purchases_period + total_reviews_period + total_sessions_period + abs(wishlist_net_added_period) > 0"""


_PARTS["trending"] = _trending(30)
_PARTS["trending_week"] = _trending(7)

# Graph
_PARTS["named"] = """
    SELECT steam_app_id, game_name, developer, publisher, primary_genre_final AS genre, platforms, themes, tags,
        popularity_score, review_score FROM games WHERE game_name <> ''"""


def _items(column: str) -> str:
    return f"list_filter(list_transform(string_split({column}, ','), lambda x: trim(x)), lambda x: x <> '')"


def _linked(column: str, rel_type: str) -> str:
    items = _items(column)
    return f"""
    SELECT DISTINCT src_id, dst, '{rel_type}' AS rel_type
    FROM (SELECT steam_app_id AS src_id, unnest({items}) AS dst FROM named)"""


_PARTS["e_genre"] = """
    SELECT DISTINCT steam_app_id AS src_id, genre AS dst, 'BELONGS_TO' AS rel_type FROM named WHERE genre <> ''"""
_PARTS["e_developer"] = _linked("developer", "DEVELOPED_BY")
_PARTS["e_publisher"] = _linked("publisher", "PUBLISHED_BY")
_PARTS["e_platform"] = _linked("platforms", "AVAILABLE_ON")
_PARTS["e_theme"] = _linked("themes", "HAS_THEME")
_PARTS["e_tag"] = _linked("tags", "TAGGED_WITH")
# Edges of one load, of one whose scores were the review scores, and of one within a narrow gap.
for _name, _score, _gap in (("similar", "popularity_score", "0.3"), ("old", "review_score", "0.3"), ("close", "popularity_score", "0.001")):
    _PARTS[f"pool_{_name}"] = f"""
    SELECT genre, steam_app_id AS id, CAST(round({_score} * 100) AS BIGINT) AS s,
        row_number() OVER (PARTITION BY genre ORDER BY {_score} DESC, steam_app_id) AS rn
    FROM named WHERE genre <> '' AND {_score} <> 0"""
    _PARTS[f"e_{_name}"] = f"""
    SELECT a, b, similarity_score, genre FROM (
        SELECT x.id AS a, y.id AS b, x.genre,
            CAST((2000 * y.s + x.s) // (2 * x.s) AS DOUBLE) / 1e3 AS similarity_score
        FROM pool_{_name} x JOIN pool_{_name} y ON x.genre = y.genre AND y.rn > x.rn AND y.rn <= x.rn + 5
        WHERE 1000 * (x.s - y.s) < {round(1000 * float(_gap))} * x.s)
    QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY similarity_score DESC, genre DESC) = 1"""
_PARTS["n_game"] = """
    SELECT steam_app_id, game_name AS name, coalesce(review_score, 0e0) AS review_score, review_label,
        coalesce(owners_estimate, 0) AS owners_estimate, coalesce(popularity_score, 0e0) AS popularity_score,
        popularity_tier, coalesce(price_usd, 0e0) AS price_usd, price_tier,
        coalesce(concurrent_users, 0) AS ccu, coalesce(avg_playtime_hours, 0e0) AS avg_playtime_hours,
        CAST(release_date AS VARCHAR) AS release_date, primary_genre_final AS primary_genre
    FROM games WHERE game_name <> ''
    QUALIFY row_number() OVER (PARTITION BY steam_app_id ORDER BY igdb_rating_count DESC NULLS LAST, igdb_id NULLS LAST) = 1"""
_PARTS["n_genre"] = """
    SELECT name, market_share_pct, avg_review_score, num_games, total_owners, positive_rate_pct
    FROM (SELECT genre AS name, coalesce(market_share_pct, 0e0) AS market_share_pct,
            coalesce(avg_review_score, 0e0) AS avg_review_score, num_games, total_owners,
            coalesce(positive_rate_pct, 0e0) AS positive_rate_pct FROM genre_stats)
    FULL OUTER JOIN (SELECT DISTINCT dst AS name FROM e_genre) USING (name)"""
_PARTS["n_publisher"] = """
    SELECT name, market_share_pct, "rank", num_games, total_owners, avg_review_score, num_distinct_genres
    FROM (SELECT publisher AS name, coalesce(market_share_games_pct, 0e0) AS market_share_pct,
            rank_by_owners AS "rank", num_games, total_owners, coalesce(avg_review_score, 0e0) AS avg_review_score,
            num_distinct_genres FROM publisher_stats)
    FULL OUTER JOIN (SELECT DISTINCT dst AS name FROM e_publisher) USING (name)"""
_PARTS["n_other"] = """
    SELECT DISTINCT 'Developer' AS label, dst AS name FROM e_developer
    UNION ALL SELECT DISTINCT 'Platform', dst FROM e_platform
    UNION ALL SELECT DISTINCT 'Theme', dst FROM e_theme
    UNION ALL SELECT DISTINCT 'Tag', dst FROM e_tag"""

_PARTS["dominance"] = f"""
    SELECT 'publisher_dominance' AS anomaly_type, publisher AS entity_name, 'Publisher' AS entity_type,
        genre AS related_entity,
        printf('%s controls %.1f%% of %s (%d/%d games)', publisher, pct, genre, held, total) AS description,
        pct AS metric_value, CASE WHEN pct > 6 THEN 'High' ELSE 'Medium' END AS severity
    FROM (
        SELECT genre, publisher, held, total, {_share("held", "total", 1)} AS pct
        FROM (SELECT g.dst AS genre, p.dst AS publisher, count(*) AS held
              FROM e_publisher p JOIN e_genre g USING (src_id) GROUP BY 1, 2)
        JOIN (SELECT dst AS genre, count(*) AS total FROM e_genre GROUP BY 1) USING (genre)
        WHERE held >= 3 AND 100 * held > 5 * total)"""
_PARTS["isolated"] = """
    SELECT 'isolated_game' AS anomaly_type, name AS entity_name, 'Game' AS entity_type,
        CAST(NULL AS VARCHAR) AS related_entity,
        name || ' has no similar games (score:' || popularity_score || ', tier:' || popularity_tier || ', owners:'
            || format('{:,}', owners_estimate) || ')' AS description,
        popularity_score AS metric_value, CASE WHEN popularity_score > 90 THEN 'High' ELSE 'Medium' END AS severity
    FROM n_game
    WHERE owners_estimate > 100 AND popularity_score > 20
        AND steam_app_id NOT IN (SELECT a FROM e_close UNION ALL SELECT b FROM e_close)"""
_PARTS["inconsistent"] = f"""
    SELECT 'sales_inconsistency' AS anomaly_type, an AS entity_name, 'Game' AS entity_type, bn AS related_entity,
        an || ' (score:' || sa || ') vs ' || bn || ' (score:' || sb || ') - ' || printf('%.1f', ratio)
            || 'x diff despite similarity=' || similarity_score || ' (' || genre || ')' AS description,
        ratio AS metric_value, CASE WHEN ratio > 5 THEN 'High' ELSE 'Medium' END AS severity
    FROM (
        SELECT e.a, e.b, x.name AS an, y.name AS bn, x.popularity_score AS sa, y.popularity_score AS sb,
            e.similarity_score, e.genre,
            {_round("greatest(sa, sb) / least(sa, sb)", 1)} AS ratio
        FROM e_old e JOIN n_game x ON e.a = x.steam_app_id JOIN n_game y ON e.b = y.steam_app_id
        WHERE x.popularity_score > 0 AND y.popularity_score > 0
            AND greatest(x.popularity_score, y.popularity_score) / least(x.popularity_score, y.popularity_score) > 3)"""
_PARTS["findings"] = """
    SELECT * FROM dominance UNION ALL SELECT * FROM isolated UNION ALL SELECT * FROM inconsistent"""

_PARTS["flagged"] = """
    SELECT 'is_viral_purchases' AS anomaly_type, steam_app_id, window_start, num_purchases AS metric,
        CAST(NULL AS DOUBLE) AS metric_2 FROM staged_purchases WHERE is_viral
    UNION ALL SELECT 'is_review_bomb', steam_app_id, window_start, num_reviews, avg_rating
        FROM staged_reviews WHERE is_review_bomb
    UNION ALL SELECT 'is_ccu_spike', steam_app_id, window_start, num_starts, avg_duration_sec
        FROM staged_sessions WHERE is_ccu_spike
    UNION ALL SELECT 'is_viral_wishlist', steam_app_id, window_start, net_added, NULL
        FROM staged_wishlist WHERE is_viral_wishlist"""

for _t in TOPICS:
    _PARTS[f"live_{_t}"] = f"""
    SELECT '{_t}' AS topic, day_{_t}.*, window_start + INTERVAL '1 day' AS updated_at FROM day_{_t}
    WHERE window_start + INTERVAL '1 day' > {AS_OF} - INTERVAL '7 days'
    QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY window_start DESC) = 1"""
_PARTS["live"] = " UNION ALL BY NAME ".join(f"SELECT * FROM live_{t}" for t in TOPICS)


def _history(topic: str, unit: str, days: int, measures: str) -> str:
    return f"""
    SELECT CAST(date_trunc('{unit}', window_start) AS TIMESTAMP) AS bucket, {measures}
    FROM day_{topic} WHERE window_start >= {AS_OF} - INTERVAL '{days} days' GROUP BY 1"""


_HISTORY_MEASURES = {
    "purchases": """CAST(sum(num_purchases) AS BIGINT) AS purchases,
        CAST(sum(CAST(round(revenue_net_usd * 1e6) AS BIGINT)) AS DOUBLE) / 1e6 AS revenue""",
    "reviews": f"""CAST(sum(num_reviews) AS BIGINT) AS reviews, {_avg("avg_rating")} AS avg_rating,
        {_avg("recommend_pct")} AS avg_recommend_pct""",
    "sessions": f"""CAST(sum(num_starts) AS BIGINT) AS starts, CAST(sum(num_ends) AS BIGINT) AS ends,
        {_avg("avg_duration_sec")} AS avg_duration_sec""",
    "wishlist": """CAST(sum(num_added) AS BIGINT) AS added, CAST(sum(num_removed) AS BIGINT) AS removed,
        CAST(sum(net_added) AS BIGINT) AS net_added""",
}
for _t, _m in _HISTORY_MEASURES.items():
    _PARTS[f"hist_{_t}"] = _history(_t, "day", 14, _m)

_PARTS["req"] = """
    SELECT ts, event_type AS handler, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status,
        value / 1000 AS duration_s FROM events"""

_PARTS["texts"] = """
    SELECT p_partkey, p_name, p_type, p_brand, p_partkey % 10 AS m, p_partkey % 6 AS t FROM part"""


_IN_TIME = "NOT (event_time < TIMESTAMP '2024-01-10' AND CAST(event_id AS BIGINT) % 50 = 0)"
for _t in TOPICS:
    _PARTS[f"punctual_{_t}"] = f"""
    SELECT * FROM {_t} WHERE {_IN_TIME}"""
    _PARTS[f"expiring_{_t}"] = f"""
    SELECT '{_t}' AS topic, intime_{_t}.*, window_start + INTERVAL '1 day' AS updated_at FROM intime_{_t}
    WHERE window_start > (SELECT max(window_start) FROM intime_{_t}) - INTERVAL '7 days'
    QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY window_start DESC) = 1"""
    _PARTS[f"sliding_{_t}"] = f"""
    SELECT make_timestamp(w * 30000000) AS window_start, game_id, {_MEASURES[_t]}
    FROM (SELECT *, unnest(range(epoch_us(event_time) // 30000000 - 59, epoch_us(event_time) // 30000000 + 1)) AS w FROM {_t})
    GROUP BY 1, 2"""


def _play_sessions(source: str) -> str:
    return f"""
    SELECT user_id, min(event_time) AS session_start, max(event_time) AS session_end,
        CAST(epoch_us(max(event_time)) - epoch_us(min(event_time)) AS DOUBLE) / 1e6 AS played_seconds,
        count(*) AS num_events, count(*) FILTER (event_type = 'session_start') AS num_starts,
        count(*) FILTER (event_type = 'session_heartbeat') AS num_heartbeats,
        count(*) FILTER (event_type = 'session_end') AS num_ends,
        count(*) FILTER (event_type = 'session_end') > 0 AS completed
    FROM (
        SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING) AS number
        FROM (
            SELECT *, CASE WHEN event_time - lag(event_time) OVER (PARTITION BY user_id ORDER BY event_time, event_id)
                <= INTERVAL '1 day' THEN 0 ELSE 1 END AS begins FROM {source}))
    GROUP BY user_id, number"""


def _matches(prefix: str = "") -> str:
    return f"""
    SELECT p.event_id, p.event_time, p.user_id, r.event_id AS review_id, r.event_time AS review_time, r.rating
    FROM {prefix}purchases p LEFT JOIN {prefix}reviews r ON p.user_id = r.user_id
        AND r.event_time >= p.event_time AND r.event_time <= p.event_time + INTERVAL '7 days'"""


_PARTS["price_changes"] = """
    SELECT game_id, event_time AS since, CAST(event_id AS BIGINT) AS change,
        CASE WHEN CAST(event_id AS BIGINT) % 11 <> 0 THEN CAST(event_id AS BIGINT) % 60 END AS list_price
    FROM reviews
    QUALIFY row_number() OVER (PARTITION BY game_id, event_time ORDER BY CAST(event_id AS BIGINT) DESC) = 1"""
_PARTS["campaigns"] = """
    SELECT event_id AS campaign, game_id, event_time AS starts, event_time + to_hours(CAST(CASE
            WHEN CAST(event_id AS BIGINT) % 97 = 0 THEN 500 WHEN CAST(event_id AS BIGINT) % 7 = 0 THEN 50
            ELSE CAST(event_id AS BIGINT) % 5 END AS INTEGER)) AS ends
    FROM wishlist"""
# Prices in 10**-12 dollars, times a hundred; those that are no amount have none.
_PARTS["odd_purchases"] = """
    SELECT *, CAST(CASE CAST(event_id AS BIGINT) % 13 WHEN 0 THEN 1000 WHEN 1 THEN 2000000000000000000000
            WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE CAST(round(price_usd * 100) AS HUGEINT) * 10000000000 END AS HUGEINT)
        * (100 - discount_pct) AS units
    FROM purchases"""
_PARTS["load_before"] = """
    SELECT appid, name, CASE WHEN appid % 5 <> 0 THEN publisher END AS publisher, ccu FROM cat_b WHERE appid % 19 <> 0"""
_PARTS["load_once"] = """
    SELECT appid, name, CASE WHEN appid % 5 <> 0 THEN publisher END AS publisher,
        CASE WHEN appid % 29 = 0 THEN -1 ELSE ccu END AS ccu FROM cat_b WHERE appid % 23 <> 0"""


# -- statements ------------------------------------------------------------------------------------


def _with_parts(sql: str) -> str:
    """The statement with the sub-queries it needs, each after those it needs itself."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\w+", text)):
            if word in _PARTS and word not in needed and _PARTS[word] is not text:
                visit(_PARTS[word])
                if word not in needed:
                    needed.append(word)

    visit(sql)
    head = ",\n".join(f"{name} AS ({_PARTS[name]}\n)" for name in needed)
    return f"WITH {head}\n{sql}" if head else sql


_STAGED_TOPIC = """
    SELECT {topic}.* RENAME (game_id AS steam_app_id{rename}){derived},
        CAST(date_trunc('hour', event_time) AS TIMESTAMP) AS event_hour,
        CAST(date_trunc('day', event_time) AS TIMESTAMP) AS event_day, {as_of} AS loaded_at
    FROM {topic}"""


def _staged_topic(topic: str, derived: str = "", rename: str = "") -> str:
    return _STAGED_TOPIC.format(
        topic=topic, derived=f", {derived}" if derived else "", rename=rename, as_of=AS_OF
    )


def _parsed(topic: str, columns: str) -> str:
    """Parsed messages: every 101st one is unreadable and leaves a row of NULLs."""
    values = ", ".join(
        f"CASE WHEN ok THEN {c} END AS {c}" for c in (x.strip() for x in columns.split(","))
    )
    return f"SELECT {values} FROM (SELECT *, CAST(event_id AS BIGINT) % 101 <> 0 AS ok FROM {topic})"


def _quantile(q: float, bounds) -> str:
    wanted = f"CAST(requests AS DOUBLE) * {q!r}e0"
    cases = ["WHEN requests = 0 THEN NULL"]
    for i, bound in enumerate(bounds):
        below = f"le_{i - 1}" if i else "0e0"
        lower = bounds[i - 1] if i else 0.0
        cases.append(
            f"WHEN le_{i} >= {wanted} THEN {lower!r}e0 + {bound - lower!r}::DOUBLE"
            f" * (({wanted} - {below}) / nullif(le_{i} - {below}, 0e0))"
        )
    return f"CASE {' '.join(cases)} ELSE {bounds[-1]!r}e0 END AS p{round(q * 100)}"


def _latency(quantiles, by: str = "") -> str:
    bounds = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
    counts = ", ".join(
        f"CAST(count(*) FILTER (duration_s <= {b!r}e0) AS DOUBLE) AS le_{i}" for i, b in enumerate(bounds)
    )
    group = f"{by}, " if by else ""
    return f"""
    SELECT window_start, {group}requests, {", ".join(_quantile(q, bounds) for q in quantiles)}
    FROM (SELECT CAST(time_bucket(INTERVAL '5 minutes', ts) AS TIMESTAMP) AS window_start, {group}
              CAST(count(duration_s) AS BIGINT) AS requests, {counts}
          FROM req GROUP BY ALL)"""


def _rate(by: str = "") -> str:
    group = f"{by}, " if by else ""
    return f"""
    SELECT CAST(time_bucket(INTERVAL '1 minute', ts) AS TIMESTAMP) AS window_start, {group}
        count(*) / 60e0 AS req_per_sec
    FROM req GROUP BY ALL"""


_CHECKED = {
    "igdb_games": ("cat_a", "igdb_id"),
    "steamspy_games": ("cat_b", "appid"),
    "mart_games": ("games", "steam_app_id"),
    "mart_trending_games": ("trending", "steam_app_id"),
    "mart_genre_stats": ("genre_stats", "genre"),
    "mart_publisher_stats": ("publisher_stats", "publisher"),
    "mart_price_analysis": ("price_analysis", "price_tier"),
    "mart_review_analysis": ("review_analysis", "steam_app_id"),
    "mart_session_analysis": ("session_analysis", "steam_app_id"),
}


def _check(name: str, tables: dict[str, tuple[str, str]]) -> str:
    def failures(source: str, column: str) -> str:
        if name == "not_null":
            return f"SELECT count(*) FROM {source} WHERE {column} IS NULL"
        return (
            f"SELECT count(*) FROM (SELECT {column} FROM {source} WHERE {column} IS NOT NULL"
            f" GROUP BY 1 HAVING count(*) > 1)"
        )

    return " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, '{table}' AS table_name, '{column}' AS column_name,"
        f" ({failures(source, column)}) AS failures"
        for table, (source, column) in tables.items()
    )


def _report(source: str, columns: str, order: str, limit: int) -> str:
    return f"SELECT {columns} FROM {source} ORDER BY {order} LIMIT {limit}"


_TRENDING_COLUMNS = """steam_app_id, game_name, developer, publisher, primary_genre, trending_score,
    total_purchases_period, total_revenue_period_usd, total_reviews_period, avg_rating_period,
    total_sessions_period, wishlist_net_added_period, had_viral_purchases_period, had_review_bomb_period,
    had_ccu_spike_period, had_viral_wishlist_period"""
_FLAGGED_TRENDING = """(SELECT * FROM trending WHERE had_viral_purchases_period OR had_review_bomb_period
    OR had_ccu_spike_period OR had_viral_wishlist_period)"""
_LIVE_TOTALS = """
    SELECT CAST(coalesce(sum(CAST(round(revenue_net_usd * 1e6) AS BIGINT)), 0) AS DOUBLE) / 1e6 AS total_revenue,
        CAST(coalesce(sum(num_purchases), 0) AS BIGINT) AS total_purchases,
        CAST(coalesce(sum(num_reviews), 0) AS BIGINT) AS total_reviews,
        CAST(coalesce(sum(num_starts + num_ends), 0) AS BIGINT) AS total_sessions,
        CAST(coalesce(sum(net_added), 0) AS BIGINT) AS total_wishlist FROM live"""


def _live_top(topic: str, measure: str) -> str:
    return f"""(SELECT topic, game_id, CAST(coalesce({measure}, 0) AS DOUBLE) AS measure FROM live
        WHERE topic = '{topic}' ORDER BY 3 DESC, 2 LIMIT 10)"""


def _select_all(*names: str) -> dict[str, str]:
    return {name: f"SELECT * FROM {name}" for name in names}


def statements() -> dict[str, str]:
    """Registered key -> SQL."""
    sql: dict[str, str] = {}

    # Sources and sinks
    head = "event_id, event_type, event_time, user_id, game_id"
    sql["topic_parse"] = _parsed("purchases", head + ", price_usd, discount_pct, payment_method, country")
    sql["topic_parse_reviews"] = _parsed(
        "reviews", head + ", rating, recommended, hours_played, review_length_chars, language, helpful_votes"
    )
    sql["topic_parse_sessions"] = _parsed(
        "sessions", head + ", session_id, platform, device, duration_seconds"
    )
    sql["topic_parse_wishlist"] = _parsed("wishlist", head + ", action, source")
    sql["catalog_top_rated"] = """
        SELECT p_partkey AS id, p_name AS name, CAST(p_partkey % 100 AS DOUBLE) + 0.5e0 AS rating,
            CAST(p_partkey % 500 AS INTEGER) AS rating_count
        FROM part WHERE p_partkey % 7 <> 0 ORDER BY rating DESC, id LIMIT 500"""
    sql["catalog_rated"] = """
        SELECT p_partkey AS id, p_name AS name, CAST(p_partkey % 100 AS DOUBLE) + 0.5e0 AS rating,
            CAST(p_partkey % 500 AS INTEGER) AS rating_count
        FROM part WHERE p_partkey % 7 <> 0"""
    sql["catalog_pages_with_bad"] = """
        SELECT CAST(p_partkey // 10 AS INTEGER) AS page, p_partkey AS appid FROM part WHERE p_partkey // 10 % 5 <> 2"""
    sql["catalog_page_rejects"] = """
        SELECT DISTINCT CAST(p_partkey // 10 AS INTEGER) AS page, 'cut ' || (p_partkey // 10) AS body
        FROM part WHERE p_partkey // 10 % 5 = 2"""
    sql["message_rejects"] = """
        SELECT '{"event_id":' AS message FROM purchases WHERE CAST(event_id AS BIGINT) % 101 = 0"""
    sql["catalog_pages_explode"] = """
        SELECT CAST(p_partkey // 100 AS INTEGER) AS page, p_partkey AS appid, p_name AS name,
            'Studio ' || (p_partkey % 40) AS developer, p_brand AS publisher,
            format('{:,}', p_partkey * 1000) || ' .. ' || format('{:,}', p_partkey * 1000 + 3000) AS owners,
            CASE WHEN p_partkey % 13 = 0 THEN 'n/a'
                 ELSE CAST(CAST(round((p_retailprice - 900) * 100) AS BIGINT) AS VARCHAR) END AS price,
            CAST(p_partkey % 60 AS VARCHAR) AS positive,
            CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_partkey % 7 AS VARCHAR) END AS negative, p_type AS genre
        FROM part"""
    sql["write_dated"] = """
        SELECT cat_a.*, d.date FROM cat_a CROSS JOIN (VALUES (DATE '2024-01-30'), (DATE '2024-01-31')) AS d(date)"""
    sql["load_agg_incremental"] = f"""
        SELECT *, {AS_OF} AS _loaded_at FROM day_purchases WHERE game_id % 10 <> 3"""
    sql["load_events_incremental"] = f"SELECT *, {AS_OF} AS _loaded_at FROM purchases"
    for t in ("reviews", "sessions", "wishlist"):
        sql[f"load_events_incremental_{t}"] = f"SELECT *, {AS_OF} AS _loaded_at FROM {t}"
    sql["load_catalog_full_refresh"] = f"SELECT *, {AS_OF} AS _loaded_at FROM cat_b"
    sql["load_rejects"] = """
        SELECT event_id, CASE WHEN bad_game THEN '??' ELSE CAST(game_id AS VARCHAR) END AS game_id,
            CASE WHEN bad_price THEN 'free' ELSE CAST(price_usd AS VARCHAR) END AS price_usd,
            concat_ws(',', CASE WHEN bad_game THEN 'game_id' END, CASE WHEN bad_price THEN 'price_usd' END) AS problems
        FROM (SELECT *, CAST(event_id AS BIGINT) % 89 = 0 AS bad_game, CAST(event_id AS BIGINT) % 83 = 0 AS bad_price
              FROM purchases)
        WHERE bad_game OR bad_price"""
    audited = {"IGDB_GAMES": "cat_a", "STEAMSPY_GAMES": "cat_b", **{f"STREAM_{t.upper()}": t for t in TOPICS}}
    sql["load_audit_counts"] = " UNION ALL ".join(
        f"SELECT '{name}' AS tbl, CAST(count(*) AS BIGINT) AS n_rows FROM {t}" for name, t in audited.items()
    )
    sql["graph_inputs"] = """
        SELECT 'game' AS input, game_name AS name, owners_estimate AS owners FROM games WHERE game_name <> ''
        UNION ALL SELECT 'genre', genre, total_owners FROM genre_stats
        UNION ALL SELECT 'publisher', publisher, total_owners FROM publisher_stats"""

    # Catalogue normalisation
    sql["flatten_catalog_a"] = """
        SELECT p_partkey AS igdb_id, p_name AS name, CAST(NULL AS VARCHAR) AS summary,
            CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 100 AS DOUBLE) + 0.5e0 END AS rating,
            CAST(p_partkey % 500 AS INTEGER) AS rating_count,
            CASE WHEN p_partkey % 11 <> 0 THEN CAST(DATE '1970-01-01' + CAST(p_partkey AS INTEGER) AS DATE) END AS release_date,
            p_type || ', ' || p_brand AS genres, CASE WHEN p_partkey % 5 <> 0 THEN p_brand ELSE '' END AS themes,
            'size ' || p_size AS platforms, '' AS keywords, '' AS game_modes, p_brand || ', House' AS developer,
            'House' AS publisher
        FROM part"""
    price = "CAST(round((p_retailprice - 900) * 100) AS BIGINT) / 1e2"
    negative = "CAST(CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 7 ELSE 0 END AS INTEGER)"
    sql["flatten_catalog_b"] = f"""
        SELECT CAST(p_partkey AS INTEGER) AS appid, p_name AS name, 'Studio ' || (p_partkey % 40) AS developer,
            p_brand AS publisher, '' AS score_rank,
            format('{{:,}}', p_partkey * 1000) || ' .. ' || format('{{:,}}', p_partkey * 1000 + 3000) AS owners_range,
            p_partkey * 1000 + 1500 AS owners_estimate, p_size * 37 AS average_forever, 0 AS average_2weeks,
            0 AS median_forever, 0 AS median_2weeks, 0 AS ccu,
            CASE WHEN p_partkey % 13 = 0 THEN 0e0 ELSE {price} END AS price_usd, {price} AS initialprice_usd,
            0 AS discount_pct, CAST(p_partkey % 60 AS INTEGER) AS positive, {negative} AS negative,
            {_share("p_partkey % 60", f"p_partkey % 60 + {negative}", 1)} AS review_score,
            p_type || ', ' || p_brand AS tags, CAST(NULL AS VARCHAR) AS languages, p_type AS genre
        FROM part"""
    sql["owners_midpoint"] = """
        SELECT p_partkey, CASE WHEN m < 4 THEN 0 ELSE p_partkey * 1000 + 1000 END AS owners_estimate FROM texts"""
    sql["cents_to_dollars"] = f"""
        SELECT p_partkey, CASE WHEN m < 3 THEN 0e0 ELSE {_round("p_partkey / 1e2", 2)} END AS price_usd FROM texts"""
    sql["tags_to_string"] = """
        SELECT p_partkey, CASE WHEN t IN (1, 2) THEN p_type || ', ' || p_brand WHEN t = 5 THEN p_name ELSE '' END AS tags
        FROM texts"""
    sql["enrich_details"] = """
        SELECT appid, CASE WHEN appid < 500 AND appid % 4 = 0 THEN 'detail of ' || p_name ELSE tags END AS tags,
            CASE WHEN appid < 500 AND appid % 2 = 0 THEN 'English, French' ELSE languages END AS languages, genre
        FROM cat_b JOIN part ON appid = p_partkey"""

    sql["enrich_details_all"] = sql["enrich_details"].replace("appid < 500 AND ", "")

    # Windows
    for t in TOPICS:
        sql[f"win_{t}"] = f"SELECT * FROM short_{t}"
        sql[f"stream_{t}"] = f"SELECT * FROM day_{t}"
        sql[f"stream_late_{t}"] = f"SELECT * FROM intime_{t}"
        sql[f"stg_{t}_agg"] = f"SELECT * FROM staged_{t}"
    sql["raw_events"] = "SELECT * FROM sessions"
    for t in ("purchases", "reviews", "wishlist"):
        sql[f"raw_events_{t}"] = f"SELECT * FROM {t}"
    for t in TOPICS:
        sql[f"win_sliding_{t}"] = f"SELECT * FROM sliding_{t}"
        sql[f"live_state_expiring_{t}"] = f"SELECT * FROM expiring_{t}"
        sql[f"stream_unique_{t}"] = f"SELECT * FROM punctual_{t}"
    sql["unique_purchases"] = "SELECT * FROM purchases"
    sql["raw_events_since"] = """
        SELECT * FROM (
            SELECT event_id, CAST(CASE WHEN CAST(event_id AS BIGINT) % 103 = 0
                THEN event_time + INTERVAL '7 years' ELSE event_time END AS DATE) AS date, 'good' AS status,
                CAST(NULL AS VARCHAR) AS message
            FROM purchases WHERE CAST(event_id AS BIGINT) % 101 <> 0)
        WHERE date >= DATE '2024-01-10'
        UNION ALL SELECT NULL, NULL, 'reject', '{"event_id":' FROM purchases WHERE CAST(event_id AS BIGINT) % 101 = 0"""
    sql["win_purchases_odd_prices"] = """
        SELECT CAST(date_trunc('day', event_time) AS TIMESTAMP) AS window_start, game_id, count(*) AS num_purchases,
            CAST(CAST(sum(units) AS VARCHAR) || 'e-14' AS DOUBLE) AS revenue_net_usd
        FROM odd_purchases GROUP BY 1, 2"""
    sql["stg_purchases_odd_prices"] = """
        SELECT event_id, CAST(CAST((units + 500000000000) // 1000000000000 AS VARCHAR) || 'e-2' AS DOUBLE) AS revenue_net_usd
        FROM odd_purchases"""
    sql["play_sessions"] = _play_sessions("sessions")
    sql["stream_play_sessions"] = _play_sessions("punctual_sessions")
    sql["purchase_reviews"] = _matches()
    sql["stream_purchase_reviews"] = _matches("punctual_")

    # Order and time
    sql["price_in_force"] = """
        SELECT p.event_id, p.game_id, c.change, c.list_price
        FROM purchases p ASOF LEFT JOIN price_changes c ON p.game_id = c.game_id AND p.event_time >= c.since"""
    sql["campaign_events"] = """
        SELECT event_id, p.game_id, campaign FROM purchases p JOIN campaigns c
        ON p.game_id = c.game_id AND event_time >= starts AND event_time < ends"""
    sql["campaign_overlaps"] = """
        SELECT a.campaign, b.campaign AS other FROM campaigns a JOIN campaigns b ON a.game_id = b.game_id
        AND a.starts < b.ends AND b.starts < a.ends AND a.campaign < b.campaign
        WHERE a.starts < a.ends AND b.starts < b.ends"""
    sql["purchase_gaps"] = """
        SELECT event_id, game_id, epoch_us(event_time) // 1000000
            - epoch_us(lag(event_time) OVER (PARTITION BY game_id ORDER BY event_time, event_id)) // 1000000 AS seconds_since
        FROM purchases"""
    sql["owner_deciles"] = """
        SELECT steam_app_id, owners_estimate,
            CAST(ntile(10) OVER (ORDER BY owners_estimate DESC, steam_app_id) AS INTEGER) AS decile FROM games"""
    sql["load_change"] = """
        SELECT *, CASE WHEN n_before = 0 THEN 'added' WHEN n_after = 0 THEN 'removed'
            WHEN n_after > n_before THEN 'repeated' ELSE 'thinned' END AS change
        FROM (SELECT appid, name, publisher, ccu, CAST(sum(b) AS BIGINT) AS n_before, CAST(sum(a) AS BIGINT) AS n_after
              FROM (SELECT *, 1 AS b, 0 AS a FROM load_before UNION ALL SELECT *, 0, 1 FROM load_once
                    UNION ALL SELECT *, 0, 1 FROM load_once WHERE appid % 31 = 0)
              GROUP BY appid, name, publisher, ccu)
        WHERE n_before <> n_after"""
    # Sketches are exact while a group has few values, as here.
    sql["players_from_sketches"] = """
        SELECT CAST(date_trunc('week', event_time) AS TIMESTAMP) AS window_start, game_id,
            count(DISTINCT user_id) AS users
        FROM sessions GROUP BY 1, 2"""
    sql["req_latency_from_sketches"] = """
        SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, CAST(count(duration_s) AS BIGINT) AS requests,
            quantile_disc(duration_s, 0.50) AS p50, quantile_disc(duration_s, 0.95) AS p95,
            quantile_disc(duration_s, 0.99) AS p99
        FROM req WHERE duration_s IS NOT NULL GROUP BY 1"""
    sql["agg_latest_version"] = "SELECT * FROM day_purchases"

    # Staging
    sql["stg_catalog_a"] = "SELECT * FROM stg_a"
    sql["stg_catalog_b"] = "SELECT * FROM stg_b"
    sql["price_tier"] = "SELECT steam_app_id, price_usd, price_tier FROM stg_b"
    sql["review_label"] = "SELECT steam_app_id, review_score, review_label FROM stg_b"
    net = _mean("CAST(round(price_usd * 1e4) AS BIGINT) * (100 - discount_pct)", "1", 6, 2)
    sql["stg_purchases"] = _staged_topic("purchases", f"{net} AS revenue_net_usd")
    sql["stg_reviews"] = _staged_topic("reviews")
    sql["stg_sessions"] = _staged_topic(
        "sessions", f"{_mean('duration_seconds', '3600', 0, 2)} AS duration_hours"
    )
    sql["stg_wishlist"] = _staged_topic("wishlist", rename=", source AS wishlist_source")

    # Marts
    sql["mart_games"] = "SELECT * FROM games"
    sql["mart_games_all_records"] = "SELECT * FROM games_all"
    sql["popularity_score"] = "SELECT steam_app_id, igdb_id, popularity_score, popularity_tier FROM games"
    sql["popularity_tier"] = """
        SELECT popularity_tier, count(*) AS num_games, min(popularity_score) AS lowest, max(popularity_score) AS highest
        FROM games GROUP BY 1"""
    sql["mart_genre_stats"] = "SELECT * FROM genre_stats"
    sql["mart_publisher_stats"] = "SELECT * FROM publisher_stats"
    sql["mart_price_analysis"] = "SELECT * FROM price_analysis"
    sql["mart_review_analysis"] = "SELECT * FROM review_analysis"
    sql["mart_session_analysis"] = "SELECT * FROM session_analysis"
    sql["mart_trending"] = "SELECT * FROM trending"
    sql["mart_trending_lookback"] = "SELECT * FROM trending_week"

    # Graph
    sql["nodes_genre"] = "SELECT * FROM n_genre"
    sql["nodes_publisher"] = "SELECT * FROM n_publisher"
    sql["nodes_game"] = "SELECT * FROM n_game"
    sql["split_csv"] = f"SELECT steam_app_id, unnest({_items('tags')}) AS tag FROM named"
    for kind in ("genre", "developer", "publisher", "platform", "theme", "tag", "similar"):
        sql[f"edges_{kind}"] = f"SELECT * FROM e_{kind}"
    sql["nodes_other"] = "SELECT * FROM n_other"
    sql["graph_stats"] = """
        SELECT 'node' AS kind, 'Game' AS name, count(*) AS n FROM n_game
        UNION ALL SELECT 'node', 'Genre', count(DISTINCT dst) FROM e_genre
        UNION ALL SELECT 'node', 'Publisher', count(DISTINCT dst) FROM e_publisher
        UNION ALL SELECT 'node', label, count(*) FROM n_other GROUP BY label
        UNION ALL SELECT 'edge', rel_type, count(*) FROM (
            SELECT * FROM e_genre UNION ALL SELECT * FROM e_developer UNION ALL SELECT * FROM e_publisher
            UNION ALL SELECT * FROM e_platform UNION ALL SELECT * FROM e_theme UNION ALL SELECT * FROM e_tag)
            GROUP BY rel_type
        UNION ALL SELECT 'edge', 'SIMILAR_TO', count(*) FROM e_similar"""
    sql["anom_publisher_dominance"] = "SELECT * FROM dominance"
    sql["anom_isolated"] = "SELECT * FROM isolated"
    sql["anom_inconsistency"] = "SELECT * FROM inconsistent"
    sql["graph_merged"] = """
        SELECT * FROM e_similar UNION ALL SELECT * FROM e_old WHERE (a, b) NOT IN (SELECT (a, b) FROM e_similar)"""
    sql["kg_anomalies"] = f"SELECT *, {AS_OF} AS _loaded_at FROM findings"
    sql["anomaly_summary"] = "SELECT anomaly_type, severity, count(*) AS n FROM findings GROUP BY 1, 2"
    sql["similar_games"] = """
        SELECT other AS steam_app_id, name AS game_name, popularity_tier, popularity_score,
            similarity_score AS similarity, genre AS shared_genre
        FROM (SELECT b AS other, similarity_score, genre FROM e_similar WHERE a = {linked}
              UNION ALL SELECT a, similarity_score, genre FROM e_similar WHERE b = {linked} AND a <> {linked})
        JOIN n_game ON other = steam_app_id ORDER BY similarity DESC, other LIMIT 50"""

    # Read queries
    sql["q_games"] = """
        SELECT steam_app_id, game_name, developer, publisher, primary_genre_final AS primary_genre, price_usd,
            price_tier, review_score, review_label, owners_estimate, popularity_score, popularity_tier
        FROM games
        WHERE owners_estimate >= 100 AND primary_genre_final ILIKE '%econ%' AND popularity_tier = 'mid'
        ORDER BY popularity_score DESC NULLS LAST, steam_app_id, igdb_id NULLS LAST LIMIT 100"""
    sql["q_game"] = "SELECT * FROM games WHERE steam_app_id = {id}"
    sql["q_genres"] = _report(
        "genre_stats",
        "* EXCLUDE (total_positive_reviews, total_negative_reviews)",
        "rank_by_owners",
        4,
    )
    sql["q_publishers"] = _report("publisher_stats", "* EXCLUDE (avg_owners, rank_by_games)", "rank_by_owners", 20)
    sql["q_trending"] = _report(_FLAGGED_TRENDING, _TRENDING_COLUMNS, "trending_score DESC, steam_app_id", 20)
    sql["q_stream_anomalies"] = _report("flagged", "*", "window_start DESC, anomaly_type, steam_app_id", 200)
    sql["q_graph_anomalies"] = _report(
        "(SELECT * FROM findings WHERE anomaly_type = 'isolated_game' AND severity = 'High')",
        "*",
        "metric_value DESC, anomaly_type, entity_name, description",
        20,
    )
    sql["q_reviews"] = _report(
        "review_analysis",
        "* EXCLUDE (lookback_days)",
        "review_bomb_windows_period DESC, stream_reviews_period DESC, steam_app_id",
        50,
    )
    sql["q_sessions"] = _report(
        "session_analysis",
        "* EXCLUDE (lookback_days)",
        "peak_starts_in_window_period DESC, total_starts_period DESC, steam_app_id",
        50,
    )
    sql["q_prices"] = "SELECT * FROM price_analysis"
    sql["live_state"] = "SELECT * FROM live"
    for t in TOPICS:
        sql["live_state_stream" if t == "purchases" else f"live_state_stream_{t}"] = f"""
        SELECT '{t}' AS topic, day_{t}.* FROM day_{t}
        QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY window_start DESC) = 1"""
    fields = ("game_id", "num_purchases", "num_reviews", "num_starts", "net_added")
    columns = ", ".join(f"CAST({f} AS VARCHAR) AS {f}" for f in fields)
    sql["live_hash"] = f"SELECT 'stat:' || topic || ':' || game_id AS key, {columns} FROM live"
    sql["q_live_stat"] = "SELECT * FROM live WHERE topic = 'purchases' AND game_id = {played}"
    sql["q_live_all"] = "SELECT * FROM live WHERE topic = 'reviews' ORDER BY topic, game_id LIMIT 50"
    sql["hist_purchases"] = _history("purchases", "hour", 14, _HISTORY_MEASURES["purchases"])
    sql["hist_reviews"] = _history("reviews", "day", 14, _HISTORY_MEASURES["reviews"])
    sql["hist_sessions"] = _history("sessions", "week", 30, _HISTORY_MEASURES["sessions"])
    sql["hist_wishlist"] = _history("wishlist", "month", 30, _HISTORY_MEASURES["wishlist"])

    # Dashboard
    sql["kpi_home"] = """
        SELECT 'games' AS kpi, count(*) AS n FROM games
        UNION ALL SELECT 'trending', count(*) FROM trending
        UNION ALL SELECT 'graph_anomalies', count(*) FROM findings
        UNION ALL SELECT 'stream_anomalies', count(*) FROM flagged"""
    sql["kpi_live"] = _LIVE_TOTALS
    sql["kpi_pulse"] = f"""
        SELECT unnest(['Purchases', 'Reviews', 'Sessions', 'Wishlist']) AS topic,
            unnest([total_purchases, total_reviews, total_sessions, total_wishlist]) AS events
        FROM ({_LIVE_TOTALS})"""
    sql["top_n_live"] = " UNION ALL ".join(
        [
            _live_top("purchases", "revenue_net_usd"),
            _live_top("reviews", "num_reviews"),
            _live_top("sessions", "num_starts + num_ends"),
            _live_top("wishlist", "net_added"),
        ]
    )
    sql["anomaly_type_counts"] = "SELECT anomaly_type, count(*) AS n FROM flagged GROUP BY 1"
    totals = "count(*) AS n, CAST(sum(CAST({} AS DECIMAL(20,6))) AS DOUBLE) AS total"
    sql["findings_subtotals"] = f"""
        SELECT anomaly_type, severity, related_entity, grouping(anomaly_type) = 1 AS all_anomaly_type,
            grouping(severity) = 1 AS all_severity, grouping(related_entity) = 1 AS all_related_entity,
            CAST(grouping(anomaly_type, severity, related_entity) AS INTEGER) AS grouping_id, {totals.format("metric_value")}
        FROM findings GROUP BY CUBE (anomaly_type, severity, related_entity)"""
    sql["flagged_rollup"] = f"""
        SELECT anomaly_type, steam_app_id, grouping(anomaly_type) = 1 AS all_anomaly_type,
            grouping(steam_app_id) = 1 AS all_steam_app_id,
            CAST(grouping(anomaly_type, steam_app_id) AS INTEGER) AS grouping_id, {totals.format("metric_2")}
        FROM flagged GROUP BY ROLLUP (anomaly_type, steam_app_id)"""
    sql["severity_kpis"] = """
        SELECT count(*) AS total, count(*) FILTER (severity = 'High') AS high,
            count(*) FILTER (severity = 'Medium') AS medium FROM findings"""
    sql["anomaly_hierarchy"] = """
        SELECT anomaly_type, severity, entity_name, CAST(sum(CAST(metric_value AS DECIMAL(20,6))) AS DOUBLE) AS metric_value
        FROM findings
        GROUP BY GROUPING SETS ((anomaly_type, severity, entity_name), (anomaly_type, severity), (anomaly_type))"""
    sql["genre_totals"] = """
        SELECT count(*) AS genres, CAST(sum(num_games) AS BIGINT) AS total_games,
            CAST(sum(total_owners) AS BIGINT) AS total_owners FROM genre_stats"""
    sql["hist_kpis"] = """
        SELECT (SELECT CAST(sum(CAST(round(revenue * 1e6) AS BIGINT)) AS DOUBLE) / 1e6 FROM hist_purchases) AS total_revenue,
            (SELECT CAST(sum(purchases) AS BIGINT) FROM hist_purchases) AS total_purchases,
            (SELECT CAST(sum(h.reviews) AS BIGINT) FROM hist_reviews h) AS total_reviews,
            (SELECT CAST(sum(starts) AS BIGINT) FROM hist_sessions) AS total_sessions,
            (SELECT CAST(sum(net_added) AS BIGINT) FROM hist_wishlist) AS total_wishlist_net"""
    sql["trending_podium"] = _report(
        "trending",
        """game_name, trending_score, coalesce(primary_genre, '-') AS primary_genre,
            concat_ws(' ', CASE WHEN had_viral_purchases_period THEN 'VIRAL' END,
                CASE WHEN had_review_bomb_period THEN 'BOMB' END,
                CASE WHEN had_ccu_spike_period THEN 'CCU' END) AS badges""",
        "trending_score DESC, steam_app_id",
        3,
    )
    sql["top_trending"] = _report(
        "trending", "steam_app_id, game_name, trending_score", "trending_score DESC, steam_app_id", 25
    )
    sql["top_genres"] = _report(
        "genre_stats", "genre, total_owners, positive_rate_pct, rank_by_owners", "rank_by_owners", 15
    )

    # Data quality
    sql["dq_not_null"] = _check("not_null", _CHECKED)
    sql["dq_unique"] = _check("unique", _CHECKED)
    sql["dq_accepted_values"] = """
        SELECT 'accepted_values' AS check_name, 'mart_games' AS table_name, 'popularity_tier' AS column_name,
            count(*) AS failures
        FROM games WHERE popularity_tier NOT IN ({tiers})""".format(
        tiers=", ".join(f"'{t}'" for t in POPULARITY_TIERS)
    )
    sql["dq_node_keys"] = _check(
        "unique",
        {
            "Game": ("n_game", "steam_app_id"),
            "Genre": ("n_genre", "name"),
            "Publisher": ("n_publisher", "name"),
            **{
                label: (f"(SELECT * FROM n_other WHERE label = '{label}')", "name")
                for label in ("Developer", "Platform", "Theme", "Tag")
            },
        },
    )

    # Request log
    sql["req_total"] = "SELECT count(*) AS total FROM req"
    sql["req_rate"] = _rate()
    sql["req_rate_by_handler"] = _rate("handler")
    sql["req_rate_by_status"] = _rate("status")
    sql["req_error_rate"] = """
        SELECT CAST(time_bucket(INTERVAL '5 minutes', ts) AS TIMESTAMP) AS window_start,
            CAST(count(*) AS BIGINT) AS requests,
            CAST(count(*) FILTER (status BETWEEN 500 AND 599) AS DOUBLE) / count(*) AS error_rate,
            CAST(count(*) FILTER (status BETWEEN 500 AND 599) AS DOUBLE) / 300e0 AS errors_per_sec
        FROM req GROUP BY 1"""
    sql["req_latency_pct"] = _latency((0.50, 0.95, 0.99))
    sql["req_latency_p99_by_handler"] = _latency((0.99,), "handler")
    sql["req_latency_percentile"] = """
        SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, CAST(count(duration_s) AS BIGINT) AS requests,
            quantile_disc(duration_s, 0.50) AS p50, quantile_disc(duration_s, 0.95) AS p95,
            quantile_disc(duration_s, 0.99) AS p99
        FROM req GROUP BY 1"""
    ids = {"{id}": GAME_ID, "{linked}": LINKED_GAME_ID, "{played}": PLAYED_GAME_ID}
    for mark, value in ids.items():
        sql = {name: text.replace(mark, str(value)) for name, text in sql.items()}
    return {name: _with_parts(text) for name, text in sql.items()}
