"""Registered queries of games: sides, their past, both put together, aggregates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import great_circle_km  # noqa: F401
from ..operators import asof, evaluate, history, matchups
from .queries import query
from .views import EVENTS, GAMES, PROBABILITIES, SIDES, events, games, probabilities, r6, table

_PAST = "(PARTITION BY team ORDER BY d, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LAST = lambda w: f"(PARTITION BY team ORDER BY d, game_id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


def _sides(spark, sf):
    return matchups.sides(games(spark, sf))


@query(f"SELECT game_id, team, opp, is_home, pts, opp_pts, won FROM {SIDES}")
def p2_p5_sides(spark, sf):
    return _sides(spark, sf).select("game_id", "team", "opp", "is_home", "pts", "opp_pts", "won")


@query(f"SELECT game_id, team, round(CASE WHEN opp_pts - 70 > 0 THEN (pts - 70) / (opp_pts - 70) END, 6) AS rate, round(pts / (pts + opp_pts), 6) AS share FROM {SIDES}")
def p3_game_rates(spark, sf):
    s = _sides(spark, sf)
    return s.select("game_id", "team", r6(F.when(F.col("opp_pts") > 70, (F.col("pts") - 70) / (F.col("opp_pts") - 70)), "rate"), r6(F.col("pts") / (F.col("pts") + F.col("opp_pts")), "share"))


@query("SELECT o_orderkey AS id, CAST(regexp_matches(lower(method), 'ko|tko|sub') AS INT) AS is_finish, CASE o_orderstatus WHEN 'F' THEN 'red' WHEN 'O' THEN 'blue' END AS winner FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'KO/TKO' WHEN 1 THEN 'Decision' WHEN 2 THEN 'Submission' ELSE 'DQ' END AS method FROM orders) WHERE o_orderstatus <> 'P'")
def p4_fight_table(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    k = F.col("o_orderkey") % 4
    method = F.when(k == 0, "KO/TKO").when(k == 1, "Decision").when(k == 2, "Submission").otherwise("DQ")
    return o.select(F.col("o_orderkey").alias("id"), F.lower(method).rlike("ko|tko|sub").cast("int").alias("is_finish"), F.when(F.col("o_orderstatus") == "F", "red").when(F.col("o_orderstatus") == "O", "blue").alias("winner"))


_PAIR = "least(home::VARCHAR, away::VARCHAR) || '|' || greatest(home::VARCHAR, away::VARCHAR)"


@query(f"SELECT game_id, ('0x' || substr(sha256(d::VARCHAR || '|' || {_PAIR}), 1, 2))::INT % 2 AS flip, ('0x' || substr(md5('7|' || game_id), 1, 1))::INT % 2 AS coin FROM {GAMES}")
def p9_p10_p11_flips(spark, sf):
    return games(spark, sf).select("game_id", matchups.neutral_flip(F.col("d"), F.col("home"), F.col("away")).alias("flip"), matchups.coin(F.col("game_id"), 7).alias("coin"))


@query(f"SELECT game_id, CASE WHEN d BETWEEN DATE '1996-06-01' AND DATE '1996-06-30' THEN 'cup96' WHEN d BETWEEN DATE '1998-06-01' AND DATE '1998-06-30' THEN 'cup98' ELSE 'other' END AS fold FROM {GAMES} WHERE neutral OR NOT (d BETWEEN DATE '1996-06-01' AND DATE '1996-06-30' OR d BETWEEN DATE '1998-06-01' AND DATE '1998-06-30')")
def p12_fold_phase(spark, sf):
    fold = F.lit(None).cast("string")
    inside = F.lit(False)
    for name, year in (("cup96", 1996), ("cup98", 1998)):
        within = F.col("d").between(F.lit(f"{year}-06-01").cast("date"), F.lit(f"{year}-06-30").cast("date"))
        fold, inside = F.when(within, name).otherwise(fold), inside | within
    return games(spark, sf).where(F.col("neutral") | ~inside).select("game_id", F.coalesce(fold, F.lit("other")).alias("fold"))


@query(f"SELECT h.game_id, h.team AS home, a.team AS away, h.pts - a.pts AS margin FROM {SIDES} h JOIN {SIDES} a USING (game_id) WHERE h.is_home = 1 AND a.is_home = 0")
def j1_home_and_away(spark, sf):
    s = _sides(spark, sf)
    home, away = s.where("is_home = 1").select("game_id", F.col("team").alias("home"), "pts"), s.where("is_home = 0").select("game_id", F.col("team").alias("away"), F.col("pts").alias("p"))
    return home.join(away, "game_id").select("game_id", "home", "away", (F.col("pts") - F.col("p")).alias("margin"))


_ENDS = f"(SELECT season, team, count(*) AS games, avg(pts) AS pts, avg(opp_pts) AS opp_pts, avg(won) AS won FROM {SIDES} GROUP BY 1, 2)"


@query(f"SELECT g.game_id, round(h.pts - a.pts, 6) AS diff_pts, round(h.won - a.won, 6) AS diff_won FROM {GAMES} g LEFT JOIN {_ENDS} h ON h.season = g.season - 1 AND h.team = g.home LEFT JOIN {_ENDS} a ON a.season = g.season - 1 AND a.team = g.away")
def j2_j3_prior_season(spark, sf):
    got = matchups.prior_season(games(spark, sf), matchups.season_ends(_sides(spark, sf)), ["pts", "won"])
    return history.differentials(got, "h_", "a_", ["pts", "won"]).select("game_id", r6("diff_pts", "diff_pts"), r6("diff_won", "diff_won"))


_FORM = f"(SELECT game_id, team, avg(pts) OVER {_PAST} AS m, avg(won) OVER {_LAST(10)} AS w10, least(coalesce(d - lag(d) OVER (PARTITION BY team ORDER BY d, game_id), 3), 7) AS rest FROM {SIDES})"


@query(f"SELECT g.game_id, round(h.m - a.m, 6) AS diff_m, round(h.w10 - a.w10, 6) AS diff_w10, h.rest - a.rest AS diff_rest FROM {GAMES} g LEFT JOIN {_FORM} h ON h.game_id = g.game_id AND h.team = g.home LEFT JOIN {_FORM} a ON a.game_id = g.game_id AND a.team = g.away")
def j4_j5_w21_assembly(spark, sf):
    """Every feature of a team in one table, joined twice, and their differences."""
    s = history.rest_days(_sides(spark, sf), ["team"], matchups.ORDER, "d", "rest")
    s = s.withColumn("m", F.avg("pts").over(matchups.past())).withColumn("w10", F.avg("won").over(matchups.past(rows=10)))
    got = history.differentials(matchups.both_sides(games(spark, sf), s, ["m", "w10", "rest"]), "h_", "a_", ["m", "w10", "rest"])
    return got.select("game_id", r6("diff_m", "diff_m"), r6("diff_w10", "diff_w10"), F.col("diff_rest").cast("long"))


_LINES = f"(SELECT CASE WHEN game_id % 2 = 0 THEN home ELSE away END AS x, CASE WHEN game_id % 2 = 0 THEN away ELSE home END AS y, d, game_id % 97 / 100.0 AS p, game_id AS line FROM {GAMES} WHERE game_id % 3 <> 0)"


@query(f"""SELECT game_id, swapped, round(p, 6) AS p FROM (SELECT g.game_id, l.x <> g.home AS swapped, CASE WHEN l.x <> g.home THEN 1 - l.p ELSE l.p END AS p, row_number() OVER (PARTITION BY g.game_id ORDER BY l.line) AS k
 FROM {GAMES} g JOIN {_LINES} l ON g.d = l.d AND least(g.home, g.away) = least(l.x, l.y) AND greatest(g.home, g.away) = greatest(l.x, l.y)) WHERE k = 1""")
def j7_j8_order_free(spark, sf):
    """Lines joined to games whichever side they name first; a turned line gives the other side's probability; the first line of a game counts."""
    g = games(spark, sf)
    even = F.col("game_id") % 2 == 0
    lines = g.where("game_id % 3 <> 0").select(F.when(even, F.col("home")).otherwise(F.col("away")).alias("x"), F.when(even, F.col("away")).otherwise(F.col("home")).alias("y"), "d", (F.col("game_id") % 97 / 100.0).alias("p"), F.col("game_id").alias("line"))
    lines = lines.select("d", matchups.pair_key(F.col("x"), F.col("y")).alias("pair"), "x", "p", "line")
    met = g.withColumn("pair", matchups.pair_key(F.col("home"), F.col("away"))).join(lines, ["d", "pair"]).withColumn("k", F.row_number().over(W.partitionBy("game_id").orderBy("line"))).where("k = 1")
    swapped = F.col("x") != F.col("home")
    return met.select("game_id", swapped.alias("swapped"), r6(F.when(swapped, 1 - F.col("p")).otherwise(F.col("p")), "p"))


_LEAGUES = "(VALUES (0, 'north', 1.0), (1, 'east', 0.8), (2, 'th', 0.5)) l(ord, part, score)"


@query(f"SELECT c_custkey, coalesce(min_by(score, ord), 0.3) AS score FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'northern fc' WHEN 1 THEN 'eas' WHEN 2 THEN 'south end' ELSE 'villa' END AS club FROM customer) c LEFT JOIN {_LEAGUES} ON contains(club, part) OR contains(part, club) GROUP BY 1")
def j20_substring_match(spark, sf):
    """A club's league by either name containing the other; of several the first counts. The leagues are a fixed short list."""
    k = F.col("c_custkey") % 4
    clubs = table(spark, sf, "customer").select("c_custkey", F.when(k == 0, "northern fc").when(k == 1, "eas").when(k == 2, "south end").otherwise("villa").alias("club"))
    leagues = spark.createDataFrame([(0, "north", 1.0), (1, "east", 0.8), (2, "th", 0.5)], "ord int, part string, score double")
    met = clubs.join(F.broadcast(leagues), F.col("club").contains(F.col("part")) | F.col("part").contains(F.col("club")), "left")
    return met.groupBy("c_custkey").agg(F.coalesce(F.min_by("score", "ord"), F.lit(0.3)).alias("score"))


@query(f"SELECT t.season, t.team, round(coalesce(a.won, b.won, m.won), 6) AS v, CASE WHEN a.won IS NOT NULL THEN 1 WHEN b.won IS NOT NULL THEN 2 ELSE 0 END AS years FROM {_ENDS} t LEFT JOIN {_ENDS} a ON a.season = t.season - 1 AND a.team = t.team AND a.games >= 5 LEFT JOIN {_ENDS} b ON b.season = t.season - 2 AND b.team = t.team AND b.games >= 5 LEFT JOIN (SELECT season, avg(won) AS won FROM {_ENDS} GROUP BY 1) m ON m.season = t.season - 1")
def j21_fallbacks(spark, sf):
    """Last season's figure, else the one before, else the league's."""
    ends = matchups.season_ends(_sides(spark, sf))
    enough = ends.where("games >= 5")
    league = ends.groupBy((F.col("season") + 1).alias("season")).agg(F.avg("won").alias("m"))
    got = ends.select("season", "team").join(enough.select((F.col("season") + 1).alias("season"), "team", F.col("won").alias("a")), ["season", "team"], "left")
    got = got.join(enough.select((F.col("season") + 2).alias("season"), "team", F.col("won").alias("b")), ["season", "team"], "left").join(league, "season", "left")
    return got.select("season", "team", r6(F.coalesce("a", "b", "m"), "v"), F.when(F.col("a").isNotNull(), 1).when(F.col("b").isNotNull(), 2).otherwise(0).alias("years"))


@query(f"SELECT game_id, team, round(avg(o) OVER {_PAST}, 6) AS allowed FROM (SELECT a.game_id, a.team, a.d, b.pts AS o FROM {SIDES} a JOIN {SIDES} b ON a.game_id = b.game_id AND a.team = b.opp)")
def j23_stats_allowed(spark, sf):
    s = matchups.opponents(_sides(spark, sf), "pts", "o")
    return s.select("game_id", "team", r6(F.avg("o").over(matchups.past()), "allowed"))


@query(f"SELECT season, team, games, round(pts, 6) AS pts, round(won, 6) AS won, round(pts / (pts + opp_pts), 6) AS share, round(avg(pts) OVER (PARTITION BY season), 6) AS league FROM {_ENDS}")
def a1_a2_a3_season_ends(spark, sf):
    ends = matchups.season_ends(_sides(spark, sf))
    return ends.select("season", "team", "games", *[r6(c, c) for c in ("pts", "won", "share")], r6(F.avg("pts").over(W.partitionBy("season")), "league"))


_PLAYERS = "(SELECT l_orderkey AS game, l_suppkey AS player, l_quantity AS mins, l_extendedprice / 7 AS pts, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_suppkey, l_linenumber, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"


@query(f"""SELECT game, round(avg(pts) FILTER (WHERE k <= 3), 6) AS top3, round(avg(pts) FILTER (WHERE k <= 3) - avg(pts) FILTER (WHERE k > 3), 6) AS bench_gap, round(stddev_samp(pts), 6) AS sd, round(sum(mins * mins) / pow(sum(mins), 2), 6) AS hhi, round(sum(mins * pts) / sum(mins), 6) AS weighted FROM {_PLAYERS} WHERE n >= 3 GROUP BY 1""")
def a4_a5_player_features(spark, sf):
    """Players of a game to features of their team: the three with most minutes, the bench, concentration; none under three players."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_quantity").alias("mins"), (F.col("l_extendedprice") / 7).alias("pts"), "l_suppkey", "l_linenumber")
    w = W.partitionBy("game")
    li = li.withColumn("k", F.row_number().over(w.orderBy(F.desc("mins"), "l_suppkey", "l_linenumber", "pts"))).withColumn("n", F.count("*").over(w)).where("n >= 3")
    top, rest = F.avg(F.when(F.col("k") <= 3, F.col("pts"))), F.avg(F.when(F.col("k") > 3, F.col("pts")))
    return li.groupBy("game").agg(r6(top, "top3"), r6(top - rest, "bench_gap"), r6(F.stddev_samp("pts"), "sd"), r6(F.sum(F.col("mins") * F.col("mins")) / F.pow(F.sum("mins"), 2), "hhi"), r6(F.sum(F.col("mins") * F.col("pts")) / F.sum("mins"), "weighted"))


@query("SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal * w) / sum(w), 6) AS weighted, round(quantile_cont(w, 0.5), 6) AS median_w, round(avg(c_acctbal), 6) AS mean, round(avg(CASE WHEN k <= 11 THEN c_acctbal END), 6) AS top11, round(avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0 END), 6) AS mapped FROM (SELECT *, c_custkey % 50 + 1.0 AS w, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) GROUP BY 1")
def a6_a9_squads(spark, sf):
    c = table(spark, sf, "customer").withColumn("w", F.col("c_custkey") % 50 + 1.0).withColumn("k", F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")))
    return c.groupBy("c_nationkey").agg(F.count("*").alias("n"), r6(F.sum(F.col("c_acctbal") * F.col("w")) / F.sum("w"), "weighted"), r6(F.percentile("w", F.lit(0.5)), "median_w"), r6(F.avg("c_acctbal"), "mean"), r6(F.avg(F.when(F.col("k") <= 11, F.col("c_acctbal"))), "top11"), r6(F.avg((F.col("c_acctbal") > 0).cast("double")), "mapped"))


@query(f"SELECT user_id, count(*) AS n, min(d) AS first, max(d) AS last, count(DISTINCT event_type) AS kinds, round(arg_max(value, (ts, event_id)) FILTER (WHERE value > 40), 6) AS latest FROM {EVENTS} GROUP BY 1")
def a7_a8_profiles(spark, sf):
    """First and last day, events, and the latest value above 40."""
    e = events(spark, sf)
    known = F.when(F.col("value") > 40, F.struct("ts", "event_id"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"), F.countDistinct("event_type").alias("kinds"), r6(F.max_by("value", known), "latest"))


@query(f"SELECT bucket, count(*) AS n, round(avg(y), 6) AS hit, round(avg(p - fair), 6) AS gap FROM (SELECT y, p, fair, CASE WHEN abs(p - fair) < 0.1 THEN 1 WHEN abs(p - fair) < 0.2 THEN 2 WHEN abs(p - fair) < 0.3 THEN 3 ELSE 4 END AS bucket FROM {PROBABILITIES}) GROUP BY 1")
def a11_disagreement(spark, sf):
    off = F.abs(F.col("p") - F.col("fair"))
    p = probabilities(spark, sf).withColumn("bucket", F.when(off < 0.1, 1).when(off < 0.2, 2).when(off < 0.3, 3).otherwise(4))
    return p.groupBy("bucket").agg(F.count("*").alias("n"), r6(F.avg("y"), "hit"), r6(F.avg(F.col("p") - F.col("fair")), "gap"))


@query(f"SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, coalesce(tier, 'unmapped') AS tier FROM {EVENTS} LEFT JOIN (VALUES ('click', 'a'), ('view', 'b')) t(event_type, tier) USING (event_type) GROUP BY event_type, tier")
def a15_taxonomy_audit(spark, sf):
    tiers = spark.createDataFrame([("click", "a"), ("view", "b")], "event_type string, tier string")
    counted = events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n")).join(F.broadcast(tiers), "event_type", "left")
    return counted.select("event_type", "n", r6(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), "share"), F.coalesce("tier", F.lit("unmapped")).alias("tier"))


@query(f"SELECT a.game_id, a.team, round(avg(b.m) OVER {_PAST.replace('team', 'a.team').replace('d, game_id', 'a.d, a.game_id')}, 6) AS sos, round((a.pts - a.opp_pts) * b.m / 100, 6) AS adjusted FROM {SIDES} a JOIN (SELECT game_id, team, avg(pts) OVER {_PAST} AS m FROM {SIDES}) b ON a.game_id = b.game_id AND a.opp = b.team")
def w4_schedule_strength(spark, sf):
    """Mean of the opponents' strength (their scoring before the game) over earlier games, and the margin weighed by it."""
    s = _sides(spark, sf).withColumn("m", F.avg("pts").over(matchups.past()))
    s = matchups.opponents(s, "m", "o")
    return s.select("game_id", "team", r6(F.avg("o").over(matchups.past()), "sos"), r6((F.col("pts") - F.col("opp_pts")) * F.col("o") / 100, "adjusted"))


@query(f"""SELECT game_id, team, back_to_back, three_in_four, last_week, CAST(sum(1 - is_home) OVER (PARTITION BY team, g ORDER BY d, game_id) AS BIGINT) AS away_run FROM (SELECT *, CAST(coalesce(d - lag(d) OVER o = 1, false) AS INT) AS back_to_back,
 CAST(count(*) OVER (PARTITION BY team ORDER BY d RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW) >= 3 AS INT) AS three_in_four, count(*) OVER (PARTITION BY team ORDER BY d RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS last_week, sum(is_home) OVER o AS g FROM {SIDES} WINDOW o AS (PARTITION BY team ORDER BY d, game_id))""")
def w5_schedule(spark, sf):
    return matchups.schedule(_sides(spark, sf)).select("game_id", "team", "back_to_back", "three_in_four", "last_week", "away_run")


_VENUE = f"(SELECT game_id, d, team, CASE WHEN is_home = 1 THEN team ELSE opp END AS host FROM {SIDES})"
_PLACED = f"(SELECT game_id, d, team, CASE WHEN host % 5 <> 0 THEN {{'lat': host % 60 * 1.0, 'lon': host % 170 * 1.0, 'zone': host % 9, 'height': host % 700}} END AS h FROM {_VENUE})"
_KM = "2 * 6371.0 * asin(sqrt(pow(sin((radians(h.lat) - radians(w.lat)) / 2), 2) + cos(radians(w.lat)) * cos(radians(h.lat)) * pow(sin((radians(h.lon) - radians(w.lon)) / 2), 2)))"


@query(f"SELECT game_id, team, round({_KM}, 4) AS km, CAST(h.zone - w.zone AS INT) AS hours, CAST(h.height - w.height AS INT) AS metres FROM (SELECT *, last_value(h IGNORE NULLS) OVER {_PAST} AS w FROM {_PLACED})")
def w6_travel(spark, sf):
    from .views import rounded

    teams = _sides(spark, sf).select("team").distinct().where("team % 5 <> 0")
    venues = teams.select("team", (F.col("team") % 60 * 1.0).alias("lat"), (F.col("team") % 170 * 1.0).alias("lon"), (F.col("team") % 9).alias("zone"), (F.col("team") % 700).alias("height"))
    got = matchups.travel(_sides(spark, sf), venues)
    return got.select("game_id", "team", rounded("km", "km", 4), F.col("hours").cast("int"), F.col("metres").cast("int"))


_EW = lambda a, by, adj: f"(SELECT game_id, team, (SELECT sum(x * pow({1 - a!r}, n - i)) / sum(pow({1 - a!r}, n - i)) FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i, len(v) AS n)) AS m FROM (SELECT game_id, team, list(pts) OVER (PARTITION BY {by} ORDER BY d, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM {SIDES}))"


@query(f"SELECT game_id, team, round(m, 6) AS ewma FROM {_EW(2 / 6, 'team, season', True)}")
def w10_w12_span_mean(spark, sf):
    """Exponential mean of a team's earlier games of the season."""
    return matchups.span_mean(_sides(spark, sf), "pts", 5, "ewma", ["team", "season"]).select("game_id", "team", r6("ewma", "ewma"))


@query(f"""SELECT game_id, team, round(CASE WHEN len(v) > 0 THEN list_reduce(v, lambda m, x: m * {1 - 2 / 6!r} + {2 / 6!r} * x) END, 6) AS ewma FROM (SELECT game_id, team, list(pts::DOUBLE) OVER {_PAST} AS v FROM {SIDES})""")
def w13_recursive_mean(spark, sf):
    return matchups.span_mean(_sides(spark, sf), "pts", 5, "ewma", adjusted=False).select("game_id", "team", r6("ewma", "ewma"))


@query(f"""WITH k AS (SELECT *, CASE WHEN won = 1 THEN 1 WHEN won = 0 THEN -1 ELSE 0 END AS k FROM {SIDES}), r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY d, game_id) - row_number() OVER (PARTITION BY team, k ORDER BY d, game_id) AS g FROM k),
 l AS (SELECT *, k * row_number() OVER (PARTITION BY team, k, g ORDER BY d, game_id) AS len FROM r) SELECT game_id, team, CAST(coalesce(lag(len) OVER (PARTITION BY team ORDER BY d, game_id), 0) AS INT) AS streak, round(avg(won) FILTER (WHERE is_home = 1) OVER {_LAST(25)}, 6) AS home_form FROM l""")
def w13_streaks(spark, sf):
    s = matchups.streak(_sides(spark, sf))
    return s.select("game_id", "team", F.col("streak").cast("int"), r6(F.avg(F.when(F.col("is_home") == 1, F.col("won"))).over(matchups.past(rows=25)), "home_form"))


_COUNTED = lambda e, c, w: f"CASE WHEN count({c}) OVER {_LAST(w)} = {w} THEN {e} OVER {_LAST(w)} END"
_SEASON = "(PARTITION BY team, season ORDER BY d, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""SELECT game_id, team, round({_COUNTED('avg(won)', 'won', 10)}, 6) AS win10, round({_COUNTED('avg(won)', 'won', 30)}, 6) AS win30, round({_COUNTED('avg(won)', 'won', 60)}, 6) AS win60, round(CASE WHEN count(won) OVER {_SEASON} >= 10 THEN avg(won) OVER {_SEASON} END, 6) AS to_date,
 round(CASE WHEN count(won) OVER {_SEASON} >= 10 THEN pow(sum(pts) OVER {_SEASON}, 1.83) / (pow(sum(pts) OVER {_SEASON}, 1.83) + pow(sum(opp_pts) OVER {_SEASON}, 1.83)) END, 6) AS pythagoras, round({_COUNTED('stddev_pop(pts)', 'pts', 30)}, 6) AS volatility FROM {SIDES}""")
def w14_w15_w17_form(spark, sf):
    got = matchups.form(_sides(spark, sf))
    return got.select("game_id", "team", *[r6(c, c) for c in ("win10", "win30", "win60", "to_date", "pythagoras", "volatility")])


@query(f"SELECT game_id, team, round(CASE WHEN count(*) OVER {_LAST(15)} = 15 THEN sum(pts) OVER {_LAST(15)} / nullif(sum(opp_pts) OVER {_LAST(15)}, 0) END, 6) AS ratio FROM {SIDES}")
def w16_ratio_of_sums(spark, sf):
    return matchups.ratio_of_sums(_sides(spark, sf), "pts", "opp_pts", 15, "ratio").select("game_id", "team", r6("ratio", "ratio"))


@query(f"SELECT game_id, team, CAST(least(coalesce(d - lag(d) OVER o, 365), 365) AS INT) AS idle, CAST(coalesce(sign(game_id % 8 - lag(game_id % 8) OVER o), 0) AS INT) AS class_move FROM {SIDES} WINDOW o AS (PARTITION BY team ORDER BY d, game_id)")
def w18_w19_idle_and_class(spark, sf):
    o = W.partitionBy("team").orderBy(*matchups.ORDER)
    s = history.rest_days(_sides(spark, sf), ["team"], matchups.ORDER, "d", "idle", first=365, cap=365)
    cls = F.col("game_id") % 8
    return s.select("game_id", "team", F.col("idle").cast("int"), F.coalesce(F.signum(cls - F.lag(cls).over(o)), F.lit(0)).cast("int").alias("class_move"))


@query(f"SELECT game_id, team, round(pts - last_value(pts) OVER (PARTITION BY team ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 365 DAY PRECEDING), 6) AS trend, round(avg(CASE WHEN won <> 0.5 THEN won END) OVER {_LAST(10)}, 6) AS decided, round(avg(pts - opp_pts) OVER {_LAST(10)}, 6) AS goals FROM (SELECT * FROM {SIDES} QUALIFY row_number() OVER (PARTITION BY team, d ORDER BY game_id) = 1)")
def w20_year_trend(spark, sf):
    """Points against those of the last game a year ago or more, and form over ten games; one game a day."""
    s = _sides(spark, sf).withColumn("k", F.row_number().over(W.partitionBy("team", "d").orderBy("game_id"))).where("k = 1")
    day = F.datediff("d", F.lit("1970-01-01").cast("date"))
    old = F.last("pts").over(W.partitionBy("team").orderBy(day).rangeBetween(W.unboundedPreceding, -365))
    ten = matchups.past(rows=10)
    return s.select("game_id", "team", r6(F.col("pts") - old, "trend"), r6(F.avg(F.when(F.col("won") != 0.5, F.col("won"))).over(ten), "decided"), r6(F.avg(F.col("pts") - F.col("opp_pts")).over(ten), "goals"))


@query(f"SELECT season, team, round((SELECT sum(x * pow({1 - 2 / 11!r}, n - i)) / sum(pow({1 - 2 / 11!r}, n - i)) FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i, len(v) AS n)), 6) AS ewma FROM (SELECT season, team, list(pts ORDER BY d, game_id) AS v FROM {SIDES} GROUP BY 1, 2)")
def w22_final_means(spark, sf):
    """The exponential mean at the end of each season."""
    rows = _sides(spark, sf).groupBy("season", "team").agg(F.array_sort(F.collect_list(F.struct("d", "game_id", "pts"))).alias("v"))
    return rows.select("season", "team", r6(matchups.weighted_mean(F.transform("v", lambda x: x["pts"].cast("double")), 2 / 11), "ewma"))


@query(f"SELECT event_id, round(avg(value) OVER p, 6) AS so_far, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS last5, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INT) AS nth FROM {EVENTS} WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def w23_player_means(spark, sf):
    o = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf).select("event_id", r6(F.avg("value").over(o.rowsBetween(W.unboundedPreceding, -1)), "so_far"), r6(F.avg("value").over(o.rowsBetween(-5, -1)), "last5"), F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("nth"))


@query(f"SELECT grp, count(*) AS n, round(m - k, 6) AS gap, CASE WHEN m - k < 0 THEN 'EDGE' WHEN m - k < 0.01 THEN 'MARGINAL' WHEN m - k < 0.02 THEN 'CAUTION' ELSE 'STOP' END AS verdict FROM (SELECT grp, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS m, -avg(y * ln(f) + (1 - y) * ln(1 - f)) AS k, count(*) AS c FROM (SELECT *, least(greatest(fair, 0.02), 0.98) AS f FROM {PROBABILITIES}) GROUP BY 1) JOIN (SELECT grp FROM {PROBABILITIES}) USING (grp) GROUP BY grp, m, k")
def j24_against_market(spark, sf):
    """Log loss of the model less that of the market, and what it says."""
    p = probabilities(spark, sf).withColumn("f", F.least(F.greatest("fair", F.lit(0.02)), F.lit(0.98)))
    got = p.groupBy("grp").agg(F.count("*").alias("n"), (evaluate.log_loss(F.col("y"), F.col("p")) - evaluate.log_loss(F.col("y"), F.col("f"))).alias("gap"))
    verdict = F.when(F.col("gap") < 0, "EDGE").when(F.col("gap") < 0.01, "MARGINAL").when(F.col("gap") < 0.02, "CAUTION").otherwise("STOP")
    return got.select("grp", "n", r6("gap", "gap"), verdict.alias("verdict"))


_MEM = f"(SELECT team, d AS start_date, lead(d) OVER (PARTITION BY team ORDER BY d) AS end_date, 'S' || (game_id % 3) AS sector FROM (SELECT * FROM {SIDES} QUALIFY row_number() OVER (PARTITION BY team, season ORDER BY d, game_id) = 1))"


@query(f"SELECT g.game_id, m.sector, g.d - m.start_date AS since, m.sector IS NOT NULL AS listed FROM {GAMES} g LEFT JOIN {_MEM} m ON m.team = g.home AND m.start_date <= g.d AND (m.end_date IS NULL OR g.d < m.end_date)")
def j12_interval_in_force(spark, sf):
    """The interval of an entity that holds at a date: sector, whether listed and alive."""
    first = _sides(spark, sf).withColumn("k", F.row_number().over(W.partitionBy("team", "season").orderBy(*matchups.ORDER))).where("k = 1")
    changes = first.select(F.col("team").alias("home"), F.date_sub("d", 1).alias("released"), F.col("d").alias("start_date"), F.concat(F.lit("S"), F.col("game_id") % 3).alias("sector"))
    got = asof.as_of(games(spark, sf).select("game_id", "home", "d"), changes, ["home"], "d", "released", ["start_date", "sector"])
    return got.select("game_id", "sector", F.datediff("d", "start_date").cast("long").alias("since"), F.col("sector").isNotNull().alias("listed"))


@query(f"SELECT cup, comparator, count(*) AS n, round(-avg(y * ln(q) + (1 - y) * ln(1 - q)), 6) AS log_loss FROM (SELECT yr AS cup, y, unnest([{{'c': 'model', 'q': p}}, {{'c': 'market', 'q': least(greatest(fair, 0.02), 0.98)}}], recursive := true) FROM {PROBABILITIES}) t(cup, y, comparator, q) GROUP BY GROUPING SETS ((cup, comparator), (comparator))")
def y24_y38_comparators(spark, sf):
    p = probabilities(spark, sf)
    both = p.select(F.col("yr").alias("cup"), "y", F.explode(F.array(F.struct(F.lit("model").alias("comparator"), F.col("p").alias("q")), F.struct(F.lit("market").alias("comparator"), F.least(F.greatest("fair", F.lit(0.02)), F.lit(0.98)).alias("q")))).alias("c")).select("cup", "y", "c.*")
    return both.groupingSets([["cup", "comparator"], ["comparator"]], "cup", "comparator").agg(F.count("*").alias("n"), r6(evaluate.log_loss(F.col("y"), F.col("q")), "log_loss"))


@query(f"SELECT outcome, hs, vs, n, round(n / sum(n) OVER (PARTITION BY outcome), 6) AS share, round(sum(n) OVER (PARTITION BY outcome ORDER BY n DESC, hs, vs) / sum(n) OVER (PARTITION BY outcome), 6) AS upto FROM (SELECT CASE WHEN hs > vs THEN 'home' WHEN hs = vs THEN 'draw' ELSE 'away' END AS outcome, hs, vs, count(*) AS n FROM {GAMES} GROUP BY 1, 2, 3)")
def y25_scorelines(spark, sf):
    outcome = F.when(F.col("hs") > F.col("vs"), "home").when(F.col("hs") == F.col("vs"), "draw").otherwise("away")
    n = games(spark, sf).groupBy(outcome.alias("outcome"), "hs", "vs").agg(F.count("*").alias("n"))
    w = W.partitionBy("outcome")
    return n.select("outcome", "hs", "vs", "n", r6(F.col("n") / F.sum("n").over(w), "share"), r6(F.sum("n").over(w.orderBy(F.desc("n"), "hs", "vs").rowsBetween(W.unboundedPreceding, 0)) / F.sum("n").over(w), "upto"))


@query(f"SELECT game_id, season FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY d DESC, game_id DESC) AS k FROM {GAMES} WHERE neutral) WHERE k <= 16")
def y23_last_sixteen(spark, sf):
    k = F.row_number().over(W.partitionBy("season").orderBy(F.desc("d"), F.desc("game_id")))
    return games(spark, sf).where("neutral").withColumn("k", k).where("k <= 16").select("game_id", "season")


@query(f"SELECT season, count(*) AS n, count(*) FILTER (WHERE neutral) AS on_neutral, count(DISTINCT home) AS hosts, count(*) >= 100 AS complete, round(avg(CASE WHEN hs = vs THEN 1.0 ELSE 0 END), 6) AS draws FROM {GAMES} GROUP BY 1")
def y43_fixture_counts(spark, sf):
    g = games(spark, sf)
    return g.groupBy("season").agg(F.count("*").alias("n"), F.count(F.when(F.col("neutral"), 1)).alias("on_neutral"), F.countDistinct("home").alias("hosts"), (F.count("*") >= 100).alias("complete"), r6(F.avg((F.col("hs") == F.col("vs")).cast("double")), "draws"))
