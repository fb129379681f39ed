"""Registered queries of column rules: odds, names, leverage, weights, dates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, scalars
from .queries import query
from .views import EVENTS, GAMES, MONEYLINES, PAIRS, PRICES, PROBABILITIES, RETURNS, SIDES, events, games, moneylines, pairs, prices, probabilities, r6, table  # noqa: F401
from ..operators import history, matchups  # noqa: I001

_SPREAD = "(SELECT p_partkey AS id, (p_partkey % 109 - 54) / 2.0 AS s FROM part)"
_FAV = "CASE " + " ".join(f"WHEN abs(s) < {x1} THEN {y0} + (abs(s) - {x0}) * {(y1 - y0) / (x1 - x0)!r}" for (x0, y0), (x1, y1) in zip(rules.SPREADS, rules.SPREADS[1:])) + f" ELSE {rules.SPREADS[-1][1]} END"


@query(f"""SELECT id, round(CASE WHEN abs(s) > 25 THEN NULL WHEN s < 0 THEN fav WHEN s > 0 THEN dog ELSE -105 END, 6) AS home_ml, round(CASE WHEN abs(s) > 25 THEN NULL WHEN s < 0 THEN dog WHEN s > 0 THEN fav ELSE -105 END, 6) AS away_ml
 FROM (SELECT *, greatest(abs(fav) - CASE WHEN fav <= -200 THEN 50 WHEN fav <= -150 THEN 20 ELSE 10 END, 100) AS dog FROM (SELECT id, s, {_FAV} AS fav FROM {_SPREAD}))""")
def f7_spread_moneylines(spark, sf):
    home, away = rules.spread_moneylines((F.col("p_partkey") % 109 - 54) / 2.0)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), r6(home, "home_ml"), r6(away, "away_ml"))


@query(f"""SELECT game_id, round(w / (w + x + l), 6) AS p_win, round(x / (w + x + l), 6) AS p_draw, round(l / (w + x + l), 6) AS p_loss FROM (SELECT game_id, least(greatest((1 - q) * p, 0.02), 0.98) AS w, least(greatest(q, 0.02), 0.98) AS x, least(greatest((1 - q) * (1 - p), 0.02), 0.98) AS l
 FROM (SELECT game_id, 1 / (1 + pow(10.0, -g / 400)) AS p, 0.27 * exp(-pow(g / 220, 2)) AS q FROM (SELECT game_id, hs * 10.0 - vs * 10.0 + CASE WHEN neutral THEN 0 ELSE 100 END AS g FROM {GAMES})))""")
def f9_three_way(spark, sf):
    p = rules.three_way(F.col("hs") * 10.0, F.col("vs") * 10.0, F.col("neutral"), 0.27, 220.0)
    return games(spark, sf).select("game_id", *[r6(c, n) for c, n in zip(p, ("p_win", "p_draw", "p_loss"))])


@query("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, CASE c_custkey % 3 WHEN 0 THEN 'BRK-B' WHEN 1 THEN 'T' || c_nationkey ELSE '' END AS sym FROM customer")
def f14_clean_ids(spark, sf):
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, " brk.b ").when(k == 1, F.concat(F.lit("t"), F.col("c_nationkey"), F.lit(" "))).otherwise("")
    return table(spark, sf, "customer").select("c_custkey", rules.company_number(F.concat(F.lit("CIK #"), "c_custkey")).alias("cik"), rules.ticker_symbol(raw).alias("sym"))


_REASONS = ("Filed for Chapter 11", "Acquired by a rival", "Market capitalisation change", "Merged, then liquidated")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 3) THEN -0.99 ELSE 0.0 END AS ret, CASE c_custkey % 5 WHEN 0 THEN 'bankruptcy' WHEN 1 THEN 'acquisition' WHEN 3 THEN 'bankruptcy' ELSE 'reshuffle' END AS category FROM customer""")
def f15_leaving_reason(spark, sf):
    reason = F.get(F.array(*map(F.lit, _REASONS)), (F.col("c_custkey") % 5).cast("int"))
    ret, category = rules.leaving_reason(reason)
    return table(spark, sf, "customer").select("c_custkey", ret.alias("ret"), category.alias("category"))


@query(f"SELECT event_id, round(CASE WHEN m IS NULL THEN 50 ELSE (n * m + 5 * 50) / (n + 5) END, 6) AS v FROM (SELECT event_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
def f16_blend_with_prior(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    df = events(spark, sf).select("event_id", F.avg("value").over(w).alias("m"), F.count("*").over(w).alias("n"))
    return df.select("event_id", r6(scalars.shrink(F.col("m"), F.col("n"), F.lit(50.0), 5), "v"))


_ENDS = f"(SELECT season, team, avg(pts) AS v FROM {SIDES} GROUP BY 1, 2)"
_MEANS = f"(SELECT season, avg(v) AS m FROM {_ENDS} GROUP BY 1)"


@query(f"""SELECT t.season, t.team, round(max(CASE WHEN i = 1 THEN m + 0.8 * (v - m) END), 6) AS shrunk, round(sum(pow(0.5, i - 1) * (m + 0.8 * (v - m))) / sum(pow(0.5, i - 1)), 6) AS blended
 FROM {_ENDS} t0 JOIN {_MEANS} USING (season) JOIN (VALUES (1), (2), (3)) k(i) ON true JOIN (SELECT season, team FROM {_ENDS}) t ON t.season = t0.season + i AND t.team = t0.team GROUP BY 1, 2""")
def f17_priors(spark, sf):
    return matchups.priors(matchups.sides(games(spark, sf)), "pts", seasons=3, shrink=0.8, decay=0.5).select("season", "team", r6("shrunk", "shrunk"), r6("blended", "blended"))


@query(f"""SELECT game_id, round(CASE WHEN neutral THEN 1 ELSE exp(-1.5 * (1 - least(dayofyear(d), 300) / 300.0)) END, 6) AS w_day, round(exp(-2.0 * (1 - (d - min(d) OVER (PARTITION BY season)) / greatest(max(d) OVER (PARTITION BY season) - min(d) OVER (PARTITION BY season), 1))), 6) AS w_season FROM {GAMES}""")
def f18_f19_recency(spark, sf):
    s = W.partitionBy("season")
    g = games(spark, sf)
    by_day = rules.recency_weight(F.when(~F.col("neutral"), F.dayofyear("d")), 1.5, F.lit(300))
    since = F.datediff("d", F.min("d").over(s))
    span = F.greatest(F.datediff(F.max("d").over(s), F.min("d").over(s)), F.lit(1))
    return g.select("game_id", r6(by_day, "w_day"), r6(rules.recency_weight(since, 2.0, span), "w_season"))


_SIGNAL = f"(SELECT ticker, d, ret, coalesce(lag(up) OVER (PARTITION BY ticker ORDER BY d), 0) AS s, abs(up - lag(up) OVER (PARTITION BY ticker ORDER BY d)) AS flip FROM (SELECT *, CASE WHEN count(px) OVER w = 50 THEN CAST(px > avg(px) OVER w AS INT) END AS up FROM {RETURNS} WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)))"


def _signal(spark, sf):
    o = W.partitionBy("ticker").orderBy("d")
    df = history.above_mean(history.returns(prices(spark, sf)), 50, "up")
    return df.withColumn("s", F.coalesce(F.lag("up").over(o), F.lit(0))).withColumn("flip", F.abs(F.col("up") - F.lag("up").over(o)))


@query(f"SELECT ticker, d, round(3 * ret - 0.0095 / 252, 6) AS levered, round(s * (3 * ret - 0.0095 / 252) + (1 - s) * 0.0001, 6) AS switched, round(1.5 * s * ret + greatest(1 - 1.5 * s, 0) * 0.0001 - greatest(1.5 * s - 1, 0) * (0.0001 + 50 / 10000.0 / 252) - CASE WHEN s > 0 THEN 0.002 / 252 ELSE 0 END, 6) AS financed FROM {_SIGNAL} WHERE ret IS NOT NULL")
def f20_f21_f22_leverage(spark, sf):
    r, s, bill = F.col("ret"), F.col("s"), F.lit(0.0001)
    return _signal(spark, sf).where("ret is not null").select("ticker", "d", r6(rules.levered(r, 3.0), "levered"), r6(rules.levered_or_cash(r, s, 3.0, bill), "switched"), r6(rules.financed(r, 1.5 * s, bill, 50, 0.002), "financed"))


@query(f"SELECT ticker, d, round(ret - CASE WHEN lag(flip) OVER (PARTITION BY ticker ORDER BY d) > 0.5 THEN 0.001 ELSE 0 END, 6) AS net FROM {_SIGNAL}")
def f23_switching_costs(spark, sf):
    from ..operators import allocate

    return allocate.switching_costs(_signal(spark, sf), "flip", 10.0).select("ticker", "d", r6("net", "net"))


_ROWS = f"(SELECT ticker, d, row_number() OVER (PARTITION BY ticker ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY ticker) AS n FROM {PRICES})"
_T = f"(SELECT *, least(k::DOUBLE / (n - 1) * (n / 252.0 / 20), 1) AS t FROM {_ROWS})"


@query(f"SELECT ticker, d, round(3 - 2 * t, 6) AS linear, round(3 - 2 * t * t, 6) AS convex, round(CASE WHEN t >= 1 THEN 1 ELSE 3 - 2 * floor(t * 4) / 4 END, 6) AS step5 FROM {_T}")
def f24_glide_path(spark, sf):
    o = W.partitionBy("ticker").orderBy("d")
    df = prices(spark, sf).withColumn("k", F.row_number().over(o) - 1).withColumn("n", F.count("*").over(W.partitionBy("ticker")))
    return df.select("ticker", "d", *[r6(rules.glide_path(F.col("k"), F.col("n"), 3.0, 1.0, 20, shape), shape) for shape in ("linear", "convex", "step5")])


@query(f"SELECT ticker, round(least(greatest(m / v * 0.25, 0), 0.3), 6) AS weight, round((m - 0.02) / v, 6) AS leverage, round(CASE WHEN m <= 0 THEN 1 ELSE exp(-2 * (m / v) * (m / v) / 100 * 0.3 * 10) END, 6) AS ruin FROM (SELECT ticker, avg(ret) * 252 AS m, var_samp(ret) * 252 AS v FROM {RETURNS} GROUP BY 1)")
def f25_f26_f27_kelly_ruin(spark, sf):
    df = history.returns(prices(spark, sf)).groupBy("ticker").agg((F.avg("ret") * 252).alias("m"), (F.var_samp("ret") * 252).alias("v"))
    m, v = F.col("m"), F.col("v")
    return df.select("ticker", r6(rules.kelly_weight(m, v), "weight"), r6(rules.kelly_leverage(m, v, 0.02), "leverage"), r6(rules.ruin(m / v / 10, -0.3, 10), "ruin"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE o_orderpriority WHEN '1-URGENT' THEN 90 WHEN '2-HIGH' THEN 45 WHEN '3-MEDIUM' THEN 30 ELSE 90 END AS released, CASE o_orderpriority WHEN '1-URGENT' THEN 'cup' WHEN '2-HIGH' THEN 'league' ELSE 'friendly' END AS tier FROM orders""")
def f30_f31_release_and_tier(spark, sf):
    p = F.col("o_orderpriority")
    form = F.when(p == "1-URGENT", "10-K").when(p == "2-HIGH", "10-Q").when(p == "3-MEDIUM", "8-K_earnings")
    return table(spark, sf, "orders").select("o_orderkey", rules.release_date(F.to_date("o_orderdate"), form).alias("released"), rules.tier(p, {"1-URGENT": "cup", "2-HIGH": "league"}).alias("tier"))


@query(f"SELECT ticker, d, round(-7 * (y - b) / 100 + b / 100 / 252, 6) AS ret FROM (SELECT ticker, d, px / 1000 AS y, lag(px) OVER (PARTITION BY ticker ORDER BY d) / 1000 AS b FROM {PRICES}) WHERE b IS NOT NULL")
def f32_bond_return(spark, sf):
    df = prices(spark, sf).select("ticker", "d", (F.col("px") / 1000).alias("y"), (F.lag("px").over(W.partitionBy("ticker").orderBy("d")) / 1000).alias("b")).where("b is not null")
    return df.select("ticker", "d", r6(rules.bond_return(F.col("y"), F.col("b"), 7.0), "ret"))


@query("SELECT a.c_custkey, round(1 - levenshtein(a.c_name, b.c_name) / greatest(length(a.c_name), length(b.c_name)), 6) AS alike FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 7")
def y40_name_similarity(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    other = c.select((F.col("c_custkey") - 7).alias("c_custkey"), F.col("c_name").alias("other"))
    return c.join(other, "c_custkey").select("c_custkey", r6(rules.name_similarity(F.col("c_name"), F.col("other")), "alike"))


@query(f"SELECT ticker, round(avg(ret - 0.02 / 252) / stddev_samp(ret - 0.02 / 252) * sqrt(252), 6) AS sharpe FROM {RETURNS} WHERE ret IS NOT NULL GROUP BY 1")
def y1_simple_sharpe(spark, sf):
    from ..operators import portfolio

    return portfolio.risk(history.returns(prices(spark, sf)).withColumn("ret", F.col("ret") - 0.02 / 252), ["ticker"]).select("ticker", r6("sharpe", "sharpe"))


@query(f"SELECT id, round(pa / (pa + pb), 6) AS open_a, round((pa + 0.01) / (pa + pb), 6) AS close_a, pa + pb > 1.0 AND pa + pb < 1.2 AS valid FROM (SELECT id, abs(ml_a) / (abs(ml_a) + 100) AS pa, 100 / (ml_b + 100) AS pb FROM {MONEYLINES}) WHERE pa IS NOT NULL")
def p6_valid_pairs(spark, sf):
    from .. import functions as fn

    m = moneylines(spark, sf)
    a, b = F.when(F.col("ml_a") < 0, -F.col("ml_a") / (100 - F.col("ml_a"))), 100 / (F.col("ml_b") + 100)
    fair, _, vig = fn.fair_pair(F.when(F.col("ml_a") <= -100, F.col("ml_a")), F.when(F.col("ml_b") >= 100, F.col("ml_b")))
    return m.select("id", r6(F.coalesce(fair, a / (a + b)), "open_a"), r6((a + 0.01) / (a + b), "close_a"), F.coalesce((vig > 0) & (vig < 0.2), ((a + b) > 1.0) & ((a + b) < 1.2)).alias("valid"))
