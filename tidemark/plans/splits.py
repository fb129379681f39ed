"""Registered queries of guards, splits, transforms, memberships and bets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import betting, evaluate, history, portfolio, splits
from .queries import query
from .views import EVENTS, GAMES, MONEYLINES, MONTHLY, PRICES, PROBABILITIES, SIDES, events, games, moneylines, monthly, plain, prices, probabilities, r6, shared  # noqa: F401

_PART = "CASE WHEN yr < 1998 THEN 'train' WHEN yr = 1998 THEN 'cal' ELSE 'test' END"


def _part():
    return F.when(F.col("yr") < 1998, "train").when(F.col("yr") == 1998, "cal").otherwise("test")


@query(f"SELECT grp, max(d) FILTER (WHERE yr < 1998) AS last_train, min(d) FILTER (WHERE yr > 1998) AS first_test, max(d) FILTER (WHERE yr < 1998) < min(d) FILTER (WHERE yr > 1998) AND max(d) FILTER (WHERE yr = 1998) < min(d) FILTER (WHERE yr > 1998) AS ok FROM {PROBABILITIES} GROUP BY 1")
def g1_g3_g5_split_order(spark, sf):
    return splits.split_order(probabilities(spark, sf), ["grp"], "d", _part()).select("grp", "last_train", "first_test", "ok")


@query(f"SELECT 'grp' AS feature, round(avg(CASE WHEN n = 1 OR g > 1 THEN 1.0 ELSE 0 END), 6) AS share FROM (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS g FROM {EVENTS} GROUP BY 1) UNION ALL SELECT 'day', round(avg(CASE WHEN n = 1 OR g > 1 THEN 1.0 ELSE 0 END), 6) FROM (SELECT user_id, count(*) AS n, count(DISTINCT d) AS g FROM {EVENTS} GROUP BY 1)")
def g2_varying_features(spark, sf):
    e = events(spark, sf).select("user_id", F.col("event_type").alias("grp"), F.col("d").cast("string").alias("day"))
    return splits.varying_share(e, "user_id", ["grp", "day"]).select("feature", r6("share", "share"))


@query(f"SELECT grp, {_PART} AS part, count(*) AS n, min(d) AS first, max(d) AS last FROM {PROBABILITIES} GROUP BY 1, 2")
def g4_fold_audit(spark, sf):
    return splits.fold_audit(probabilities(spark, sf), ["grp"], _part(), "d")


@query(f"SELECT id, released FROM (SELECT id, d + CAST(id % 60 AS INT) AS released, DATE '1998-06-01' AS decided FROM {PROBABILITIES} WHERE d < DATE '1998-06-01') WHERE released >= decided")
def g6_g7_g8_y5_released_late(spark, sf):
    p = probabilities(spark, sf).where("d < date '1998-06-01'").select("id", F.date_add("d", (F.col("id") % 60).cast("int")).alias("released"), F.lit("1998-06-01").cast("date").alias("decided"))
    return splits.released_late(p, "released", "decided").select("id", "released")


_RANKED = "(SELECT yr, row_number() OVER (ORDER BY {order}) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT yr FROM {p}))"
_CUT = "CASE WHEN k <= floor(n * 0.6 + 1e-9) THEN 'train' WHEN k <= floor(n * 0.6 + 1e-9) + floor(n * 0.2 + 1e-9) THEN 'val' ELSE 'test' END"


@query(f"SELECT yr, a.part, count(*) AS n, b.part AS drawn FROM {PROBABILITIES} JOIN (SELECT yr, {_CUT} AS part FROM {_RANKED.format(order='yr', p=PROBABILITIES)}) a USING (yr) JOIN (SELECT yr, {_CUT} AS part FROM {_RANKED.format(order=chr(109) + 'd5(' + repr('5|') + ' || yr)', p=PROBABILITIES)}) b USING (yr) GROUP BY yr, a.part, b.part")
def g9_g10_season_splits(spark, sf):
    p = splits.season_split(probabilities(spark, sf), "yr")
    both = splits.drawn_split(p.withColumnRenamed("part", "sorted"), "yr", 5)
    return both.groupBy("yr", F.col("sorted").alias("part"), F.col("part").alias("drawn")).agg(F.count("*").alias("n"))


@query(f"SELECT yr, CASE WHEN yr = 2000 THEN 'test' ELSE part END AS part FROM (SELECT yr, CASE WHEN k <= floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'val' END AS part FROM (SELECT yr, row_number() OVER (PARTITION BY yr = 2000 ORDER BY md5('3|' || yr)) AS k, count(*) OVER (PARTITION BY yr = 2000) AS n FROM (SELECT DISTINCT yr FROM {PROBABILITIES})))")
def g11_held_out_season(spark, sf):
    p = probabilities(spark, sf).select("yr").distinct()
    return splits.drawn_split(p, "yr", 3, 0.8, 1.0, test=F.col("yr") == 2000).select("yr", "part")


@query(f"""WITH p AS (SELECT id, yr, d, row_number() OVER (ORDER BY yr, d, id) AS k FROM {PROBABILITIES}), e AS (SELECT yr AS eval, (SELECT count(*) FROM p b WHERE b.yr < y.yr) AS n FROM (SELECT DISTINCT yr FROM p) y),
 g AS (SELECT * FROM e WHERE eval - (SELECT min(yr) FROM p) >= 2 AND n >= 50) SELECT eval, CASE WHEN yr = eval THEN 'test' WHEN k <= floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'cal' END AS part, count(*) AS n, min(id) AS least FROM p JOIN g ON p.yr <= g.eval GROUP BY 1, 2""")
def g12_walk_forward_rows(spark, sf):
    got = splits.walk_forward(probabilities(spark, sf).select("id", "yr", "d"), "yr", "d", "id", 2)
    return got.groupBy("eval", "part").agg(F.count("*").alias("n"), F.min("id").alias("least"))


_SPAN = f"(SELECT min(d) AS lo, max(d) AS hi FROM {PRICES})"
_FOLDS = f"""(SELECT fold, train_start, test_start, test_end, (SELECT count(DISTINCT d) FROM {PRICES} WHERE d >= test_start AND d < test_end) AS n FROM (SELECT fold, ts AS train_start, vs AS test_start, least(CAST(vs + INTERVAL 12 MONTH AS DATE), hi) AS test_end
 FROM (SELECT fold, hi, CAST(lo + to_months(CAST(fold * 12 AS INT)) AS DATE) AS ts, CAST(CAST(lo + to_months(CAST(fold * 12 AS INT)) AS DATE) + INTERVAL 36 MONTH AS DATE) AS vs FROM {_SPAN}, (SELECT unnest(range(12)) AS fold)) WHERE vs < hi))"""


@query(f"SELECT CAST(fold AS INT) AS fold, train_start, test_start, test_end, n FROM {_FOLDS} WHERE n >= 20")
def g14_g15_g16_g17_month_folds(spark, sf):
    return splits.month_folds(prices(spark, sf))


@query(f"""SELECT id, round((p - (SELECT avg(p) FROM {PROBABILITIES} WHERE yr < 1998)) / (SELECT stddev_samp(p) FROM {PROBABILITIES} WHERE yr < 1998), 6) AS z, round((fair - (SELECT min(fair) FROM {PROBABILITIES} WHERE yr < 1998)) / (SELECT max(fair) - min(fair) FROM {PROBABILITIES} WHERE yr < 1998), 6) AS scaled FROM {PROBABILITIES}""")
def g18_g20_g21_normalised(spark, sf):
    """Two fitted steps, one after the other."""
    p = probabilities(spark, sf).select("id", "yr", F.col("p").alias("z"), F.col("fair").alias("scaled"))
    train = F.col("yr") < 1998
    return splits.normalised(splits.normalised(p, train, ["z"]), train, ["scaled"], "minmax").select("id", r6("z", "z"), r6("scaled", "scaled"))


_HOLES = f"(SELECT id, grp, yr, CASE WHEN id % 7 <> 0 AND grp <> '5-LOW' THEN p END AS p FROM {PROBABILITIES})"


@query(f"SELECT id, round(coalesce(p, g, a), 6) AS mean, round(coalesce(p, m), 6) AS median FROM {_HOLES} LEFT JOIN (SELECT grp, avg(p) AS g FROM {_HOLES} WHERE yr < 1998 GROUP BY 1) USING (grp), (SELECT avg(p) AS a, quantile_cont(p, 0.5) AS m FROM {_HOLES} WHERE yr < 1998)")
def g19_imputed(spark, sf):
    p = probabilities(spark, sf).select("id", "grp", "yr", F.when((F.col("id") % 7 != 0) & (F.col("grp") != "5-LOW"), F.col("p")).alias("mean"))
    p = p.withColumn("median", F.col("mean"))
    train = F.col("yr") < 1998
    got = splits.imputed(splits.imputed(p, train, "mean", by="grp"), train, "median", median=True)
    return got.select("id", r6("mean", "mean"), r6("median", "median"))


@query(f"""WITH v AS (SELECT p, yr < 1998 AS tr FROM {PROBABILITIES}), c AS (SELECT p, sum(sum(CASE WHEN tr THEN 1 ELSE 0 END)) OVER (ORDER BY p) AS a, sum(sum(CASE WHEN tr THEN 0 ELSE 1 END)) OVER (ORDER BY p) AS b FROM v GROUP BY p)
 SELECT round(max(abs(a / (SELECT count(*) FROM v WHERE tr) - b / (SELECT count(*) FROM v WHERE NOT tr))), 6) AS ks, (SELECT count(*) FROM v WHERE tr) AS n_train, (SELECT count(*) FROM v WHERE NOT tr) AS n_test FROM c""")
def g23_two_sample_ks(spark, sf):
    return evaluate.two_sample_ks(probabilities(spark, sf), "p", F.col("yr") < 1998).select(r6("ks", "ks"), "n_train", "n_test")


_EVENTS = f"(SELECT team AS ticker, d, CASE WHEN game_id % 3 = 0 THEN 'remove' ELSE 'add' END AS kind, CASE game_id % 4 WHEN 0 THEN 'Acquired by a rival' WHEN 1 THEN 'Bankruptcy' WHEN 2 THEN 'Market capitalization change' ELSE '' END AS reason FROM (SELECT * FROM {SIDES} QUALIFY row_number() OVER (PARTITION BY team, d ORDER BY game_id) = 1))"


def _changes(spark, sf):
    from pyspark.sql import Window as W

    from ..operators import matchups

    s = matchups.sides(games(spark, sf)).withColumn("k", F.row_number().over(W.partitionBy("team", "d").orderBy("game_id"))).where("k = 1")
    return s.select(F.col("team").alias("ticker"), "d", F.when(F.col("game_id") % 3 == 0, "remove").otherwise("add").alias("kind"), F.element_at(F.array(*map(F.lit, ("Acquired by a rival", "Bankruptcy", "Market capitalization change", ""))), (F.col("game_id") % 4 + 1).cast("int")).alias("reason"))


_SEED_TEXT = "SELECT ticker, start_date FROM (SELECT CAST(floor(o_custkey / 10) AS INT) AS ticker, DATE '1998-01-01' + CAST(min(o_orderkey) % 1500 AS INT) AS start_date FROM {orders} GROUP BY CAST(floor(o_custkey / 10) AS INT)) s WHERE ticker % 7 = 0"
#: Event after event: the start of the open interval, what the event closed, and whether it was an orphan.
_MEMBERSHIP = f"""e AS (SELECT ticker, d, kind, row_number() OVER (PARTITION BY ticker ORDER BY d, kind DESC) AS k FROM {_EVENTS}), s AS (SELECT * FROM {plain(_SEED_TEXT)}),
 m(ticker, k, open, s, e, orphan) AS (SELECT ticker, 0::BIGINT, max(start_date), NULL::DATE, NULL::DATE, 0 FROM (SELECT DISTINCT ticker FROM e UNION SELECT ticker FROM s) LEFT JOIN s USING (ticker) GROUP BY ticker UNION ALL
 SELECT m.ticker, e.k, CASE WHEN kind = 'remove' THEN CASE WHEN open < d THEN NULL ELSE open END WHEN open IS NULL OR d - open > 30 THEN d WHEN d - open >= -30 THEN least(open, d) ELSE open END,
  CASE WHEN (kind = 'remove' AND open < d) OR (kind = 'add' AND d - open > 30) THEN open END, CASE WHEN (kind = 'remove' AND open < d) OR (kind = 'add' AND d - open > 30) THEN d END,
  CASE WHEN (kind = 'remove' AND (open IS NULL OR open >= d)) OR (kind = 'add' AND d - open < -30) THEN 1 ELSE 0 END FROM m JOIN e ON e.ticker = m.ticker AND e.k = m.k + 1),
 i AS (SELECT ticker, s AS start_date, e AS end_date FROM m WHERE s IS NOT NULL UNION ALL SELECT ticker, open, NULL FROM m WHERE open IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY k DESC) = 1 AND k = (SELECT coalesce(max(k), 0) FROM e WHERE e.ticker = m.ticker))"""


def _seeds(spark, sf):
    return shared(spark, sf, _SEED_TEXT)


@query(f"WITH RECURSIVE {_MEMBERSHIP} SELECT ticker, start_date, end_date FROM i")
def u4_consolidated(spark, sf):
    return splits.consolidated(_changes(spark, sf), _seeds(spark, sf))


@query(f"WITH RECURSIVE {_MEMBERSHIP} SELECT ticker, sum(orphan)::BIGINT AS orphans FROM m GROUP BY ticker HAVING sum(orphan) > 0")
def u4_orphans(spark, sf):
    return splits.membership(_changes(spark, sf), _seeds(spark, sf)).where("what = 'orphan'").groupBy("ticker").agg(F.count("*").alias("orphans"))


_RAW = f"(SELECT ticker, d AS start_date, d + CAST(CASE ticker % 4 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 20 END AS INT) AS end_date FROM {_EVENTS} WHERE kind = 'add')"


@query(f"SELECT ticker, start_date, end_date, CASE WHEN end_date < start_date THEN 'negative' WHEN end_date = start_date THEN 'empty' ELSE 'overlap' END AS fault FROM (SELECT *, lag(end_date) OVER (PARTITION BY ticker ORDER BY start_date) AS le FROM {_RAW}) WHERE end_date <= start_date OR le > start_date")
def u5_interval_faults(spark, sf):
    add = F.when(F.col("ticker") % 4 == 0, -1).when(F.col("ticker") % 4 == 1, 0).otherwise(20)
    return splits.overlapping(_changes(spark, sf).where("kind = 'add'").select("ticker", F.col("d").alias("start_date"), F.date_add("d", add).alias("end_date")))


@query(f"WITH RECURSIVE {_MEMBERSHIP} SELECT ticker, max(d) AS delist_date, arg_max(reason, d) AS reason, CASE WHEN arg_max(reason, d) = 'Bankruptcy' THEN -0.99 ELSE 0.0 END AS delist_return FROM {_EVENTS} WHERE kind = 'remove' AND ticker NOT IN (SELECT ticker FROM i WHERE end_date IS NULL) GROUP BY 1")
def u6_delistings(spark, sf):
    changes = _changes(spark, sf)
    return splits.delistings(changes, splits.consolidated(changes, _seeds(spark, sf)).where("end_date is null")).drop("category")


@query(f"SELECT id FROM {PROBABILITIES} WHERE yr < 1998 AND id IN (SELECT id - 64 FROM {PROBABILITIES} WHERE yr >= 1998)")
def u1_split_overlap(spark, sf):
    p = probabilities(spark, sf)
    return p.where("yr < 1998").select("id").join(p.where("yr >= 1998").select((F.col("id") - 64).alias("id")), "id", "left_semi")


_BETS = f"""(SELECT id, side, p, fair, p - fair AS edge, odds, least(greatest(0, ((odds - 1) * p - (1 - p)) / (odds - 1)) * 0.25, 0.1) AS stake, won FROM (SELECT id, vig, unnest([{{'side': 'a', 'p': p_a, 'fair': (1 / oa) / (1 / oa + 1 / ob), 'odds': oa, 'won': y = 1}}, {{'side': 'b', 'p': 1 - p_a, 'fair': (1 / ob) / (1 / oa + 1 / ob), 'odds': ob, 'won': y = 0}}], recursive := true)
 FROM (SELECT id, y, p AS p_a, 1 / oa + 1 / ob - 1 AS vig, oa, ob FROM (SELECT id, y, p, 100 / (120.0 + id % 90) + 1 AS oa, (100.0 + id % 80) / 100 + 1 AS ob FROM {PROBABILITIES}))) WHERE p - fair > vig / 2)"""


def _bets(spark, sf):
    p = probabilities(spark, sf).select("id", "yr", "d", "y", F.col("p").alias("p_a"), (-(120.0 + F.col("id") % 90)).alias("ml_a"), (100.0 + F.col("id") % 80).alias("ml_b"))
    return betting.candidates(p)


@query(f"SELECT id, side, round(edge, 6) AS edge, round(odds, 6) AS odds, round(stake, 6) AS stake, won, round(CASE WHEN won THEN stake * (odds - 1) ELSE -stake END, 6) AS profit FROM {_BETS}")
def b1_k7_candidates(spark, sf):
    return _bets(spark, sf).select("id", "side", r6("edge", "edge"), r6("odds", "odds"), r6("stake", "stake"), "won", r6("profit", "profit"))


@query(f"SELECT id, side, round(stake * 1000 / (SELECT sum(stake) FROM {_BETS}), 6) AS size FROM {_BETS}")
def b2_scaled_bets(spark, sf):
    return betting.scaled(_bets(spark, sf), 1000.0).select("id", "side", r6("size", "size"))


@query(f"SELECT yr, side, count(*) AS bets, round(sum(stake), 6) AS staked, round(sum(CASE WHEN won THEN stake * (odds - 1) ELSE -stake END) / sum(stake), 6) AS roi, round(avg(CASE WHEN won THEN 1.0 ELSE 0 END), 6) AS win_rate, round(avg(CASE WHEN won THEN odds - 1 ELSE -1 END), 6) AS flat_roi FROM {_BETS} JOIN (SELECT id, yr FROM {PROBABILITIES}) USING (id) GROUP BY 1, 2")
def b3_b7_b8_report(spark, sf):
    got = betting.report(_bets(spark, sf), ["yr", "side"])
    return got.select("yr", "side", "bets", *[r6(c, c) for c in ("staked", "roi", "win_rate", "flat_roi")])


_DAYS = f"""(SELECT yr, d, count(*) AS bets, sum(stake) * least(1.0, 0.2 / sum(stake)) AS staked, product(1 + scale * CASE WHEN won THEN stake * (odds - 1) ELSE -stake END) - 1 AS ret FROM (SELECT *, least(1.0, 0.2 / sum(stake) OVER (PARTITION BY yr, d)) AS scale FROM {_BETS} JOIN (SELECT id, yr, d FROM {PROBABILITIES}) USING (id)) GROUP BY 1, 2)"""
_OPENS = f"(SELECT *, max(CASE WHEN open < 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY yr ORDER BY d) AS stopped FROM (SELECT *, coalesce(exp(sum(ln(1 + ret)) OVER (PARTITION BY yr ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS open FROM {_DAYS}))"


@query(f"SELECT yr, d, bets, round(staked, 6) AS staked, stopped = 1 AS stopped, round(sum(CASE WHEN stopped = 1 THEN 0 ELSE ln(1 + ret) END) OVER (PARTITION BY yr ORDER BY d), 6) AS log_roll FROM {_OPENS}")
def b4_b5_daily_bankroll(spark, sf):
    got = betting.daily_path(_bets(spark, sf), ["yr"], "d")
    return got.select("yr", "d", "bets", r6("staked", "staked"), "stopped", r6(F.log("roll"), "log_roll"))


@query(f"""WITH r AS (SELECT perm, yr, id, p, fair, y, row_number() OVER (PARTITION BY perm, yr ORDER BY id) AS i, row_number() OVER (PARTITION BY perm, yr ORDER BY md5('7|' || perm || '|' || id)) AS j FROM {PROBABILITIES}, (SELECT unnest(range(1, 6)) AS perm) WHERE p - fair >= 0.3)
 SELECT a.perm, count(*) AS n, round(sum(CASE WHEN b.y = 1 THEN 1 / a.fair - 1 ELSE -1 END), 6) AS pnl FROM r a JOIN r b ON a.perm = b.perm AND a.yr = b.yr AND a.i = b.j GROUP BY 1""")
def b6_permutations(spark, sf):
    bets = probabilities(spark, sf).where("p - fair >= 0.3").select("id", "yr", "y", "fair")
    got = betting.shuffled(bets, "y", ["yr"], "id", 5)
    return got.groupBy("perm").agg(F.count("*").alias("n"), r6(F.sum(F.when(F.col("y") == 1, 1 / F.col("fair") - 1).otherwise(-1.0)), "pnl"))
