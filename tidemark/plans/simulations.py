"""Registered queries of full backtests, membership filters, costs and path-dependent portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, portfolio, simulate
from .queries import query
from .views import PRICES, RETURNS, plain, prices, r6, shared

_PANEL_TEXT = "SELECT l_suppkey % 20 AS ticker, CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice) / sum(l_quantity) AS px FROM {lineitem} GROUP BY l_suppkey % 20, CAST(l_shipdate AS DATE)"
_T_TEXT = "SELECT DISTINCT l_suppkey % 20 AS t FROM {lineitem}"
#: Weights that do not sum to one, on the first trading day of each month; a fold a year.
_WEIGHTS_TEXT = "SELECT CAST(year(d) AS INT) AS fold, d, t AS ticker, CAST(1 + (t + month(d)) % 3 AS DOUBLE) / 30 AS w FROM (SELECT min(CAST(l_shipdate AS DATE)) AS d FROM {lineitem} GROUP BY date_trunc('month', l_shipdate)) m, (" + _T_TEXT + ") u WHERE (t * 7 + month(d)) % 3 <> 0"
_UNIVERSE_TEXT = """SELECT t AS ticker, DATE '1995-01-01' + CAST(t * 60 AS INT) AS inception_date, CASE WHEN t % 5 = 0 THEN DATE '1999-06-01' + CAST(t * 10 AS INT) END AS closure_date,
 CASE WHEN t % 4 <> 0 THEN CAST(t * 0.0003 AS DOUBLE) END AS expense_ratio, CASE t % 6 WHEN 0 THEN 'factor' WHEN 1 THEN 'broad_us_equity' WHEN 2 THEN 'crypto_etf' WHEN 3 THEN 'sector_thematic' WHEN 4 THEN 'unheard_of' END AS category FROM (""" + _T_TEXT + ") u"
_MEMBER_TEXT = """SELECT ticker, start_date, end_date, sector, cik FROM (SELECT t AS ticker, DATE '1995-01-01' + CAST(t * 30 AS INT) AS start_date, CASE WHEN t % 3 = 0 THEN DATE '1995-01-01' + CAST(t * 30 + 900 AS INT) END AS end_date, 'S' || CAST(t % 4 AS STRING) AS sector, CAST(t * 1001 AS STRING) AS cik FROM (""" + _T_TEXT + """) a
 UNION ALL SELECT t, DATE '1995-01-01' + CAST(t * 30 + 1200 AS INT), NULL, 'S' || CAST(t % 5 AS STRING), NULL FROM (""" + _T_TEXT + ") b WHERE t % 3 = 0) m"
_PANEL, _WEIGHTS, _UNIVERSE, _MEMBER = (plain(t).replace("AS STRING", "AS VARCHAR") for t in (_PANEL_TEXT, _WEIGHTS_TEXT, _UNIVERSE_TEXT, _MEMBER_TEXT))
_BPS = "CASE category WHEN 'broad_us_equity' THEN 1.0 WHEN 'broad_intl_equity' THEN 3.0 WHEN 'broad_us_bond' THEN 1.0 WHEN 'sector_thematic' THEN 4.0 WHEN 'factor' THEN 3.0 WHEN 'cash_equivalent' THEN 1.0 WHEN 'leveraged_etf' THEN 5.0 WHEN 'crypto_etf' THEN 8.0 ELSE 4.0 END"
_RATE = f"(SELECT ticker, {_BPS} AS bps, coalesce(expense_ratio, 0.0008) AS expense FROM {_UNIVERSE})"
_BILL = "(0.00005 + 0.00001 * (month(d) % 3))"


def _sized(text: str, off: float) -> str:
    return f"(SELECT fold, d, ticker, CASE WHEN s > 0 AND abs(s - 1) > {off} THEN w / s ELSE w END AS w FROM (SELECT *, sum(w) OVER (PARTITION BY fold, d) AS s FROM {text}))"


_ALIVE = f"(SELECT w.* FROM {_WEIGHTS} w JOIN {_UNIVERSE} u USING (ticker) WHERE u.inception_date <= w.d AND (u.closure_date IS NULL OR u.closure_date > w.d))"
_MEMBERS = f"(SELECT DISTINCT w.* FROM {_WEIGHTS} w JOIN {_MEMBER} m USING (ticker) WHERE m.start_date <= w.d AND (m.end_date IS NULL OR m.end_date > w.d))"


def _moved(w: str) -> str:
    """CTEs w, rb and mv: weights, rebalances, and changes of weight at all but a fold's first."""
    return f"""w AS {w}, rb AS (SELECT fold, d, lag(d) OVER o AS pv, lead(d) OVER o AS nx FROM (SELECT DISTINCT fold, d FROM w) WINDOW o AS (PARTITION BY fold ORDER BY d)),
 mv AS (SELECT rb.fold, rb.d, u.ticker, coalesce(a.w, 0) AS old, coalesce(b.w, 0) AS new FROM rb JOIN (SELECT DISTINCT fold, d, ticker FROM w) u ON u.fold = rb.fold AND (u.d = rb.d OR u.d = rb.pv)
  LEFT JOIN w a ON a.fold = rb.fold AND a.d = rb.pv AND a.ticker = u.ticker LEFT JOIN w b ON b.fold = rb.fold AND b.d = rb.d AND b.ticker = u.ticker WHERE rb.pv IS NOT NULL GROUP BY ALL)"""


def _run(costs: str, expense: bool) -> str:
    """CTEs r (returns), c (costs), hd (held days) and f (fold, d, ret, invested)."""
    return f"""r AS (SELECT ticker, d, px / lag(px) OVER (PARTITION BY ticker ORDER BY d) - 1 AS ret FROM {_PANEL}), c AS ({costs}),
 hd AS (SELECT rb.fold, x.d, rb.d AS rebal, row_number() OVER (PARTITION BY rb.fold, rb.d ORDER BY x.d) = 1 AS first FROM rb JOIN (SELECT DISTINCT d FROM r) x ON x.d > rb.d AND x.d <= coalesce(nx, make_date(rb.fold + 1, 1, 1))),
 f AS (SELECT fold, d, coalesce(rr, 0) + greatest(1 - invested, 0) * {_BILL} - e - CASE WHEN first THEN coalesce(cost, 0) ELSE 0 END AS ret, invested FROM (
  SELECT hd.fold, hd.d, hd.rebal, hd.first, sum(w.w * ret) AS rr, coalesce(sum(w.w) FILTER (ret IS NOT NULL), 0) AS invested, coalesce(sum(w.w * {'coalesce(expense, 0.0008)' if expense else '0'} / 252), 0) AS e
  FROM hd LEFT JOIN w ON w.fold = hd.fold AND w.d = hd.rebal LEFT JOIN r ON r.d = hd.d AND r.ticker = w.ticker LEFT JOIN {_RATE} k ON k.ticker = w.ticker GROUP BY ALL)
  LEFT JOIN (SELECT fold, d AS rebal, cost FROM c) USING (fold, rebal))"""


_FUND_COST = f"SELECT fold, d, sum(abs(new - old) * coalesce(bps, 4.0) / 10000) AS cost, sum(abs(new - old)) / 2 AS turnover FROM mv LEFT JOIN {_RATE} USING (ticker) GROUP BY fold, d"
_FIGURES = f"(SELECT fold, w.d, w.ticker, px, px * 1e5 * (1 + w.ticker * w.ticker * 40) AS cap FROM (SELECT DISTINCT fold, d FROM {_WEIGHTS}) b, (SELECT DISTINCT ticker FROM {_WEIGHTS}) t, LATERAL (SELECT b.d AS d, t.ticker AS ticker) w ASOF LEFT JOIN {_PANEL} p ON p.ticker = w.ticker AND p.d < w.d)"
_SIZE = "CASE WHEN cap / 1e9 >= 200 THEN 2.0 WHEN cap / 1e9 >= 10 THEN 5.0 WHEN cap / 1e9 >= 2 THEN 10.0 WHEN cap / 1e9 >= 0.3 THEN 25.0 ELSE 75.0 END"
_STOCK_COST = f"SELECT fold, d, sum(abs(new - old) * {_SIZE} / 10000 + CASE WHEN px > 0 THEN abs(new - old) * 1e6 / px * 0.005 / 1e6 ELSE 0 END) AS cost, sum(abs(new - old)) / 2 AS turnover FROM mv LEFT JOIN {_FIGURES} USING (fold, d, ticker) GROUP BY fold, d"


def _panel(spark, sf):
    return shared(spark, sf, _PANEL_TEXT)


def _weights(spark, sf):
    return shared(spark, sf, _WEIGHTS_TEXT)


def _universe(spark, sf):
    return shared(spark, sf, _UNIVERSE_TEXT)


def _ends(weights):
    return weights.select("fold", F.make_date(F.col("fold") + 1, F.lit(1), F.lit(1)).alias("end")).distinct()


def _bill():
    return 0.00005 + 0.00001 * (F.month("d") % 3)


def _figures(spark, sf):
    """Last prices before each rebalance, and a market value from them."""
    from ..operators import asof

    w = _weights(spark, sf)
    every = w.select("fold", "d").distinct().crossJoin(F.broadcast(w.select("ticker").distinct()))  # a row a ticker
    got = asof.as_of(every, _panel(spark, sf).withColumn("released", F.col("d")).drop("d"), ["ticker"], "d", "released", ["px"])
    return got.withColumn("cap", F.col("px") * 1e5 * (1 + F.col("ticker") * F.col("ticker") * 40))


def _funds(spark, sf):
    w = simulate.renormalised(simulate.alive_only(_weights(spark, sf), _universe(spark, sf)))
    rate = simulate.rates(_universe(spark, sf))
    costs = simulate.fund_costs(simulate.moves(w), rate)
    return simulate.run(history.returns(_panel(spark, sf)), w, _ends(w), _bill(), rate, costs), costs


@query(f"WITH {_moved(_sized(_ALIVE, 0.01))}, {_run(_FUND_COST, True)} SELECT fold, d, round(ret, 6) AS ret, round(invested, 6) AS invested FROM f")
def t2_backtest(spark, sf):
    """Weights of names alive at each rebalance, held from the next day, gaps as cash, expenses daily, the rebalance's cost on the first day."""
    return _funds(spark, sf)[0].select("fold", "d", r6("ret", "ret"), r6("invested", "invested"))


@query(f"""WITH {_moved(_sized(_ALIVE, 0.01))}, {_run(_FUND_COST, True)}, p AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY d ORDER BY fold) = 1)
 SELECT count(*) AS n, round(avg(ret) * 252, 6) AS mean, round(stddev_samp(ret) * sqrt(252), 6) AS vol, (SELECT round(sum(turnover), 6) FROM c) AS turnover, (SELECT round(sum(cost), 6) FROM c) AS cost FROM p""")
def t3_pooled(spark, sf):
    """All folds as one series, a day's first fold counting, with the folds' turnover and costs."""
    rets, costs = _funds(spark, sf)
    whole = costs.agg(r6(F.sum("turnover"), "turnover"), r6(F.sum("cost"), "cost"))
    return simulate.pooled(rets).agg(F.count("*").alias("n"), r6(F.avg("ret") * 252, "mean"), r6(F.stddev_samp("ret") * F.sqrt(F.lit(252.0)), "vol")).crossJoin(F.broadcast(whole))  # one row


@query(f"WITH {_moved(_sized(_MEMBERS, 0.001))}, {_run(_STOCK_COST, False)} SELECT fold, d, round(ret, 6) AS ret, round(invested, 6) AS invested FROM f")
def t4_stock_backtest(spark, sf):
    """Only members are held and weights are made whole; costs by the companies' size as known at the rebalance."""
    w = simulate.renormalised(simulate.members_only(_weights(spark, sf), shared(spark, sf, _MEMBER_TEXT)), 0.001)
    costs = simulate.stock_costs(simulate.moves(w), _figures(spark, sf), 1e6)
    return simulate.run(history.returns(_panel(spark, sf)), w, _ends(w), _bill(), costs=costs).select("fold", "d", r6("ret", "ret"), r6("invested", "invested"))


@query(f"WITH {_moved(_WEIGHTS)} SELECT fold, d, round(cost, 8) AS cost, round(turnover, 6) AS turnover FROM ({_STOCK_COST})")
def t6_stock_costs(spark, sf):
    from .views import rounded

    got = simulate.stock_costs(simulate.moves(_weights(spark, sf)), _figures(spark, sf), 1e6)
    return got.select("fold", "d", rounded("cost", "cost", 8), r6("turnover", "turnover"))


@query(f"SELECT fold, d, round(sum(w * coalesce(expense, 0.0008) / 252), 9) AS drag FROM {_WEIGHTS} LEFT JOIN {_RATE} USING (ticker) GROUP BY fold, d")
def t8_expense_drag(spark, sf):
    from .views import rounded

    met = _weights(spark, sf).join(simulate.rates(_universe(spark, sf)), "ticker", "left")
    return met.groupBy("fold", "d").agg(rounded(F.sum(F.col("w") * F.coalesce("expense", F.lit(simulate.EXPENSE)) / 252), "drag", 9))


@query(f"SELECT ticker, bps, round(expense, 6) AS expense FROM {_RATE}")
def y2_y3_cost_model(spark, sf):
    return simulate.rates(_universe(spark, sf)).select("ticker", "bps", r6("expense", "expense"))


@query(f"SELECT w.d, w.ticker, max(sector) AS sector FROM {_WEIGHTS} w LEFT JOIN {_MEMBER} m ON m.ticker = w.ticker AND m.start_date <= w.d AND (m.end_date IS NULL OR m.end_date > w.d) GROUP BY ALL")
def j13_sector_as_of(spark, sf):
    """The sector of the interval that holds on the day, null for a ticker that is no member."""
    w = _weights(spark, sf).select("d", "ticker")
    m = shared(spark, sf, _MEMBER_TEXT).drop("cik")
    met = w.join(m, "ticker").where((F.col("start_date") <= F.col("d")) & (F.col("end_date").isNull() | (F.col("end_date") > F.col("d")))).groupBy("d", "ticker").agg(F.max("sector").alias("sector"))
    return w.join(met, ["d", "ticker"], "left")


@query(f"SELECT fold, d, ticker, round(w, 6) AS w FROM {_MEMBERS}")
def j14_members_only(spark, sf):
    return simulate.members_only(_weights(spark, sf), shared(spark, sf, _MEMBER_TEXT)).select("fold", "d", "ticker", r6("w", "w"))


@query(f"SELECT fold, d, ticker, round(w, 6) AS w FROM (SELECT w.* FROM {_WEIGHTS} w JOIN {_UNIVERSE} u USING (ticker) WHERE u.inception_date <= w.d)")
def j15_listed_only(spark, sf):
    return simulate.listed_only(_weights(spark, sf), _universe(spark, sf)).select("fold", "d", "ticker", r6("w", "w"))


@query(f"SELECT fold, d, ticker, round(w, 6) AS w FROM {_sized(_ALIVE, 0.01)}")
def j16_alive_only(spark, sf):
    """Names alive at the rebalance, their weights made whole."""
    return simulate.renormalised(simulate.alive_only(_weights(spark, sf), _universe(spark, sf))).select("fold", "d", "ticker", r6("w", "w"))


@query(f"SELECT DISTINCT ticker FROM {_MEMBER}")
def u2_tickers_ever(spark, sf):
    return shared(spark, sf, _MEMBER_TEXT).select("ticker").distinct()


@query(f"SELECT ticker, lpad(any_value(cik) FILTER (cik IS NOT NULL), 10, '0') AS cik FROM {_MEMBER} GROUP BY ticker")
def y9_padded_cik(spark, sf):
    """The ten-digit key of each ticker, from the first interval that has one."""
    return shared(spark, sf, _MEMBER_TEXT).groupBy("ticker").agg(F.lpad(F.min("cik"), 10, "0").alias("cik"))


_SLEEVES = f"(SELECT d, list(coalesce(ret, 0) ORDER BY ticker) AS rets, max(CASE WHEN ticker = 'A' THEN coalesce(ret, 0) END) > 0.1 AS flip FROM {RETURNS} GROUP BY d HAVING count(*) = 3)"
_MIXES = "(VALUES ('even', [0.4, 0.3, 0.3]), ('bold', [0.8, 0.1, 0.1]), ('half', [0.5, 0.5, 0.0]))"
_DAYS = f"SELECT portfolio, goal, d, rets, flip, row_number() OVER (PARTITION BY portfolio ORDER BY d) AS k FROM {_SLEEVES}, {_MIXES} m(portfolio, goal)"


def _days(spark, sf):
    """Three mixes of three sleeves, on the days that all have; a flip where the first one gained over a tenth."""
    rets = history.returns(prices(spark, sf)).select("ticker", "d", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    days = rets.groupBy("d").agg(F.transform(F.array_sort(F.collect_list(F.struct("ticker", "ret"))), lambda s: s["ret"]).alias("rets"), F.count("*").alias("_n")).where("_n = 3").drop("_n")
    mixes = F.array(*[F.struct(F.lit(n).alias("portfolio"), F.array(*map(F.lit, w)).alias("goal")) for n, w in (("even", (0.4, 0.3, 0.3)), ("bold", (0.8, 0.1, 0.1)), ("half", (0.5, 0.5, 0.0)))])
    return days.select("d", "rets", (F.col("rets")[0] > 0.1).alias("flip"), F.explode(mixes).alias("m")).select("m.portfolio", "m.goal", "d", "rets", "flip")


_GROW = "[w[i] * (1 + rets[i]) FOR i IN [1, 2, 3]]"


@query(f"""WITH RECURSIVE x AS ({_DAYS}), p(portfolio, d, k, w, since, ret) AS (SELECT portfolio, NULL::DATE, 0, goal::DOUBLE[], 0, NULL::DOUBLE FROM {_MIXES} m(portfolio, goal) UNION ALL
 SELECT portfolio, d, k, CASE WHEN total <= 0 OR since >= 252 OR list_max([abs(g[i] / total - goal[i]) FOR i IN [1, 2, 3]]) > 0.05 THEN goal ELSE [v / total FOR v IN g] END, CASE WHEN total > 0 AND since >= 252 THEN 0 ELSE since END, CASE WHEN total <= 0 THEN -1 ELSE total / was - 1 END
 FROM (SELECT x.portfolio, x.d, x.k, x.goal::DOUBLE[] AS goal, since + 1 AS since, {_GROW} AS g, list_sum({_GROW}) AS total, list_sum(w) AS was FROM p JOIN x ON x.portfolio = p.portfolio AND x.k = p.k + 1))
 SELECT portfolio, d, round(ret, 6) AS ret FROM p WHERE k > 0""")
def t29_drift_rebalanced(spark, sf):
    return simulate.drift_rebalanced(_days(spark, sf)).select("portfolio", "d", r6("ret", "ret"))


@query(f"""WITH RECURSIVE x AS ({_DAYS}), p(portfolio, d, k, w, ret) AS (SELECT portfolio, NULL::DATE, 0, goal::DOUBLE[], NULL::DOUBLE FROM {_MIXES} m(portfolio, goal) UNION ALL
 SELECT portfolio, d, k, CASE WHEN back THEN goal ELSE g END, list_sum(g) / was - 1 - CASE WHEN back THEN 0.001 ELSE 0 END
 FROM (SELECT x.portfolio, x.d, x.k, x.goal::DOUBLE[] AS goal, {_GROW} AS g, list_sum(w) AS was, flip OR x.k % 252 = 0 AS back FROM p JOIN x ON x.portfolio = p.portfolio AND x.k = p.k + 1))
 SELECT portfolio, d, round(ret, 6) AS ret FROM p WHERE k > 0""")
def t30_flip_rebalanced(spark, sf):
    return simulate.flip_rebalanced(_days(spark, sf)).select("portfolio", "d", r6("ret", "ret"))


_SIG = f"(SELECT ticker, d, ret, coalesce(lag(up) OVER (PARTITION BY ticker ORDER BY d), false) AS sig FROM (SELECT *, px > avg(px) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS up FROM {RETURNS}))"


@query(f"""SELECT ticker, d, round(CASE WHEN sig THEN 2 * ret WHEN days <= 3 THEN -2 * ret ELSE 0.0001 END, 6) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY ticker, run ORDER BY d) - CASE WHEN run > 0 THEN 1 ELSE 0 END AS days FROM (
 SELECT *, sum(CASE WHEN sig THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY d) AS run FROM {_SIG}))""")
def w45_short_capped(spark, sf):
    """Twice long above the mean of 20 days, else twice short for three days on end, then bills."""
    from pyspark.sql import Window as W

    o = W.partitionBy("ticker").orderBy("d")
    df = history.returns(prices(spark, sf)).withColumn("up", F.col("px") > F.avg("px").over(o.rowsBetween(-19, 0)))
    days = df.select(F.col("ticker").alias("portfolio"), "d", F.array(2 * F.col("ret"), -2 * F.col("ret"), F.lit(0.0001)).alias("rets"), F.array().cast("array<double>").alias("goal"), F.coalesce(F.lag("up").over(o), F.lit(False)).alias("flip"))
    return simulate.short_capped(days, 3).select(F.col("portfolio").alias("ticker"), "d", r6("ret", "ret"))
