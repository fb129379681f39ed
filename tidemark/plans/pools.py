"""Registered queries of pooled sleeves, rotations and grids of strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocate, history
from .factors import _REGIONS, _regions
from .queries import query
from .views import RETURNS, prices, r6

_RF = 0.0001
_PX = "(SELECT ticker, d, px, ret, {flag} AS e FROM (SELECT *, lag(up) OVER (PARTITION BY ticker ORDER BY d) AS was FROM (SELECT *, CASE WHEN count(px) OVER w = {n} THEN CAST(px > avg(px) OVER w AS INT) END AS up FROM " + RETURNS + " WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN {m} PRECEDING AND CURRENT ROW))))"
_TREND = lambda n: _PX.format(flag="coalesce(was, 0)", n=n, m=n - 1)


def _rets(spark, sf):
    return history.returns(prices(spark, sf))


@query(f"""WITH RECURSIVE s AS (SELECT region || '|' || ticker AS t, d, ret FROM {_REGIONS} WHERE ret IS NOT NULL), n AS (SELECT list(DISTINCT t ORDER BY t) AS names FROM s),
 g AS (SELECT d, map_from_entries(list((t, ret))) AS m FROM s GROUP BY d), x AS (SELECT d, [m[v] FOR v IN names] AS r, year(d + 1) AS seg, row_number() OVER (ORDER BY d) AS k FROM g, n),
 p(k, d, seg, w, ret) AS (SELECT 0::BIGINT, NULL::DATE, 0::BIGINT, NULL::DOUBLE[], NULL::DOUBLE UNION ALL
  SELECT k, d, seg, [v / list_sum(grown) FOR v IN grown], coalesce(list_sum([w[i] * r[i] FOR i IN range(1, len(r) + 1)]), 0) FROM (SELECT *, [w[i] * (1 + r[i]) FOR i IN range(1, len(r) + 1)] AS grown FROM (
   SELECT x.k, x.d, x.seg, x.r, CASE WHEN x.seg <> p.seg THEN [1.0::DOUBLE / len(x.r) FOR v IN x.r] ELSE p.w END AS w FROM p JOIN x ON x.k = p.k + 1)))
 SELECT d, round(ret, 6) AS ret FROM p WHERE k > 0""")
def t17_pooled_sleeves(spark, sf):
    """Six sleeves in equal parts, set back at each year's end; one that misses a day is out until then."""
    got = allocate.pooled_sleeves(_regions(spark, sf).select("ticker", "d", "ret"), F.year(F.date_add("d", 1)))
    return got.select("d", r6("ret", "ret"))


_FULL3 = f"(SELECT * FROM {RETURNS} WHERE ret IS NOT NULL QUALIFY count(*) OVER (PARTITION BY d) = 3)"


@query(f"SELECT d, round(avg(ret), 6) AS ret FROM {_FULL3} GROUP BY d")
def t31_independent_sleeves(spark, sf):
    return allocate.complete_mean(_rets(spark, sf).where("ret is not null")).select("d", r6("ret", "ret"))


@query(f"""SELECT d, round(sum(k * g) / sum(k * b) - 1, 6) AS ret FROM (SELECT d, CASE WHEN ticker = 'A' THEN 0.6 ELSE 0.2 END AS k, product(1 + ret) OVER (PARTITION BY ticker, seg ORDER BY d) AS g, coalesce(product(1 + ret) OVER (PARTITION BY ticker, seg ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS b
 FROM (SELECT *, (row_number() OVER (PARTITION BY ticker ORDER BY d) - 1) // 252 AS seg FROM {_FULL3})) GROUP BY d""")
def t28_rebalanced_by_rows(spark, sf):
    """Weights set back every 252 rows of the days that all sleeves have."""
    from pyspark.sql import Window as W

    full = _rets(spark, sf).where("ret is not null").withColumn("_k", F.count("*").over(W.partitionBy("d"))).where("_k = 3")
    seg = full.withColumn("seg", allocate.row_segment(252, ["ticker"]))
    weight = F.when(F.col("ticker") == "A", 0.6).otherwise(0.2)
    return allocate.drifting_mix(seg, weight, F.col("seg")).select("d", r6("ret", "ret"))


@query(f"""SELECT d, round(coalesce(avg(ret) FILTER (m IS NOT NULL AND k <= 2), {_RF}), 6) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY m DESC NULLS LAST, ticker) AS k FROM (SELECT ticker, d, ret, CASE WHEN e > 0 AND count(ret) OVER w = 20 THEN sum(ret) OVER w END AS m
 FROM {_TREND(50)} WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE ret IS NOT NULL) GROUP BY d""")
def t25_trend_top_k(spark, sf):
    return allocate.trend_top_k(allocate.trend(_rets(spark, sf), 50, "e"), "e", 20, 2, _RF).select("d", r6("ret", "ret"))


@query(f"""SELECT d, round(coalesce(sum(i * ret) / sum(i), {_RF}), 6) AS ret FROM (SELECT ticker, d, ret, CASE WHEN e > 0 AND count(ret) OVER w = 20 AND stddev_samp(ret) OVER w > 0 THEN 1 / stddev_samp(ret) OVER w END AS i
 FROM {_TREND(50)} WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE ret IS NOT NULL GROUP BY d""")
def t26_trend_inverse_vol(spark, sf):
    return allocate.trend_inverse_vol(allocate.trend(_rets(spark, sf), 50, "e"), "e", 20, _RF).select("d", r6("ret", "ret"))


@query(f"""WITH v AS (SELECT ticker, d, ret, CASE WHEN count(ret) OVER w >= 31 THEN stddev_samp(ret) OVER w * sqrt(252) END AS v FROM {RETURNS} WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
 m AS (SELECT ticker, CAST(date_trunc('month', d) AS DATE) AS month, product(1 + coalesce(ret, 0)) - 1 AS ret, arg_max(v, d) AS v FROM v GROUP BY 1, 2),
 s AS (SELECT *, coalesce(v, CASE WHEN count(ret) OVER w >= 6 THEN stddev_samp(ret) OVER w * sqrt(12) END) AS s FROM m WINDOW w AS (PARTITION BY ticker ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
 SELECT ticker, month, round(ret, 6) AS ret, round(coalesce(least(lag(20 / greatest(s, 0.01)) OVER (PARTITION BY ticker ORDER BY month), 1.5), 0), 6) AS exposure FROM s""")
def t21_monthly_vol_target(spark, sf):
    got = allocate.monthly_vol_target(_rets(spark, sf), 20.0, 1.5)
    return got.select("ticker", "month", r6("ret", "ret"), r6("exposure", "exposure"))


_STRATS = " UNION ALL ".join(f"SELECT '{name}' AS strategy, ticker, d, {ret} AS ret FROM {rows} WHERE ret IS NOT NULL" for name, ret, rows in (("hold", "ret", RETURNS), ("trend50", f"CASE WHEN e > 0 THEN ret ELSE {_RF} END", _TREND(50)), ("trend100", f"CASE WHEN e > 0 THEN ret ELSE {_RF} END", _TREND(100))))


@query(f"SELECT strategy, ticker, count(*) AS n, round(avg(ret) * 252, 6) AS mean, round(stddev_samp(ret) * sqrt(252), 6) AS vol, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe FROM ({_STRATS}) GROUP BY 1, 2")
def t16_factors_by_strategies(spark, sf):
    """Every series under every strategy, in one job."""
    rets = _rets(spark, sf)
    for n in (50, 100):
        rets = allocate.trend(rets, n, f"e{n}")
    timed = lambda n: allocate.exposed(F.col(f"e{n}"), F.col("ret"), F.lit(_RF))
    each = rets.where("ret is not null").select("ticker", "d", F.explode(F.create_map(F.lit("hold"), F.col("ret"), F.lit("trend50"), timed(50), F.lit("trend100"), timed(100))).alias("strategy", "ret"))
    x = F.col("ret")
    return each.groupBy("strategy", "ticker").agg(F.count("*").alias("n"), r6(F.avg(x) * 252, "mean"), r6(F.stddev_samp(x) * F.sqrt(F.lit(252.0)), "vol"), r6(F.avg(x) / F.stddev_samp(x) * F.sqrt(F.lit(252.0)), "sharpe"))
