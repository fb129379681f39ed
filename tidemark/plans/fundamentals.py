"""Registered queries of company figures: filings made of supplier quarters, in three reporting patterns, with restatements."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import asof, fundamentals
from ..sources.saved import saved
from .queries import query
from .views import MONTHLY, monthly, plain, r2, r6, shared

_FLOWS = ("Revenues", "GrossProfit", "NetIncomeLoss", "OperatingIncomeLoss", "NetCashProvidedByUsedInOperatingActivities")
_STOCKS = ("Assets", "Liabilities", "StockholdersEquity", "Cash", "LongTermDebt", "DebtCurrent", "AssetsCurrent", "LiabilitiesCurrent")
_case = lambda names: " ".join(f"WHEN '{c}' THEN x{i}" for i, c in enumerate(names))
_values = lambda names: ", ".join(f"('{c}')" for c in names)

#: Facts in filing form: flows by quarter (ticker % 3 = 2), quarter and annual (0) or cumulative (1), balances, shares; some filed again later.
_QUARTERS_TEXT = """SELECT l_suppkey AS ticker, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q0, sum(l_extendedprice) / 7 AS rev, sum(l_extendedprice * l_discount) / 7 AS disc, sum(l_extendedprice * l_tax) / 7 AS tax, sum(l_quantity) / 7 AS qty
 FROM {lineitem} GROUP BY l_suppkey, date_trunc('quarter', l_shipdate)"""
_FILED_TEXT = f"""WITH q AS (SELECT * FROM {{quarters}}),
 e AS (SELECT *, CAST(date_trunc('year', q0) AS DATE) AS y0, CAST(q0 + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS end_d, CAST(quarter(q0) AS INT) AS k FROM q),
 f AS (SELECT ticker, q0, y0, end_d, k, concept, CASE concept {_case(_FLOWS)} END AS x FROM (SELECT *, rev AS x0, rev * 0.4 - disc AS x1, tax - rev * 0.035 AS x2, tax - rev * 0.03 AS x3, qty * 30 - disc AS x4 FROM e) t CROSS JOIN (VALUES {_values(_FLOWS)}) AS c(concept)),
 g AS (SELECT *, sum(x) OVER (PARTITION BY ticker, concept, y0 ORDER BY k) AS upto FROM f),
 s AS (SELECT ticker, end_d, concept, CASE concept {_case(_STOCKS)} END AS val FROM (SELECT *, rev * 4 AS x0, rev * 2 + disc AS x1, rev * 2 - disc AS x2, qty * 9 AS x3, rev * 0.5 AS x4, disc * 2 AS x5, rev + qty AS x6, rev * 0.7 + disc AS x7 FROM e) t CROSS JOIN (VALUES {_values(_STOCKS)}) AS c(concept)),
 a AS (SELECT ticker, 'us-gaap' AS taxonomy, concept, 'USD' AS unit, CASE WHEN ticker % 3 = 1 THEN y0 ELSE q0 END AS start_d, end_d, CASE WHEN ticker % 3 = 1 THEN upto ELSE x END AS val, CAST(end_d + INTERVAL 40 DAY AS DATE) AS filed, '10-Q' AS form FROM g WHERE k < 4 OR ticker % 3 = 2
  UNION ALL SELECT ticker, 'us-gaap', concept, 'USD', y0, end_d, upto, CAST(end_d + INTERVAL 80 DAY AS DATE), '10-K' FROM g WHERE k = 4
  UNION ALL SELECT ticker, 'us-gaap', concept, 'USD', end_d, end_d, val, CAST(end_d + INTERVAL 40 DAY AS DATE), '10-Q' FROM s
  UNION ALL SELECT ticker, 'dei', 'EntityCommonStockSharesOutstanding', 'shares', end_d, end_d, 100 + qty % 900, CAST(end_d + INTERVAL 35 DAY AS DATE), '10-Q' FROM e WHERE ticker % 2 = 0
  UNION ALL SELECT ticker, 'us-gaap', 'CommonStockSharesOutstanding', 'shares', end_d, end_d, 100 + qty % 700, CAST(end_d + INTERVAL 40 DAY AS DATE), '10-Q' FROM e WHERE ticker % 2 = 1)
 SELECT * FROM a UNION ALL SELECT ticker, taxonomy, concept, unit, start_d, end_d, val * 1.02, CAST(filed + INTERVAL 160 DAY AS DATE), form FROM a WHERE ticker % 4 = 0 AND month(end_d) = 6"""
FACTS = plain(_FILED_TEXT.replace("SELECT * FROM {quarters}", _QUARTERS_TEXT))
_AT = "(SELECT DISTINCT ticker, CAST(date_trunc('year', d) + INTERVAL 7 MONTH AS DATE) AS at FROM " + MONTHLY + ")"

_NAMES = ", ".join(f"('{a}', '{c}')" for a, cs in fundamentals.ALIASES.items() for c in cs)
_SUMS = fundamentals.FLOWS
_CHAIN = f"""WITH facts AS MATERIALIZED (SELECT * FROM {FACTS}), dec AS (SELECT * FROM {_AT}), dec2 AS (SELECT * FROM dec UNION SELECT ticker, at - 365 FROM dec),
 m AS (SELECT f.*, alias, max(CASE WHEN taxonomy = 'dei' THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, f.concept) AS dei FROM facts f JOIN (VALUES {_NAMES}) n(alias, concept) ON n.concept = f.concept),
 al AS (SELECT ticker, alias, start_d, end_d, val, filed, form FROM m WHERE CASE WHEN alias = 'shares_outstanding' THEN unit = 'shares' AND taxonomy = CASE WHEN dei = 1 THEN 'dei' ELSE 'us-gaap' END ELSE unit = 'USD' AND taxonomy = 'us-gaap' END),
 kn AS MATERIALIZED (SELECT * FROM (SELECT a.*, d.at, row_number() OVER (PARTITION BY a.ticker, alias, d.at, end_d ORDER BY filed DESC, val DESC) AS newest FROM al a JOIN dec2 d ON a.ticker = d.ticker AND a.filed < d.at) WHERE newest = 1),
 kd AS (SELECT *, end_d - start_d AS days FROM kn WHERE alias IN ({', '.join(f"'{a}'" for a in _SUMS)})), ann AS (SELECT * FROM kd WHERE days > 300),
 pt AS (SELECT a.ticker, a.alias, a.at, a.start_d AS ys, a.end_d AS ye, a.val AS yv, a.filed AS yf, p.start_d, p.end_d, p.val, p.filed,
  CASE WHEN p.days BETWEEN 60 AND 100 AND p.start_d = a.start_d AND p.end_d < a.end_d THEN 'q1' WHEN p.days BETWEEN 60 AND 100 AND p.start_d > a.start_d AND p.end_d <= a.end_d THEN 'pure' WHEN p.days BETWEEN 101 AND 300 AND p.start_d = a.start_d AND p.end_d < a.end_d THEN 'cum' END AS kind
  FROM ann a JOIN kd p USING (ticker, alias, at)),
 yr AS (SELECT ticker, alias, at, ys, ye, any_value(yv) AS yv, any_value(yf) AS yf, count(*) FILTER (WHERE kind = 'q1') AS nq, count(*) FILTER (WHERE kind = 'pure') AS np, count(*) FILTER (WHERE kind = 'cum') AS nc,
  sum(val) FILTER (WHERE kind IN ('q1', 'pure')) AS spent, max(end_d) FILTER (WHERE kind = 'pure') AS pe, max(val) FILTER (WHERE kind = 'q1') AS v1, max(end_d) FILTER (WHERE kind = 'q1') AS e1,
  min_by(val, end_d) FILTER (WHERE kind = 'cum') AS vh, min(end_d) FILTER (WHERE kind = 'cum') AS eh, min_by(filed, end_d) FILTER (WHERE kind = 'cum') AS fh, max_by(val, end_d) FILTER (WHERE kind = 'cum') AS v9, max(end_d) FILTER (WHERE kind = 'cum') AS e9, max_by(filed, end_d) FILTER (WHERE kind = 'cum') AS f9
  FROM pt WHERE kind IS NOT NULL GROUP BY 1, 2, 3, 4, 5 HAVING nq = 1),
 un AS (SELECT p.ticker, p.alias, p.at, p.start_d, p.end_d, p.val, p.filed FROM pt p JOIN yr y USING (ticker, alias, at, ys, ye) WHERE kind = 'q1' AND ((np = 2 AND nc = 0) OR (np = 0 AND nc = 2) OR (np = 3 AND nc = 0)) OR kind = 'pure' AND nc = 0 AND np IN (2, 3)
  UNION ALL SELECT ticker, alias, at, pe, ye, yv - spent, yf FROM yr WHERE np = 2 AND nc = 0
  UNION ALL SELECT ticker, alias, at, e1, eh, vh - v1, fh FROM yr WHERE np = 0 AND nc = 2 UNION ALL SELECT ticker, alias, at, eh, e9, v9 - vh, f9 FROM yr WHERE np = 0 AND nc = 2 UNION ALL SELECT ticker, alias, at, e9, ye, yv - v9, yf FROM yr WHERE np = 0 AND nc = 2
  UNION ALL SELECT k.ticker, k.alias, k.at, k.start_d, k.end_d, k.val, k.filed FROM kd k LEFT JOIN (SELECT ticker, alias, at, max(end_d) AS la FROM ann GROUP BY 1, 2, 3) l USING (ticker, alias, at) WHERE days BETWEEN 60 AND 100 AND (la IS NULL OR k.end_d > la)),
 qt AS MATERIALIZED (SELECT ticker, alias, at, start_d, end_d, val, filed FROM (SELECT *, row_number() OVER (PARTITION BY ticker, alias, at, end_d ORDER BY filed DESC, val DESC) AS r FROM un) WHERE r = 1),
 tt AS (SELECT ticker, at, alias, sum(val) AS val FROM (SELECT *, row_number() OVER (PARTITION BY ticker, alias, at ORDER BY end_d DESC) AS r FROM qt) WHERE r <= 4 GROUP BY 1, 2, 3 HAVING count(*) = 4),
 lv AS (SELECT ticker, at, alias, max_by(val, end_d) AS val, max_by(filed, end_d) AS filed, max(filed) AS newest FROM kn GROUP BY 1, 2, 3),
 fl AS (SELECT ticker, at, {', '.join(f"max(val) FILTER (WHERE alias = '{a}') AS ttm_{a}" for a in _SUMS)} FROM tt GROUP BY 1, 2),
 st AS (SELECT ticker, at, {', '.join(f"max(val) FILTER (WHERE alias = '{a}') AS {n}" for n, a in fundamentals.STOCKS.items())}, max(filed) FILTER (WHERE alias = 'net_income') AS latest_filing FROM lv GROUP BY 1, 2),
 mt AS MATERIALIZED (SELECT d.ticker, d.at, fl.* EXCLUDE (ticker, at), st.* EXCLUDE (ticker, at), ttm_gross_profit / nullif(ttm_revenue, 0) AS gross_margin_ttm, ttm_net_income / nullif(ttm_revenue, 0) AS net_margin_ttm, ttm_operating_income / nullif(ttm_revenue, 0) AS operating_margin_ttm,
  ttm_net_income / nullif(stockholders_equity, 0) AS roe_ttm, ttm_net_income / nullif(total_assets, 0) AS roa_ttm, CASE WHEN long_term_debt IS NOT NULL OR short_term_debt IS NOT NULL THEN (coalesce(long_term_debt, 0) + coalesce(short_term_debt, 0)) / nullif(stockholders_equity, 0) END AS debt_to_equity,
  current_assets / nullif(current_liabilities, 0) AS current_ratio, ttm_operating_income / nullif(total_assets, 0) AS earnings_yield_on_assets, (ttm_net_income - ttm_operating_cash_flow) / nullif(total_assets, 0) AS accruals_ratio
  FROM dec2 d LEFT JOIN fl USING (ticker, at) LEFT JOIN st USING (ticker, at)),
 pr AS (SELECT dec.ticker, dec.at, p.px FROM dec ASOF LEFT JOIN (SELECT ticker, d, px FROM {MONTHLY}) p ON dec.ticker = p.ticker AND dec.at > p.d),
 va AS (SELECT mt.*, px, CASE WHEN shares_outstanding > 0 AND px > 0 THEN shares_outstanding * px END AS cap FROM mt JOIN pr USING (ticker, at))
"""
_FIGURES = ["ttm_net_income", "ttm_revenue", "ttm_gross_profit", "ttm_operating_income", "ttm_operating_cash_flow", *fundamentals.STOCKS, "gross_margin_ttm", "net_margin_ttm", "operating_margin_ttm", "roe_ttm", "roa_ttm", "debt_to_equity", "current_ratio", "earnings_yield_on_assets", "accruals_ratio"]


def _facts(spark, sf):
    """Written once: every figure of a decision is made from them."""
    return saved(spark.sql(_FILED_TEXT, quarters=saved(shared(spark, sf, _QUARTERS_TEXT))))


def _decisions(spark, sf):
    return monthly(spark, sf).select("ticker", F.to_date(F.date_trunc("year", "d") + F.expr("INTERVAL 7 MONTH")).alias("at")).distinct()


def _known(spark, sf):
    return fundamentals.as_known(fundamentals.by_alias(_facts(spark, sf)), _decisions(spark, sf))


def _valued(spark, sf):
    """Figures of every decision with the last price before it."""
    decisions = saved(_decisions(spark, sf))
    priced = asof.as_of(decisions, monthly(spark, sf).select("ticker", "d", "px"), ["ticker"], "at", "d", ["px"])
    return fundamentals.valuations(fundamentals.metrics(_facts(spark, sf), decisions).join(priced, ["ticker", "at"]))


@query(f"{_CHAIN} SELECT ticker, at, alias, end_d, start_d, round(val, 2) AS val, filed FROM qt JOIN dec USING (ticker, at)")
def x2_quarters(spark, sf):
    known = _known(spark, sf)
    got = fundamentals.quarterise(known.where(F.col("alias").isin(*fundamentals.FLOWS)))
    return got.select("ticker", "at", "alias", "end_d", "start_d", r2("val", "val"), "filed")


@query(f"{_CHAIN} SELECT ticker, at, alias, round(val, 2) AS val FROM tt JOIN dec USING (ticker, at)")
def x3_trailing_sums(spark, sf):
    quarters = fundamentals.quarterise(_known(spark, sf).where(F.col("alias").isin(*fundamentals.FLOWS)))
    return fundamentals.trailing_sums(quarters).select("ticker", "at", "alias", r2("val", "val"))


@query(f"{_CHAIN} SELECT ticker, at, alias, round(val, 2) AS val, newest FROM lv JOIN dec USING (ticker, at)")
def x4_latest_values(spark, sf):
    return fundamentals.latest_values(fundamentals.by_alias(_facts(spark, sf)), _decisions(spark, sf)).select("ticker", "at", "alias", r2("val", "val"), "newest")


@query(f"{_CHAIN} SELECT ticker, at, {', '.join(f'round({c}, 2) AS {c}' for c in _FIGURES)}, latest_filing FROM mt JOIN dec USING (ticker, at)")
def x5_metrics(spark, sf):
    got = fundamentals.metrics(_facts(spark, sf), _decisions(spark, sf))
    return got.select("ticker", "at", *[r2(c, c) for c in _FIGURES], "latest_filing")


_OLD = "(SELECT ticker, at + 365 AS at, roa_ttm AS o1, debt_to_equity AS o2, current_ratio AS o3, shares_outstanding AS o4, gross_margin_ttm AS o5, ttm_revenue / nullif(total_assets, 0) AS o6 FROM mt)"


@query(f"""{_CHAIN}, fs AS (SELECT ticker, at, CAST(roa_ttm > 0 AS INT) AS p1, CAST(ttm_operating_cash_flow > 0 AS INT) AS p2, CAST(roa_ttm > o1 AS INT) AS p3, CAST(ttm_operating_cash_flow > ttm_net_income AS INT) AS p4, CAST(debt_to_equity < o2 AS INT) AS p5,
 CAST(current_ratio > o3 AS INT) AS p6, CAST(shares_outstanding <= o4 AS INT) AS p7, CAST(gross_margin_ttm > o5 AS INT) AS p8, CAST(ttm_revenue / nullif(total_assets, 0) > o6 AS INT) AS p9 FROM mt JOIN dec USING (ticker, at) JOIN {_OLD} USING (ticker, at))
 SELECT *, p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 + p9 AS score, coalesce(p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 + p9 >= 7, false) AS strong FROM fs""")
def x6_f_score(spark, sf):
    got = fundamentals.f_scores(_facts(spark, sf), _decisions(spark, sf))
    return got.withColumn("strong", F.coalesce(F.col("score") >= 7, F.lit(False)))


@query(f"{_CHAIN} SELECT ticker, filed, round(val, 2) AS shares FROM (SELECT *, row_number() OVER (PARTITION BY ticker, filed ORDER BY end_d DESC, val DESC) AS r FROM al WHERE alias = 'shares_outstanding') WHERE r = 1")
def x8_shares_by_filing(spark, sf):
    rows = fundamentals.by_alias(_facts(spark, sf)).where("alias = 'shares_outstanding'")
    last = rows.withColumn("r", F.row_number().over(W.partitionBy("ticker", "filed").orderBy(F.desc("end_d"), F.desc("val")))).where("r = 1")
    return last.select("ticker", "filed", r2("val", "shares"))


_DELIST_TEXT = """SELECT l_suppkey AS ticker, CAST(max(l_shipdate) + INTERVAL 20 DAY - INTERVAL 2 YEAR AS DATE) AS delist_date, -0.1 * (l_suppkey % 11) AS delist_return FROM {lineitem} WHERE l_suppkey % 3 = 0 GROUP BY l_suppkey"""


@query(f"""WITH p AS (SELECT ticker, d, px FROM {MONTHLY}), x AS (SELECT DISTINCT d FROM p), e AS (SELECT l.ticker, delist_return AS dr, x.d AS e FROM {plain(_DELIST_TEXT)} l ASOF JOIN x ON x.d <= l.delist_date WHERE l.ticker IN (SELECT ticker FROM p)),
 g AS (SELECT p.ticker, p.d, p.px, e, dr FROM p LEFT JOIN e USING (ticker) UNION ALL SELECT ticker, e, NULL, e, dr FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.ticker = e.ticker AND p.d = e.e)),
 b AS (SELECT ticker, max_by(px, d) AS before FROM g WHERE d < e GROUP BY 1)
 SELECT ticker, d, round(CASE WHEN e IS NULL OR before IS NULL OR d < e THEN px WHEN d = e THEN before * (1 + dr) END, 2) AS px FROM g LEFT JOIN b USING (ticker)""")
def x9_delisting(spark, sf):
    got = fundamentals.delisted_prices(monthly(spark, sf).select("ticker", "d", "px"), shared(spark, sf, _DELIST_TEXT))
    return got.select("ticker", "d", r2("px", "px"))


@query(f"{_CHAIN} SELECT ticker, at, round(ttm_net_income / cap, 6) AS ep, round(ttm_revenue / cap, 6) AS sp, round(CASE WHEN stockholders_equity > 0 THEN stockholders_equity / cap END, 6) AS bm, round(CASE WHEN total_assets > 0 THEN ttm_gross_profit / total_assets END, 6) AS gpa, round(roe_ttm, 6) AS roe FROM va")
def x15_x24_x26_valuations(spark, sf):
    return _valued(spark, sf).select("ticker", "at", *[r6(c, c) for c in ("ep", "sp", "bm", "gpa")], r6("roe_ttm", "roe"))


@query(f"""{_CHAIN}, c AS (SELECT ticker, at, ttm_operating_income / total_assets AS ey, ttm_operating_income / (total_assets - coalesce(cash, 0)) AS roic FROM va WHERE ttm_operating_income IS NOT NULL AND total_assets > 0 AND total_assets - coalesce(cash, 0) > 0)
 SELECT ticker, at, CAST(-(rank() OVER (PARTITION BY at ORDER BY ey DESC) + rank() OVER (PARTITION BY at ORDER BY roic DESC)) AS INT) AS score FROM c""")
def x28_magic_formula(spark, sf):
    return fundamentals.magic_formula(_valued(spark, sf)).select("ticker", "at", F.col("score").cast("int"))


def _composite(names: dict[str, str], least: int) -> str:
    """SQL of fundamentals.composite."""
    z = ", ".join(f"CASE WHEN {e} IS NOT NULL THEN CASE WHEN stddev_samp({e}) OVER w > 0 THEN ({e} - avg({e}) OVER w) / stddev_samp({e}) OVER w ELSE 0 END END AS z{i}" for i, e in enumerate(names.values()))
    there = " + ".join(f"(z{i} IS NOT NULL)::INT" for i in range(len(names)))
    return f"{_CHAIN}, z AS (SELECT ticker, at, {z} FROM va WINDOW w AS (PARTITION BY at)) SELECT ticker, at, round(({' + '.join(f'coalesce(z{i}, 0)' for i in range(len(names)))}) / ({there}), 6) AS score FROM z WHERE {there} >= {least}"


_EP, _GPA = "(ttm_net_income / cap)", "(CASE WHEN total_assets > 0 THEN ttm_gross_profit / total_assets END)"


@query(_composite({"ep": _EP, "gpa": _GPA}, 2))
def x29_value_profitability(spark, sf):
    return fundamentals.composite(_valued(spark, sf), ["ep", "gpa"], 2).select("ticker", "at", r6("score", "score"))


@query(_composite({"roe": "roe_ttm", "gm": "gross_margin_ttm", "ep": _EP}, 2))
def x30_quality_value(spark, sf):
    return fundamentals.composite(_valued(spark, sf), ["roe_ttm", "gross_margin_ttm", "ep"], 2).select("ticker", "at", r6("score", "score"))


@query(f"{_CHAIN} SELECT ticker, at, round(px * shares, 2) AS cap, round(px, 2) AS px FROM pr ASOF LEFT JOIN (SELECT ticker AS t, filed, max_by(val, end_d) AS shares FROM al WHERE alias = 'shares_outstanding' GROUP BY 1, 2) s ON pr.ticker = s.t AND pr.at > s.filed")
def j17_market_caps(spark, sf):
    shares = fundamentals.by_alias(_facts(spark, sf)).where("alias = 'shares_outstanding'").groupBy("ticker", "filed").agg(F.max_by("val", "end_d").alias("shares"))
    priced = asof.as_of(_decisions(spark, sf), monthly(spark, sf).select("ticker", "d", "px"), ["ticker"], "at", "d", ["px"])
    known = asof.as_of(priced, shares, ["ticker"], "at", "filed", ["shares"])
    return known.select("ticker", "at", r2(F.col("px") * F.col("shares"), "cap"), r2("px", "px"))


@query(f"SELECT ticker, concept, max(filed) AS newest, count(*) AS filings, count(DISTINCT end_d) AS periods FROM {FACTS} WHERE unit = 'USD' GROUP BY 1, 2")
def y7_y8_filings(spark, sf):
    f = _facts(spark, sf).where("unit = 'USD'")
    return f.groupBy("ticker", "concept").agg(F.max("filed").alias("newest"), F.count("*").alias("filings"), F.countDistinct("end_d").alias("periods"))
