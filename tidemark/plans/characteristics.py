"""Registered queries of characteristics, coverage, momentum scores, regimes and class representatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import characteristics as chars

from .queries import query
from .simulations import _PANEL, _panel
from .views import PAIRS, PRICES, pairs, plain, prices, r6, rounded, shared

_L = lambda k: f"lag(px, {k}) OVER o" if k else "px"
_MOM = lambda a, b: f"CASE WHEN {_L(a)} > 0 AND {_L(b)} > 0 THEN ln({_L(b)} / {_L(a)}) END"
_CHARS = f"""WITH p AS (SELECT *, px / lag(px) OVER o - 1 AS ret, row_number() OVER o AS k, {_MOM(22, 1)} AS m1, {_MOM(126, 22)} AS m6, {_MOM(252, 22)} AS m12, {_MOM(756, 273)} AS m36 FROM {PRICES} WINDOW o AS (PARTITION BY ticker ORDER BY d)),
 q AS (SELECT *, CASE WHEN k >= 274 THEN m6 - lag(m6, 126) OVER (PARTITION BY ticker ORDER BY d) END AS ch, CASE WHEN count(ret) OVER s >= 15 THEN max(ret) OVER s END AS mx, CASE WHEN count(ret) OVER s >= 15 THEN stddev_samp(ret) OVER s * sqrt(252) END AS sd FROM p WINDOW s AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)),
 j AS (SELECT a.ticker, a.d, a.ret, b.ret AS bench FROM p a JOIN p b ON b.ticker = 'N' AND a.d = b.d WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL),
 b AS (SELECT ticker, d, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY d) >= 126 AND var_samp(bench) OVER f > 0 THEN covar_samp(ret, bench) OVER f / var_samp(bench) OVER f END AS beta FROM j WINDOW f AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))"""


@query(f"""{_CHARS} SELECT q.ticker, q.d, round(m1, 6) AS mom_1m_1m, round(m6, 6) AS mom_6m_1m, round(m12, 6) AS mom_12m_1m, round(m36, 6) AS mom_36m_13m, round(ch, 6) AS chmom, round(mx, 6) AS maxret_22d, round(sd, 6) AS retvol_22d, round(beta, 6) AS beta_252d, round(beta * beta, 6) AS betasq_252d
 FROM (SELECT ticker, d, k, CASE WHEN k >= 22 THEN m1 END AS m1, CASE WHEN k >= 22 THEN m6 END AS m6, m12, m36, ch, CASE WHEN k >= 22 THEN mx END AS mx, CASE WHEN k >= 22 THEN sd END AS sd FROM q) q LEFT JOIN b ON b.ticker = q.ticker AND b.d = q.d""")
def x10_price_characteristics(spark, sf):
    """Momentum, moments and beta of every row; the residual deviation is x13."""
    got = chars.price_characteristics(prices(spark, sf), "N")
    return got.select("ticker", "d", *[r6(c, c) for c in chars.PRICE if c != "idiovol_126d"])


_SECTOR = f"(SELECT ticker, d, px, CASE WHEN ticker % 7 <> 0 THEN 'S' || ticker % 3 END AS sector, CASE WHEN ticker % 5 <> 0 THEN px END AS v FROM {_PANEL})"


@query(f"SELECT ticker, d, round(CASE WHEN sector IS NULL OR n = 0 THEN NULL WHEN v IS NULL OR n = 1 THEN t / n ELSE (t - v) / (n - 1) END, 6) AS peers FROM (SELECT *, sum(v) OVER (PARTITION BY d, sector) AS t, count(v) OVER (PARTITION BY d, sector) AS n FROM {_SECTOR})")
def x10_peer_mean(spark, sf):
    """The mean of the others of a sector on a day."""
    t = F.col("ticker")
    rows = _panel(spark, sf).withColumns({"sector": F.when(t % 7 != 0, F.concat(F.lit("S"), t % 3)), "v": F.when(t % 5 != 0, F.col("px"))})
    return chars.peer_mean(rows, ["d", "sector"], "v", "peers").select("ticker", "d", r6("peers", "peers"))


_BARS_TEXT = "SELECT CAST(l_suppkey % 4 AS INT) AS ticker, CAST(l_shipdate AS DATE) AS d, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_extendedprice) / sum(l_quantity) AS close, CASE WHEN CAST(min(l_orderkey) AS BIGINT) % 9 = 0 THEN 0.0 ELSE sum(l_quantity) END AS volume, CASE WHEN l_suppkey % 4 <> 3 THEN 1000.0 + l_suppkey % 4 END AS shares FROM {lineitem} GROUP BY l_suppkey % 4, CAST(l_shipdate AS DATE)"


@query(f"""WITH b AS (SELECT *, close * volume AS dv, abs(close / lag(close) OVER (PARTITION BY ticker ORDER BY d) - 1) AS r FROM {plain(_BARS_TEXT)}), c AS (SELECT *, CASE WHEN dv > 0 THEN ln(dv) END AS ldv, CASE WHEN dv > 0 THEN r / dv END AS ill, (high - low) / ((high + low) / 2) AS sp FROM b)
 SELECT ticker, d, round(CASE WHEN k THEN avg(volume) OVER f / shares END, 6) AS turn_22d, round(CASE WHEN k AND avg(dv) OVER f > 0 THEN ln(avg(dv) OVER f) END, 6) AS dolvol_22d, round(CASE WHEN k AND count(ldv) OVER f >= 5 THEN stddev_samp(ldv) OVER f END, 6) AS std_dolvol,
 round(CASE WHEN k AND count(ill) OVER f >= 15 THEN avg(ill) OVER f END, 10) AS ill_amihud, round(CASE WHEN k THEN avg(sp) OVER f END, 6) AS baspread_hl, round(CASE WHEN k THEN avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0 END) OVER f END, 6) AS zerotrade FROM (SELECT *, count(*) OVER f >= 15 AS k FROM c WINDOW f AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)) WINDOW f AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)""")
def x14_volume_characteristics(spark, sf):
    got = chars.volume_characteristics(shared(spark, sf, _BARS_TEXT))
    return got.select("ticker", "d", *[rounded(c, c, 10 if c == "ill_amihud" else 6) for c in chars.VOLUME])


@query(f"{_CHARS} SELECT d, count(*) FILTER (g >= 0.7 - 1e-12) AS good, count(*) AS total, count(*) FILTER (g >= 0.7 - 1e-12) >= 2 AS valid FROM (SELECT d, ((m1 IS NOT NULL)::INT + (m6 IS NOT NULL)::INT + (m12 IS NOT NULL)::INT + (ch IS NOT NULL)::INT) / 4 AS g FROM q) GROUP BY d")
def x17_coverage_gate(spark, sf):
    """Days on which at least two series have 70 per cent of four features."""
    got = chars.price_characteristics(prices(spark, sf), "N")
    return chars.covered(got, ["d"], ["mom_1m_1m", "mom_6m_1m", "mom_12m_1m", "chmom"], 2)


@query("SELECT month, count(*) AS n, CASE WHEN k <= greatest(1, floor(n0 * 0.2 + 1e-9)) THEN 'val' ELSE 'train' END AS part FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, dense_rank() OVER (ORDER BY date_trunc('month', o_orderdate) DESC) AS k FROM orders), (SELECT count(DISTINCT date_trunc('month', o_orderdate)) AS n0 FROM orders) GROUP BY month, k, n0")
def x19_recent_dates(spark, sf):
    rows = shared(spark, sf, "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM {orders}")
    return chars.recent_split(rows, "month").groupBy("month", "part").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT d, row_number() OVER (ORDER BY d) AS r FROM (SELECT DISTINCT d FROM {_PANEL})), a AS (SELECT DISTINCT CAST(date_trunc('quarter', d) AS DATE) AS at FROM c), l AS (SELECT at, max(r) AS l FROM a JOIN c ON c.d < at GROUP BY at HAVING max(r) >= 274),
 w AS (SELECT at, ticker, px, x.d FROM l JOIN c x ON x.r > l - 273 AND x.r <= l - 21 JOIN {_PANEL} p ON p.d = x.d)
 SELECT at, ticker, round(max_by(px, d) / min_by(px, d) - 1, 6) AS score FROM w GROUP BY at, ticker HAVING count(*) >= 40""")
def x22_skipped_momentum(spark, sf):
    """The year's return that ends a month before each quarter, by each ticker's own first and last price."""
    panel = _panel(spark, sf)
    at = panel.select(F.trunc("d", "quarter").alias("at")).distinct()
    return chars.skipped_momentum(panel, at, least=40).select("at", "ticker", r6("score", "score"))


_WINDOWS = {"crash": ("1997-07-01", "1997-12-31"), "all": ("1990-01-01", "2010-01-01")}
_MASKS = "(VALUES ('full'), ('pre_1998'), ('post_1998'), ('ex_crash'), ('ex_all')) k(mask)"
_KEEP = "CASE mask WHEN 'full' THEN true WHEN 'pre_1998' THEN d < DATE '1998-06-01' WHEN 'post_1998' THEN d >= DATE '1998-06-01' WHEN 'ex_crash' THEN NOT (d BETWEEN DATE '1997-07-01' AND DATE '1997-12-31') ELSE NOT (d BETWEEN DATE '1990-01-01' AND DATE '2010-01-01') END"


@query(f"SELECT ticker, mask, count(*) AS n, round(avg(ret - bench), 6) AS excess FROM {PAIRS}, {_MASKS} WHERE {_KEEP} GROUP BY 1, 2")
def p13_p15_masked_pairs(spark, sf):
    """Both returns of a pair under each mask, in one pass."""
    got = chars.masked(pairs(spark, sf), chars.regime_masks("d", "1998-06-01", _WINDOWS))
    return got.groupBy("ticker", "mask").agg(F.count("*").alias("n"), r6(F.avg(F.col("ret") - F.col("bench")), "excess"))


@query(f"SELECT ticker, mask, count(*) AS n_full, count(*) FILTER ({_KEEP}) AS n_kept, round(count(*) FILTER ({_KEEP}) / count(*), 6) AS fraction, round(count(*) FILTER ({_KEEP}) / 252, 6) AS years, min(d) FILTER ({_KEEP}) AS first, max(d) FILTER ({_KEEP}) AS last FROM {PAIRS}, {_MASKS} GROUP BY 1, 2")
def p14_mask_coverage(spark, sf):
    got = chars.mask_coverage(pairs(spark, sf), ["ticker"], "d", chars.regime_masks("d", "1998-06-01", _WINDOWS))
    return got.select("ticker", "mask", "n_full", "n_kept", r6("fraction", "fraction"), r6("years", "years"), "first", "last")


@query(f"SELECT ticker, d, round(ret - 3.5 * 12 / 10000 / 252, 9) AS ret FROM {PAIRS}")
def t41_commission_drag(spark, sf):
    return pairs(spark, sf).select("ticker", "d", rounded(chars.commission_drag(F.col("ret"), 3.5, 12.0), "ret", 9))


def _classes(spark, sf):
    t = F.col("ticker")
    have = _panel(spark, sf).select(F.trunc("d", "month").alias("month"), "ticker").distinct()
    return have, _panel(spark, sf).select("ticker").distinct().select("ticker", F.concat(F.lit("c"), t % 3).alias("cls"), ((t * 7) % 10).cast("int").alias("rank"))


_HAVE = f"(SELECT DISTINCT CAST(date_trunc('month', d) AS DATE) AS month, ticker, 'c' || ticker % 3 AS cls, ticker * 7 % 10 AS rank FROM {_PANEL})"


@query(f"SELECT month, cls, arg_min(ticker, rank * 1000 + ticker) AS ticker FROM {_HAVE} GROUP BY 1, 2")
def k5_representatives(spark, sf):
    have, order = _classes(spark, sf)
    return chars.representatives(have, order, ["month"])


@query(f"SELECT month, cls, string_agg(ticker, ',' ORDER BY rank, ticker) AS tickers FROM {_HAVE} GROUP BY 1, 2")
def k6_available_by_class(spark, sf):
    have, order = _classes(spark, sf)
    return chars.available_by_class(have, order, ["month"]).withColumn("tickers", F.array_join(F.transform("tickers", lambda t: t.cast("string")), ","))
