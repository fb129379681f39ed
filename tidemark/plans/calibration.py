"""Registered queries of calibrators and fold runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import betting, calibrate, evaluate, experiment, splits
from .queries import query
from .views import PROBABILITIES, probabilities, r6

#: Rows of the folds: probabilities in fiftieths, three classes with probabilities q, a gap of ratings and who won or drew.
_BASE = f"""(SELECT *, [0.6 * p, 0.2 * p + 0.1, 1 - 0.6 * p - (0.2 * p + 0.1)] AS q, CASE WHEN u < 20 + 35 * p THEN 0 WHEN u < 60 + 10 * p THEN 1 ELSE 2 END AS c,
 CASE WHEN u < 28 * exp(-pow((p - 0.5) * 800 / 180, 2)) THEN 1 ELSE 0 END AS drawn, (p - 0.5) * 800 AS gap FROM (SELECT id, yr, d, y, grp, fair, floor(p * 50) / 50 AS p, (id * 7919) % 100 AS u FROM {PROBABILITIES}))"""
_WF = f"""(SELECT eval AS fold, CASE WHEN yr = eval THEN 'test' WHEN nth <= floor(g.n * 0.8 + 1e-9) THEN 'train' ELSE 'cal' END AS part, o.* FROM (SELECT *, row_number() OVER (ORDER BY yr, d, id) AS nth FROM {_BASE}) o
 JOIN (SELECT yr AS eval, sum(n) OVER (ORDER BY yr) - n AS n, yr - min(yr) OVER () AS since FROM (SELECT yr, count(*) AS n FROM {PROBABILITIES} GROUP BY yr)) g ON o.yr <= g.eval AND g.since >= 3 AND g.n >= 50)"""


def _folds(spark, sf):
    rows = probabilities(spark, sf).select("id", "yr", "d", "y", "grp", "fair", (F.floor(F.col("p") * 50) / 50).alias("p"), (F.col("id") * 7919 % 100).alias("u"))
    p, u = F.col("p"), F.col("u")
    q = F.array(0.6 * p, 0.2 * p + 0.1, 1 - 0.6 * p - (0.2 * p + 0.1))
    c = F.when(u < 20 + 35 * p, 0).when(u < 60 + 10 * p, 1).otherwise(2)
    gap = (p - 0.5) * 800
    drawn = F.when(u < 28 * F.exp(-F.pow(gap / 180, F.lit(2.0))), 1).otherwise(0)
    return splits.walk_forward(rows.select("*", q.alias("q"), c.alias("c"), drawn.alias("drawn"), gap.alias("gap")), "yr", "d", "id", 3).withColumnRenamed("eval", "fold")


def _steps(rows: str, by: str, y: str) -> str:
    """Isotonic values at every point by the largest least mean: CTEs x, r, j, m and f (by, p, v)."""
    return f"""x AS (SELECT {by}, p, count(*)::DOUBLE AS n, sum({y})::DOUBLE AS s FROM {rows} GROUP BY ALL),
 r AS (SELECT *, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM x WINDOW w AS (PARTITION BY {by} ORDER BY p)),
 j AS (SELECT a.* EXCLUDE (p, n, s, cn, cs), a.p AS lo, b.p AS hi, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS v FROM r a JOIN r b USING ({by}) WHERE b.p >= a.p),
 m AS (SELECT {by}, p, lo, min(v) AS v FROM r JOIN j USING ({by}) WHERE lo <= p AND p <= hi GROUP BY ALL),
 f AS (SELECT {by}, p, max(v) AS v FROM m GROUP BY ALL)"""


def _at(rows: str, by: str) -> str:
    """(by, p, v) of f at the values p of rows: on a line between points, the nearest point's outside."""
    return f"""(SELECT {by}, p, CASE WHEN a IS NULL THEN w WHEN b IS NULL OR a = b THEN v ELSE v + (w - v) * (p - a) / (b - a) END AS v FROM (
 SELECT {by}, t.p, max(f.p) FILTER (f.p <= t.p) AS a, min(f.p) FILTER (f.p >= t.p) AS b, max_by(f.v, f.p) FILTER (f.p <= t.p) AS v, min_by(f.v, f.p) FILTER (f.p >= t.p) AS w
 FROM (SELECT DISTINCT {by}, p FROM {rows}) t JOIN f USING ({by}) GROUP BY ALL))"""


@query(f"WITH w AS {_WF}, {_steps('(SELECT * FROM w WHERE part = ' + repr('cal') + ')', 'fold', 'y')} SELECT fold, id, round(least(greatest(v, 0.03), 0.97), 6) AS q FROM (SELECT fold, id, p FROM w WHERE part = 'test') JOIN {_at('(SELECT * FROM w WHERE part = ' + repr('test') + ')', 'fold')} USING (fold, p)")
def v6_isotonic(spark, sf):
    rows = _folds(spark, sf)
    fit = calibrate.isotonic(rows.where("part = 'cal'"), ["fold"])
    got = calibrate.apply_isotonic(rows.where("part = 'test'").select("fold", "id", "p"), fit, ["fold"], "p", "q")
    return got.select("fold", "id", r6(calibrate.clipped(F.col("q")), "q"))


_LOGIT = """x AS (SELECT fold, {x} AS x, count(*)::DOUBLE AS n, sum({y})::DOUBLE AS s FROM w WHERE part = '{part}' GROUP BY ALL),
 f(step, fold, a, b) AS (SELECT 0, fold, 0::DOUBLE, 0::DOUBLE FROM (SELECT DISTINCT fold FROM x) UNION ALL
  SELECT step + 1, fold, a + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01), b + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01) FROM (
   SELECT step, fold, a, b, sum(s - n * pr) AS g0, sum((s - n * pr) * x) - b AS g1, sum(n * pr * (1 - pr)) AS h00, sum(n * pr * (1 - pr) * x) AS h01, sum(n * pr * (1 - pr) * x * x) + 1 AS h11
   FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS pr FROM f JOIN x USING (fold)) WHERE step < 15 GROUP BY step, fold, a, b))"""


@query(f"WITH RECURSIVE w AS {_WF}, {_LOGIT.format(x='p', y='y', part='cal')} SELECT fold, id, round(least(greatest(1 / (1 + exp(-(a + b * p))), 0.03), 0.97), 6) AS q FROM w JOIN f USING (fold) WHERE part = 'test' AND step = 15")
def v7_platt(spark, sf):
    """A logistic curve with a unit penalty on its slope."""
    rows = _folds(spark, sf)
    fit = calibrate.fitted(rows.where("part = 'cal'"), ["fold"], ["p"], ridge=1.0)
    got = rows.where("part = 'test'").select("fold", "id", "p").join(F.broadcast(fit.select("fold", "coef")), "fold")  # a row a fold
    return got.select("fold", "id", r6(calibrate.clipped(calibrate.sigmoid(calibrate.linear(F.col("coef"), [F.col("p")]))), "q"))


_TEMPER = """x AS (SELECT fold, [ln(v) FOR v IN q] AS l, c, count(*)::DOUBLE AS n FROM w WHERE part = 'cal' GROUP BY ALL),
 e AS (SELECT fold, l, n, l[c + 1] AS t FROM x),
 f(step, fold, k) AS (SELECT 0, fold, 1::DOUBLE FROM (SELECT DISTINCT fold FROM x) UNION ALL
  SELECT step + 1, fold, k - sum(n * (m - t)) / sum(n * (mm - m * m)) FROM (
   SELECT step, fold, k, n, t, list_sum([v * exp(k * v) FOR v IN l]) / list_sum([exp(k * v) FOR v IN l]) AS m, list_sum([v * v * exp(k * v) FOR v IN l]) / list_sum([exp(k * v) FOR v IN l]) AS mm
   FROM f JOIN e USING (fold) WHERE step < 15) GROUP BY step, fold, k)"""


@query(f"WITH RECURSIVE w AS {_WF}, {_TEMPER} SELECT fold, sum(n)::BIGINT AS n, round(1 / k, 4) AS t, round(sum(n * (ln(list_sum([exp(k * v) FOR v IN l])) - k * t)) / sum(n), 6) AS loss FROM f JOIN e USING (fold) WHERE step = 15 GROUP BY fold, k")
def v8_temperature(spark, sf):
    from .views import rounded

    fit = calibrate.temperature(_folds(spark, sf).where("part = 'cal'"), ["fold"])
    return fit.select("fold", "n", rounded("t", "t", 4), r6("loss", "loss"))


@query(f"WITH RECURSIVE w AS {_WF}, {_TEMPER}, s AS (SELECT fold, id, [least(greatest(exp(k * ln(v)) / list_sum([exp(k * ln(z)) FOR z IN q]), 0.03), 0.97) FOR v IN q] AS s FROM w JOIN f USING (fold) WHERE part = 'test' AND step = 15) SELECT fold, id, round(s[1] / list_sum(s), 4) AS a, round(s[2] / list_sum(s), 4) AS b FROM s")
def y12_softened(spark, sf):
    from .views import rounded

    rows = _folds(spark, sf)
    fit = calibrate.temperature(rows.where("part = 'cal'"), ["fold"]).select("fold", "t")
    got = rows.where("part = 'test'").join(F.broadcast(fit), "fold")  # a row a fold
    got = got.select("fold", "id", calibrate.renormalised(calibrate.softened(F.col("q"), F.col("t"))).alias("s"))
    return got.select("fold", "id", rounded(F.col("s")[0], "a", 4), rounded(F.col("s")[1], "b", 4))


_CLASSES = "SELECT fold, part, id, z.k, q[z.k + 1] AS p, CASE WHEN c = z.k THEN 1 ELSE 0 END AS hit FROM w, (SELECT unnest(range(3)) AS k) z"


@query(f"WITH w AS {_WF}, z AS ({_CLASSES}), {_steps('(SELECT * FROM z WHERE part = ' + repr('cal') + ')', 'fold, k', 'hit')}, v AS (SELECT fold, id, k, least(greatest(v, 0.03), 0.97) AS v FROM (SELECT fold, id, k, p FROM z WHERE part = 'test') JOIN {_at('(SELECT * FROM z WHERE part = ' + repr('test') + ')', 'fold, k')} USING (fold, k, p)) SELECT fold, id, CAST(k AS INT) AS k, round(v / sum(v) OVER (PARTITION BY fold, id), 6) AS q FROM v")
def v9_isotonic_by_class(spark, sf):
    """One curve a class and fold in one job, each clipped, a row's classes summing to one."""
    rows = _folds(spark, sf)
    each = rows.select("fold", "part", "id", "c", F.posexplode("q").alias("k", "p")).withColumn("hit", (F.col("c") == F.col("k")).cast("int"))
    fit = calibrate.isotonic(each.where("part = 'cal'"), ["fold", "k"], "p", "hit")
    got = calibrate.apply_isotonic(each.where("part = 'test'").select("fold", "id", "k", "p"), fit, ["fold", "k"], "p", "v")
    whole = got.groupBy("fold", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("v"))
    return whole.select("fold", "id", F.posexplode(calibrate.renormalised(F.col("v"))).alias("k", "q")).select("fold", "id", "k", r6("q", "q"))


_CURVE = """x AS (SELECT fold, gap * gap / 10000 AS x, count(*)::DOUBLE AS n, sum(drawn)::DOUBLE AS s FROM w WHERE part <> 'test' GROUP BY ALL),
 f(step, fold, a, b) AS (SELECT 0, fold, ln(0.25), -0.25::DOUBLE FROM (SELECT DISTINCT fold FROM x) UNION ALL
  SELECT step + 1, fold, a + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01), b + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01) FROM (
   SELECT step, fold, a, b, sum(g) AS g0, sum(g * x) AS g1, sum(h) AS h00, sum(h * x) AS h01, sum(h * x * x) AS h11
   FROM (SELECT *, s - (n - s) * pr / (1 - pr) AS g, (n - s) * pr / ((1 - pr) * (1 - pr)) AS h FROM (SELECT *, exp(a + b * x) AS pr FROM f JOIN x USING (fold))) WHERE step < 25 GROUP BY step, fold, a, b))"""


@query(f"WITH RECURSIVE w AS {_WF}, {_CURVE} SELECT fold, (SELECT count(*) FROM w WHERE w.fold = f.fold AND part <> 'test') AS n, round(exp(a), 6) AS base, round(100 / sqrt(-b), 4) AS spread FROM f WHERE step = 25")
def v20_draw_curve(spark, sf):
    from .views import rounded

    fit = calibrate.draw_curve(_folds(spark, sf).where("part <> 'test'"), ["fold"], "gap", "drawn")
    return fit.select("fold", "n", r6("base", "base"), rounded("spread", "spread", 4))


_THREE = "least(greatest({v}, 0.02), 0.98)"


@query(f"""WITH RECURSIVE w AS {_WF}, {_CURVE}, p AS (SELECT fold, CASE WHEN drawn = 1 THEN 1 WHEN y = 1 THEN 0 ELSE 2 END AS c, exp(a + b * gap * gap / 10000) AS dr, 1 / (1 + pow(10, -gap / 400)) AS e FROM w JOIN f USING (fold) WHERE part = 'test' AND step = 25),
 s AS (SELECT fold, c, [{_THREE.format(v='e * (1 - dr)')}, {_THREE.format(v='dr')}, {_THREE.format(v='(1 - e) * (1 - dr)')}] AS s FROM p), t AS (SELECT fold, c, [v / list_sum(s) FOR v IN s] AS q FROM s)
 SELECT fold, count(*) AS n, round(-avg(ln(q[c + 1])), 6) AS log_loss, round(avg(CASE WHEN list_position(q, list_max(q)) = c + 1 THEN 1.0 ELSE 0 END), 6) AS accuracy FROM t GROUP BY fold""")
def y19_rating_only_folds(spark, sf):
    """Three-way probabilities from the gap alone, the draw curve fitted again for each fold on the rows before it."""
    rows = _folds(spark, sf)
    fit = calibrate.draw_curve(rows.where("part <> 'test'"), ["fold"], "gap", "drawn").select("fold", "base", "spread")
    met = rows.where("part = 'test'").join(F.broadcast(fit), "fold")  # a row a fold
    draw = F.col("base") * F.when(F.col("spread").isNull(), 1.0).otherwise(F.exp(-F.pow(F.col("gap") / F.col("spread"), F.lit(2.0))))
    e = 1 / (1 + F.pow(F.lit(10.0), -F.col("gap") / 400))
    q = calibrate.renormalised(F.array(e * (1 - draw), draw, (1 - e) * (1 - draw)), 0.02, 0.98)
    c = F.when(F.col("drawn") == 1, 1).when(F.col("y") == 1, 0).otherwise(2)
    return evaluate.class_scores(met.select("fold", c.alias("c"), q.alias("q")), ["fold"]).select("fold", "n", r6("log_loss", "log_loss"), r6("accuracy", "accuracy"))


_SLOPE = """f(step, {by}, a) AS (SELECT 0, {by}, 0::DOUBLE FROM (SELECT DISTINCT {by} FROM x) UNION ALL
  SELECT step + 1, {by}, a + sum((s - n * pr) * x) / sum(n * pr * (1 - pr) * x * x) FROM (SELECT *, 1 / (1 + exp(-a * x)) AS pr FROM f JOIN x USING ({by})) WHERE step < 15 GROUP BY step, {by}, a)"""


@query(f"""WITH RECURSIVE x AS (SELECT CAST(date_trunc('week', d) AS DATE) AS wk, gap AS x, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s FROM {_BASE} GROUP BY ALL),
 z AS (SELECT wk, sum(n) AS k, sum(s) / sum(n) AS rate FROM x GROUP BY wk), {_SLOPE.format(by='wk')} SELECT wk, k::BIGINT AS n, round(CASE WHEN k < 30 THEN 0 ELSE a END, 8) AS slope, round(rate, 6) AS rate FROM f JOIN z USING (wk) WHERE step = 15""")
def v21_gap_slope(spark, sf):
    from .views import rounded

    p = probabilities(spark, sf).select("y", F.date_trunc("week", "d").cast("date").alias("wk"), ((F.floor(F.col("p") * 50) / 50 - 0.5) * 800).alias("gap"))
    return calibrate.gap_slope(p, ["wk"], "gap", "y").select("wk", "n", rounded("slope", "slope", 8), r6("rate", "rate"))


@query(f"WITH RECURSIVE w AS {_WF}, x AS (SELECT fold, gap AS x, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s FROM w WHERE part <> 'test' GROUP BY ALL), {_SLOPE.format(by='fold')} SELECT fold, (SELECT sum(n)::BIGINT FROM x WHERE x.fold = f.fold) AS n, round(a, 8) AS slope FROM f WHERE step = 15")
def y20_slopes_before(spark, sf):
    from .views import rounded

    return calibrate.gap_slope(_folds(spark, sf).where("part <> 'test'"), ["fold"], "gap", "y").select("fold", "n", rounded("slope", "slope", 8))


_FEATURES = ["p", "fair"]


def _solved(train: str, rows: str, ridge: float, name: str = "f") -> str:
    """CTEs of a logistic regression on a, b of `train` by fold (Newton, ridge on slopes): x_, f (step, fold, w0, w1, w2); name is f."""
    det = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
    d0 = "(g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2))"
    d1 = "(h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02))"
    d2 = "(h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02))"
    return f"""{name}_x AS (SELECT fold, a, b, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s FROM {train} GROUP BY ALL),
 {name}(step, fold, w0, w1, w2) AS (SELECT 0, fold, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM (SELECT DISTINCT fold FROM {name}_x) UNION ALL
  SELECT step + 1, fold, w0 + {d0} / {det}, w1 + {d1} / {det}, w2 + {d2} / {det} FROM (
   SELECT step, fold, w0, w1, w2, sum(g) AS g0, sum(g * a) - {ridge} * w1 AS g1, sum(g * b) - {ridge} * w2 AS g2, sum(h) AS h00, sum(h * a) AS h01, sum(h * b) AS h02, sum(h * a * a) + {ridge} AS h11, sum(h * a * b) AS h12, sum(h * b * b) + {ridge} AS h22
   FROM (SELECT *, s - n * pr AS g, n * pr * (1 - pr) AS h FROM (SELECT *, 1 / (1 + exp(-(w0 + w1 * a + w2 * b))) AS pr FROM {name} JOIN {name}_x USING (fold)) WHERE step < 12) GROUP BY step, fold, w0, w1, w2))"""


_Z = """z AS (SELECT fold, part, id, y, (p - ma) / sa AS a, (fair - mb) / sb AS b FROM w JOIN (SELECT fold, avg(p) AS ma, stddev_samp(p) AS sa, avg(fair) AS mb, stddev_samp(fair) AS sb FROM w WHERE part = 'train' GROUP BY fold) USING (fold))"""
_RAW = f"{_Z}, {_solved('(SELECT * FROM z WHERE part = ' + repr('train') + ')', 'z', 1.0)}, r AS (SELECT fold, part, id, y, 1 / (1 + exp(-(w0 + w1 * a + w2 * b))) AS raw FROM z JOIN f USING (fold) WHERE part <> 'train' AND step = 12)"
_PLATT = """x AS (SELECT fold, raw AS x, 1::DOUBLE AS n, y::DOUBLE AS s FROM r WHERE part = 'cal'),
 c(step, fold, a, b) AS (SELECT 0, fold, 0::DOUBLE, 0::DOUBLE FROM (SELECT fold FROM x GROUP BY fold HAVING count(*) >= 11) UNION ALL
  SELECT step + 1, fold, a + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01), b + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01) FROM (
   SELECT step, fold, a, b, sum(s - n * pr) AS g0, sum((s - n * pr) * x) - b AS g1, sum(n * pr * (1 - pr)) AS h00, sum(n * pr * (1 - pr) * x) AS h01, sum(n * pr * (1 - pr) * x * x) + 1 AS h11
   FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS pr FROM c JOIN x USING (fold)) WHERE step < 12 GROUP BY step, fold, a, b)),
 o AS (SELECT fold, id, y, raw, least(greatest(coalesce(1 / (1 + exp(-(a + b * raw))), raw), 0.03), 0.97) AS p FROM r LEFT JOIN (SELECT * FROM c WHERE step = 12) USING (fold) WHERE part = 'test')"""
_CLIPPED = "o AS (SELECT fold, id, y, raw, least(greatest(raw, 0.03), 0.97) AS p FROM r WHERE part = 'test')"
_SCORES = "round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(pow(p - y, 2)), 6) AS brier"


def _model_rows(spark, sf):
    return probabilities(spark, sf).select("id", "yr", "d", "y", "p", "fair")


def _walk(spark, sf):
    return splits.walked(_model_rows(spark, sf), "yr", "d", "id", 3)


_FULL = _WF.replace("floor(p * 50) / 50 AS p", "p")


@query(f"WITH RECURSIVE w AS {_FULL}, {_RAW}, {_PLATT} SELECT fold, id, round(raw, 6) AS raw, round(p, 6) AS p FROM o")
def g13_folds(spark, sf):
    """Every test row of a walk forward by year: scaled, fitted and calibrated on earlier rows, the order of days guarded."""
    got = experiment.run(_walk(spark, sf), _FEATURES, "y", "id", method="platt", day="d")
    return got.select("fold", "id", r6("raw", "raw"), r6("p", "p"))


@query(f"WITH RECURSIVE w AS {_FULL}, {_RAW}, {_PLATT} SELECT fold, count(*) AS n, {_SCORES} FROM o GROUP BY GROUPING SETS ((fold), ())")
def g13_y41_pooled_scores(spark, sf):
    """Scores of each fold and of all test rows together: 80 per cent of the earlier rows train, the newest 20 calibrate."""
    got = experiment.summary(experiment.run(_walk(spark, sf), _FEATURES, "y", "id", method="platt", day="d"))
    return got.select("fold", "n", r6("log_loss", "log_loss"), r6("accuracy", "accuracy"), r6("brier", "brier"))


_SEASONS = "(SELECT f.yr AS fold, CASE WHEN o.yr = f.yr THEN 'test' {cal} ELSE 'train' END AS part, o.* FROM {p} o JOIN (SELECT DISTINCT yr, yr - (SELECT min(yr) FROM {p}) AS since FROM {p}) f ON {used})"
_LOO = _SEASONS.format(p=PROBABILITIES, cal="", used="true")


@query(f"WITH RECURSIVE w AS {_LOO}, {_RAW}, {_CLIPPED} SELECT fold, count(*) AS n, {_SCORES} FROM o GROUP BY GROUPING SETS ((fold), ())")
def v16_leave_one_season_out(spark, sf):
    rows = experiment.seasons(_model_rows(spark, sf), "yr", "leave_one_out")
    got = experiment.summary(experiment.run(rows, _FEATURES, "y", "id", method=None))
    return got.select("fold", "n", r6("log_loss", "log_loss"), r6("accuracy", "accuracy"), r6("brier", "brier"))


_PREVIOUS = _SEASONS.format(p=PROBABILITIES, cal="WHEN o.yr = f.yr - 1 THEN 'cal'", used="o.yr <= f.yr AND since >= 2")


@query(f"WITH RECURSIVE w AS {_PREVIOUS}, {_RAW}, {_PLATT} SELECT fold, count(*) AS n, {_SCORES} FROM o GROUP BY GROUPING SETS ((fold), ())")
def y32_one_season_backtests(spark, sf):
    """Seasons before the last train, the last one calibrates, the next is tested."""
    rows = experiment.seasons(_model_rows(spark, sf), "yr", "previous")
    got = experiment.summary(experiment.run(rows, _FEATURES, "y", "id", method="platt", day="d"))
    return got.select("fold", "n", r6("log_loss", "log_loss"), r6("accuracy", "accuracy"), r6("brier", "brier"))


_WINDOW = _SEASONS.format(p="{p}", cal="", used="o.yr <= f.yr AND o.yr >= f.yr - 2 AND since >= 2")
_SHUFFLED = f"(SELECT a.id, a.yr, a.d, a.p, a.fair, b.y FROM (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY id) AS i FROM {PROBABILITIES}) a JOIN (SELECT yr, y, row_number() OVER (PARTITION BY yr ORDER BY md5('7|1|' || id)) AS i FROM {PROBABILITIES}) b USING (yr, i))"


@query(f"WITH RECURSIVE w AS {_WINDOW.format(p=PROBABILITIES)}, {_RAW}, {_CLIPPED} SELECT fold, count(*) AS n, {_SCORES} FROM o GROUP BY GROUPING SETS ((fold), ())")
def y33_fixed_windows(spark, sf):
    """Only the last two seasons train."""
    rows = experiment.seasons(_model_rows(spark, sf), "yr", "expanding", width=2)
    got = experiment.summary(experiment.run(rows, _FEATURES, "y", "id", method=None, day="d"))
    return got.select("fold", "n", r6("log_loss", "log_loss"), r6("accuracy", "accuracy"), r6("brier", "brier"))


@query(f"WITH RECURSIVE w AS {_WINDOW.format(p=_SHUFFLED)}, {_RAW}, {_CLIPPED} SELECT fold, count(*) AS n, {_SCORES} FROM o GROUP BY GROUPING SETS ((fold), ())")
def y33_shuffled_labels(spark, sf):
    """The same with labels dealt anew inside each season: what a model finds where there is nothing."""
    rows = betting.shuffled(_model_rows(spark, sf), "y", ["yr"], "id", 1).drop("perm")
    got = experiment.summary(experiment.run(experiment.seasons(rows, "yr", "expanding", width=2), _FEATURES, "y", "id", method=None, day="d"))
    return got.select("fold", "n", r6("log_loss", "log_loss"), r6("accuracy", "accuracy"), r6("brier", "brier"))


_STACK = f"z AS (SELECT e.yr AS fold, CASE WHEN o.yr = e.yr THEN 'test' ELSE 'train' END AS part, id, y, p AS a, fair AS b FROM {PROBABILITIES} o JOIN (SELECT DISTINCT yr FROM {PROBABILITIES}) e ON o.yr <= e.yr AND e.yr > (SELECT min(yr) FROM {PROBABILITIES}))"


@query(f"WITH RECURSIVE {_STACK}, {_solved('(SELECT * FROM z WHERE part = ' + repr('train') + ')', 'z', 1.0)} SELECT fold, id, round(least(greatest(1 / (1 + exp(-(w0 + w1 * a + w2 * b))), 0.03), 0.97), 6) AS p FROM z JOIN f USING (fold) WHERE part = 'test' AND step = 12")
def v14_stacked(spark, sf):
    """Two probabilities as features of a logistic mix that is fitted on the folds before."""
    p = probabilities(spark, sf).select(F.col("yr").alias("fold"), "id", "y", "p", "fair")
    return experiment.stacked(p, "id", ["p", "fair"]).select("fold", "id", r6("p", "p"))


@query(f"""WITH s AS (SELECT id, yr, [p, fair, (p + fair) / 2, p * p] AS m FROM {PROBABILITIES}), t AS (SELECT *, list_avg(m) AS mean, sqrt(list_sum([pow(v - list_avg(m), 2) FOR v IN m]) / 4) AS std FROM s),
 c AS (SELECT quantile_cont(std, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM t WHERE yr < 1998) SELECT id, round(mean, 6) AS mean, round(std, 6) AS std, CAST(len(list_filter(cuts, lambda v: v <= std)) AS INT) AS quintile FROM t, c WHERE yr >= 1998""")
def v15_four_models(spark, sf):
    """Mean and spread of four models' probabilities, and the quintile of the spread by cuts of the training years."""
    m = probabilities(spark, sf).select("id", "yr", "p", "fair", ((F.col("p") + F.col("fair")) / 2).alias("mix"), (F.col("p") * F.col("p")).alias("square"))
    got = experiment.agreement(m.where("yr >= 1998"), ["p", "fair", "mix", "square"], m.where("yr < 1998"))
    return got.select("id", r6("mean", "mean"), r6("std", "std"), "quintile")


@query()
def v11_boosted_folds(spark, sf):
    """Boosted trees stopped by the calibration rows, calibrated by isotonic steps; importances come with the folds."""
    return experiment.summary(experiment.run(_walk(spark, sf), _FEATURES, "y", "id", experiment.boosted(maxIter=20), steps=[experiment.Step("mean", tuple(_FEATURES))], day="d"))


@query()
def x20_elastic_folds(spark, sf):
    """Elastic net: penalised sums of squares and absolute values."""
    return experiment.summary(experiment.run(_walk(spark, sf), _FEATURES, "y", "id", experiment.elastic(), day="d"))




def _three_features(spark, sf):
    rows = probabilities(spark, sf).select("id", "yr", "d", "y", "p", "fair", (F.col("id") * 31 % 101 / F.lit(101.0)).alias("noise"))
    return splits.walked(rows, "yr", "d", "id", 3)


def _without(name: str, a: str, b: str) -> str:
    """One configuration's test rows (config, y, p): a logistic regression of two scaled features, each 0 where it is left out."""
    z = f"z AS (SELECT fold, part, id, y, {a} AS a, {b} AS b FROM (SELECT fold, part, id, y, (p - ma) / sa AS p, (fair - mb) / sb AS f FROM w JOIN (SELECT fold, avg(p) AS ma, stddev_samp(p) AS sa, avg(fair) AS mb, stddev_samp(fair) AS sb FROM w WHERE part = 'train' GROUP BY fold) USING (fold)))"
    return f"SELECT * FROM (WITH RECURSIVE {z}, {_solved('(SELECT * FROM z WHERE part = ' + repr('train') + ')', 'z', 1.0)} SELECT {name} AS config, y, least(greatest(1 / (1 + exp(-(w0 + w1 * a + w2 * b))), 0.03), 0.97) AS p FROM z JOIN f USING (fold) WHERE part = 'test' AND step = 12)"


@query(f"""WITH w AS {_FULL}, s AS ({_without('NULL', 'p', 'f')} UNION ALL {_without("'fair'", 'p', '0')} UNION ALL {_without("'p'", '0', 'f')}),
 g AS (SELECT config, count(*) AS n, {_SCORES} FROM s GROUP BY config) SELECT config AS left_out, n, log_loss, accuracy, brier FROM g""")
def v18_y34_ablation(spark, sf):
    """The scores without each feature, all in one job."""
    got = experiment.ablation(_walk(spark, sf), "y", "id", {"p": ["p"], "fair": ["fair"]}, day="d")
    return got.select("left_out", "n", r6("log_loss", "log_loss"), r6("accuracy", "accuracy"), r6("brier", "brier"))


@query()
def v17_random_search(spark, sf):
    """24 drawn configurations of features and penalties, scored in one job, the best first."""
    got = experiment.search(_three_features(spark, sf), "y", "id", experiment.drawn_configs(["p", "fair", "noise"], 24), day="d")
    return got.select("config", "n", r6("log_loss", "log_loss"), r6("accuracy", "accuracy"), r6("brier", "brier")).orderBy("log_loss", "config")


@query()
def v19_forward_selection(spark, sf):
    got = experiment.forward_selection(_three_features(spark, sf), "y", "id", ["p", "fair", "noise"], day="d")
    return spark.createDataFrame([(k, f, round(loss, 6)) for k, (f, loss) in enumerate(got, 1)], "step int, feature string, log_loss double")
