"""Company figures as they were known: filings to quarters, trailing sums, ratios and cross-sectional scores.

Facts are long rows (ticker, taxonomy, concept, unit, start_d, end_d, val, filed, form), decisions are rows (ticker, at). All tickers,
aliases and decisions go through each step together; a filing meets only the decisions at which it is the known one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.saved import saved
from .asof import latest_filed

# Names under which filers report a figure, best first.
ALIASES = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet", "SalesRevenueGoodsNet"],
    "cogs": ["CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold"],
    "gross_profit": ["GrossProfit"],
    "operating_income": ["OperatingIncomeLoss"],
    "net_income": ["NetIncomeLoss"],
    "assets": ["Assets"],
    "liabilities": ["Liabilities"],
    "equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "cash": ["CashAndCashEquivalentsAtCarryingValue", "Cash"],
    "long_term_debt": ["LongTermDebtNoncurrent", "LongTermDebt"],
    "short_term_debt": ["ShortTermBorrowings", "DebtCurrent"],
    "assets_current": ["AssetsCurrent"],
    "liabilities_current": ["LiabilitiesCurrent"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities"],
    "shares_outstanding": ["CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding"],
}
FLOWS = ("net_income", "revenue", "gross_profit", "operating_income", "operating_cash_flow")
STOCKS = {
    "total_assets": "assets", "total_liabilities": "liabilities", "stockholders_equity": "equity", "cash": "cash", "long_term_debt": "long_term_debt", "short_term_debt": "short_term_debt",
    "current_assets": "assets_current", "current_liabilities": "liabilities_current", "shares_outstanding": "shares_outstanding",
}
KEY = ["ticker", "alias"]


def by_alias(facts: DataFrame) -> DataFrame:
    """All filings of each alias, restatements kept: (ticker, alias, start_d, end_d, val, filed, form).

    Amounts count in USD under us-gaap; shares under dei, or under us-gaap for a ticker and concept without any.
    """
    names = [(a, c) for a, concepts in ALIASES.items() for c in concepts]
    table = facts.sparkSession.createDataFrame(names, "alias string, concept string")
    met = facts.join(F.broadcast(table), "concept").repartition("ticker")  # dealt once: the steps to quarters and sums stay in a ticker's task
    shares = F.col("alias") == "shares_outstanding"
    dei = F.max((F.col("taxonomy") == "dei").cast("int")).over(W.partitionBy("ticker", "concept")) == 1
    kept = met.where(F.when(shares, F.col("unit") == "shares").otherwise((F.col("unit") == "USD") & (F.col("taxonomy") == "us-gaap")))
    kept = kept.withColumn("_dei", dei).where(~shares | (F.col("_dei") & (F.col("taxonomy") == "dei")) | (~F.col("_dei") & (F.col("taxonomy") == "us-gaap")))
    return kept.select("ticker", "alias", "start_d", "end_d", "val", "filed", "form")


def as_known(filings: DataFrame, decisions: DataFrame) -> DataFrame:
    """(ticker, at, alias, start_d, end_d, val, filed, form): for each period end the newest filing before the decision."""
    met = latest_filed(filings.withColumnRenamed("ticker", "_t"), decisions.withColumnRenamed("ticker", "_t"), ["_t"], "at", ["alias"], "end_d")
    return met.withColumnRenamed("_t", "ticker")


def quarterise(known: DataFrame) -> DataFrame:
    """(ticker, at, alias, start_d, end_d, val, filed): pure quarters out of quarters, cumulative and annual figures.

    Each year is taken apart by what its filer reports beside the annual figure: a first quarter with two more (the fourth is what is
    left), with half-year and nine-month sums (differences), or with three more. Other years give nothing. Quarters
    after the last annual figure count as they are.
    """
    group = ["ticker", "alias", "at"]
    days = F.datediff("end_d", "start_d")
    rows = known.select(*group, "start_d", "end_d", "val", "filed", F.when(days > 300, "annual").when(days.between(60, 100), "pure").when(days.between(101, 300), "sum").alias("kind")).where("kind is not null")
    annual = F.col("kind") == "annual"
    order = W.partitionBy(*group).orderBy("start_d", (~annual).cast("int"), "end_d").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("y", F.last(F.when(annual, F.struct("start_d", "end_d", "val", "filed")), ignorenulls=True).over(order))
    rows = rows.withColumn("last_annual", F.max(F.when(annual, F.col("end_d"))).over(W.partitionBy(*group)))
    part = F.struct("end_d", "start_d", "val", "filed")
    first = (F.col("kind") == "pure") & (F.col("start_d") == F.col("y.start_d")) & (F.col("end_d") < F.col("y.end_d"))
    later = (F.col("kind") == "pure") & (F.col("start_d") > F.col("y.start_d")) & (F.col("end_d") <= F.col("y.end_d"))
    sums = (F.col("kind") == "sum") & (F.col("start_d") == F.col("y.start_d")) & (F.col("end_d") < F.col("y.end_d"))
    loose = (F.col("kind") == "pure") & (F.col("last_annual").isNull() | (F.col("end_d") > F.col("last_annual")))
    listed = lambda c: F.collect_list(F.when(c, part))
    # quarters after the last annual figure come along with the year before them, so that the rows are made once
    years = rows.groupBy(*group, "y").agg(F.array_sort(listed(first)).alias("q1"), F.array_sort(listed(later)).alias("pure"), F.array_sort(listed(sums)).alias("sums"), listed(loose).alias("loose"))
    q1, made = F.get("q1", F.lit(0)), lambda end, start, val, filed: F.struct(end.alias("end_d"), start.alias("start_d"), val.alias("val"), filed.alias("filed"))
    spent = F.aggregate("pure", q1["val"], lambda s, p: s + p["val"])
    rest = made(F.col("y.end_d"), F.array_max(F.transform("pure", lambda p: p["end_d"])), F.col("y.val") - spent, F.col("y.filed"))
    half, nine = F.get("sums", F.lit(0)), F.get("sums", F.lit(1))
    steps = F.array(q1, made(half["end_d"], q1["end_d"], half["val"] - q1["val"], half["filed"]), made(nine["end_d"], half["end_d"], nine["val"] - half["val"], nine["filed"]), made(F.col("y.end_d"), nine["end_d"], F.col("y.val") - nine["val"], F.col("y.filed")))
    n_pure, n_sums, one = F.size("pure"), F.size("sums"), F.size("q1") == 1
    quarters = F.when(one & (n_pure == 2) & (n_sums == 0), F.concat("q1", "pure", F.array(rest))).when(one & (n_pure == 0) & (n_sums == 2), steps).when(one & (n_pure == 3) & (n_sums == 0), F.concat("q1", "pure"))
    both = years.select(*group, F.inline(F.when(quarters.isNull(), F.col("loose")).otherwise(F.concat(quarters, "loose"))))
    both = both.withColumn("_n", F.row_number().over(W.partitionBy(*group, "end_d").orderBy(F.desc("filed"), F.desc("val")))).where("_n = 1")
    return both.select(*group, "start_d", "end_d", "val", "filed")


def trailing_sums(quarters: DataFrame, n: int = 4) -> DataFrame:
    """(ticker, at, alias, val): the sum of the last n quarters, only where there are n."""
    group = ["ticker", "at", "alias"]
    last = quarters.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("end_d")))).where(F.col("_n") <= n)
    return last.groupBy(*group).agg(F.sum("val").alias("val"), F.count("*").alias("k")).where(F.col("k") == n).drop("k")


def _last_known(filings: DataFrame, decisions: DataFrame, parts: int | None = None) -> tuple[DataFrame, dict[str, dict[str, Column]]]:
    """(ticker, at, a column an alias): what each alias showed last before a decision, and each alias's val, filed and newest as expressions of it.

    A filing counts once, for the first decision after it, and decisions then take the best of those before: a ticker has a row a
    decision there, not one for each period that is known at it.
    """
    rank = {a: f"_a{k}" for k, a in enumerate(ALIASES)}
    event = filings.where("filed is not null").select("ticker", F.col("filed").alias("_t"), F.lit(1).alias("_kind"), "alias", F.struct("end_d", "filed", "val").alias("_v"))
    asked = decisions.select("ticker", "at").where("at is not null").distinct()
    asks = asked.select("ticker", F.col("at").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("alias"), F.lit(None).cast(event.schema["_v"].dataType).alias("_v"))
    # a decision sorts before filings of its day, so these belong to the next one
    after = W.partitionBy("ticker").orderBy(F.desc("_t"), F.desc("_kind")).rowsBetween(W.unboundedPreceding, 0)
    slotted = (_dealt(event.unionByName(asks), parts) if parts else event.unionByName(asks)).withColumn("at", F.last(F.when(F.col("_kind") == 0, F.col("_t")), ignorenulls=True).over(after)).where("at is not null")
    mine = lambda a: F.when(F.col("alias") == a, F.col("_v"))
    each = slotted.groupBy("ticker", "at").agg(*[F.struct(F.max(mine(a)).alias("v"), F.max(mine(a)["filed"]).alias("n")).alias(c) for a, c in rank.items()])
    upto = W.partitionBy("ticker").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    best = each.select("ticker", "at", *[F.struct(F.max(f"{c}.v").over(upto).alias("v"), F.max(f"{c}.n").over(upto).alias("n")).alias(c) for c in rank.values()])
    dated = lambda c, x: F.when(F.col(f"{c}.v.end_d").isNotNull(), F.col(f"{c}.v.{x}"))
    return best, {a: {"val": dated(c, "val"), "filed": dated(c, "filed"), "newest": F.col(f"{c}.n")} for a, c in rank.items()}


def latest_values(filings: DataFrame, decisions: DataFrame) -> DataFrame:
    """(ticker, at, alias, val, filed, newest): the value of each alias's latest period known at a decision, as filed last, and its filing; newest: the alias's last filing."""
    best, shown = _last_known(filings, decisions)
    rows = F.array(*[F.struct(F.lit(a).alias("alias"), c["val"].alias("val"), c["filed"].alias("filed"), c["newest"].alias("newest")) for a, c in shown.items()])
    every = best.select("ticker", "at", F.inline(rows)).where("newest is not null")
    return decisions.select("ticker", "at").join(every, ["ticker", "at"])


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


#: A task of the steps from filings to figures takes the filings of so many tickers that their pairs with decisions are about this many.
PAIRS = 250_000


def _parts(filings: DataFrame, decisions: DataFrame) -> int | None:
    """In how many parts to deal filings and decisions by ticker; None: as Spark likes. Both are saved tables.

    The steps that follow keep a ticker in its task and make a row of each filing and decision in several sorts. Left to itself
    Spark joins parts up by the compressed bytes that go into the task.
    """
    n = filings.agg(F.count("*").alias("rows"), F.approx_count_distinct("ticker").alias("tickers")).first()
    pairs = n["rows"] * max(1, -(-decisions.count() // max(1, n["tickers"])))
    return max(-(-pairs // PAIRS), int(filings.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if pairs > PAIRS else None


def _dealt(rows: DataFrame, parts: int | None) -> DataFrame:
    return rows.repartition(parts, "ticker") if parts else rows.repartition("ticker")


def metrics(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row for each decision: trailing sums, balances, ratios and the filing date of the latest income. Null wherever a part is missing."""
    filings = saved(by_alias(facts))  # read for flows and for balances
    decisions = saved(decisions.select("ticker", "at"))  # read for flows, for balances and for the rows themselves
    parts = _parts(filings, decisions)
    sums = trailing_sums(quarterise(as_known(_dealt(filings.where(F.col("alias").isin(*FLOWS)), parts), decisions)))
    flows = sums.groupBy("ticker", "at").agg(*[F.max(F.when(F.col("alias") == a, F.col("val"))).alias(f"ttm_{a}") for a in FLOWS])
    best, shown = _last_known(filings.where(F.col("alias").isin("net_income", *STOCKS.values())), decisions, parts)
    stocks = best.select("ticker", "at", *[shown[a]["val"].alias(name) for name, a in STOCKS.items()], shown["net_income"]["filed"].alias("latest_filing"))
    got = decisions.join(flows, ["ticker", "at"], "left").join(stocks, ["ticker", "at"], "left")
    c = F.col
    debt = F.when(c("long_term_debt").isNotNull() | c("short_term_debt").isNotNull(), F.coalesce("long_term_debt", F.lit(0.0)) + F.coalesce("short_term_debt", F.lit(0.0)))
    return got.withColumns({
        "gross_margin_ttm": _ratio(c("ttm_gross_profit"), c("ttm_revenue")), "net_margin_ttm": _ratio(c("ttm_net_income"), c("ttm_revenue")), "operating_margin_ttm": _ratio(c("ttm_operating_income"), c("ttm_revenue")),
        "roe_ttm": _ratio(c("ttm_net_income"), c("stockholders_equity")), "roa_ttm": _ratio(c("ttm_net_income"), c("total_assets")), "debt_to_equity": _ratio(debt, c("stockholders_equity")),
        "current_ratio": _ratio(c("current_assets"), c("current_liabilities")), "earnings_yield_on_assets": _ratio(c("ttm_operating_income"), c("total_assets")),
        "accruals_ratio": _ratio(c("ttm_net_income") - c("ttm_operating_cash_flow"), c("total_assets")),
    })


FLAGS = ("p1", "p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9")


def f_scores(facts: DataFrame, decisions: DataFrame, days: int = 365) -> DataFrame:
    """(ticker, at, p1 ... p9, score) of figures at a decision against those `days` earlier; a null flag voids the score."""
    earlier = decisions.select("ticker", F.date_sub("at", days).alias("at"))
    every = saved(metrics(facts, decisions.select("ticker", "at").unionByName(earlier).distinct()))  # now and a year ago
    now = decisions.select("ticker", "at").join(every, ["ticker", "at"])
    past = every.select("ticker", F.date_add("at", days).alias("at"), *[F.col(c).alias(f"o_{c}") for c in ("roa_ttm", "debt_to_equity", "current_ratio", "shares_outstanding", "gross_margin_ttm", "ttm_revenue", "total_assets")])
    met, c = now.join(past, ["ticker", "at"]), F.col
    tests = [
        c("roa_ttm") > 0, c("ttm_operating_cash_flow") > 0, c("roa_ttm") > c("o_roa_ttm"), c("ttm_operating_cash_flow") > c("ttm_net_income"), c("debt_to_equity") < c("o_debt_to_equity"),
        c("current_ratio") > c("o_current_ratio"), c("shares_outstanding") <= c("o_shares_outstanding"), c("gross_margin_ttm") > c("o_gross_margin_ttm"),
        _ratio(c("ttm_revenue"), c("total_assets")) > _ratio(c("o_ttm_revenue"), c("o_total_assets")),
    ]
    flags = [t.cast("int").alias(p) for t, p in zip(tests, FLAGS)]
    return met.select("ticker", "at", *flags).withColumn("score", sum((F.col(p) for p in FLAGS[1:]), F.col("p1")))


def zscore(x: Column, by: list[str]) -> Column:
    """(x - mean) / sample deviation of a date's non-null values; 0 where they do not vary, null where x is."""
    w = W.partitionBy(*by)
    sd = F.stddev_samp(x).over(w)
    return F.when(x.isNotNull(), F.when(sd > 0, (x - F.avg(x).over(w)) / sd).otherwise(0.0))


def valuations(figures: DataFrame, price: str = "px") -> DataFrame:
    """figures (with a price) with earnings yield, and earnings, sales and book to market value; null without shares or a price above 0."""
    c = F.col
    cap = F.when((c("shares_outstanding") > 0) & (c(price) > 0), c("shares_outstanding") * c(price))
    return figures.withColumns({"ep": c("ttm_net_income") / cap, "sp": c("ttm_revenue") / cap, "bm": F.when(c("stockholders_equity") > 0, c("stockholders_equity") / cap), "gpa": F.when(c("total_assets") > 0, c("ttm_gross_profit") / c("total_assets"))})


def magic_formula(figures: DataFrame) -> DataFrame:
    """(ticker, at, score): minus the sum of a date's ranks by operating income over assets, and over assets without cash; equal values share the best rank."""
    c = F.col
    rows = figures.withColumn("invested", c("total_assets") - F.coalesce("cash", F.lit(0.0))).where("ttm_operating_income is not null and total_assets > 0 and invested > 0")
    rank = lambda x: F.rank().over(W.partitionBy("at").orderBy(F.desc(x)))
    rows = rows.withColumn("ey", c("ttm_operating_income") / c("total_assets")).withColumn("roic", c("ttm_operating_income") / c("invested"))
    return rows.select("ticker", "at", (-(rank("ey") + rank("roic"))).alias("score"))


def composite(figures: DataFrame, names: list[str], least: int) -> DataFrame:
    """(ticker, at, score): mean of a date's z-scores of so many figures, for tickers that have `least` of them."""
    z = figures.select("ticker", "at", F.array(*[zscore(F.col(n), ["at"]) for n in names]).alias("z"))
    there = F.filter("z", lambda x: x.isNotNull())
    return z.where(F.size(there) >= least).select("ticker", "at", (F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there)).alias("score"))


def delisted_prices(prices: DataFrame, delistings: DataFrame) -> DataFrame:
    """(ticker, d, px) with terminal prices: on the last trading day of any ticker up to the delisting day, the price before times 1 + return; nothing after.

    The calendar is that of all prices; a ticker without an earlier price keeps its own. Rows are kept, prices after the end are null.
    """
    kind = prices.schema["ticker"].dataType.simpleString()
    days = prices.select("d").distinct().withColumn("_k", F.lit(0))
    ends = delistings.select("ticker", F.col("delist_date").alias("_dd"), F.col("delist_return").alias("_dr"), F.lit(0).alias("_k"))
    # one window over the calendar and the few delistings
    both = days.select("_k", F.col("d").alias("_t"), F.lit(0).alias("_o"), "d", F.lit(None).cast(f"struct<ticker:{kind},_dr:double>").alias("_row"))
    both = both.unionByName(ends.select("_k", F.col("_dd").alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast("date").alias("d"), F.struct(F.col("ticker").cast(kind).alias("ticker"), F.col("_dr").cast("double").alias("_dr")).alias("_row")))
    snapped = both.withColumn("_end", F.last("d", ignorenulls=True).over(W.partitionBy("_k").orderBy("_t", "_o").rowsBetween(W.unboundedPreceding, 0))).where("_row is not null and _end is not null").select("_row.ticker", "_row._dr", "_end")
    gone = prices.select("ticker").distinct().join(F.broadcast(snapped), "ticker")
    grid = prices.join(gone, "ticker", "left")
    missing = gone.join(prices.select("ticker", F.col("d").alias("_end"), F.lit(1).alias("_has")), ["ticker", "_end"], "left").where("_has is null").select("ticker", F.col("_end").alias("d"), F.lit(None).cast("double").alias("px"), "_dr", "_end")
    grid = grid.select("ticker", "d", "px", "_dr", "_end").unionByName(missing)
    before = F.last(F.when(F.col("d") < F.col("_end"), F.col("px")), ignorenulls=True).over(W.partitionBy("ticker").orderBy("d").rowsBetween(W.unboundedPreceding, -1))
    grid = grid.withColumn("_before", before).withColumn("_any", F.max(F.when(F.col("d") < F.col("_end"), F.col("px"))).over(W.partitionBy("ticker")))
    px = F.when(F.col("_end").isNull() | F.col("_any").isNull() | (F.col("d") < F.col("_end")), F.col("px")).when(F.col("d") == F.col("_end"), F.col("_before") * (1 + F.col("_dr")))
    return grid.select("ticker", "d", px.alias("px"))
