"""Rules of figures, names and leverage as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Moneyline of the favourite at each point spread.
SPREADS = [(0.0, -105), (0.5, -108), (1.0, -120), (1.5, -125), (2.0, -134), (2.5, -142), (3.0, -155), (3.5, -165), (4.0, -180), (4.5, -195), (5.0, -210), (5.5, -230), (6.0, -250), (6.5, -275), (7.0, -300), (7.5, -330), (8.0, -360), (8.5, -400),
           (9.0, -450), (9.5, -520), (10.0, -600), (11.0, -780), (12.0, -990), (13.0, -1300), (14.0, -1800), (15.0, -2500), (17.0, -5000), (20.0, -10000)]
# Words that tell why a company left.
BANKRUPT = ("bankrupt", "chapter 11", "liquidat", "delist", "ceased trading", "dissolved", "insolven")
ACQUIRED = ("acquir", "merg", "bought", "taken private", "taken over", "deal closed", "spin-off", "spinoff")
FILING_LAGS = {"10-K": 90, "10-Q": 45, "8-K_earnings": 30}


def spread_moneylines(spread: Column) -> tuple[Column, Column]:
    """Home and away moneylines of a home point spread: the table is read between its points, the underdog gets less; beyond 25 none."""
    s = F.abs(spread)
    fav = F.lit(float(SPREADS[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(SPREADS, SPREADS[1:]))):
        fav = F.when(s < x1, y0 + (s - x0) * ((y1 - y0) / (x1 - x0))).otherwise(fav)
    dog = F.greatest(F.abs(fav) - F.when(fav <= -200, 50).when(fav <= -150, 20).otherwise(10), F.lit(100.0))
    side = lambda first, second: F.when(s > 25, None).when(spread < 0, first).when(spread > 0, second).when(spread == 0, -105.0)
    return side(fav, dog), side(dog, fav)


def three_way(a: Column, b: Column, neutral: Column, base: float, spread: float, home: float = 100.0, low: float = 0.02, high: float = 0.98) -> tuple[Column, Column, Column]:
    """Probabilities of a win, a draw and a loss from two ratings: a bell-shaped draw curve, clipped and made to add up to one."""
    gap = a - b + F.when(neutral, 0.0).otherwise(home)
    win, draw = 1 / (1 + F.pow(F.lit(10.0), -gap / 400)), base * F.exp(-F.pow(gap / spread, 2))
    clip = lambda p: F.least(F.greatest(p, F.lit(low)), F.lit(high))
    p = [clip((1 - draw) * win), clip(draw), clip((1 - draw) * (1 - win))]
    total = p[0] + p[1] + p[2]
    return tuple(x / total for x in p)


def company_number(text: Column) -> Column:
    """Digits only, ten of them with leading zeros; empty without any."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")
    return F.when(digits == "", "").otherwise(F.lpad(digits, 10, "0"))


def ticker_symbol(text: Column) -> Column:
    return F.replace(F.upper(F.trim(text)), F.lit("."), F.lit("-"))


def leaving_reason(reason: Column) -> tuple[Column, Column]:
    """(terminal return, category) of a free text."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    has = lambda words: low.rlike("|".join(words))
    return F.when(has(BANKRUPT), -0.99).otherwise(0.0), F.when(has(BANKRUPT), "bankruptcy").when(has(ACQUIRED), "acquisition").otherwise("reshuffle")


def recency_weight(day: Column, decay: float, last: Column) -> Column:
    """exp(-decay (1 - day / last)), the day cut to 0 ... last; a null day weighs 1."""
    return F.when(day.isNull(), 1.0).otherwise(F.exp(-decay * (1 - F.least(F.greatest(day, F.lit(0)), last) / last)))


def levered(ret: Column, leverage: float, expense: float = 0.0095) -> Column:
    return leverage * ret - expense / 252


def levered_or_cash(ret: Column, signal: Column, leverage: float, bill: Column, expense: float = 0.0095) -> Column:
    """`signal` is the one of the day before."""
    return signal * levered(ret, leverage, expense) + (1 - signal) * bill


def financed(ret: Column, exposure: Column, bill: Column, spread_bps: float = 50.0, expense: float = 0.0) -> Column:
    """Return of an exposure (of the day before): cash below one, borrowing at a spread above, expense while invested."""
    more, less = F.greatest(exposure - 1, F.lit(0.0)), F.greatest(1 - exposure, F.lit(0.0))
    return exposure * ret + less * bill - more * (bill + spread_bps / 10000 / 252) - F.when(exposure > 0, expense / 252).otherwise(0.0)


def glide_path(row: Column, n: Column, start: float, end: float, years: float, shape: str = "linear") -> Column:
    """Leverage on row 0 ... n - 1 of a daily series that reaches `end` after so many years: linear, convex or in steps of five years."""
    t = F.least(F.coalesce(F.try_divide(row.cast("double"), n - 1), F.lit(0.0)) * (n / 252 / years), F.lit(1.0))
    if shape == "linear":
        return start + (end - start) * t
    if shape == "convex":
        return start + (end - start) * t * t
    if shape != "step5":
        raise ValueError(f"unknown shape: {shape}")
    steps = int(years / 5)
    return F.when(t >= 1, end).otherwise(start + (end - start) * F.floor(t * steps) / steps)


def kelly_weight(mu: Column, variance: Column, fraction: float = 0.25, most: float = 0.30) -> Column:
    return F.when(variance < 1e-10, 0.0).otherwise(F.least(F.greatest(F.try_divide(mu, variance) * fraction, F.lit(0.0)), F.lit(most)))


def kelly_leverage(mu: Column, variance: Column, rf: float = 0.0) -> Column:
    return F.when(variance < 1e-10, 0.0).otherwise(F.try_divide(mu - rf, variance))


def ruin(sharpe: Column, drawdown: float, years: float) -> Column:
    return F.when(sharpe <= 0, 1.0).otherwise(F.exp(-2 * sharpe * sharpe * abs(drawdown) * years))


def release_date(end: Column, form: Column) -> Column:
    """A cautious release date where the filing date is missing."""
    lag = F.lit(90)
    for name, days in FILING_LAGS.items():
        lag = F.when(form == name, days).otherwise(lag)
    return F.date_add(end, lag)


def tier(name: Column, tiers: dict[str, str], other: str = "friendly") -> Column:
    got = F.lit(other)
    for k, v in tiers.items():
        got = F.when(name == k, v).otherwise(got)
    return got


def bond_return(yield_pct: Column, before_pct: Column, duration: float) -> Column:
    """Return of a constant-maturity bond from its yield and the one before, in per cent."""
    return -duration * (yield_pct - before_pct) / 100 + before_pct / 100 / 252


def name_similarity(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))
