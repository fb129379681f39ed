"""Odds, stakes and rating expectations as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_odds(moneyline: Column) -> Column:
    """American odds as decimal odds; values between -100 and 100 are no odds and give null."""
    return F.when(moneyline >= 100, moneyline / 100 + 1).when(moneyline <= -100, 100 / F.abs(moneyline) + 1)


def implied(moneyline: Column) -> Column:
    """Probability that the odds imply, the margin included."""
    return 1 / decimal_odds(moneyline)


def fair_pair(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """The two sides' probabilities without the margin, and the overround."""
    total = implied(a) + implied(b)
    return implied(a) / total, implied(b) / total, total - 1


def kelly(p: Column, odds: Column) -> Column:
    """Full Kelly share at decimal odds, never below 0; odds of 1 win nothing and get nothing."""
    return F.coalesce(F.greatest(F.lit(0.0), F.try_divide((odds - 1) * p - (1 - p), odds - 1)), F.lit(0.0))


def kelly_capped(p: Column, odds: Column, fraction: float = 0.25, cap: float = 0.05, confidence: Column | None = None) -> Column:
    """A fraction of Kelly, scaled by confidence where given (0 or less bets nothing), under a hard cap."""
    stake = kelly(p, odds) * fraction
    if confidence is not None:
        stake = F.when(confidence <= 0, F.lit(0.0)).otherwise(stake * confidence)
    return F.least(stake, F.lit(cap))


def elo_expected(difference: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -difference / 400))
