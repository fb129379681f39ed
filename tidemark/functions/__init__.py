"""Column expressions: odds, stakes, ratings, texts."""

from .odds import decimal_odds, elo_expected, fair_pair, implied, kelly, kelly_capped
from .scalars import great_circle_km, minutes, ratio, shrink, size_bucket, team_name

__all__ = ["decimal_odds", "elo_expected", "fair_pair", "great_circle_km", "implied", "kelly", "kelly_capped", "minutes", "ratio", "shrink", "size_bucket", "team_name"]
