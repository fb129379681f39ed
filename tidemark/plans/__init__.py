"""Queries over the supplied tables, each with SQL that gives the same rows."""

from . import backtests, calibration, characteristics, factors, fundamentals, inference, matchups, payloads, pools, queries, ratings, scalars, signals, simulations, splits  # noqa: F401 - importing registers the queries
