"""Schemas of the tables that operators exchange."""

from __future__ import annotations

OHLCV = "asset string, date timestamp_ntz, open double, high double, low double, close double, volume double"
FUNDING = "asset string, date timestamp_ntz, funding_sum double, funding_n bigint"
OPEN_INTEREST = "asset string, date timestamp_ntz, open_interest double"
KEY = ["model", "asset", "origin", "h"]
PREDICTIONS = "model string, asset string, origin timestamp_ntz, fold timestamp_ntz, h int, y double, last double, sigma double, rv double, regime_driver double, q10 double, q50 double, q90 double"
HF_PREDICTIONS = "model string, asset string, origin timestamp_ntz, target_time timestamp_ntz, split string, h int, y double, last double, regime_driver double, origin_sigma double, origin_momentum double, q10 double, q50 double, q90 double"
RESULTS_LOG = "run string, tag string, meta string, model string, metric string, value double"
