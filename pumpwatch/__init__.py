"""pumpwatch — snapshot price analytics on Spark DataFrames.

Prices are observed again and again: every poll of a feed is a *snapshot*
holding one price per (station, category). The library turns feeds and
archives into fact / dimension DataFrames and answers questions over the
accumulated history with plain DataFrame plans (no UDFs, no custom rules).
"""

from pumpwatch.session import configure, get_session, work_dir

__all__ = ["configure", "get_session", "work_dir"]
