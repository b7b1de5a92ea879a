"""Where queries and their oracle SQL are collected."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import Views, with_views

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return add


def rounded(df, digits, *cols):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})
