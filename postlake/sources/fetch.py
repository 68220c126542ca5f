"""Outcomes of fetches."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def http_outcome(status: Column) -> Column:
    """not_modified, ok, rate_limited, gone, transient or permanent, by HTTP status."""
    return (
        F.when(status == 304, "not_modified")
        .when(status.between(200, 299), "ok")
        .when(status == 429, "rate_limited")
        .when(status.isin(404, 410), "gone")
        .when((status >= 500) | status.isin(408, 425), "transient")
        .otherwise("permanent")
    )


def retry_after(header: Column) -> Column:
    """Seconds of a Retry-After header, if it's digits."""
    return F.when(header.rlike(r"^\s*\d+\s*$"), F.trim(header).try_cast("double"))
