"""Match scores with named, weighted components."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from postlake.functions import vocabulary as V
from postlake.functions.text import lookup, normalize_title


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def skill_match(required: Column, preferred: Column, have: list[str]) -> Column:
    """(value, matched, missing): share of skills that the candidate has, preferred ones by half; null value without skills."""
    preferred = F.array_except(preferred, required)
    held = lambda xs: F.filter(xs, lambda s: s.isin(*have))
    total = F.size(required) + V.PREFERRED_SKILL * F.size(preferred)
    got = F.size(held(required)) + V.PREFERRED_SKILL * F.size(held(preferred))
    return F.struct(
        F.when(total > 0, F.round(clamp(got / total), 4)).alias("value"),
        F.concat(held(required), held(preferred)).alias("matched"),
        F.filter(required, lambda s: ~s.isin(*have)).alias("missing"),
    )


def _scaled(v: Column) -> tuple[Column, Column]:
    scale = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return scale, F.transform(v, lambda x: x.cast("double") / scale)


def _dot(a: Column, b: Column) -> Column:
    return F.reduce(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, scaled first; 0 if one is zero, an error if lengths differ or are 0, null if one is null."""
    sa, xa = _scaled(a)
    sb, xb = _scaled(b)
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    value = clamp(_dot(xa, xb) / (F.sqrt(_dot(xa, xa)) * F.sqrt(_dot(xb, xb))), -1.0)
    return F.when(a.isNull() | b.isNull(), None).when(~fits, F.raise_error(F.lit("vectors must be of equal length and not empty"))).when((sa == 0) | (sb == 0), 0.0).otherwise(value)


def semantic(similarity: Column) -> Column:
    return F.round(clamp((similarity - 0.1) / 0.6), 4)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt pattern matching ratio of two texts."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def token_overlap(role: Column, title: Column) -> Column:
    """Share of a role's words that a title has."""
    words = F.array_distinct(F.filter(F.split(role, " "), lambda w: w != ""))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_intersect(words, F.split(title, " "))) / F.size(words))


def role_similarity(title: Column, roles: list[str], ratio: bool = True) -> Column:
    """(role, value) of the most similar target role of a normalised title, the first among equals; null without roles."""
    if not roles:
        return F.lit(None).cast("struct<role:string,value:double>")
    best = None
    for role in roles:
        target = normalize_title(F.lit(role))
        value = F.greatest(sequence_ratio(target, title), token_overlap(target, title)) if ratio else token_overlap(target, title)
        one = F.struct(F.lit(role).alias("role"), F.round(clamp(value), 4).alias("value"))
        best = one if best is None else F.when(one.value > best.value, one).otherwise(best)
    return best


def seniority_fit(level: Column, profile: str) -> Column:
    gap = F.abs(lookup(V.SENIORITY_RANK, level) - V.SENIORITY_RANK.get(profile, 2))
    return F.when((level == "unknown") | F.lit(profile == "unknown"), V.UNKNOWN_CREDIT).when(gap == 0, 1.0).when(gap == 1, 0.6).when(gap == 2, 0.2).otherwise(0.0)


def rule_credit(rules: Column, names: tuple[str, ...] = ("location", "timezone", "work_model")) -> Column:
    """Mean credit of the named rules: 1 for pass, 0.6 for unknown, 0 for fail."""
    credits = F.transform(F.filter(rules, lambda r: r.rule.isin(*names)), lambda r: F.when(r.outcome == "pass", 1.0).when(r.outcome == "unknown", V.UNKNOWN_CREDIT).otherwise(0.0))
    return F.round(F.reduce(credits, F.lit(0.0), lambda s, x: s + x) / len(names), 4)


def freshness(published: Column, now: Column) -> Column:
    """Halves every seven days; a date in the future counts as now, an unknown one as 0.5."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / 86_400_000_000)
    return F.when(published.isNull(), V.UNKNOWN_FRESHNESS).otherwise(F.round(F.pow(F.lit(0.5), days / V.HALF_LIFE_DAYS), 4))


def total_score(components: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """(final_score, components): weights are shared out anew among components that aren't null."""
    weights = weights or V.WEIGHTS
    parts = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("value"), F.lit(weights[k]).alias("weight")) for k, v in components.items()])
    there = F.reduce(F.filter(parts, lambda p: p.value.isNotNull()), F.lit(0.0), lambda s, p: s + p.weight)
    weighed = F.transform(parts, lambda p: F.struct(p["name"].alias("name"), p.value.alias("value"), F.when(p.value.isNull() | (there == 0), 0.0).otherwise(F.round(p.weight / there, 6)).alias("weight")))
    final = F.reduce(weighed, F.lit(0.0), lambda s, p: s + F.coalesce(p.value, F.lit(0.0)) * p.weight)
    return F.struct(F.round(clamp(final), 4).alias("final_score"), weighed.alias("components"))
