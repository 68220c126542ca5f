"""Policies and seeds from text."""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlake.operators.rules import Policy

MOST_POLICY_BYTES, MOST_SEED_BYTES = 64 << 10, 256 << 10


def _mapping(text: str, most: int) -> dict:
    """A JSON mapping, or a YAML one where a YAML parser is installed."""
    if len(text.encode()) > most:
        raise ValueError(f"longer than {most} bytes")
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError:
            raise ValueError("neither JSON nor is a YAML parser installed") from None
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("a mapping is asked for")
    return found


def load_policy(text: str) -> Policy:
    """A policy; what isn't named keeps its default, what isn't known is an error."""
    found = _mapping(text, MOST_POLICY_BYTES)
    unknown = found.keys() - {f.name for f in fields(Policy)}
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    policy = Policy(**found)
    if policy.experience_min > policy.experience_max:
        raise ValueError("experience_min is above experience_max")
    return policy


def load_sources(spark: SparkSession, text: str) -> DataFrame:
    """(kind, token, url) of the list ``sources`` in a seed."""
    rows = [(s["kind"], s.get("token"), s.get("url")) for s in _mapping(text, MOST_SEED_BYTES).get("sources", [])]
    return spark.createDataFrame(rows, "kind string, token string, url string").dropDuplicates()


def read_policies(texts: DataFrame, text: str = "policy") -> DataFrame:
    """``texts`` with the policy of each JSON text as the columns of ``Policy``, and ``problem``.

    What a text doesn't name keeps its default. The problem is "long" beyond ``MOST_POLICY_BYTES``, "unreadable" if there's no JSON mapping or a field is of another
    kind, "unknown" with a field that no policy has, "range" if the least experience is above the most, else null; a policy with a problem is all nulls.
    """
    default = Policy()
    kinds = {f.name: "array<string>" if isinstance(getattr(default, f.name), list) else "double" for f in fields(Policy)}
    t = F.col(text)
    made = texts.withColumn("_p", F.from_json(t, ", ".join(f"{k} {v}" for k, v in kinds.items()))).withColumn("_keys", F.json_object_keys(t))
    named = {k: F.coalesce(F.col(f"_p.{k}"), F.array(*[F.lit(x) for x in getattr(default, k)]) if v != "double" else F.lit(getattr(default, k))) for k, v in kinds.items()}
    lost = [F.array_contains("_keys", k) & F.col(f"_p.{k}").isNull() for k in kinds]
    problem = (
        F.when(F.octet_length(t) > MOST_POLICY_BYTES, "long")
        .when(F.col("_keys").isNull(), "unreadable")
        .when(F.size(F.array_except("_keys", F.array(*[F.lit(k) for k in kinds]))) > 0, "unknown")
        .when(F.greatest(*lost), "unreadable")
        .when(named["experience_min"] > named["experience_max"], "range")
    )
    made = made.withColumn("problem", problem)
    return made.withColumns({k: F.when(F.col("problem").isNull(), v) for k, v in named.items()}).drop("_p", "_keys")
