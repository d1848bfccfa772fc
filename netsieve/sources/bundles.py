"""Saving and loading models with their feature contract."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from netsieve import __version__


def feature_hash(columns: Sequence[str]) -> str:
    """16 hex digits identifying an ordered feature list."""
    return hashlib.sha256(json.dumps(list(columns)).encode()).hexdigest()[:16]


@dataclass
class Bundle:
    """Feature contract, configuration and model parameters (all small: no row data)."""

    feature_columns: list[str]
    config: dict
    model: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)


# The parts a bundle must have.
REQUIRED = ["feature_columns", "config", "model"]


def save_bundle(spark: SparkSession, path: str, bundle: Bundle) -> None:
    """Write the bundle as one JSON row per part, through Spark, so that any shared file system will do."""
    config = {
        "bundle_version": __version__,
        **bundle.config,
        "feature_columns_hash": feature_hash(bundle.feature_columns),
    }
    parts = {
        "feature_columns": bundle.feature_columns, "config": config, "model": bundle.model, "metadata": bundle.metadata,
    }
    rows = [(name, json.dumps(value, sort_keys=True)) for name, value in parts.items()]
    spark.createDataFrame(rows, "part string, body string").coalesce(1).write.mode("overwrite").json(path)


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    rows = spark.read.schema("part string, body string").json(path).collect()
    parts: Mapping[str, object] = {r["part"]: json.loads(r["body"]) for r in rows}
    missing = [p for p in REQUIRED if p not in parts]
    if missing:
        raise FileNotFoundError(f"bundle {path} lacks {missing}")
    cols = parts["feature_columns"]
    if not isinstance(cols, list) or not all(isinstance(c, str) for c in cols):
        raise ValueError("feature_columns must be a list of names")
    config = dict(parts["config"])
    if config.get("feature_columns_hash") != feature_hash(cols):
        raise ValueError("feature list does not match the hash stored with the bundle")
    return Bundle(cols, config, dict(parts["model"]), dict(parts.get("metadata") or {}))


def same_contract(*bundles: Bundle) -> None:
    """Models applied together must share one ordered feature list."""
    first = bundles[0].feature_columns
    for b in bundles[1:]:
        if b.feature_columns != first:
            raise ValueError(f"bundles must share feature_columns ({len(first)} vs {len(b.feature_columns)})")
