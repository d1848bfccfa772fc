"""Feature contracts: which columns, in which order, under which names."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

from netsieve.functions.guards import col, finite


@dataclass(frozen=True)
class FeatureSpec:
    feature_columns: list[str] = field(default_factory=list)
    label_column: str = "label"
    id_columns: list[str] = field(default_factory=list)


def infer_feature_columns(df: DataFrame, drop: Sequence[str] = ()) -> list[str]:
    gone = set(drop)
    return [c for c in df.columns if c not in gone]


def numeric_columns(df: DataFrame, among: Sequence[str] | None = None) -> list[str]:
    """Names of numeric columns (booleans are not numeric); none at all is an error."""
    wanted = None if among is None else set(among)
    found = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and (wanted is None or f.name in wanted)]
    if not found:
        raise ValueError("no numeric feature columns left after dropping label and id columns")
    return found


def _require_label(df: DataFrame, label: str) -> None:
    if label in df.columns:
        return
    close = [c for c in df.columns if c.lower() == label.lower()]
    hint = f"; did you mean {close[0]!r}?" if close else ""
    raise KeyError(f"label column {label!r} not found{hint}")


def split_xy(df: DataFrame, spec: FeatureSpec) -> tuple[DataFrame, DataFrame]:
    """Feature table and label table; both keep the id columns so that rows can be matched by key."""
    _require_label(df, spec.label_column)
    ids = [c for c in spec.id_columns if c in df.columns]
    features = spec.feature_columns or infer_feature_columns(df, [spec.label_column, *ids])
    x = align_columns_strict(df, features, keep=ids)
    y = df.select(*[col(c) for c in ids], col(spec.label_column))
    return x, y


def align_columns_strict(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the contract's columns in order (after any kept ids); a missing one is an error naming it."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return df.select(*[col(c) for c in keep if c not in columns], *[col(c) for c in columns])


def validate_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per contract column: is it there, is it numeric, how many values are null, NaN or infinite.

    All columns are counted in a single aggregate over the table.
    """
    types = {f.name: f.dataType for f in df.schema}
    numeric = [c for c in columns if isinstance(types.get(c), T.NumericType)]
    counts = [F.count_if(~finite(col(c))).alias(f"_{i}") for i, c in enumerate(numeric)]
    position = {c: i for i, c in enumerate(numeric)}
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(c in types).alias("found"),
            F.lit(c in position).alias("numeric"),
            (F.col(f"_{position[c]}") if c in position else F.lit(None)).cast("bigint").alias("bad_values"),
        )
        for c in columns
    ]
    base = df.agg(F.count(F.lit(1)).alias("_n"), *counts)
    return base.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# Parts of a header that mark an id or metadata column.
ID_MARKS = [
    "flow id", "flow_id", "timestamp", "src ip", "dst ip",
    "source ip", "destination ip", "ip src", "ip dst",
]


def build_alias_to_canonical(columns: Sequence[str], extra: Mapping[str, str] | None = None) -> dict[str, str]:
    """Spellings under which a contract column may arrive: lower case, and with spaces as ``_``, removed or collapsed."""
    out: dict[str, str] = {}
    for name in columns:
        low = name.strip().lower()
        for key in (low, low.replace(" ", "_"), low.replace(" ", ""), re.sub(r"\s+", " ", low)):
            if key:
                out[key] = name
    out.update({k.strip().lower(): v for k, v in (extra or {}).items()})
    return out


def normalize_columns(
    df: DataFrame,
    feature_columns: Sequence[str],
    label_column: str | None = None,
    extra_aliases: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rename headers to the contract's names and drop id-like columns. Two headers for one name are an error."""
    aliases = build_alias_to_canonical(feature_columns, extra_aliases)
    out: list[tuple[str, str]] = []
    for c in df.columns:
        key = c.strip().lower()
        name = c if c == label_column else aliases.get(key, aliases.get(key.replace(" ", "_"), aliases.get(c, c)))
        is_id = name != label_column and any(m in name.lower() for m in ID_MARKS)
        if not is_id:
            out.append((c, name))
    names = [n for _, n in out]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"several input columns map to {clash}")
    return df.select(*[col(c).alias(n) for c, n in out])


def contract_gap(df: DataFrame, feature_columns: Sequence[str], label_column: str | None = None) -> tuple[list[str], list[str]]:
    """(contract columns not in the table, table columns not in the contract)."""
    missing = [c for c in feature_columns if c not in df.columns]
    extra = [c for c in df.columns if c not in set(feature_columns) and c != label_column]
    return missing, extra


def normalize_to_contract(
    df: DataFrame,
    feature_columns: Sequence[str],
    label_column: str | None = None,
    extra_aliases: Mapping[str, str] | None = None,
) -> tuple[DataFrame | None, dict]:
    """Normalise, report the gap, and give the contract-ordered table when nothing is missing."""
    norm = normalize_columns(df, feature_columns, label_column, extra_aliases)
    missing, extra = contract_gap(norm, feature_columns, label_column)
    report = {"missing": missing, "extra": extra, "complete": not missing}
    if missing:
        return None, report
    tail = [col(label_column)] if label_column and label_column in norm.columns else []
    return norm.select(*[col(c) for c in feature_columns], *tail), report


def probability_columns(classes: Sequence[str]) -> list[str]:
    """Column-safe names of per-class probabilities, unique within the list."""
    out: list[str] = []
    for c in classes:
        safe = re.sub(r"[^A-Za-z0-9_]+", "_", str(c).strip()) or "cls"
        safe = ("c_" + safe if safe[0].isdigit() else safe)[:120]
        base = name = "p_" + safe
        j = 0
        while name in out:
            j += 1
            name = f"{base}_{j}"
        out.append(name)
    return out


def class_columns(df: DataFrame, label: str) -> DataFrame:
    """``class`` and ``column_name`` of the probability column of every label of a table, in the order of the names."""
    found = df.where(col(label).isNotNull()).select(col(label).cast("string").alias("class")).distinct().orderBy("class").collect()  # a model's classes: few
    names = [r["class"] for r in found]
    return df.sparkSession.createDataFrame([*zip(names, probability_columns(names), strict=True)], "class string, column_name string")
