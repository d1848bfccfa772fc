"""From raw rows to model features: cleaning, label mapping, derived features and contract mappings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from netsieve.functions.guards import col, nan_to_null, to_number
from netsieve.operators.schema import align_columns_strict

# Binary class names, default benign spellings and protocol numbers.
BENIGN = "Benign"
ATTACK = "Attack"
BENIGN_SPELLINGS = ["Benign", "benign", "BENIGN"]
PROTOCOLS = {"tcp": 6.0, "udp": 17.0, "icmp": 1.0}


def proto_code(c: Column, trim: bool = True) -> Column:
    key = F.lower(F.trim(c.cast("string")) if trim else c.cast("string"))
    out = F.when(F.lit(False), F.lit(0.0))
    for name, number in PROTOCOLS.items():
        out = out.when(key == name, F.lit(number))
    return out.otherwise(F.lit(0.0))


def to_benign_attack(c: Column, benign: Iterable[str] = BENIGN_SPELLINGS) -> Column:
    """Two-class label: benign when the trimmed, lower-cased value is in the benign set, else attack."""
    known = sorted({b.strip().lower() for b in benign})
    is_benign = F.coalesce(F.lower(F.trim(c.cast("string"))).isin(known), F.lit(False))
    return F.when(is_benign, F.lit(BENIGN)).otherwise(F.lit(ATTACK))


def unknown_label(c: Column, known: Iterable[str], trim: bool = True) -> Column:
    """True when the label is outside the known set. A missing label is unknown."""
    text = c.cast("string")
    names = sorted({k.strip() for k in known} if trim else set(known))
    return ~F.coalesce((F.trim(text) if trim else text).isin(names), F.lit(False))


def clean(df: DataFrame, label_column: str = "Label", drop_missing_label: bool = True, drop_duplicates: bool = True) -> DataFrame:
    """Drop rows without a label, then exact duplicate rows (one hash shuffle with map-side combine)."""
    if drop_missing_label and label_column in df.columns:
        df = df.where(col(label_column).isNotNull())
    return df.dropDuplicates() if drop_duplicates else df


def num_column(df: DataFrame, name: str) -> Column:
    """The column coerced to a number; an absent column reads as 0."""
    return to_number(col(name)) if name in df.columns else F.lit(0.0)


def derived_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Add ``der_log1p_<c>`` for wide non-negative columns and the forward/backward packet ratio.

    Which columns qualify (all values >= 0, none missing, maximum above 100) is read in one aggregate.
    """
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and (columns is None or f.name in columns)]
    out = df
    if numeric:
        stats = df.agg(
            *[F.min(nan_to_null(col(c))).alias(f"lo{i}") for i, c in enumerate(numeric)],
            *[F.max(nan_to_null(col(c))).alias(f"hi{i}") for i, c in enumerate(numeric)],
            *[F.count_if(nan_to_null(col(c)).isNull()).alias(f"gone{i}") for i, c in enumerate(numeric)],
        ).first()
        wide = [
            c
            for i, c in enumerate(numeric)
            if stats[f"lo{i}"] is not None and stats[f"gone{i}"] == 0 and stats[f"lo{i}"] >= 0 and stats[f"hi{i}"] > 100
        ]
        out = out.withColumns({f"der_log1p_{c}": F.log1p(col(c).cast("double")) for c in wide})
    if {"Total Fwd Packets", "Total Backward Packets"} <= set(df.columns):
        back = col("Total Backward Packets").cast("double") + F.lit(1.0)
        # A count of -1 gives a zero denominator: a signed infinity in floating point, not an error.
        fwd = col("Total Fwd Packets").cast("double")
        endless = F.when(fwd > 0, F.lit(float("inf"))).when(fwd < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
        out = out.withColumn("der_fwd_bwd_packet_ratio", F.when(back != 0, F.try_divide(fwd, back)).when(back == 0, endless))
    return out


def conn_basic_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Small stable feature set of a connection log; only columns that are present are emitted."""
    # Source column and output name.
    numbers = [
        ("orig_bytes", "orig_bytes"), ("resp_bytes", "resp_bytes"), ("duration", "duration"),
        ("id.resp_p", "dst_port"), ("id.orig_p", "src_port"),
        ("orig_pkts", "orig_pkts"), ("resp_pkts", "resp_pkts"),
    ]
    texts = ["proto", "service", "conn_state"]
    return df.select(
        *[col(k) for k in keep],
        *[to_number(col(src)).alias(dst) for src, dst in numbers if src in df.columns],
        *[col(t).cast("string").alias(t) for t in texts if t in df.columns],
    )


def conn_contract_columns(df: DataFrame) -> dict[str, Column]:
    """Every contract feature a connection log can supply, by its contract name."""
    dur, ob, rb, op, rp = (num_column(df, c) for c in ("duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts"))
    proto = proto_code(col("proto")) if "proto" in df.columns else F.lit(0.0)
    seconds = F.when(dur > 0, dur).otherwise(1.0)
    tb, tp = ob + rb, op + rp

    def floor0(x: Column) -> Column:
        return F.when(x > 0, x).otherwise(0.0)

    def per_packet(total: Column, packets: Column) -> Column:
        # The guarded denominator keeps the division defined on rows the condition excludes.
        return F.when(packets > 0, total / F.when(packets > 0, packets).otherwise(1.0)).otherwise(0.0)

    # The contract's names and what a connection record means for each.
    return {
        "Protocol": proto,
        "Flow Duration": dur * 1_000_000.0,
        "Total Fwd Packets": op,
        "Total Backward Packets": rp,
        "Fwd Packets Length Total": ob,
        "Bwd Packets Length Total": rb,
        "Flow Bytes/s": tb / seconds,
        "Flow Packets/s": tp / seconds,
        "Fwd Packets/s": op / seconds,
        "Bwd Packets/s": rp / seconds,
        "Fwd Packet Length Max": ob,
        "Fwd Packet Length Min": floor0(ob),
        "Fwd Packet Length Mean": per_packet(ob, op),
        "Bwd Packet Length Max": rb,
        "Bwd Packet Length Min": floor0(rb),
        "Bwd Packet Length Mean": per_packet(rb, rp),
        "Packet Length Min": floor0(tb),
        "Packet Length Max": tb,
        "Packet Length Mean": per_packet(tb, tp),
        "Avg Packet Size": per_packet(tb, tp),
        "Subflow Fwd Packets": op,
        "Subflow Fwd Bytes": ob,
        "Subflow Bwd Packets": rp,
        "Subflow Bwd Bytes": rb,
        "Init Fwd Win Bytes": num_column(df, "id.orig_p"),
        "Init Bwd Win Bytes": num_column(df, "id.resp_p"),
    }


def conn_to_contract(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Connection log to model contract in one projection; a feature the log cannot supply is 0."""
    known = conn_contract_columns(df)
    return df.select(*[col(k) for k in keep], *[known.get(c, F.lit(0.0)).alias(c) for c in columns])


# Columns by which a connection log is recognised.
CONN_MARKS = ["orig_bytes", "resp_bytes", "duration", "orig_pkts", "resp_pkts"]


def prepare_input(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Contract rows pass through aligned, connection-log rows are mapped, anything else is an error."""
    if set(columns) <= set(df.columns):
        return align_columns_strict(df, columns, keep=keep)
    if set(CONN_MARKS) & set(df.columns):
        return conn_to_contract(df, columns, keep=keep)
    raise ValueError("input matches neither the feature contract nor a connection log")


def external_to_contract(df: DataFrame, columns: Sequence[str], label_name: str = "Label", keep: Sequence[str] = ()) -> DataFrame:
    """Map a second public flow data set (spkts/dpkts/sbytes/dbytes naming) onto the contract and its labels."""
    have = set(df.columns)
    n = lambda c: to_number(col(c))
    duration = n("dur") if "dur" in have else F.lit(0.0)

    def per_second(total: Column) -> Column:
        return F.when(duration != 0, total / F.when(duration != 0, duration).otherwise(1.0)).otherwise(0.0)

    # Contract name, source columns needed, and the expression.
    rules: list[tuple[str, list[str], Column | None]] = [
        ("Protocol", ["proto"], proto_code(col("proto"), trim=False) if "proto" in have else None),
        ("Flow Duration", ["dur"], duration * 1_000_000.0),
        ("Total Fwd Packets", ["spkts"], None),
        ("Total Backward Packets", ["dpkts"], None),
        ("Fwd Packets Length Total", ["sbytes"], None),
        ("Bwd Packets Length Total", ["dbytes"], None),
        ("Flow Packets/s", ["spkts", "dpkts", "dur"], per_second(n("spkts") + n("dpkts"))),
        ("Flow Bytes/s", ["sbytes", "dbytes", "dur"], per_second(n("sbytes") + n("dbytes"))),
        ("Fwd Packet Length Mean", ["smean"], None),
        ("Bwd Packet Length Mean", ["dmean"], None),
        ("Fwd IAT Mean", ["sinpkt"], None),
        ("Bwd IAT Mean", ["dinpkt"], None),
    ]
    known = {name: (expr if expr is not None else n(need[0])) for name, need, expr in rules if set(need) <= have}
    category = col("attack_cat").cast("string") if "attack_cat" in have else None
    if "label" in have:
        attack = F.coalesce(category, F.lit("UnknownAttack")) if category is not None else F.lit(ATTACK)
        label = F.when(n("label").cast("bigint") == 0, F.lit(BENIGN)).otherwise(attack)
    elif category is not None:
        label = F.coalesce(category, F.lit("UnknownAttack"))
    else:
        label = F.lit("UnknownAttack")
    return df.select(
        *[col(k) for k in keep],
        *[known.get(c, F.lit(0.0)).alias(c) for c in columns],
        label.alias(label_name),
    )


def export_benign(df: DataFrame, label_column: str, benign: Iterable[str] = BENIGN_SPELLINGS) -> DataFrame:
    """Rows whose label is exactly one of the benign values."""
    return df.where(col(label_column).cast("string").isin(sorted(benign)))
