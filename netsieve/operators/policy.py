"""Suppressions, detection rules, tenant scope and per-tenant settings."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from netsieve.functions.guards import col
from netsieve.session import broadcast_if_small, materialize

SENT = 200_000  # suppressions sent to the rows


def find_field(columns: Sequence[str], name: str) -> str | None:
    """Exact column name first, then ignoring case and space/underscore differences."""
    if name in columns:
        return name
    key = name.lower().replace(" ", "_")
    return next((c for c in columns if c.lower().replace(" ", "_") == key), None)


def _field(df: DataFrame, name: str) -> Column:
    found = find_field(df.columns, name)
    return col(found) if found is not None else F.lit(None).cast("string")


def _number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


# Fixed value: form of a plain rule, ``field op number``.
PLAIN_RULE = re.compile(r"\s*([a-zA-Z0-9_]+)\s*([><=!]+)\s*([0-9.eE+-]+)\s*")


def compile_rule(df: DataFrame, expression: str) -> Column:
    """A rule as a boolean column of ``df``. Whatever cannot be read or evaluated is false, never an error.

    JSON rules compare ``==`` exactly; plain rules within 1e-9. ``!=`` is accepted by the plain form but never holds.
    """
    text = expression.strip()
    exact = text.startswith("{")
    if exact:
        try:
            spec = json.loads(text)
        except json.JSONDecodeError:
            return F.lit(False)
        name, op, raw = str(spec.get("field", "")), str(spec.get("op", "")), spec.get("value")
    else:
        m = PLAIN_RULE.fullmatch(text)
        if m is None:
            return F.lit(False)
        name, op, raw = m.groups()
    limit = _number(raw)
    found = find_field(df.columns, name)
    if limit is None or math.isnan(limit) or found is None:
        return F.lit(False)
    x = col(found).try_cast("double")
    v = F.lit(limit)
    tests = {">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v}
    if exact:
        tests["=="] = x == v
    else:
        tests["=="] = tests["="] = F.abs(x - v) < 1e-9
    if op not in tests:
        return F.lit(False)
    return F.coalesce(tests[op] & ~F.isnan(x), F.lit(False))


def applies_to_tenant(rule_tenant, tenant: Column) -> Column:
    """A rule without tenant applies to all; a tenant's rule only to that tenant's rows."""
    return F.lit(True) if rule_tenant is None else F.coalesce(tenant == rule_tenant, F.lit(False))


def rule_hits(df: DataFrame, rules: Sequence[Mapping], tenant: Column) -> Column:
    """Names of the enabled rules that hold for the row, in rule order, as an array column.

    Rules are configuration, so they are compiled once on the driver into one projection.
    """
    hits = [
        F.when(applies_to_tenant(r.get("tenant_id"), tenant) & compile_rule(df, str(r["expression"])), F.lit(str(r["name"])))
        for r in rules
        if int(r.get("enabled", 1)) == 1
    ]
    if not hits:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*hits))


def is_suppressed(df: DataFrame, suppressions: DataFrame, tenant: str | None, now_ts: int, out: str = "_suppressed") -> DataFrame:
    """Flag rows that an unexpired suppression covers.

    Suppressions are grouped by kind and value, with the tenants they hold for. Up to ``SENT`` of them, by count, are sent
    to the rows, which look up their IP, their label, and their IP's prefixes of the lengths in use where they are: the rows
    are not shuffled. Beyond that, rows are reduced to their distinct combinations of address, label and tenant, which
    list what could cover them; one equi join finds the suppressions among that, and the covered ones are joined back.
    """
    tid = F.col("tenant_id").cast("string")
    live = suppressions.where(F.col("until_ts").isNull() | (F.col("until_ts") > F.lit(now_ts))).select(
        F.when(F.lower("target_type").isin("label", "decision"), F.lit("label")).otherwise(F.lower("target_type")).alias("kind"),
        F.col("target_value").alias("value"),
        # "" stands for every tenant, "=<id>" for one.
        F.when(tid.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), tid)).alias("scope"),
    )
    nonempty = lambda c: F.when(c.cast("string") != "", c.cast("string"))
    ip_field = _field(df, "ip")
    ip = F.coalesce(nonempty(ip_field), nonempty(_field(df, "dst_ip")), _field(df, "src_ip").cast("string"))
    label = F.coalesce(nonempty(_field(df, "decision_label")), _field(df, "label").cast("string"))
    own = F.lit(None).cast("string") if tenant is None else F.concat(F.lit("="), col(tenant).cast("string"))

    # Prefix lengths in use: at most as many as an address has characters.
    lengths = sorted(
        r[0] for r in live.where(F.col("kind") == "subnet").select(F.length("value")).distinct().collect() if r[0] is not None
    )
    base_ip = F.coalesce(ip_field.cast("string"), F.lit(""))
    grouped = materialize(live.where("value IS NOT NULL").groupBy("kind", "value").agg(F.collect_set("scope").alias("scopes")), "suppressions")
    if (grouped.agg(F.sum(F.size("scopes"))).first()[0] or 0) <= SENT:
        return _look_up(df, grouped, ip, label, base_ip, lengths, own, out)
    probe = lambda kind, value, scope: F.struct(F.lit(kind).alias("kind"), value.alias("value"), scope.alias("scope"))
    shape = F.to_json(F.struct(ip.alias("ip"), label.alias("label"), base_ip.alias("base"), own.alias("own")))
    shapes = df.select(shape.alias("_t"), ip.alias("ip"), label.alias("label"), base_ip.alias("base"), own.alias("own")).distinct()
    scopes = [F.lit(""), F.col("own")]
    probes = [probe(kind, F.col(kind), s) for kind in ("ip", "label") for s in scopes]
    for n in lengths:
        prefix = F.when(F.length("base") >= n, F.substring("base", 1, n))
        probes += [probe("subnet", prefix, s) for s in scopes]
    asked = shapes.select("_t", F.explode(F.array(*probes)).alias("p")).where("p.value IS NOT NULL AND p.scope IS NOT NULL")
    keys = live.where("value IS NOT NULL").distinct()
    hit = asked.select("_t", "p.*").join(keys, ["kind", "value", "scope"]).select("_t").distinct().withColumn("_hit", F.lit(True))
    res = df.withColumn("_t", shape).join(broadcast_if_small(hit, "suppressed"), "_t", "left")
    return res.withColumn(out, F.coalesce("_hit", F.lit(False))).select(*[col(c) for c in df.columns], F.col(out))


def _look_up(df: DataFrame, grouped: DataFrame, ip: Column, label: Column, base_ip: Column, lengths: Sequence[int], own: Column, out: str) -> DataFrame:
    """``df`` with ``out``, by one broadcast join for the IP, one for the label, and one for each prefix length."""
    names, own_name = df.columns, "_sup"
    while any(c.startswith(own_name) for c in names):
        own_name += "_"
    mine = {k: F.col(f"{own_name}{k}") for k in ("ip", "label", "base", "own")}
    res = df.withColumns({f"{own_name}{k}": v for k, v in (("ip", ip), ("label", label), ("base", base_ip), ("own", own))})
    probes = [("ip", mine["ip"], F.lit(True)), ("label", mine["label"], F.lit(True))]
    for n in lengths:
        probes.append(("subnet", F.when(F.length(mine["base"]) >= n, F.substring(mine["base"], 1, n)), F.length("value") == n))
    found = F.lit(False)
    for i, (kind, value, wanted) in enumerate(probes):
        theirs, scopes = f"{own_name}v{i}", F.col(f"{own_name}s{i}")
        side = grouped.where((F.col("kind") == kind) & wanted).select(F.col("value").alias(theirs), F.col("scopes").alias(f"{own_name}s{i}"))
        res = res.join(F.broadcast(side), value == F.col(theirs), "left")
        found = found | F.coalesce(F.array_contains(scopes, F.lit("")), F.lit(False)) | F.coalesce(F.array_contains(scopes, mine["own"]), F.lit(False))
    return res.select(*[col(c) for c in names], found.alias(out))


def enrich(df: DataFrame, suppressions: DataFrame, rules: Sequence[Mapping], tenant: str | None, now_ts: int) -> DataFrame:
    """Add ``_suppressed`` and ``_rule_hits`` to scored rows."""
    owner = F.lit(None) if tenant is None else col(tenant)
    hits = rule_hits(df, rules, owner)
    return is_suppressed(df.withColumn("_rule_hits", hits), suppressions, tenant, now_ts)


def tenant_scope(role: str, tenant_id: int | None, column: Column) -> Column:
    """Rows a user may see: a global admin all, a tenant its own and shared ones, others only shared ones."""
    if role == "admin" and tenant_id is None:
        return F.lit(True)
    if tenant_id is None:
        return column.isNull()
    return F.coalesce(column == F.lit(tenant_id), F.lit(False)) | column.isNull()


def effective_settings(df: DataFrame, tenant: str, settings: DataFrame, keys: Mapping[str, object]) -> DataFrame:
    """Per-row settings: the tenant's value unless null or blank, else the global one, else the default.

    ``settings`` holds one row per tenant and one with a NULL ``tenant_id``. The global row comes in as a scalar
    subquery; tenants join on their key.
    """
    stored = [k for k in keys if k in settings.columns]
    shared = settings.where(F.col("tenant_id").isNull()).agg(
        F.struct(*[F.max(col(k)).alias(k) for k in stored]).alias("g")
    ).scalar() if stored else None
    own = settings.where(F.col("tenant_id").isNotNull()).select(
        F.col("tenant_id").alias("_tenant"),
        *[F.when(F.trim(col(k).cast("string")) != "", col(k)).alias(f"_own_{k}") for k in stored],
    )
    joined = df.join(broadcast_if_small(own, "settings"), col(tenant) == F.col("_tenant"), "left")
    merged = {}
    for k, default in keys.items():
        options = [F.col(f"_own_{k}"), shared.getField(k)] if k in stored else []
        merged[k] = F.coalesce(*options, F.lit(default))
    return joined.withColumns(merged).drop("_tenant", *[f"_own_{k}" for k in stored])


def list_alerts(
    alerts: DataFrame, role: str, tenant_id: int | None, status: str | None = None, from_ts: int | None = None,
    limit: int = 100, offset: int = 0,
) -> DataFrame:
    """Newest alerts a user may see, with the JSON columns parsed."""
    out = alerts.where(tenant_scope(role, tenant_id, F.col("tenant_id")))
    if status:
        out = out.where(F.col("status") == status)
    if from_ts is not None:
        out = out.where(F.col("created_at") >= from_ts)
    out = out.orderBy(F.col("id").desc()).offset(offset).limit(limit)
    return out.withColumn("payload", F.from_json("payload_json", "map<string,string>")).withColumn(
        "rule_hits", F.from_json("rule_hits_json", "array<string>")
    ).drop("payload_json", "rule_hits_json")


def list_cases(cases: DataFrame, role: str, tenant_id: int | None, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    out = cases.where(tenant_scope(role, tenant_id, F.col("tenant_id")))
    if status:
        out = out.where(F.col("status") == status)
    return out.orderBy(F.col("id").desc()).offset(offset).limit(limit)


def case_entries(cases: DataFrame, entries: DataFrame, role: str, tenant_id: int | None) -> DataFrame:
    """Timeline, comment or assignment rows of every visible case, in order within the case."""
    visible = cases.where(tenant_scope(role, tenant_id, F.col("tenant_id"))).select(F.col("id").alias("case_id"))
    return entries.join(visible, "case_id", "left_semi").orderBy("case_id", "id")
