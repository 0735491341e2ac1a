"""Schema coercion and data-quality rules evaluated in one pass."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from plumbline import fixed_values as fv


class QualityError(ValueError):
    """All violated rules of a table, gathered before raising."""


class FeatureContractError(QualityError):
    """A table lacks required feature columns."""


@dataclasses.dataclass(frozen=True)
class Rule:
    """`ok` must hold for every row; a null outcome counts as a pass (nullability has its own rule)."""

    name: str
    column: str
    ok: Column

    @property
    def broken(self) -> Column:
        return F.coalesce(~self.ok, F.lit(False))


@dataclasses.dataclass(frozen=True)
class Field:
    """One declared column of an open schema: extra columns stay untouched."""

    name: str
    kind: str
    nullable: bool = True
    allowed: tuple = ()
    low: float | None = None
    high: float | None = None
    min_length: int | None = None

    def rules(self) -> list[Rule]:
        c, out = F.col(self.name), []
        if not self.nullable:
            out.append(Rule("not_null", self.name, c.isNotNull()))
        if self.allowed:
            out.append(Rule("allowed_values", self.name, c.isin(*self.allowed)))
        if self.low is not None and self.high is not None:
            out.append(Rule("in_range", self.name, c.between(self.low, self.high)))
        if self.min_length is not None:
            out.append(Rule("min_length", self.name, F.length(c) >= self.min_length))
        return out


@dataclasses.dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]
    unique: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]


def _field(name: str, kind: str, nullable: bool = True, **extra: object) -> Field:
    return Field(name, kind, nullable, **extra)


_PLACE = (
    _field("latitude", "double", False, low=-90, high=90),
    _field("longitude", "double", False, low=-180, high=180),
)
_BUILDING = (
    _field("year_built", "double"),
    _field("property_class", "string"),
    _field("lot_size_sqft", "double"),
    _field("building_sqft", "double"),
    _field("stories", "double"),
    _field("has_basement", "boolean"),
)

RAW_INVENTORY = Schema(
    (
        _field("address", "string", False),
        _field("zip_code", "string", False),
        _field("ward", "int", False),
        _field("property_type", "string"),
        _field("service_line_material", "string", allowed=fv.LABEL_DOMAIN),
        *_PLACE,
    )
)
RAW_ASSESSOR = Schema((_field("pin", "string", False), _field("address", "string"), *_BUILDING))
INTERIM = Schema(
    (
        _field("property_id", "string", False, min_length=1),
        _field("address", "string", False),
        _field("zip_code", "string", False),
        _field("ward", "int", False),
        *_PLACE,
        *_BUILDING,
        _field("service_line_material", "string", allowed=fv.LABEL_DOMAIN),
        _field("material_source", "string", False, allowed=fv.LABEL_SOURCES),
        _field("census_tract", "string"),
        _field("inspected_at", "timestamp_ntz"),
        _field("last_updated", "timestamp_ntz", False),
    ),
    unique=("property_id",),
)
FEATURES = Schema(
    (
        *[f for f in INTERIM.fields if f.name not in ("service_line_material", "material_source")],
        _field("h3_index_res8", "bigint", False),
        _field("h3_index_res9", "bigint", False),
        _field("dist_to_nearest_hydrant_m", "double", False),
        _field("dist_to_nearest_known_lead_m", "double", False),
        _field("neighbor_lead_rate_h3res8", "double", False, low=0.0, high=1.0),
        _field("knn10_lead_rate", "double", False, low=0.0, high=1.0),
        _field("service_line_material", "string"),
        _field("material_source", "string", False),
    ),
    unique=("property_id",),
    forbidden=fv.FORBIDDEN_COLUMNS,
)
FAIRNESS_REFERENCE = Schema(
    (
        _field("census_tract", "string", False),
        _field("income_quartile", "int", False, allowed=(1, 2, 3, 4)),
    ),
    unique=("census_tract",),
)
INSPECTION = Schema(
    (
        _field("property_id", "string", False),
        _field("inspected_material", "string", False, allowed=fv.LABEL_DOMAIN),
        _field("source", "string", False, allowed=fv.INSPECTION_SOURCES),
        _field("cost_usd", "double", False, low=0.0, high=1e12),
    )
)


def coerce(df: DataFrame, schema: Schema) -> DataFrame:
    """Cast declared columns leniently, add absent nullable ones as null, keep extras.

    A value that fails to cast becomes null and is flagged in `_uncast` so the rules can report it.
    """
    present = set(df.columns)
    declared = {f.name: f for f in schema.fields}
    failed = [
        F.when(F.col(n).isNotNull() & F.col(n).try_cast(f.kind).isNull(), F.lit(n))
        for n, f in declared.items()
        if n in present
    ]
    columns = [F.col(c).try_cast(declared[c].kind).alias(c) if c in declared else F.col(c) for c in df.columns]
    absent = [F.lit(None).cast(f.kind).alias(n) for n, f in declared.items() if n not in present]
    return df.select(*columns, *absent, F.array_compact(F.array(*failed)).alias("_uncast"))


def with_columns(df: DataFrame, defaults: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Add missing columns and fill nulls: name -> (type, default), default None only adds."""
    out = {}
    for name, (kind, default) in defaults.items():
        c = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        out[name] = c if default is None else F.coalesce(c, F.lit(default).cast(kind))
    return df.withColumns(out)


def rule_report(df: DataFrame, rules: Sequence[Rule], sample: str | None = None) -> DataFrame:
    """One row per rule (rule, column, n_bad[, sample]) from a single scan of `df`."""
    counts = [F.count_if(r.broken).alias(f"n{i}") for i, r in enumerate(rules)]
    if sample:
        counts += [F.min(F.when(r.broken, F.col(sample))).alias(f"s{i}") for i, r in enumerate(rules)]
    totals = df.agg(*counts)
    lines = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.lit(r.column).alias("column"),
            F.col(f"n{i}").alias("n_bad"),
            *([F.col(f"s{i}").alias("sample")] if sample else []),
        )
        for i, r in enumerate(rules)
    ]
    return totals.select(F.inline(F.array(*lines)))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def forbidden_present(df: DataFrame, forbidden: Iterable[str] = fv.FORBIDDEN_COLUMNS) -> list[str]:
    wanted = {c.lower() for c in forbidden}
    return sorted(c for c in df.columns if c.lower() in wanted)


def guard_forbidden(df: DataFrame, forbidden: Iterable[str] = fv.FORBIDDEN_COLUMNS) -> DataFrame:
    found = forbidden_present(df, forbidden)
    if found:
        raise QualityError(f"forbidden columns in a feature table: {found}")
    return df


def violations(df: DataFrame, schema: Schema) -> DataFrame:
    """Every broken rule of `schema` in `df`: (rule, column, n_bad, sample)."""
    sample_key = schema.unique[0] if schema.unique else schema.fields[0].name
    rules = [r for f in schema.fields for r in f.rules()]
    if "_uncast" in df.columns:
        rules += [Rule("cast", f.name, ~F.array_contains("_uncast", f.name)) for f in schema.fields]
    text = df.withColumn("_sample", F.col(sample_key).cast("string"))
    report = rule_report(text, rules, "_sample").where("n_bad > 0")
    for key in schema.unique:
        repeated = duplicates(df, [key]).agg(
            F.lit("unique").alias("rule"), F.lit(key).alias("column"),
            F.count("*").alias("n_bad"), F.min(F.col(key).cast("string")).alias("sample"),
        )
        report = report.unionByName(repeated.where("n_bad > 0"))
    return report


def validate(df: DataFrame, schema: Schema) -> DataFrame:
    """Coerce, gather all failures, raise if there are any; returns the coerced table."""
    guard_forbidden(df, schema.forbidden)
    coerced = coerce(df, schema)
    found = violations(coerced, schema).collect()  # at most one line per rule
    if found:
        raise QualityError("; ".join(f"{r['column']}: {r['rule']} x{r['n_bad']}" for r in found))
    return coerced.drop("_uncast")


def feature_contract(df: DataFrame, required: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the required columns, in order, as double (after `keep`); never zero-filled."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise FeatureContractError(f"missing required features: {missing}")
    return df.select(*keep, *[F.col(c).cast(T.DoubleType()).alias(c) for c in required])


def profile(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Labelled count, count per known label and missing rate per column, in one pass."""
    rows = F.count("*")
    return df.agg(
        rows.alias("n_rows"),
        F.count(label).alias("n_labelled"),
        *[F.count_if(F.col(label) == v).alias(f"n_{v.lower()}") for v in fv.KNOWN_LABELS],
        *[(F.count_if(F.col(c).isNull()) / rows).alias(f"missing_{c}") for c in columns],
    )
