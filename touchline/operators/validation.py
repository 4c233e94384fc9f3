"""Data contracts, leakage and log audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LeakageError(RuntimeError):
    """A feature is not available strictly before its deadline."""


class ContractError(RuntimeError):
    """A required field is missing."""


def require_columns(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {missing}")


def check_contract(schema: T.StructType, contract: T.StructType, context: str = "payload") -> list[str]:
    """Missing required field: error. Extra fields: returned, sorted.

    A contract field is required when it is not nullable. Arrays of structs
    and structs are checked all the way down, one report per collection.
    """
    extra: list[str] = []

    def struct_of(data_type: T.DataType) -> T.StructType | None:
        if isinstance(data_type, T.ArrayType):
            data_type = data_type.elementType
        return data_type if isinstance(data_type, T.StructType) else None

    def walk(actual: T.StructType, wanted: T.StructType, path: str) -> None:
        have = {f.name: f for f in actual.fields}
        for field in wanted.fields:
            if field.name not in have:
                if not field.nullable:
                    raise ContractError(f"{context}: required field {path}{field.name} is missing")
                continue
            inner, expected = struct_of(have[field.name].dataType), struct_of(field.dataType)
            if inner is not None and expected is not None:
                walk(inner, expected, f"{path}{field.name}.")
        known = {f.name for f in wanted.fields}
        extra.extend(f"{path}{name}" for name in have if name not in known)

    walk(schema, contract, "")
    return sorted(extra)


def null_report(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Row-level contract check: nulls per required column, in one pass."""
    required = [f.name for f in contract.fields if not f.nullable]
    require_columns(df, *required)
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counted.unpivot("n_rows", required, "field", "n_missing")


def leakage_violations(df: DataFrame, available_at: str = "available_at", deadline: str = "deadline") -> DataFrame:
    """Rows whose feature time is unknown or not strictly before the deadline."""
    return df.filter(~F.coalesce(F.col(available_at) < F.col(deadline), F.lit(False)))


def assert_no_leakage(df: DataFrame, available_at: str = "available_at", deadline: str = "deadline", context: str = "") -> None:
    """Raise with the violation count and the first five offenders."""
    bad = leakage_violations(df, available_at, deadline)
    sample = bad.limit(5).collect()
    if sample:
        n = bad.count()
        shown = ", ".join(str(row.asDict()) for row in sample)
        more = f" (+{n - 5} more)" if n > 5 else ""
        raise LeakageError(f"{context}: {n} feature(s) at or after the deadline: {shown}{more}")


def leak_checked(value: Column, available_at: Column, deadline: Column, context: str = "feature") -> Column:
    """`value`, failing the job at run time if it leaks; costs no extra pass."""
    ok = F.coalesce(available_at < deadline, F.lit(False))
    message = F.concat(
        F.lit(f"{context} available at "), F.coalesce(available_at.cast("string"), F.lit("unknown time")),
        F.lit(", not before deadline "), F.coalesce(deadline.cast("string"), F.lit("unknown")),
    )
    return F.when(ok, value).otherwise(F.raise_error(message).cast("double"))


def sample_violations(violations: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First n offenders in order, with how many more there are."""
    more = violations.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("n_more"))
    return violations.orderBy(*order).limit(n).withColumn("n_more", more.scalar())


def freeze_window_status(write_log: DataFrame, hours: int = 6, written: str = "written_at", deadline: str = "deadline") -> DataFrame:
    """early / open / late: writes are allowed in the hours before a deadline."""
    opens = F.col(deadline) - F.expr(f"INTERVAL {hours} HOURS")
    status = F.when(F.col(written) < opens, "early").when(F.col(written) >= F.col(deadline), "late").otherwise("open")
    return write_log.withColumn("freeze_status", status)


def immutability_audit(write_log: DataFrame, keys: list[str], written: str = "written_at", deadline: str = "deadline") -> DataFrame:
    """One row per frozen key: was it written exactly once, by its deadline?"""
    per_key = write_log.groupBy(*keys).agg(
        F.count(written).alias("n_writes"),
        F.min(written).alias("first_write"),
        F.min(deadline).alias("deadline"),
    )
    verdict = (
        F.when(F.col("n_writes") == 0, "never written")
        .when(F.col("n_writes") > 1, "rewritten")
        .when(F.col("first_write") > F.col("deadline"), "late")
        .otherwise("ok")
    )
    return per_key.withColumn("verdict", verdict)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
