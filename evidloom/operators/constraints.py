"""Checks of tables: each returns the rows that violate it, so an empty result means that it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """A table violates a constraint."""


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n) of every key that occurs more than once; null keys count as equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_targets(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not null and has no target."""
    known = target.select(F.col(key).alias("_target")).where("_target is not null").distinct()
    return df.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_target"), "left_anti")


def outside(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is null or not in the list."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(values))


def not_matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose value is null or does not match the whole pattern."""
    return df.where(F.col(column).isNull() | ~F.col(column).rlike(rf"^(?:{pattern})\z"))


def failing(df: DataFrame, **checks: Column) -> DataFrame:
    """(columns..., violations): the rows that fail any check, with the names of those failed; null fails."""
    names = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    return df.withColumn("violations", names).where(F.size("violations") > 0)


def bijection(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys..., problem): keys that only one side has, and keys whose other columns differ (nulls being equal)."""
    a = left.select(*keys, F.struct(*columns).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(*keys, F.struct(*columns).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, keys, "full")
    same = reduce(lambda x, y: x & y, (F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in columns), F.lit(True))
    problem = F.when(F.col("_in_b").isNull(), "only_left").when(F.col("_in_a").isNull(), "only_right").when(~same, "differs")
    return both.withColumn("problem", problem).where("problem is not null").select(*keys, "problem")


def require(violations: DataFrame, message: str) -> None:
    """Raise unless there is no violation; looks at one row only."""
    first = violations.limit(1).collect()
    if first:
        raise ConstraintError(f"{message}: {first[0].asDict()}")


def field_set(payload_fields: list[str], wanted: list[str]) -> list[str]:
    """What is wrong with a set of field names: missing and unexpected ones."""
    return [f"missing {f}" for f in wanted if f not in payload_fields] + [f"unexpected {f}" for f in payload_fields if f not in wanted]


def safe_relative_path(path: Column) -> Column:
    """Whether a path is relative, has no parent step and no part that looks like a secret, database or log."""
    bad = r"(?i)^(\.env.*|.*(secret|password|credential|id_rsa|private[_-]?key).*|.*\.(pem|key|p12|pfx|db|sqlite3?|log))$"
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.coalesce(~path.rlike(r"^(/|\\|[A-Za-z]:)") & ~F.exists(parts, lambda p: (p == "..") | p.rlike(bad)) & (F.trim(path) != ""), F.lit(False))


def url_check(url: Column, status: Column, location: Column, error: Column, official: str) -> Column:
    """(result, reason) of a checked address: PASS, WARN or FAIL."""
    https = url.rlike(r"^https://[^\s/]+(/\S*)?$")
    host = F.lower(F.regexp_extract(url, r"^https://([^/:?#]+)", 1))
    trusted = host.rlike(official)
    moved = status.between(300, 399)
    near = location.rlike(r"^https://") | location.rlike("^/")
    result = F.when(~https, F.struct(F.lit("FAIL"), F.lit("invalid_url"))).when(~trusted, F.struct(F.lit("FAIL"), F.lit("not_official")))
    result = result.when(error.isNotNull() & (error != ""), F.struct(F.lit("WARN"), F.lit("unreachable"))).when(status.between(200, 299), F.struct(F.lit("PASS"), F.lit("ok")))
    result = result.when(moved & near, F.struct(F.lit("PASS"), F.lit("redirect"))).when(moved, F.struct(F.lit("WARN"), F.lit("odd_redirect")))
    result = result.when(status.isin(401, 403, 405, 429), F.struct(F.lit("WARN"), F.lit("blocked"))).otherwise(F.struct(F.lit("FAIL"), F.lit("bad_status")))
    return result.cast("struct<result:string,reason:string>")


# What an error is called and how a command ends on it.
EXIT_CODES = {"ok": 0, "blocked": 1, "usage": 2, "missing_input": 3, "unsupported_type": 4, "too_large": 5, "parse_failed": 6, "constraint": 7, "ledger": 8, "output_exists": 9, "pdf_library_missing": 10, "internal": 70}


def error_code(error: BaseException) -> str:
    """The name of an error, one of EXIT_CODES."""
    known = {"ConstraintError": "constraint", "LedgerError": "ledger", "FileNotFoundError": "missing_input", "FileExistsError": "output_exists", "ValueError": "usage"}
    name = next((known[k.__name__] for k in type(error).__mro__ if k.__name__ in known), "internal")
    return str(error) if str(error) in EXIT_CODES else name


def exit_code(error: BaseException) -> int:
    return EXIT_CODES[error_code(error)]
