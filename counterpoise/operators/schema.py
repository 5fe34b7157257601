"""Roles of columns, category dictionaries, and checks on rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from .prefix import sorted_rank


@dataclass(frozen=True)
class Roles:
    """What each column is used for; columns that are not named are ignored."""

    label: str
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    regression: bool = False

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @property
    def used(self) -> list[str]:
        return [*self.features, self.label]


def valid_rows(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows with a value in every used column and a number in every numeric one."""
    numbers = [*roles.numeric, *([roles.label] if roles.regression else [])]
    parsed = df.withColumns({c: F.col(c).try_cast("double") for c in numbers})
    return parsed.na.drop(subset=roles.used).drop(*roles.ignored)


def category_values(df: DataFrame, attributes: list[str]) -> DataFrame:
    """Distinct values per attribute: (attr, value)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("attr"), F.col(c).cast("string").alias("value")) for c in attributes]))
    return df.select(pairs.alias("p")).select("p.attr", "p.value").distinct()


def describe(df: DataFrame, roles: Roles) -> DataFrame:
    """Values of every categorical attribute (the label too unless regression) and the valid row count."""
    rows = valid_rows(df, roles)
    attributes = roles.categorical + ([] if roles.regression else [roles.label])
    n = rows.agg(F.count(F.lit(1))).scalar()
    return category_values(rows, attributes).withColumn("n_rows", n)


def dictionary(df: DataFrame, attributes: list[str]) -> DataFrame:
    """(attr, value, code) with codes from 0 in value order; a domain may outgrow one task."""
    values = category_values(df, attributes).where(F.col("value").isNotNull())
    return sorted_rank(values, ["value"], ["attr"], out="code").withColumn("code", F.col("code").cast("int"))


def encode_categories(df: DataFrame, attributes: list[str], codes: DataFrame) -> DataFrame:
    """Replace values by codes; a value the dictionary lacks becomes -1."""
    for attr in attributes:
        part = codes.where(F.col("attr") == attr).select(F.col("value").alias("_v"), F.col("code").alias("_c"))
        df = df.join(part, F.col(attr).cast("string") == F.col("_v"), "left")
        df = df.withColumn(attr, F.coalesce("_c", F.lit(-1))).drop("_v", "_c")
    return df


def decode_categories(df: DataFrame, attributes: list[str], codes: DataFrame) -> DataFrame:
    """Replace codes by values; a missing or unknown code becomes 'unknown'."""
    for attr in attributes:
        part = codes.where(F.col("attr") == attr).select(F.col("value").alias("_v"), F.col("code").alias("_c"))
        df = df.join(part, F.col(attr) == F.col("_c"), "left")
        df = df.withColumn(attr, F.coalesce("_v", F.lit("unknown"))).drop("_v", "_c")
    return df


def subset(df: DataFrame, attr: str, op: str, value) -> DataFrame:
    """Rows whose attribute equals, is below, or is at least ``value``."""
    tests = {"eq": F.col(attr) == value, "lt": F.col(attr) < value, "ge": F.col(attr) >= value}
    return df.where(tests[op])


def contained(rows: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``rows`` that occur in ``table``, missing values matching missing values."""
    other = table.select(*[F.col(c).alias(f"_{c}") for c in columns])
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(other, on, "left_semi")


def labels(df: DataFrame, roles: Roles) -> DataFrame:
    return df.select(roles.label)


def features(df: DataFrame, roles: Roles) -> DataFrame:
    return df.select(*roles.features)
