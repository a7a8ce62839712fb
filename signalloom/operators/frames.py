"""Reshaping and comparing frames: recoding, typing, provenance, unions, equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recode(column: str, mapping: dict[str, str]) -> Column:
    """Values by a map; those it lacks stay as they are."""
    made = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return F.coalesce(F.try_element_at(made, F.col(column)), F.col(column))


def canonical(df: DataFrame, types: dict[str, str], extra: Sequence[str] = ()) -> DataFrame:
    """The named columns in their types: texts trimmed, empty ones null, what doesn't parse null; columns that are missing are null."""
    def one(name: str, kind: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast(kind).alias(name)
        if kind == "string":
            text = F.trim(F.col(name).cast("string"))
            return F.when(text != "", text).alias(name)
        return F.col(name).try_cast(kind).alias(name)

    return df.select(*(one(n, k) for n, k in types.items()), *extra)


def without_operational(df: DataFrame, operational: Sequence[str]) -> DataFrame:
    """What a result says, without how it came about: cache states, timings."""
    return df.drop(*operational)


def prefixed(df: DataFrame, prefix: str, names: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({n: prefix + n for n in names})


def with_literals(df: DataFrame, **values) -> DataFrame:
    """Provenance columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def price_window_end(end: Column, horizons: Sequence[int], slack: int) -> Column:
    """Last calendar day of prices that the longest horizon may need: three days a session, and some slack."""
    return F.date_add(end, 3 * max(horizons) + slack)


def subset_tags(rules: dict[str, Column]) -> Column:
    """Names of the subsets a row belongs to, in order."""
    return F.filter(F.array(*(F.when(ok, name) for name, ok in rules.items())), lambda x: x.isNotNull())


#: Numeric types, each wider than those before it.
_WIDER = ("tinyint", "smallint", "int", "bigint", "float", "double")


def relaxed_union(*parts: DataFrame) -> DataFrame:
    """Union by name: a column that a frame lacks is null, and numbers take the widest of their types. Other types that differ are an error."""
    kinds: dict[str, str] = {}
    for df in parts:
        for name, kind in df.dtypes:
            had = kinds.setdefault(name, kind)
            if had != kind:
                if had not in _WIDER or kind not in _WIDER:
                    raise ValueError(f"no common type for {name}: {had}, {kind}")
                wide = max(had, kind, key=_WIDER.index)
                # A float can't hold every whole number of 32 bits and more.
                kinds[name] = "double" if wide == "float" and {had, kind} & {"int", "bigint"} else wide
    cast = [df.select(*(F.col(n).cast(kinds[n]).alias(n) for n in df.columns)) for df in parts]
    out = cast[0]
    for df in cast[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def map_equality(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys that only one side holds, keys whose values differ, and whether the maps are equal. Keys must be unique."""
    a = left.select(F.col(key).alias("_a"), F.col(value).alias("_x"))
    b = right.select(F.col(key).alias("_b"), F.col(value).alias("_y"))
    joined = a.join(b, F.col("_a") == F.col("_b"), "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    differing = both & ~F.col("_x").eqNullSafe(F.col("_y"))
    count = lambda c: F.count(F.when(c, 1))
    return joined.agg(count(F.col("_a").isNull()).alias("only_right"), count(F.col("_b").isNull()).alias("only_left"), count(differing).alias("differing"), (count(~both | differing) == 0).alias("equal"))


def row_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many rows, repeated ones counted, only either side holds; both zero where the frames are equal as row sets."""
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError("frames have different columns")
    right = right.select(*left.columns)
    return left.exceptAll(right).agg(F.count("*").alias("left_rows")).crossJoin(right.exceptAll(left).agg(F.count("*").alias("right_rows")))


def zipped(left: DataFrame, right: DataFrame, key: str, check: Sequence[str]) -> DataFrame:
    """Rows of two frames side by side by identity; a row without partner or with another value in a checked column fails when it runs."""
    named = right.select(F.col(key).alias("_key"), *(F.col(c).alias(f"other_{c}") for c in right.columns if c != key))
    joined = left.join(named, F.col(key) == F.col("_key"), "full")
    same = F.col(key).isNotNull() & F.col("_key").isNotNull()
    for c in check:
        same = same & F.col(c).eqNullSafe(F.col(f"other_{c}"))
    ok = F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("frames don't line up at "), F.coalesce(F.col(key), F.col("_key")).cast("string"))).cast("boolean"))
    return joined.withColumn("_ok", ok).where("_ok").drop("_ok", "_key")
