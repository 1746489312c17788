"""Schema checks and strict casts: what isn't exactly of a kind is an error, never a guess."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column sets that may name the original recording; the first that is wholly present does.
IDENTITY_SETS = (("recording_group",), ("parquet_file", "row_group", "row_in_group"), ("archive_path", "archive_member"), ("audio_sha256",), ("source_path",))


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    """df, or ValueError naming all missing columns."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")
    return df


def identity_columns(df: DataFrame) -> list[str]:
    """The columns that identify the original recording."""
    for names in IDENTITY_SETS:
        if set(names) <= set(df.columns):
            return list(names)
    raise ValueError("no column set identifies the original recording")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column) -> Column:
    """Trimmed text; blank text is null."""
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def normal(c: str | Column) -> Column:
    """Trimmed lower-case text; blank text is null."""
    return F.lower(blank_to_null(c))


def strict_bool(c: str | Column, what: str = "boolean") -> Column:
    """true or false from those two words in any case; anything else is an error."""
    text = F.lower(F.trim(col(c).cast("string")))
    return F.when(text == "true", True).when(text == "false", False).otherwise(F.raise_error(F.concat(F.lit(f"not a {what}: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def strict_int(c: str | Column, what: str = "integer") -> Column:
    """A whole number; 1.5, NaN, blank and null are errors."""
    number = col(c).cast("string").try_cast("double")
    fine = number.isNotNull() & ~F.isnan(number) & (number == F.floor(number))
    return F.when(fine, number.cast("long")).otherwise(F.raise_error(F.concat(F.lit(f"not an {what}: "), F.coalesce(col(c).cast("string"), F.lit("null")))).cast("long"))


def finite(c: str | Column, what: str = "value") -> Column:
    """The number as a double; null, NaN and infinities are errors."""
    number = col(c).cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(~bad, number).otherwise(F.raise_error(F.lit(f"{what} is not finite")).cast("double"))


def adapt(df: DataFrame, columns: dict[str, str | Column], constants: dict[str, object] | None = None) -> DataFrame:
    """A table in a common layout: new name -> old name or expression, and constant columns."""
    return df.select(*[col(c).alias(n) for n, c in columns.items()], *[F.lit(v).alias(n) for n, v in (constants or {}).items()])


def starts_with_any(c: str | Column, prefixes: Iterable[str]) -> Column:
    """Whether the text begins with one of the prefixes; null and no prefixes: false."""
    out = F.lit(False)
    for p in prefixes:
        out = out | F.coalesce(col(c).startswith(p), F.lit(False))
    return out


def contains_key(value: object, forbidden: set[str]) -> bool:
    """Whether a nested configuration has one of the keys or text values (lower case) anywhere."""
    if isinstance(value, dict):
        return any(str(k).lower() in forbidden or contains_key(v, forbidden) for k, v in value.items())
    if isinstance(value, list | tuple):
        return any(contains_key(v, forbidden) for v in value)
    return isinstance(value, str) and value.lower() in forbidden
