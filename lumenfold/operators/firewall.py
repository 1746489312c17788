"""The consumed-data firewall: locked tokens, forbidden hashes, and rows that may not be read again."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PATH_LIKE = re.compile("path|file|dir|root|source|manifest|archive", re.IGNORECASE)
_HASH_LIKE = re.compile("sha256|hash|digest", re.IGNORECASE)


def compact(value: str) -> str:
    """Lower case without anything but a-z and 0-9."""
    return re.sub("[^a-z0-9]", "", value.lower())


def compacted(column: Column) -> Column:
    return F.regexp_replace(F.lower(column), "[^a-z0-9]", "")


def locked(column: Column, tokens: list[str]) -> Column:
    """Whether the compacted text holds a compacted token; null holds none."""
    pattern = "|".join(re.escape(t) for t in sorted({compact(t) for t in tokens} - {""}))
    return F.coalesce(compacted(column.cast("string")).rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def locked_rows(df: DataFrame, tokens: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows in which any of the columns (default: all, joined) holds a locked token."""
    if columns is None:
        return df.where(locked(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]), tokens))
    return df.where(reduce(lambda a, b: a | b, [locked(F.col(c), tokens) for c in columns]))


def reject_locked_path(path: str, tokens: list[str]) -> Path:
    """The path, unless it or what its links lead to holds a locked token."""
    for p in (Path(path), Path(path).resolve()):
        if any(compact(t) in compact(str(p)) for t in tokens):
            raise ValueError(f"locked path: {path}")
    return Path(path)


def forbidden_rows(df: DataFrame, column: str, forbidden: DataFrame, forbidden_column: str = "sha256") -> DataFrame:
    """Rows whose hash (trimmed, lower case) is forbidden."""
    keys = forbidden.select(F.lower(F.trim(forbidden_column)).alias("_h")).distinct()
    return df.join(keys, F.lower(F.trim(F.col(column))) == F.col("_h"), "left_semi")


def allowed_rows(df: DataFrame, column: str, forbidden: DataFrame, forbidden_column: str = "sha256") -> DataFrame:
    """The other rows; those without hash stay."""
    keys = forbidden.select(F.lower(F.trim(forbidden_column)).alias("_h")).distinct()
    return df.join(keys, F.lower(F.trim(F.col(column))) == F.col("_h"), "left_anti")


def audit_rows(df: DataFrame, tokens: list[str], forbidden: DataFrame) -> DataFrame:
    """One row: rows read, locked_rows by path-like columns, forbidden_rows by hash-like columns; 0 and 0 is clean."""
    paths = [c for c in df.columns if _PATH_LIKE.search(c) and not _HASH_LIKE.search(c)]
    hashes = [c for c in df.columns if _HASH_LIKE.search(c)]
    seen = df.agg(F.count("*").alias("rows"), F.count_if(reduce(lambda a, b: a | b, [locked(F.col(c), tokens) for c in paths], F.lit(False))).alias("locked_rows"))
    each = df.select(F.monotonically_increasing_id().alias("_id"), F.explode(F.array(*[F.col(c).cast("string") for c in hashes])).alias("_x")) if hashes else None
    bad = forbidden_rows(each, "_x", forbidden).agg(F.count_distinct("_id").alias("forbidden_rows")) if each is not None else df.sparkSession.range(1).select(F.lit(0).cast("long").alias("forbidden_rows"))
    return seen.crossJoin(bad)  # one row each


def enforce(df: DataFrame, tokens: list[str], forbidden: DataFrame) -> int:
    """The number of rows, or ValueError if any is locked or forbidden."""
    r = audit_rows(df, tokens, forbidden).first()
    if r.locked_rows or r.forbidden_rows:
        raise ValueError(f"{r.locked_rows} locked and {r.forbidden_rows} forbidden rows")
    return r.rows


def changed_keys(baseline: dict, candidate: dict) -> dict[str, tuple]:
    """Dotted path -> (before, after) of what differs between two nested configurations."""

    def flat(x: dict, at: str = "") -> dict:
        out = {}
        for k, v in x.items():
            name = f"{at}.{k}" if at else str(k)
            out |= flat(v, name) if isinstance(v, dict) and v else {name: v}
        return out

    a, b = flat(baseline), flat(candidate)
    return {k: (a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if (k in a) != (k in b) or a.get(k) != b.get(k)}


def only_allowed_changes(baseline: dict, candidate: dict, allowed: set[str]) -> None:
    """ValueError unless exactly the allowed keys differ."""
    found = set(changed_keys(baseline, candidate))
    if found != allowed:
        raise ValueError(f"unexpected: {sorted(found - allowed)}; unchanged: {sorted(allowed - found)}")
