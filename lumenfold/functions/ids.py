"""Identifier rules of missions and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefix of each mission's catalog.
PREFIXES = {"kepler": "KIC", "k2": "EPIC", "tess": "TIC", "vsx_tess": "TIC"}


def with_mission(ident: Column, mission: Column) -> Column:
    """A bare number with its mission's catalog name before it; anything else as it is."""
    m = F.lower(mission)
    name = F.when(m == "kepler", "KIC").when(m == "tess", "TIC")
    return F.when(ident.rlike(r"^\d+$") & name.isNotNull(), F.concat_ws(" ", name, ident)).otherwise(ident)


def first_number(ident: Column) -> Column:
    """The first run of digits, null without one."""
    return F.nullif(F.regexp_extract(ident, r"(\d+)", 1), F.lit(""))


def prefixed(ident: Column, mission: str) -> Column:
    """PREFIX_number by the mission's catalog, null without digits."""
    return F.concat(F.lit(f"{PREFIXES[mission.lower()]}_"), first_number(ident))


def is_canonical(ident: Column) -> Column:
    return ident.rlike(r"^[A-Z]+_\d+$")


def tic_number(ident: Column) -> Column:
    """Digits after TIC_, null without them."""
    return F.nullif(F.regexp_extract(ident, r"TIC_(\d+)", 1), F.lit(""))


def clean_tic(ident: Column) -> Column:
    return F.concat(F.lit("TIC_"), F.coalesce(tic_number(ident), F.lit("MISSING")))


def composite(*parts: Column | str) -> Column:
    return F.concat_ws("_", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def declination_file(dec: Column) -> Column:
    """Name of the two-degree catalog slice that a declination falls into."""
    low = F.floor(dec / 2) * 2
    side = lambda v: F.format_string("%02d_00%s", F.abs(v), F.when(v >= 0, "N").otherwise("S"))
    return F.concat(F.lit("tic_dec"), side(low), F.lit("__"), side(low + 2), F.lit(".csv.gz"))


def needed_slices(df: DataFrame, slice_col: str, first: int | None = None) -> DataFrame:
    """Rows that fall into the catalog slices in use, or into the first of them by name."""
    names = df.select(slice_col).distinct()
    return df.join(names.orderBy(slice_col).limit(first) if first is not None else names, slice_col, "left_semi")
