"""Schema reconciliation: column aliases, a type lattice over files, and rows brought to one schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Canonical columns with the physical names that stand for them; of a name listed twice the later counts.
ALIASES = {
    "id": ["id", "source_id", "ID", "id_objeto", "oid"],
    "mission_id": ["id_mision"],
    "mission": ["mission", "mision"],
    "start_date": ["fecha_inicio"],
    "end_date": ["fecha_fin"],
    "label_source": ["origen_etiqueta"],
    "clase_variable": ["clase_variable", "variable_class"],
    "clase_variable_normalizada": ["clase_variable_normalizada", "normalized_class"],
    "period": ["period", "PERIOD", "period_days", "period_day"],
    "amplitude": ["amplitude", "AMPLITUDE", "ampli", "ampli_max"],
    "ra": ["ra", "RA", "ra_deg"],
    "dec": ["dec", "DEC", "dec_deg"],
    "flux": ["flux"],
    "flux_err": ["flux_err", "error"],
    "mag": ["mag", "magnitud"],
    "mag_err": ["mag_err", "magerr"],
    "magzp": ["magzp"],
    "magzprms": ["magzprms"],
    "limitmag": ["limitmag"],
    "airmass": ["airmass"],
    "cadenceno": ["cadenceno"],
    "quality": ["quality", "sap_quality"],
    "fcor": ["fcor"],
    "cbv01": ["cbv01"],
    "cbv02": ["cbv02"],
    "cbv03": ["cbv03"],
    "cbv04": ["cbv04"],
    "cbv05": ["cbv05"],
    "cbv06": ["cbv06"],
    "bkg": ["bkg", "sap_bkg"],
    "bkg_err": ["sap_bkg_err"],
    "centroid_col": ["centroid_col"],
    "centroid_row": ["centroid_row"],
    "sap_flux": ["sap_flux"],
    "sap_flux_err": ["sap_flux_err"],
    "pdcsap_flux": ["pdcsap_flux"],
    "pdcsap_flux_err": ["pdcsap_flux_err"],
    "psf_centr1": ["psf_centr1"],
    "psf_centr1_err": ["psf_centr1_err"],
    "psf_centr2": ["psf_centr2"],
    "psf_centr2_err": ["psf_centr2_err"],
    "mom_centr1": ["mom_centr1"],
    "mom_centr1_err": ["mom_centr1_err"],
    "mom_centr2": ["mom_centr2"],
    "mom_centr2_err": ["mom_centr2_err"],
    "pos_corr1": ["pos_corr1"],
    "pos_corr2": ["pos_corr2"],
    "band": ["band", "filtercode"],
    "tiempo": ["tiempo", "mjd", "HJD", "hjd", "time"],
    "time": ["time", "HJD", "MJD", "hjd", "mjd", "tiempo"],
    "timecorr": ["timecorr"],
    "field": ["field"],
    "filefracday": ["filefracday"],
    "catflags": ["catflags"],
    "ccdid": ["ccdid"],
    "chi": ["chi"],
    "clrcoeff": ["clrcoeff"],
    "clrcounc": ["clrcounc"],
    "expid": ["expid"],
    "exptime": ["exptime"],
    "programid": ["programid"],
    "qid": ["qid"],
    "sharp": ["sharp"],
    "source_dataset": ["source_dataset"],
}
CANONICAL = {alias: name for name, aliases in ALIASES.items() for alias in aliases}


def canonical(name: str) -> str:
    return CANONICAL.get(name, name)


def find_column(names: Iterable[str], logical: str) -> str | None:
    """The physical column for a logical one: itself, an alias of it, or of the canonical name that it is an alias of."""
    have = list(names)
    for known in (logical, *ALIASES.get(logical, []), *ALIASES.get(canonical(logical), []), canonical(logical)):
        if known in have:
            return known
    return None


def canonicalize(df: DataFrame) -> DataFrame:
    """Columns under canonical names; several of one name become the first non-null of each row, after the others."""
    target: dict[str, list[str]] = {}
    for c in df.columns:
        target.setdefault(canonical(c), []).append(c)
    single = [F.col(f"`{cs[0]}`").alias(n) for n, cs in target.items() if len(cs) == 1]
    return df.select(*single, *(coalesce_columns(df, cs).alias(n) for n, cs in target.items() if len(cs) > 1))


def coalesce_columns(df: DataFrame, columns: list[str]) -> Column:
    """First value of each row that is neither null nor NaN, left to right."""
    kinds = {c: df.schema[c].dataType for c in columns}
    common = _join(kinds.values())
    clean = [F.nanvl(F.col(c), F.lit(None).cast(k)) if isinstance(k, T.DoubleType | T.FloatType) else F.col(c) for c, k in kinds.items()]
    return F.coalesce(*(c.cast(common) for c in clean))


def _join(kinds: Iterable[T.DataType]) -> T.DataType:
    """Upper bound of types: string over double (which takes all numbers) over boolean over timestamp; else string."""
    kinds = list(kinds)
    if any(isinstance(k, T.StringType) for k in kinds):
        return T.StringType()
    if all(isinstance(k, T.ArrayType | T.MapType | T.StructType) for k in kinds) and len({k.simpleString() for k in kinds}) == 1:
        return kinds[0]
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return T.LongType()
    if all(isinstance(k, T.NumericType) for k in kinds):
        return T.DoubleType()
    for one in (T.BooleanType, T.TimestampType, T.TimestampNTZType):
        if all(isinstance(k, one) for k in kinds):
            return one()
    return T.StringType()


def resolve_schema(schemas: Iterable[T.StructType]) -> T.StructType:
    """One schema for all: canonical columns in order of appearance with the upper bound of their types. Reads no rows."""
    found: dict[str, list[T.DataType]] = {}
    for s in schemas:
        for f in s.fields:
            found.setdefault(canonical(f.name), []).append(f.dataType)
    return T.StructType([T.StructField(n, _join(k)) for n, k in found.items()])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the columns of schema: missing ones null, values that do not cast null."""
    have = set(df.columns)
    return df.select(*((F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))


def unify(frames: list[DataFrame]) -> DataFrame:
    """Union of frames of any schemas under one resolved schema."""
    named = [canonicalize(d) for d in frames]
    schema = resolve_schema(d.schema for d in named)
    out = conform(named[0], schema)
    for d in named[1:]:
        out = out.unionByName(conform(d, schema))
    return out


def backfill_labels(df: DataFrame, raw: str, normalized: str) -> DataFrame:
    """Either label column from the other where it is missing; rows without both go."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    have = [c for c in (raw, normalized) if c in df.columns]
    if not have:
        raise ValueError(f"neither {raw} nor {normalized} is there")
    first = df
    for c in (raw, normalized):
        if c not in have:
            first = first.withColumn(c, F.lit(None).cast("string"))
    both = first.select("*", F.coalesce(blank(raw), blank(normalized)).alias("_raw"), F.coalesce(blank(normalized), blank(raw)).alias("_norm"))
    return both.filter(F.col("_raw").isNotNull()).withColumn(raw, F.col("_raw")).withColumn(normalized, F.col("_norm")).drop("_raw", "_norm")


def require(df: DataFrame, needed: Iterable[str], instead: dict[str, str] | None = None) -> None:
    """Raise unless every needed column, or what may stand instead of it, is there."""
    missing = [c for c in needed if c not in df.columns and (instead or {}).get(c) not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def coordinate_columns(names: Iterable[str], order: tuple[tuple[str, str], ...] = (("tic_ra", "tic_dec"), ("ra", "dec"))) -> tuple[str, str]:
    """The first pair of coordinate columns that is there."""
    have = set(names)
    for pair in order:
        if have.issuperset(pair):
            return pair
    raise ValueError("no coordinate columns")
