"""Catalogs and curves from Parquet, CSV, text, JSON and HTML files, as lazy DataFrames."""

from __future__ import annotations

import fnmatch
import re
from typing import Protocol

import pandas as pd
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import unify

CURVE_POINTS = "array<struct<mjd: double, mag: double, magerr: double>>"
#: A cell behind its comma: in quotes, where quotes are doubled, or up to the next comma.
CELL = r',(\s*"(?:[^"]|"")*"\s*|[^,]*)'
CURVE_JSON = f"map<string, struct<meta: struct<filter: string>, lc: {CURVE_POINTS}>>"


def read_parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """One relation over all paths; only the columns asked for are read."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    return df.select(*columns) if columns else df


def read_mixed(spark: SparkSession, *paths: str) -> DataFrame:
    """Files whose columns and types differ, under one resolved schema; corrupt files are passed over, see scan_report."""
    reader = spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true")
    return unify([reader.parquet(p) for p in paths])


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path and bytes of every file below root whose name fits, empty ones too; from the file system's listing alone."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(root)
    found, rows = folder.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(folder, True), []
    while found.hasNext():
        f = found.next()
        if fnmatch.fnmatch(f.getPath().getName(), glob):
            rows.append((f.getPath().toString(), f.getLen()))
    return spark.createDataFrame(rows, "path string, bytes long")


def _plain_path(path: Column) -> Column:
    """A path without its scheme, as listings and scans spell schemes in different ways."""
    return F.regexp_replace(path, "^[a-z0-9]+:/+", "/")


def scan_report(spark: SparkSession, *paths: str) -> DataFrame:
    """path, bytes, n_rows, checksum and state of each Parquet file that read_mixed would read: valid, empty (no bytes) or
    corrupt (not a row could be read). The checksum reads all columns, as damage may lie in any."""
    reader, read, files = spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true"), None, None
    for p in paths:
        df = reader.parquet(p)
        part = df.select(_plain_path(F.col("_metadata.file_path")).alias("_path"), F.xxhash64(*df.columns).alias("_x"))
        listed = list_files(spark, p, "*.parquet")
        read = part if read is None else read.unionByName(part)
        files = listed if files is None else files.unionByName(listed)
    counts = read.groupBy("_path").agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor("_x").alias("checksum"))
    joined = files.distinct().join(counts, _plain_path(F.col("path")) == F.col("_path"), "left").drop("_path")
    state = F.when(F.col("bytes") == 0, "empty").when(F.col("n_rows").isNull(), "corrupt").otherwise("valid")
    return joined.withColumn("state", state).withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def open_file(path: str):
    """A file in any store that pyarrow's file systems open, for tasks."""
    fs, inside = pyarrow.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pyarrow.fs.LocalFileSystem(), path)
    return fs.open_input_file(inside)


def parquet_footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, rows, row groups and columns of each file; tasks read the footers alone, one row a file."""

    def run(parts):
        for part in parts:
            out = []
            for path in part["path"]:
                with open_file(path) as f:
                    m = pq.read_metadata(f)
                out.append((path, m.num_rows, m.num_row_groups, m.num_columns))
            yield pd.DataFrame(out, columns=["path", "n_rows", "n_row_groups", "n_columns"])

    named = spark.createDataFrame([(p,) for p in paths], "path string")
    return named.repartition(max(1, min(len(paths), 200))).mapInPandas(run, "path string, n_rows long, n_row_groups long, n_columns long")


def read_row_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Rows start <= position < stop of each Parquet file, by its own numbering; row groups outside need not be decoded."""
    at = F.col("_metadata.row_index")
    return spark.read.parquet(path).filter((at >= start) & (at < stop))


def read_catalog(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    return spark.read.csv(path, header=True, comment=comment, inferSchema=False)


def read_k2_catalog(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """EPIC_ID and K2_TYPE of a catalog without header; rows without either go."""
    columns = "EPIC_ID string, K2_TYPE string, RANGE_PCT string, PERIOD_DAYS string, AMPLITUDE_PCT string, PROPOSAL_INFO string, AMP_ERR1 string, AMP_ERR2 string"
    df = spark.read.schema(columns).csv(path).select(F.col("EPIC_ID").try_cast("long").alias("EPIC_ID"), "K2_TYPE").na.drop()
    return df.limit(limit * 10) if limit else df


def read_tic_slices(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """tic_id, tic_ra and tic_dec (columns 0, 13, 14) of gzip catalog slices; Spark reads each file in one task, and
    partitions spreads its rows. read_tic_members() reads files member by member."""
    schema = ", ".join(f"_c{i} string" for i in range(15))
    df = _tic_columns(spark.read.schema(schema).csv(path))
    return df.repartition(partitions) if partitions else df


def _tic_columns(df: DataFrame) -> DataFrame:
    return df.select(F.col("_c0").try_cast("long").alias("tic_id"), F.col("_c13").try_cast("double").alias("tic_ra"), F.col("_c14").try_cast("double").alias("tic_dec")).na.drop()


def read_tic_members(spark: SparkSession, root: str, glob: str = "*.csv.gz", partitions: int | None = None) -> DataFrame:
    """The same rows as read_tic_slices from a folder: members of a file are inflated by tasks of their own, and lines
    are parsed by partitions tasks whatever the number of files."""
    from .gzip_lines import gzip_lines

    schema = ", ".join(f"_c{i} string" for i in range(15))
    lines = gzip_lines(spark, root, glob, partitions)
    return _tic_columns(lines.select(F.from_csv("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*"))


def file_stem() -> Column:
    return F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")


def read_dat(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated curve files: eight columns, # comments, the object's id in the file name."""
    names = ["time", "camera", "mag", "mag_err", "flux", "flux_err", "fwhm", "image"]
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.translate(file_stem(), "_", " ").alias("id"))
    cells = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#")).select("id", F.split("line", r"\s+").alias("c")).filter(F.size("c") >= len(names))
    typed = {"camera": "string", "mag": "string", "image": "string"}
    return cells.select("id", *(F.col("c")[i].try_cast(typed.get(n, "double")).alias(n) for i, n in enumerate(names)))


def votable_rows(text: Column) -> Column:
    """Lines of the CDATA section of a document, without the header line."""
    body = F.regexp_extract(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", 1)
    return F.filter(F.transform(F.split(body, r"\r?\n"), F.trim), lambda x: x != "")


def read_votable_csv(spark: SparkSession, path: str, schema: str = "ID string, RAJ2000 double, DEJ2000 double, Type string") -> DataFrame:
    """Rows of a semicolon-separated table inside a CDATA section."""
    whole = spark.read.text(path, wholetext=True).select(votable_rows(F.col("value")).alias("lines"))
    rows = whole.select(F.explode(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"))
    return rows.select(F.from_csv("line", schema, {"sep": ";", "mode": "PERMISSIVE"}).alias("r")).select("r.*")


def curve_files(spark: SparkSession, root: str) -> DataFrame:
    """stem, header and cells of every line of the small CSV files below root, each with the header of its own file.

    Header names are lower-cased, white space and quotes around cells go; empty files have no lines."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(root, wholetext=True)
    lines = whole.select(file_stem().alias("stem"), F.split("value", r"\r?\n").alias("lines"))
    # commas inside quotes do not separate cells
    cells = lambda line: F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1)), lambda x: F.regexp_replace(x, r'^[\s"]+|[\s"]+$', ""))
    split = lines.select("stem", F.transform(cells(F.col("lines")[0]), F.lower).alias("header"), F.explode(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"))
    return split.filter(F.trim("line") != "").select("stem", "header", cells(F.col("line")).alias("cells"))


def cell(name: str) -> Column:
    """The number in the column name of a line of curve_files, null where its file has no such column."""
    at = F.array_position("header", name)
    return F.when(at > 0, F.get("cells", (at - 1).cast("int"))).try_cast("double")


def read_named_curves(spark: SparkSession, root: str) -> DataFrame:
    """Curve files mission_id_meta_flux_date.csv any folders down, columns by each file's header; other names are passed over."""
    named = curve_files(spark, root).withColumn("_parts", F.split("stem", "_")).filter(F.size("_parts") >= 5)
    return named.select(F.concat_ws("_", F.slice("_parts", 1, 3)).alias("id_objeto"), F.col("_parts")[0].alias("mision"), F.col("_parts")[1].alias("id_mision"), cell("time").alias("tiempo"), cell("flux").alias("magnitud"), cell("flux_err").alias("error"))


def read_object_curves(spark: SparkSession, root: str, catalog: DataFrame, key: str = "source_id") -> DataFrame:
    """CSV curves named after their object, with HJD or hjd, columns by each file's header, joined to its catalog row;
    missing columns are null, rows without time go. Of repeated keys in the catalog the smallest row counts."""
    curves = curve_files(spark, root).select(F.col("stem").alias(key), cell("hjd").alias("tiempo"), cell("mag").alias("magnitud"), cell("mag_err").alias("error"), cell("flux").alias("flux"), cell("flux_err").alias("flux_err"))
    rest = [c for c in catalog.columns if c != key]
    one = catalog.groupBy(F.col(key).cast("string").alias(key)).agg(F.min(F.struct(*rest)).alias("_c")).select(key, *(F.col("_c")[c].alias(c) for c in rest)) if rest else catalog.select(F.col(key).cast("string").alias(key)).distinct()
    return curves.join(one, key).filter(F.col("tiempo").isNotNull())


def file_report(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """path and bytes of every file, and whether it is empty (zero bytes)."""
    return list_files(spark, root, glob).withColumn("is_empty", F.col("bytes") == 0)


def checked_files(spark: SparkSession, root: str, schema: str, class_col: str, classes: list[str], glob: str = "*.csv") -> DataFrame:
    """path, bytes, n_valid, n_corrupt, n_other_class, checksum and state of every CSV file below root: empty (no bytes), corrupt (a
    row that does not fit the schema), other_class (no row of the target classes) or valid."""
    bad = "_corrupt"
    df = spark.read.schema(f"{schema}, {bad} string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).csv(root)
    state = F.when(F.col(bad).isNotNull(), "corrupt").when(F.col(class_col).isin(classes), "valid").otherwise("other_class")
    # the checksum reads all columns: a reader that skips some does not see that they are corrupt
    rows = df.select(_plain_path(F.col("_metadata.file_path")).alias("_path"), state.alias("_state"), F.xxhash64(*(c for c in df.columns if c != bad)).alias("_all"))
    counts = rows.groupBy("_path").agg(*(F.count_if(F.col("_state") == s).alias(f"n_{s}") for s in ("valid", "corrupt", "other_class")), F.bit_xor("_all").alias("checksum"))
    joined = list_files(spark, root, glob).join(counts, _plain_path(F.col("path")) == F.col("_path"), "left").drop("_path")
    joined = joined.na.fill(0, ["n_valid", "n_corrupt", "n_other_class"])
    verdict = F.when(F.col("bytes") == 0, "empty").when(F.col("n_corrupt") > 0, "corrupt").when(F.col("n_valid") == 0, "other_class").otherwise("valid")
    return joined.withColumn("state", verdict)


def read_checked(spark: SparkSession, root: str, schema: str, class_col: str, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the target classes of CSV files, and the number and checksum of rows by state: valid, corrupt, other_class.

    The checksum reads all columns: a reader that skips some would not see that they are corrupt.
    """
    bad = "_corrupt"
    df = spark.read.schema(f"{schema}, {bad} string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).csv(root)
    state = F.when(F.col(bad).isNotNull(), "corrupt").when(F.col(class_col).isin(classes), "valid").otherwise("other_class")
    marked = df.withColumn("_state", state)
    return marked.filter(F.col("_state") == "valid").drop(bad, "_state"), marked.groupBy(F.col("_state").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*(c for c in df.columns if c != bad))).alias("checksum"))


def explode_curves(df: DataFrame, json_col: str) -> DataFrame:
    """object_id, band and points of nested curve JSON; objects without points have no rows, bands without name are unknown."""
    objects = df.select(F.explode(F.from_json(json_col, CURVE_JSON)).alias("object_id", "o"))
    points = objects.filter(F.size("o.lc") > 0).select("object_id", F.coalesce("o.meta.filter", F.lit("unknown")).alias("band"), F.explode("o.lc").alias("p"))
    return points.select("object_id", "band", "p.mjd", "p.mag", "p.magerr")


def links(html: Column, pattern: str = r"href=\"([^\"]*)\"") -> Column:
    """All link targets of a page that the pattern's group takes."""
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def object_links(html: Column, text: str) -> Column:
    """Targets /variables/<uuid> of the anchors of a page whose text is exactly text."""
    quoted = re.sub(r"([^\w\s])", r"\\\1", text)
    return F.regexp_extract_all(html, F.lit(rf'<a\b[^>]*href="(/variables/[0-9a-fA-F-]{{36}})"[^>]*>\s*{quoted}\s*</a>'), F.lit(1))


class CurveSource(Protocol):
    """Where curves of objects come from; sources are asked in order of preference."""

    def curves(self, objects: DataFrame) -> DataFrame: ...


def first_source(objects: DataFrame, key: str, sources: list[DataFrame]) -> DataFrame:
    """For each object the rows of the first source (key first) that has it."""
    ranked = None
    for i, s in enumerate(sources):
        part = s.withColumn("_source", F.lit(i))
        ranked = part if ranked is None else ranked.unionByName(part, allowMissingColumns=True)
    best = ranked.groupBy(key).agg(F.min("_source").alias("_source"))
    return ranked.join(best, [key, "_source"]).join(objects.select(key).distinct(), key, "left_semi").drop("_source")


def prefetched(normalize: bool, df: DataFrame, key: str, value: str) -> DataFrame:
    """Curves without NaN; with normalize divided by their median."""
    from ..operators.curves import normalize_by_median

    clean = df.filter(~F.isnan(value) & F.col(value).isNotNull())
    return normalize_by_median(clean, key, value) if normalize else clean
