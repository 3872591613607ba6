"""Registered queries, one for each operator, on the shared test tables, with the SQL that must give the same rows.

Floating columns are rounded to six digits on both sides. Roles of the tables: events are curves (user_id, ts, value,
event_type), lineitem with part are short curves, customer and supplier stand for sky catalogs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import ids as I
from ..functions import labels as L
from ..operators import curves as C
from ..operators import evaluate as V
from ..operators import quality as Q
from ..operators import relations as R
from ..operators.matching import nearest_on_sky
from ..sources import batches, readers, schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """t(name) is a table of the folder; t.batches(name, rows) its rows with file and number of their batch."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def batches(self, name: str, rows: int) -> DataFrame:
        return batches.read_batches(self.spark, f"{self.sf_dir}/{name}.parquet", rows=rows)


def query(sql: str | None = None):
    """Register a function of Tables under its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _s6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE AS {name}"


# Labels with known classes, used as a literal corpus.
GOLDEN = {
    "EB": "Eclipsing Binary", "DSCT|GDOR|SXPHE": "Delta Scuti", "RRC|EC": "RR Lyrae", "EC|RRC|ESD": "Eclipsing Binary", "SR|EA": "Eclipsing Binary", "EA+BY+UV": "Eclipsing Binary", "ESD|CW-FU|CW-FO|EC": "Eclipsing Binary", "CW-FU": "Variable", "ELL/DW:": "Rotational", "roAp": "Rotational", " P": "Variable", "AP": "Irregular",
    "QP": "Variable", "SRB:": "Irregular", "NL:": "Cataclysmic", "UGSU+E": "Cataclysmic", "ZZLep": "White Dwarf", "BY_DRA": "Rotational", "T Tauri": "Young Stellar Object", "GDOR": "Unknown", "OTHER": "Unknown", "-----": "Unknown", "UNKNOWN": "Unknown", "": "Unknown",
}
_CORPUS = list(GOLDEN)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CORPUS_SQL = "[" + ", ".join(map(_q, _CORPUS)) + "]"
_LABELLED_SQL = f"(SELECT p_partkey, p_type, p_brand, {_CORPUS_SQL}[(p_partkey % {len(_CORPUS)})::INTEGER + 1] AS raw FROM part)"


def _case(x: str, pairs: dict[str, str], default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in pairs.items()) + f" ELSE {default} END"


def labelled(t) -> DataFrame:
    return t("part").select("p_partkey", "p_type", "p_brand", F.array(*map(F.lit, _CORPUS))[(F.col("p_partkey") % len(_CORPUS)).cast("int")].alias("raw"))


def curves_of(t) -> DataFrame:
    return t("events").select(F.col("user_id"), "ts", "event_id", "value", "event_type")


# ---- curves

_FEATURES_SQL = f"""
    WITH a AS (SELECT user_id, count(*) AS n, avg(value) AS mu, stddev_pop(value) AS sd, quantile_cont(value, [0.25, 0.5, 0.75]) AS q, min(value) AS lo, max(value) AS hi, kurtosis_pop(value) AS k, mad(value) AS md FROM events GROUP BY user_id),
         m AS (SELECT e.user_id, avg((e.value - a.mu) * (e.value - a.mu) * (e.value - a.mu)) AS m3 FROM events e JOIN a USING (user_id) GROUP BY e.user_id)
    SELECT user_id, n, {_s6("sd", "f_std")}, {_s6("q[3] - q[1]", "f_iqr")}, {_s6("least(100.0, greatest(0.0, hi - lo))::DOUBLE", "f_amplitude")}, {_s6("q[2]", "f_median")}, {_s6("md", "f_mad")},
           {_s6("least(10.0, greatest(-10.0, m3 / (sd * sd * sd)))::DOUBLE", "f_skew")}, {_s6("least(20.0, greatest(-20.0, k))::DOUBLE", "f_kurtosis")}
    FROM a JOIN m USING (user_id)"""


@query(_FEATURES_SQL)
def curve_features(t):
    f = C.curve_features(curves_of(t), "user_id", "value")
    return f.select("user_id", "n", *(r6(c).alias(c) for c in C.FEATURES))


@query("""
    WITH x AS (SELECT l_partkey, p_type AS label, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
         s AS (SELECT l_partkey, min(CASE WHEN l_partkey % 13 = 0 THEN 'Unknown' ELSE label END) AS label, count(*) AS n, count(v) AS f, coalesce(stddev_pop(v), 0) AS sd FROM x GROUP BY l_partkey),
         r AS (SELECT CASE WHEN label = 'Unknown' THEN 'unknown_class' WHEN f = 0 THEN 'all_invalid' WHEN n < 30 THEN 'short_curve' WHEN sd < 1e-4 THEN 'low_std' ELSE 'ok' END AS status FROM s)
    SELECT status, count(*) AS n FROM r GROUP BY status""")
def curve_discard_reasons(t):
    part = t("part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_partkey") % 13 == 0, "Unknown").otherwise(F.col("p_type")).alias("label"))
    x = t("lineitem").select("l_partkey", F.when(F.col("l_partkey") % 11 != 0, F.col("l_extendedprice")).alias("v")).join(part, "l_partkey")
    s = C.curve_stats(x, "l_partkey", "v", F.min("label"))
    return Q.status_counts(s.select(C.discard_reason(s).alias("reason")), "reason")


_DIRTY = "CASE WHEN event_id % 7 = 0 THEN concat('> ', value::VARCHAR) WHEN event_id % 11 = 0 THEN 'abc' ELSE value::VARCHAR END"


@query(f"SELECT event_id, {_s6(f"try_cast(trim(replace({_DIRTY}, '>', '')) AS DOUBLE)", 'magnitude')} FROM events")
def dirty_magnitude_parse(t):
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("> "), F.col("value").cast("string"))).when(F.col("event_id") % 11 == 0, "abc").otherwise(F.col("value").cast("string"))
    return t("events").select("event_id", r6(A.parse_magnitude(text)).alias("magnitude"))


@query(f"""
    WITH x AS (SELECT event_id, user_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v FROM events),
         m AS (SELECT user_id, quantile_cont(v, 0.5) AS med FROM x GROUP BY user_id)
    SELECT event_id, {_s6("coalesce(v, med)", "imputed")} FROM x JOIN m USING (user_id)""")
def median_imputation(t):
    x = t("events").select("event_id", "user_id", F.when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    return C.impute_median(x, "user_id", "v").select("event_id", r6("imputed").alias("imputed"))


_QUARTILES = "q AS (SELECT user_id, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events GROUP BY user_id)"
_SCALED = "least(1000.0, greatest(-1000.0, CASE WHEN q[3] - q[1] > 0 THEN (value - q[2]) / (q[3] - q[1]) ELSE value - q[2] END))::DOUBLE"


@query(f"WITH {_QUARTILES} SELECT event_id, {_s6(_SCALED, 'scaled')} FROM events JOIN q USING (user_id)")
def robust_normalize(t):
    return C.normalize_robust(t("events"), "user_id", "value").select("event_id", r6("scaled").alias("scaled"))


@query(f"WITH m AS (SELECT user_id, quantile_cont(value, 0.5) AS med FROM events GROUP BY user_id) SELECT event_id, {_s6('value / med', 'normalized')} FROM events JOIN m USING (user_id)")
def median_normalize(t):
    return C.normalize_by_median(t("events"), "user_id", "value").select("event_id", r6("normalized").alias("normalized"))


@query("""
    WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
         u AS (SELECT DISTINCT user_id FROM events), p AS (SELECT user_id, unnest(range(1, 65)) AS i FROM u)
    SELECT p.user_id, p.i::INTEGER AS pos, coalesce(r.value, 0.0)::DOUBLE AS x, CASE WHEN r.i IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS m FROM p LEFT JOIN r USING (user_id, i)""")
def pad_mask(t):
    s = C.to_sequences(curves_of(t), "user_id", ["ts", "event_id"], "value", 64)
    z = s.select("user_id", F.posexplode(F.arrays_zip("sequence", "mask")).alias("pos", "z"))
    return z.select("user_id", (F.col("pos") + 1).alias("pos"), F.col("z.sequence").alias("x"), F.col("z.mask").alias("m"))


@query(f"WITH f AS ({_FEATURES_SQL}), q AS (SELECT quantile_cont(f_std, [0.25, 0.5, 0.75]) AS a, quantile_cont(f_mad, [0.25, 0.5, 0.75]) AS b FROM f) SELECT user_id, {_s6('(f_std - a[2]) / (a[3] - a[1] + 1e-8)', 'f_std')}, {_s6('(f_mad - b[2]) / (b[3] - b[1] + 1e-8)', 'f_mad')} FROM f, q")
def feature_robust_scaling(t):
    f = curve_features(t).select("user_id", "f_std", "f_mad")
    return C.scale_features(f, ["f_std", "f_mad"]).select("user_id", r6("f_std").alias("f_std"), r6("f_mad").alias("f_mad"))


@query("SELECT p_partkey, p_type, (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS label_idx FROM part")
def label_encode(t):
    return C.encode_labels(t("part").select("p_partkey", "p_type"), "p_type").select("p_partkey", "p_type", "label_idx")


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS label FROM events GROUP BY user_id")
def first_label(t):
    return C.first_label(t("events"), "user_id", "event_type", ["ts", "event_id"]).withColumnRenamed("event_type", "label")


@query(f"""
    WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey), q AS (SELECT quantile_cont(n, [0.5, 0.75, 0.9, 0.95, 0.99]) AS q, count(*) AS c, avg(n) AS a, stddev_samp(n) AS s, min(n) AS lo, max(n) AS hi FROM n)
    SELECT c AS n_curves, {_s6("a", "mean")}, {_s6("s", "std")}, lo AS min, {", ".join(_s6(f"q[{i + 1}]", f"p{p}") for i, p in enumerate((50, 75, 90, 95, 99)))}, hi AS max FROM q""")
def curve_lengths(t):
    d = C.length_distribution(t("lineitem"), "l_partkey")
    return d.select("n_curves", r6("mean").alias("mean"), r6("std").alias("std"), "min", *(r6(f"p{p}").alias(f"p{p}") for p in (50, 75, 90, 95, 99)), "max")


@query("""
    WITH x AS (SELECT l_partkey, p_type, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_quantity END AS v FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT l_partkey, min(p_type) AS p_type, count(v) AS n, coalesce(stddev_pop(v), 0) AS s FROM x GROUP BY l_partkey)
    SELECT p_type, count(*) FILTER (WHERE n > 0 AND s > 0) AS n_valid, count(*) FILTER (WHERE n = 0 OR s = 0) AS n_invalid FROM s GROUP BY p_type""")
def curve_validity(t):
    x = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_partkey", "p_type", F.when(F.col("l_partkey") % 9 != 0, F.col("l_quantity")).alias("v"))
    return C.validity_by_class(x, "l_partkey", "p_type", "v")


@query(f"""
    WITH f AS ({_FEATURES_SQL}), u AS (UNPIVOT f ON {", ".join(C.FEATURES)} INTO NAME feature VALUE x)
    SELECT feature, {_s6("avg(x)", "mean")}, {_s6("stddev_pop(x)", "std")}, min(x) AS min, max(x) AS max, 0::BIGINT AS n_nan, 0::BIGINT AS n_inf, count(*) FILTER (WHERE x = 0) AS n_zero FROM u GROUP BY feature""")
def feature_summary(t):
    s = C.feature_summary(curve_features(t), C.FEATURES)
    return s.select("feature", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max", "n_nan", "n_inf", "n_zero")


@query("SELECT event_id, min(ts) OVER (PARTITION BY user_id) AS start_time, max(ts) OVER (PARTITION BY user_id) AS end_time FROM events")
def observation_window(t):
    return C.observation_window(t("events"), "user_id", "ts").select("event_id", "start_time", "end_time")


@query("WITH n AS (SELECT user_id, event_type, count(value) AS n_points FROM events GROUP BY ALL HAVING count(value) >= 12), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS r FROM n) SELECT user_id, event_type, n_points FROM r WHERE r = 1")
def first_long_curve(t):
    return C.first_long_curve(t("events"), "user_id", "event_type", "value", 12)


@query(f"WITH c AS (SELECT user_id, least(count(*), 80) AS n FROM events GROUP BY user_id) SELECT user_id, {_s6('n / 80.0::DOUBLE', 'density')} FROM c WHERE n / 80.0 >= 0.75")
def mask_density_gate(t):
    s = C.to_sequences(curves_of(t), "user_id", ["ts", "event_id"], "value", 80).withColumn("density", A.density(F.col("mask")))
    return s.filter(F.col("density") >= 0.75).select("user_id", r6("density").alias("density"))


# ---- samples, caps, order

_ORDER_SQL = "md5(concat({0}::VARCHAR, '42'))"


@query(f"""
    WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_ORDER_SQL.format("c_custkey")}, c_custkey) AS r, floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.1::DOUBLE) AS nt, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
    SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 50 = 0 THEN 'train' WHEN r <= nt THEN 'test' WHEN r <= nt + floor((n - nt) * 0.2222::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r""")
def stratified_split(t):
    c = t("customer").select("c_custkey", "c_mktsegment")
    return R.stratified_split(c, "c_custkey", "c_mktsegment", into_train=c.filter(F.col("c_custkey") % 50 == 0))


def _cap_sql(keep: str) -> str:
    return f"WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY {_ORDER_SQL.format('p_partkey')}, p_partkey) AS r FROM part) SELECT p_partkey, p_type FROM r WHERE {keep}"


@query(_cap_sql("r <= 20"))
def class_cap(t):
    return R.cap_classes(t("part").select("p_partkey", "p_type"), "p_partkey", "p_type", 20)


@query(_cap_sql("CASE p_type WHEN 'ECONOMY' THEN TRUE WHEN 'SMALL' THEN FALSE WHEN 'LARGE' THEN r <= 2 ELSE r <= 20 END"))
def class_cap_override(t):
    return R.cap_classes(t("part").select("p_partkey", "p_type"), "p_partkey", "p_type", 20, {"ECONOMY": None, "SMALL": 0, "LARGE": 2})


@query(_cap_sql("(r <= 20 OR p_partkey % 40 = 0) AND p_type <> 'SMALL'"))
def class_cap_reinforced(t):
    p = t("part").select("p_partkey", "p_type")
    return R.cap_classes(p, "p_partkey", "p_type", 20, {"SMALL": 0}, always=p.filter(F.col("p_partkey") % 40 == 0))


@query("WITH r AS (SELECT l_partkey, l_shipdate, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_extendedprice) AS r FROM lineitem) SELECT l_partkey, l_shipdate, l_extendedprice FROM r WHERE r = 1")
def dedupe_keep_first(t):
    return R.keep_first(t("lineitem").select("l_partkey", "l_shipdate", "l_extendedprice"), ["l_partkey"], ["l_shipdate", "l_extendedprice"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderstatus = 'F', o_orderkey LIMIT 900")
def topk_flagged_first(t):
    return R.flagged_first(t("orders"), F.col("o_orderstatus") == "F", ["o_orderkey"], 900).select("o_orderkey", "o_totalprice")


@query(f"SELECT c_custkey, c_name FROM customer ORDER BY {_ORDER_SQL.format('c_custkey')}, c_custkey LIMIT 100")
def seeded_sample(t):
    return R.seeded_sample(t("customer"), "c_custkey", 100).select("c_custkey", "c_name")


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {_ORDER_SQL.format('c_custkey')}, c_custkey)::INTEGER AS pos FROM customer")
def seeded_shuffle(t):
    return R.stable_rank(t("customer").select("c_custkey"), "c_custkey", [], "pos").withColumn("pos", F.col("pos").cast("int"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type")
def class_counts_in_order(t):
    return R.counts_in_order(t("part"), "p_type")


@query(f"SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_ORDER_SQL.format('o_orderkey')}, o_orderkey) AS r FROM orders) WHERE r <= 5")
def preview_rows(t):
    return R.preview(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 5)


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def exclude_ids(t):
    gone = t("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return R.exclude(t("orders"), gone, "o_custkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_join_ids(t):
    return R.only(t("orders"), t("customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def anti_join_pending(t):
    from ..sources.writers import pending

    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return pending(o, o.filter("o_orderstatus = 'O'"), ["o_orderkey"]).select("o_orderkey", "o_custkey")


# ---- labels

@query(f"SELECT p_partkey, raw, {_case('raw', GOLDEN, 'NULL')} AS label_class FROM {_LABELLED_SQL}")
def normalize_label(t):
    return L.normalize_labels(labelled(t).select("p_partkey", "raw"), "raw", "label_class").select("p_partkey", "raw", "label_class")


@query(f"SELECT DISTINCT raw, {_case('raw', GOLDEN, 'NULL')} AS label_class, {_case('raw', GOLDEN, 'NULL')} = 'Unknown' AS is_unknown FROM {_LABELLED_SQL}")
def label_coverage_report(t):
    return L.label_coverage(labelled(t), "raw")


_TOKENS = {tok: name for name, toks in L.TOKEN_GROUPS.items() for tok in toks}
_TOKEN_SQL = "replace(replace(split_part(regexp_replace(upper(trim(raw)), '[|/+,:]', '|', 'g'), '|', 1), '-', ''), ' ', '')"


@query(f"SELECT p_partkey, CASE WHEN trim(raw) = '' THEN 'UNKNOWN' ELSE {_case(_TOKEN_SQL, _TOKENS | {'': 'UNKNOWN'}, _TOKEN_SQL)} END AS label_class FROM {_LABELLED_SQL}")
def label_v1_first_token(t):
    return labelled(t).select("p_partkey", L.first_token_class(F.col("raw")).alias("label_class"))


@query("WITH n AS (SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_partkey, CASE WHEN n < 85 THEN 'RARE' ELSE p_brand END AS label_class FROM n")
def rare_class_fold(t):
    return L.fold_rare(t("part").select("p_partkey", "p_brand"), "p_brand", 85, "label_class").select("p_partkey", "label_class")


@query(f"""SELECT p_partkey, CASE WHEN x IN ('', 'UNKNOWN', ',') THEN 'UNKNOWN' WHEN contains(x, 'ROT') THEN 'Rotational' WHEN starts_with(x, 'RS') THEN 'RS_CVn' WHEN starts_with(x, 'BY') THEN 'BY_Dra' WHEN contains(x, 'DSCT') THEN 'Delta_Scuti' WHEN contains(x, 'RR') THEN 'RR_Lyrae'
    WHEN contains(x, 'EB') OR contains(x, 'EA') OR contains(x, 'ECLIPSING') OR starts_with(x, 'E') THEN 'Eclipsing' WHEN contains(x, 'SR') OR contains(x, 'M') OR contains(x, 'LPV') OR contains(x, 'LB') THEN 'Irregular' WHEN contains(x, 'CV') OR contains(x, 'UG') OR contains(x, 'NL') THEN 'Cataclysmic'
    WHEN contains(x, 'WD') THEN 'White_Dwarf' WHEN contains(x, 'BCEP') OR contains(x, 'SPB') THEN 'Beta_Cep' WHEN contains(x, 'GDOR') THEN 'Gamma_Dor' WHEN contains(x, 'HADS') THEN 'Delta_Scuti' WHEN x IN ('S', 'L') OR contains(x, 'VAR') OR contains(x, 'MISC') THEN 'Irregular' WHEN contains(x, 'YSO') THEN 'YSO' ELSE 'RARE' END AS label_class
    FROM (SELECT p_partkey, upper(trim(raw)) AS x FROM {_LABELLED_SQL})""")
def label_v2_rules(t):
    return labelled(t).select("p_partkey", L.substring_class(F.col("raw")).alias("label_class"))


@query(f"SELECT p_partkey, {_case('raw', {r: n for n, rs in L.MERGE_MAP.items() for r in rs}, _q('Other'))} AS merged, {_case('raw', {r: n for n, rs in L.SHORT_MAP.items() for r in rs}, 'NULL')} AS short FROM {_LABELLED_SQL}")
def label_map_other(t):
    return labelled(t).select("p_partkey", L.merged_class(F.col("raw")).alias("merged"), L.short_class(F.col("raw")).alias("short"))


_ORIGIN_IDS = ["ASASSN-V J1", "ZTF123", "TIC_77", "KIC 8", "ZTF_ASASSN"]


@query("SELECT p_partkey, CASE WHEN contains(x, 'ASASSN') THEN 'ASAS-SN' WHEN contains(x, 'ZTF') THEN 'ZTF' WHEN contains(x, 'TIC_') THEN 'TESS' ELSE 'Otros' END AS origin FROM (SELECT p_partkey, [" + ", ".join(map(_q, _ORIGIN_IDS)) + "][(p_partkey % 5)::INTEGER + 1] AS x FROM part)")
def origin_from_id(t):
    return t("part").select("p_partkey", L.origin_of(F.array(*map(F.lit, _ORIGIN_IDS))[(F.col("p_partkey") % 5).cast("int")]).alias("origin"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'g' WHEN 2 THEN 'r' ELSE 'unknown' END AS band FROM part")
def band_map(t):
    return t("part").select("p_partkey", L.band_of(F.col("p_size") % 4).alias("band"))


# ---- identifiers

@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'KIC ' || c_custkey WHEN c_custkey % 3 = 1 THEN 'TIC ' || c_custkey ELSE c_name END AS ident FROM customer")
def id_prefix(t):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 2, F.col("c_name")).otherwise(k.cast("string"))
    return t("customer").select("c_custkey", I.with_mission(raw, F.when(k % 3 == 0, "Kepler").otherwise("TESS")).alias("ident"))


@query("SELECT s_suppkey, 'KIC_' || nullif(regexp_extract(CASE WHEN s_suppkey % 5 = 0 THEN 'none' ELSE s_name END, '(\\d+)', 1), '') AS ident FROM supplier")
def id_extract_numeric(t):
    raw = F.when(F.col("s_suppkey") % 5 == 0, "none").otherwise(F.col("s_name"))
    return t("supplier").select("s_suppkey", I.prefixed(raw, "kepler").alias("ident"))


@query("SELECT bool_and(regexp_matches('TIC_' || c_custkey, '^[A-Z]+_\\d+$')) AS all_tic, bool_and(regexp_matches(c_name, '^[A-Z]+_\\d+$')) AS all_names FROM customer")
def id_format_check(t):
    good = I.is_canonical(F.concat(F.lit("TIC_"), F.col("c_custkey")))
    return t("customer").agg(F.bool_and(good).alias("all_tic"), F.bool_and(I.is_canonical(F.col("c_name"))).alias("all_names"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'TIC_MISSING' ELSE 'TIC_' || c_custkey END AS ident FROM customer")
def id_clean(t):
    raw = F.when(F.col("c_custkey") % 4 == 0, "star").otherwise(F.concat(F.lit("x TIC_"), F.col("c_custkey"), F.lit(" y")))
    return t("customer").select("c_custkey", I.clean_tic(raw).alias("ident"))


@query("SELECT s_suppkey, 'GAIA_TIC_' || s_suppkey AS gaia, 'K2_' || s_suppkey || '_' || s_nationkey AS k2 FROM supplier")
def id_composite(t):
    return t("supplier").select("s_suppkey", I.composite("GAIA", "TIC", F.col("s_suppkey")).alias("gaia"), I.composite("K2", F.col("s_suppkey"), F.col("s_nationkey")).alias("k2"))


_DEC_SQL = "(c_custkey::DOUBLE * 3.17::DOUBLE) % 180 - 90"


def _dec() -> Column:
    return F.col("c_custkey").cast("double") * 3.17 % 180 - 90


def _bin_sql(low: str) -> str:
    side = lambda v: f"printf('%02d_00%s', abs({v})::INTEGER, CASE WHEN {v} >= 0 THEN 'N' ELSE 'S' END)"
    return f"'tic_dec' || {side(low)} || '__' || {side(low + ' + 2')} || '.csv.gz'"


@query(f"SELECT c_custkey, {_bin_sql('lo')} AS slice FROM (SELECT c_custkey, (floor(({_DEC_SQL}) / 2) * 2)::INTEGER AS lo FROM customer)")
def dec_bins(t):
    return t("customer").select("c_custkey", I.declination_file(_dec()).alias("slice"))


@query(f"WITH b AS (SELECT c_custkey, {_bin_sql('lo')} AS slice FROM (SELECT c_custkey, (floor(({_DEC_SQL}) / 2) * 2)::INTEGER AS lo FROM customer)) SELECT c_custkey, slice FROM b WHERE slice IN (SELECT DISTINCT slice FROM b ORDER BY slice LIMIT 10)")
def needed_dec_bins(t):
    return I.needed_slices(dec_bins(t), "slice", 10).select("c_custkey", "slice")


@query(f"SELECT c_custkey, {_s6('d', 'dec')} FROM (SELECT c_custkey, {_DEC_SQL} AS d FROM customer) WHERE d BETWEEN -20 AND 20")
def dec_range_filter(t):
    return t("customer").select("c_custkey", _dec().alias("d")).filter(F.col("d").between(-20, 20)).select("c_custkey", r6("d").alias("dec"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 6 <> 0 AND c_custkey % 7 <> 0")
def dropna_subset(t):
    k = F.col("c_custkey")
    x = t("customer").select(k, F.when(k % 6 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(k % 7 != 0, F.col("c_nationkey")).alias("n"))
    return x.na.drop(subset=["c_acctbal", "n"]).select("c_custkey", "c_acctbal")


@query("SELECT p_partkey, p_type FROM part WHERE p_type IN ('ECONOMY', 'SMALL')")
def isin_filter(t):
    return t("part").filter(F.col("p_type").isin("ECONOMY", "SMALL")).select("p_partkey", "p_type")


# ---- joins and sets

@query("SELECT l_partkey, coalesce(p_type, 'Unknown') AS p_type, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 0) ON l_partkey = p_partkey GROUP BY ALL")
def left_join_labels(t):
    cat = t("part").filter(F.col("p_partkey") % 10 != 0).select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return R.join_labels(t("lineitem").select("l_partkey"), cat, "l_partkey", "p_type").groupBy("l_partkey", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("WITH f AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier) SELECT n_nationkey, s_suppkey, s_suppkey IS NULL AS missing FROM nation LEFT JOIN (SELECT * FROM f WHERE r = 1) ON n_nationkey = s_nationkey")
def left_join_dedup(t):
    one = R.keep_first(t("supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey"), ["n_nationkey"], ["s_suppkey"])
    return t("nation").join(one, "n_nationkey", "left").select("n_nationkey", "s_suppkey", F.col("s_suppkey").isNull().alias("missing"))


@query("SELECT (SELECT count(*) FROM nation) AS rows_before, count(*) AS rows_after, count(*) FILTER (WHERE s_suppkey IS NULL) AS rows_without FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey")
def left_join_report(t):
    n = t("nation")
    j = n.join(t("supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left").agg(F.count(F.lit(1)).alias("rows_after"), F.count_if(F.col("s_suppkey").isNull()).alias("rows_without"))
    return n.agg(F.count(F.lit(1)).alias("rows_before")).join(j, F.lit(True))


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality IS DISTINCT FROM toxic")
def discrepancy_join(t):
    a, b = t("labels").select("doc_id", "quality"), t("labels").select("doc_id", "toxic")
    return R.discrepancies(a, b, "doc_id", "quality", "toxic")


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'NO_ENCONTRADO') AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey")
def lookup_default(t):
    c = t("customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return R.lookup(t("orders").select("o_orderkey", "o_custkey"), c, "o_custkey", "segment").select("o_orderkey", "segment")


@query("SELECT e.event_id, c.c_mktsegment AS label, 'V' AS band, 'catalog' AS label_source FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey")
def batched_merge(t):
    c = t("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("label"))
    return t("events").join(c, "user_id", "left").select("event_id", "label", F.lit("V").alias("band"), F.lit("catalog").alias("label_source"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000")
def inner_key_join(t):
    return t("orders").join(t("customer").filter("c_acctbal > 9000"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


def _coords(df: DataFrame, key: str, a: float, b: float) -> DataFrame:
    k = F.col(key).cast("double")
    return df.select(F.col(key).alias("id"), (k * a % 360).alias("ra"), (k * b % 180 - 90).alias("dec"))


_SKY_SQL = """
    WITH a AS (SELECT c_custkey AS i, (c_custkey::DOUBLE * 7.31::DOUBLE) % 360 AS ra, (c_custkey::DOUBLE * 3.17::DOUBLE) % 180 - 90 AS de FROM customer), b AS (SELECT s_suppkey AS j, (s_suppkey::DOUBLE * 7.37::DOUBLE) % 360 AS ra, (s_suppkey::DOUBLE * 3.19::DOUBLE) % 180 - 90 AS de FROM supplier),
         p AS (SELECT i, j, degrees(2 * asin(sqrt(least(1.0, pow(sin(radians(b.de - a.de) / 2), 2) + cos(radians(a.de)) * cos(radians(b.de)) * pow(sin(radians(b.ra - a.ra) / 2), 2))::DOUBLE))) AS s FROM a, b),
         r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s, j) AS r FROM p WHERE s <= {0})
    SELECT i AS probe_id, j AS target_id, round(s, 6) + 0.0::DOUBLE AS separation FROM r WHERE r <= {1}"""


def _sky(t, radius: float, k: int) -> DataFrame:
    a, b = _coords(t("customer"), "c_custkey", 7.31, 3.17), _coords(t("supplier"), "s_suppkey", 7.37, 3.19)
    return nearest_on_sky(a, b, radius, ("id", "ra", "dec"), ("id", "ra", "dec"), k).select("probe_id", "target_id", r6("separation").alias("separation"))


@query(_SKY_SQL.format(5, 3))
def sky_crossmatch_nearest(t):
    return _sky(t, 5.0, 3)


@query(_SKY_SQL.format(2, 1))
def cone_search_top1(t):
    return _sky(t, 2.0, 1)


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(t):
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").select(F.col("o_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_difference_of_some(t):
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersection(t):
    return t("customer").select(F.col("c_custkey").alias("k")).intersect(t("orders").select(F.col("o_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier")
def set_union(t):
    return t("customer").select(F.col("c_custkey").alias("k")).union(t("supplier").select(F.col("s_suppkey").alias("k"))).distinct()


# ---- quality

@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def class_counts(t):
    return Q.class_counts(t("part"), "p_type")


@query("SELECT count(*) AS n_rows, count(DISTINCT l_partkey) AS n_objects FROM lineitem")
def dataset_summary(t):
    return Q.dataset_summary(t("lineitem"), "l_partkey")


@query(f"WITH x AS (SELECT raw, {_case('raw', GOLDEN, 'NULL')} AS label_class FROM {_LABELLED_SQL}), r AS (SELECT raw, label_class, count(*) AS n_raw FROM x GROUP BY ALL) SELECT raw, label_class, n_raw, (sum(n_raw) OVER (PARTITION BY label_class))::BIGINT AS n_normalized FROM r")
def raw_vs_normalized(t):
    return Q.raw_and_normalized(normalize_label(t), "raw", "label_class").select("raw", "label_class", "n_raw", "n_normalized")


@query("SELECT p_type, count(DISTINCT l_partkey) AS n_objects FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def distinct_objects_per_class(t):
    return Q.objects_by_class(t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")), "l_partkey", "p_type")


@query("SELECT count(*) FILTER (WHERE event_id % 3 = 0) AS null_a, count(*) FILTER (WHERE event_id % 5 = 0) AS null_b FROM events")
def null_counts(t):
    e = t("events").select(F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("b"))
    return Q.null_counts(e, ["a", "b"])


@query("SELECT coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_type END, p_brand) AS label, count(*) AS n FROM part GROUP BY ALL")
def coalesced_class_counts(t):
    p = t("part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("a"), "p_brand")
    return Q.coalesced_counts(p, "a", "p_brand")


_MISSIONS = [" none", "Tess ", "KEPLER", "None2"]


@query("SELECT replace(upper(trim([" + ", ".join(map(_q, _MISSIONS)) + "][(p_partkey % 4)::INTEGER + 1])), 'NONE', 'ZTF') AS mission, count(*) AS n FROM part GROUP BY ALL")
def mission_counts(t):
    return Q.mission_counts(t("part").select(F.array(*map(F.lit, _MISSIONS))[(F.col("p_partkey") % 4).cast("int")].alias("m")), "m")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(t):
    return Q.status_counts(t("orders").select(F.concat_ws(":", "o_orderstatus", "o_orderpriority").alias("s")), "s")


@query(f"WITH x AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT count(*) AS n_total, count(*) FILTER (WHERE k % 4 = 0) AS n_done, round(100.0::DOUBLE * count(*) FILTER (WHERE k % 4 = 0) / count(*), 2) AS pct_done FROM x")
def progress_report(t):
    o = t("orders").select(F.col("o_custkey").alias("k"))
    return Q.progress(o, o.filter("k % 4 = 0"), "k")


@query(f"WITH x AS (SELECT {_case('raw', GOLDEN, 'NULL')} AS label_class, p_type FROM {_LABELLED_SQL}), r AS (SELECT label_class, p_type, count(*) AS n FROM x GROUP BY ALL) SELECT label_class, sum(n)::BIGINT AS n FROM r GROUP BY label_class")
def recount_after_mapping(t):
    x = L.normalize_labels(labelled(t), "raw", "label_class").groupBy("label_class", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return Q.recount(x, "label_class", "n")


@query("""
    WITH c AS (SELECT p_type, count(DISTINCT p_partkey) FILTER (WHERE p_size % 3 = 0) AS a, count(DISTINCT p_partkey) FILTER (WHERE p_size % 3 = 1) AS b, count(DISTINCT p_partkey) FILTER (WHERE p_size % 3 = 2) AS c FROM part GROUP BY p_type)
    SELECT p_type, a, b, c, a + b + c AS "TOTAL" FROM c UNION ALL SELECT 'TOTAL', sum(a)::BIGINT, sum(b)::BIGINT, sum(c)::BIGINT, sum(a + b + c)::BIGINT FROM c""")
def class_by_dataset_pivot(t):
    p = t("part").withColumn("d", F.array(F.lit("a"), F.lit("b"), F.lit("c"))[F.col("p_size") % 3])
    return Q.class_by_dataset(p, "p_partkey", "p_type", "d", ["a", "b", "c"])


@query(f"SELECT p_type, count(*) AS n_rows, count(*) FILTER (WHERE c = 'Unknown') AS n_unknown, round(100.0::DOUBLE * count(*) FILTER (WHERE c = 'Unknown') / count(*), 2) AS pct_unknown FROM (SELECT p_type, {_case('raw', GOLDEN, 'NULL')} AS c FROM {_LABELLED_SQL}) GROUP BY p_type")
def unknown_pct(t):
    return Q.unknown_share(L.normalize_labels(labelled(t), "raw", "c"), "p_type", "c")


# ---- scores

_PAIRS_SQL = "(SELECT doc_id, quality AS t, toxic AS p FROM labels)"


def pairs_of(t) -> DataFrame:
    return t("labels").select("doc_id", F.col("quality").alias("t"), F.col("toxic").alias("p"))


@query(f"SELECT t, n, {_s6('sum(n) OVER () / (count(*) OVER () * n)', 'weight')} FROM (SELECT quality AS t, count(*) AS n FROM labels GROUP BY quality)")
def class_weights(t):
    return V.class_weights(pairs_of(t), "t").select("t", "n", r6("weight").alias("weight"))


@query(f"SELECT t, p, count(*) AS n FROM {_PAIRS_SQL} GROUP BY t, p")
def confusion_matrix(t):
    return V.confusion(pairs_of(t), "t", "p")


@query(f"""
    WITH c AS (SELECT c::VARCHAR AS class, count(*) FILTER (WHERE t = c) AS support, count(*) FILTER (WHERE p = c) AS said, count(*) FILTER (WHERE t = c AND p = c) AS hit FROM {_PAIRS_SQL}, (SELECT quality AS c FROM labels UNION SELECT toxic FROM labels) GROUP BY c),
         r AS (SELECT class, CASE WHEN said = 0 THEN 0.0::DOUBLE ELSE hit / said END AS precision, CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE hit / support END AS recall, support, hit FROM c),
         f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r),
         u AS (SELECT class, precision, recall, f1, support FROM f UNION ALL SELECT 'accuracy', NULL, NULL, sum(hit) / sum(support), sum(support) FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
               UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)
    SELECT class, {_s6("precision", "precision")}, {_s6("recall", "recall")}, {_s6("f1", "f1")}, support::BIGINT AS support FROM u""")
def classification_report(t):
    return V.classification_report(pairs_of(t), "t", "p").select("class", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


@query(f"SELECT {_s6('avg((t = p)::INTEGER)', 'accuracy')} FROM {_PAIRS_SQL}")
def accuracy(t):
    return V.accuracy(pairs_of(t), "t", "p").select(r6("accuracy").alias("accuracy"))


_LOGITS_SQL = "(SELECT vec_id, list_transform(embedding[1:5], lambda x: x::DOUBLE) AS z, (label % 5)::INTEGER AS y, embedding FROM embeddings)"
_CE_SQL = "ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[y + 1]"


def logits_of(t) -> DataFrame:
    return t("embeddings").select("vec_id", F.slice("embedding", 1, 5).cast("array<double>").alias("z"), (F.col("label") % 5).cast("int").alias("y"))


@query(f"SELECT vec_id, (list_position(z, list_max(z)) - 1)::INTEGER AS predicted FROM {_LOGITS_SQL}")
def argmax(t):
    return logits_of(t).select("vec_id", A.argmax(F.col("z")).alias("predicted"))


@query(f"SELECT vec_id, {_s6(_CE_SQL, 'loss')}, {_s6(f'({_CE_SQL}) * (y + 1)', 'weighted')} FROM {_LOGITS_SQL}")
def cross_entropy(t):
    z, y = F.col("z"), F.col("y")
    return logits_of(t).select("vec_id", r6(A.cross_entropy(z, y)).alias("loss"), r6(A.cross_entropy(z, y, y + 1)).alias("weighted"))


@query(f"SELECT vec_id, {_s6(f'pow(1 - exp(-({_CE_SQL})), 2) * ({_CE_SQL})', 'loss')}, {_s6(f'0.9::DOUBLE * ({_CE_SQL}) + 0.1::DOUBLE * (ln(list_sum(list_transform(z, lambda x: exp(x)))) - list_avg(z))', 'smoothed')} FROM {_LOGITS_SQL}")
def focal_loss(t):
    z, y = F.col("z"), F.col("y")
    return logits_of(t).select("vec_id", r6(A.focal_loss(A.cross_entropy(z, y))).alias("loss"), r6(A.smoothed_cross_entropy(z, y, 0.1)).alias("smoothed"))


@query(f"SELECT doc_id, t, p FROM {_PAIRS_SQL} WHERE t <> p")
def error_rows(t):
    return V.errors(pairs_of(t), "t", "p")


@query(f"SELECT t, p, count(*) AS n FROM {_PAIRS_SQL} WHERE t <> p GROUP BY t, p")
def error_pairs(t):
    return V.error_pairs(pairs_of(t), "t", "p")


@query(f"SELECT vec_id, {_s6('list_avg(z)', 'mean')}, {_s6('list_stddev_samp(z)', 'std')} FROM {_LOGITS_SQL} WHERE y <> list_position(z, list_max(z)) - 1")
def error_sequence_stats(t):
    wrong = logits_of(t).filter(F.col("y") != A.argmax(F.col("z")))
    return V.with_sequence_stats(wrong, "z").select("vec_id", r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"SELECT doc_id, t AS original_class, CASE WHEN p = 1 THEN 'false_positive' ELSE 'false_negative' END AS reason, 'Otros' AS origin FROM {_PAIRS_SQL} WHERE t <> p")
def curation_set(t):
    return V.curation_set(pairs_of(t), "doc_id", "t", "p", 1)


@query(f"SELECT DISTINCT doc_id FROM {_PAIRS_SQL} WHERE t <> p AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')")
def reinforcement_candidates(t):
    d = t("documents")
    return V.reinforcement_candidates(V.errors(pairs_of(t), "t", "p"), d.filter("lang = 'en'"), d.filter("source = 'src0'"), "doc_id")


# ---- schema

@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def union_by_name(t):
    return t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).unionByName(t("region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k")))


@query("SELECT c_custkey::VARCHAR AS id, c_acctbal AS time, NULL::DOUBLE AS mag FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_name, s_nationkey::DOUBLE, s_acctbal FROM supplier")
def schema_resolution(t):
    a = t("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id_objeto"), F.col("c_acctbal").alias("HJD"))
    b = t("supplier").select(F.col("s_name").alias("source_id"), F.col("s_nationkey").alias("tiempo"), F.col("s_acctbal").alias("magnitud"))
    return schema.unify([a, b])


@query("SELECT s_suppkey, s_name, NULL::DOUBLE AS period, NULL::VARCHAR AS band FROM supplier")
def fill_missing_columns(t):
    return schema.conform(t("supplier"), schema.T.StructType.fromDDL("s_suppkey long, s_name string, period double, band string"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value WHEN event_id % 2 = 0 THEN -1.0::DOUBLE END AS time FROM events")
def coalesce_duplicates(t):
    k = F.col("event_id")
    x = t("events").select("event_id", F.when(k % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("HJD"), F.when(k % 2 == 0, F.lit(-1.0)).alias("mjd"))
    return schema.canonicalize(x)


@query("SELECT p_partkey, coalesce(a, b) AS raw, coalesce(b, a) AS norm FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS a, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS b FROM part) WHERE coalesce(a, b) IS NOT NULL")
def label_backfill(t):
    k = F.col("p_partkey")
    x = t("part").select("p_partkey", F.when(k % 3 != 0, F.col("p_type")).otherwise(" ").alias("raw"), F.when(k % 4 != 0, F.col("p_brand")).alias("norm"))
    return schema.backfill_labels(x, "raw", "norm")


# ---- nested sources

@query("SELECT event_id::VARCHAR AS object_id, CASE WHEN event_id % 2 = 0 THEN 'g' ELSE 'unknown' END AS band, (event_id + i)::DOUBLE AS mjd, value AS mag, NULL::DOUBLE AS magerr FROM events, (SELECT unnest([0, 1]) AS i) WHERE event_id % 5 <> 0")
def json_curve_explode(t):
    k = F.col("event_id")
    point = lambda i: F.struct((k + i).cast("double").alias("mjd"), F.col("value").alias("mag"))
    lc = F.when(k % 5 != 0, F.array(point(0), point(1))).otherwise(F.array().cast("array<struct<mjd: double, mag: double>>"))
    made = F.to_json(F.create_map(k.cast("string"), F.struct(F.struct(F.when(k % 2 == 0, "g").alias("filter")).alias("meta"), lc.alias("lc"))))
    return readers.explode_curves(t("events").select(made.alias("j")), "j")


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def html_links(t):
    return t("pages").select("page_id", F.explode(readers.links(F.col("html"))).alias("link"))


_ANCHORS = """concat('<p><a class="x" href="/variables/', {0}, '">V100</a> <a href="/variables/', {0}, '">other</a> <a href="/x">V100</a></p>')"""
_UUID = "concat_ws('-', substr({0}, 1, 8), substr({0}, 9, 4), substr({0}, 13, 4), substr({0}, 17, 4), substr({0}, 21, 12))".format("md5(page_id::VARCHAR)")


@query(f"SELECT page_id, unnest(regexp_extract_all({_ANCHORS.format(_UUID)}, '<a[^>]*href=\"(/variables/[0-9a-f-]{{36}})\"[^>]*>V100</a>', 1)) AS link FROM pages")
def object_links(t):
    pages = t("pages").select("page_id", F.expr(_ANCHORS.format(_UUID.replace("page_id::VARCHAR", "cast(page_id AS STRING)"))).alias("html"))
    return pages.select("page_id", F.explode(readers.object_links(F.col("html"), "V100")).alias("link"))


@query("SELECT page_id, 'ID' || page_id AS ident, (page_id + 0.5)::DOUBLE AS ra FROM pages")
def cdata_csv(t):
    k = F.col("page_id")
    doc = F.concat(F.lit("<CSV><![CDATA[ID;RA\n"), F.lit("ID"), k.cast("string"), F.lit(";"), (k + F.lit(0.5)).cast("double").cast("string"), F.lit("\n]]></CSV>"))
    line = F.explode(F.slice(readers.votable_rows(doc), 2, 1_000_000)).alias("line")
    rows = t("pages").select("page_id", line).select("page_id", F.from_csv("line", "ident string, ra double", {"sep": ";"}).alias("r"))
    return rows.select("page_id", "r.ident", "r.ra")


# ---- augmentation: places and factors follow from the key, so results are defined

_AUG_SQL = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def vectors_of(t) -> DataFrame:
    return t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.posexplode("v").alias("pos", "x")).select("vec_id", "pos", r6("x").alias("x"))


def _flat_sql(v: str) -> str:
    return f"SELECT vec_id, (i - 1)::INTEGER AS pos, round(v[i], 6) + 0.0::DOUBLE AS x FROM (SELECT vec_id, {v} AS v FROM {_AUG_SQL}), (SELECT unnest(range(1, 65)) AS i) WHERE i <= len(v)"


@query(_flat_sql("list_concat(v[65 - (vec_id % 63 + 1):64], v[1:64 - (vec_id % 63 + 1)])"))
def aug_jitter_roll(t):
    return _flat(vectors_of(t).withColumn("v", A.roll(F.col("v"), F.col("vec_id") % 63 + 1)))


@query(_flat_sql("list_reverse(v)"))
def aug_flip(t):
    return _flat(vectors_of(t).withColumn("v", A.flip(F.col("v"))))


@query(_flat_sql("list_transform(v, lambda x, i: CASE WHEN i - 1 >= vec_id % 40 AND i - 1 < vec_id % 40 + 16 THEN 0.0::DOUBLE ELSE x END)"))
def aug_mask(t):
    return _flat(vectors_of(t).withColumn("v", A.zero_block(F.col("v"), F.col("vec_id") % 40, 16)))


@query(_flat_sql("list_transform(v, lambda x: x * (0.9::DOUBLE + (vec_id % 20) / 100.0::DOUBLE))"))
def aug_scale(t):
    return _flat(vectors_of(t).withColumn("v", A.scale(F.col("v"), F.lit(0.9) + F.col("vec_id") % 20 / 100)))


@query(_flat_sql("list_transform(v, lambda x: x + ((vec_id % 10) / 100.0::DOUBLE - 0.05::DOUBLE))"))
def aug_offset(t):
    return _flat(vectors_of(t).withColumn("v", A.offset(F.col("v"), F.col("vec_id") % 10 / 100 - F.lit(0.05))))


@query(_flat_sql("list_transform(v, lambda x, i: CASE WHEN (i - 1 >= vec_id % 30 AND i - 1 < vec_id % 30 + 5) OR (i - 1 >= vec_id % 50 + 5 AND i - 1 < vec_id % 50 + 10) THEN 0.0::DOUBLE ELSE x END)"))
def aug_window_dropout(t):
    return _flat(vectors_of(t).withColumn("v", A.drop_windows(F.col("v"), F.array(F.col("vec_id") % 30, F.col("vec_id") % 50 + 5), 5)))


@query(_flat_sql("list_transform(v, lambda x: least(5.0, greatest(-5.0, x * 100))::DOUBLE)"))
def aug_clamp(t):
    return _flat(vectors_of(t).withColumn("v", A.sanitize(A.scale(F.col("v"), F.lit(100.0)))))


@query()
def aug_gaussian(t):
    return _flat(vectors_of(t).withColumn("v", A.gaussian(F.col("v"), F.col("vec_id"))))


# ---- batches: runs of rows of a file

@query("WITH b AS (SELECT event_id, user_id, event_id // 128 AS batch FROM events), f AS (SELECT user_id, min(batch) AS batch FROM b GROUP BY user_id) SELECT event_id, user_id, batch FROM b JOIN f USING (user_id, batch)")
def first_batch_only(t):
    return batches.first_batch_only(t.batches("events", 128), "user_id").select("event_id", "user_id", "batch")


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_id // 128) AS n_batches FROM events GROUP BY user_id")
def merged_batches(t):
    return t.batches("events", 128).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("batch").alias("n_batches"))


@query(f"SELECT event_id, {_s6('CASE WHEN NOT bool_or(event_id % 3001 = 0) OVER (PARTITION BY event_id // 1000) THEN value END', 'value')} FROM events")
def batch_null_cast(t):
    text = F.when(F.col("event_id") % 3001 == 0, "abc").otherwise(F.col("value").cast("string"))
    return batches.cast_by_batch(t.batches("events", 1000).withColumn("value", text), {"value": "double"}).select("event_id", r6("value").alias("value"))


@query("SELECT row_number() OVER () AS position, column_name AS column, (SELECT count(*) FROM orders) AS n_rows, (SELECT count(*) FROM orders WHERE o_orderkey IS NOT NULL) AS n_keys FROM (DESCRIBE orders)")
def schema_summary(t):
    s = Q.schema_summary(t("orders"))
    keys = s.filter("column = 'o_orderkey'").select((F.col("n_rows") - F.col("n_null")).alias("n_keys"))
    return s.join(keys, F.lit(True)).select("position", "column", "n_rows", "n_keys")


@query("SELECT n_nationkey, coalesce(min(s_name), 'NO_ENCONTRADO') AS name FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey")
def lookup_repeated_keys(t):
    names = t("supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("name"))
    return R.lookup(t("nation").select("n_nationkey"), names, "n_nationkey", "name")


# ---- whole preparation

@query()
def prepared_curves(t):
    from .prepare import prepare_curves

    points = t("events").select(F.col("user_id").alias("id"), "ts", "value", F.col("event_type").alias("label")).withColumnRenamed("ts", "time")
    samples, _ = prepare_curves(points, 64, cap=40)
    return samples.select("id", "label", "label_idx", F.size("sequence").alias("length"), r6(A.density(F.col("mask"))).alias("density"), "split")
