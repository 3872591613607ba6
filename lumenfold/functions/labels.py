"""Class labels: reference taxonomies and the rules that lead raw labels to them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Raw labels of each class of the common taxonomy, in dictionary order; the classes that count as valid;
# the order in which a compound label prefers them.
CLASS_LABELS = {
    "Eclipsing Binary": ["ECLIPSING BINARY", "EA", "EB", "EW", "ECL", "E", "ECLIPSING", "DETACHED BINARY", "SEMI-DETACHED BINARY", "CONTACT BINARY", "EC", "ED", "ESD", "EP", "EA:", "EW/RS"],
    "RR Lyrae": ["RR LYRAE", "RRAB", "RRC", "RRD", "ARRD", "RR", "ACEP", "RRC|EC", "RR_LYRAE", "RRAB/BL", "RRAB/BL:", "BL"],
    "Delta Scuti": ["DELTA SCUTI", "DSCT", "HADS", "DSCT:", "DSCT|GDOR|SXPHE", "DELTA_SCUTI", "DSCTC", "DSCTR"],
    "Rotational": ["ROTATIONAL", "ROT", "BY", "BYDRA", "BY_DRA", "ACV", "ROAP", "ROAM", "ELL", "RSCVN", "RS_CVN", "RS", "SXARI", "SPOTTED ROTATOR", "RVA"],
    "Irregular": ["IRREGULAR", "LB", "L", "Y", "SRC", "SRA", "SRB", "SR", "S", "MIRA", "M", "AP", "LC", "SRD", "LPV", "SRS"],
    "Variable": ["VARIABLE", "CEP", "CEPII", "VAR", "VAR:", "CEPH", "CEPHIED", "CEPHEID", "CEPHEID VARIABLE", "BETA_CEP", "BETA CEP", "CWFU", "UV", "MISC", "DCEP", "DCEPS", "DDCEP", "CWA", "CWB", "QP", "P", "BCEP", "SPB", "CW-FU", "CW-FO"],
    "Cataclysmic": ["CATACLYSMIC", "UG", "UGSU", "UGSS", "UGZ", "UGWZ", "UGSU+E", "NL", "NOVA", "CV", "CV:", "CV+E", "CV:E", "UGER", "UGSU:E", "UGSU:", "AM", "AM+E", "AM:", "DQ", "DQ:"],
    "White Dwarf": ["WHITE DWARF", "DAV", "DBV", "WD", "ZZA", "ZZ_CETI", "ZZ CETI", "V1093HER", "V361HYA", "WHITE_DWARF", "ZZ", "ZZ:", "ZZB", "ZZLEP", "ZZLep", "ZZO"],
    "Young Stellar Object": ["YOUNG STELLAR OBJECT", "YSO", "TTS", "T TAURI"],
}
PREFERENCE = ["Eclipsing Binary", "RR Lyrae", "Delta Scuti", "Rotational", "Irregular", "Variable", "Cataclysmic", "White Dwarf", "Young Stellar Object"]
SEPARATORS = "|/+:"
TARGET_CLASSES = list(CLASS_LABELS)

# Groups of the first token of a catalog label.
TOKEN_GROUPS = {
    "RR_Lyrae": ["RRAB", "RRC", "RRD", "RR"],
    "Delta_Scuti": ["DSCT", "DSCTC", "HADS"],
    "Gamma_Dor": ["GDOR"],
    "Beta_Cep": ["BCEP", "SPB"],
    "EA": ["EA"],
    "EB": ["EB"],
    "EW": ["EW"],
    "RS_CVn": ["RS"],
    "Rotational": ["ROT"],
    "ACV": ["ACV"],
    "BY_Dra": ["BY"],
    "Irregular": ["VAR", "MISC", "LPV", "LC", "SRA", "SR", "SRB", "SRD", "SRS"],
    "ZZ_Ceti": ["ZZA"],
    "White_Dwarf": ["WD"],
    "Cataclysmic": ["CV", "UG", "UGZ", "UGWZ", "UGSU"],
    "Cepheid": ["CWB", "DCEP", "ACEP"],
    "Eclipsing": ["ED", "ESD", "EP", "EC"],
    "UNKNOWN": ["UNKNOWN"],
}

# The plain map of a merged catalog, and a short map of published abbreviations.
MERGE_MAP = {
    "Eclipsing Binary": ["EB", "EA", "EW", "EA/RS", "EA|EB", "EA:", "ELL/RS", "ELL/DW:", "EB,"],
    "RR Lyrae": ["RRAB", "RRC", "RRAB/BL", "RRAB:", "RR", "RRD", "RRC|EC", "ACEP"],
    "Delta Scuti": ["DSCT", "DSCTC", "DSCT|GDOR|SXPHE", "DSCT|EC|ESD", "DSCT:"],
    "Rotational": ["ROT", "BY", "BY:", "ROT/WD", "RS", "RS:", "RS_CVn"],
    "Irregular": ["M", "L", "SR", "SR:", "SRB", "SRB:", "SRA", "SRS", "LPV", "LB", "SR|M", "LC"],
    "Cataclysmic": ["CV", "CV:", "NL:"],
    "White Dwarf": ["ZZA", "WD"],
    "Young Stellar Object": ["YSO", "T Tauri"],
    "Variable": ["VAR", "VAR:"],
    "Unknown": ["UNKNOWN", ""],
}
SHORT_MAP = {"EB": ["EA", "EB", "EW", "OC", "SD", "D", "ELV"], "RR Lyrae": ["RRab", "RRc", "RRLyr"], "Delta Scuti": ["DSCT"], "Gamma Dor": ["Gamma Doradus"], "Cepheid": ["CEP"], "Cepheid Type II": ["T2CEP"], "Rotational": ["ROT"], "Noise": ["No variable"], "Other": ["otra periódica"]}


def _inverse(groups: dict[str, list[str]]) -> dict[str, str]:
    return {raw: name for name, raws in groups.items() for raw in raws}


def _literal_map(pairs: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def _class_number(key: Column, marks: str, exact: Column, tight: Column) -> Column:
    """Place in PREFERENCE of a cleaned label's class, null without one: the label itself, else the preferred class among
    its parts at the first mark (these may have the later marks), else the label without blanks, dashes and underscores."""
    squeezed = tight[F.translate(key, " -_", "")]
    if not marks:
        return F.coalesce(exact[key], squeezed)
    whole = _class_number(key, marks[1:], exact, tight)
    parts = F.transform(F.split(key, f"[{marks[0]}]"), lambda part: _class_number(F.trim(part), marks[1:], exact, tight))
    return F.coalesce(exact[key], F.when(key.contains(marks[0]), F.array_min(F.array_compact(parts))).otherwise(whole), squeezed)


def normalize_labels(df: DataFrame, raw: str, out: str) -> DataFrame:
    """df with out, the class of raw. Only different labels are resolved; they join back on the label."""
    place = {name: i for i, name in enumerate(PREFERENCE)}
    exact = {label: place[name] for label, name in _inverse(CLASS_LABELS).items()}
    tight: dict[str, int] = {}
    for label, number in exact.items():
        tight.setdefault(re.sub("[ _-]", "", label), number)
    text = F.col(raw).cast("string")
    key = F.trim(F.regexp_replace(F.translate(F.upper("_raw"), "-_", "  "), r"(?U)\s+", " "))  # white space of any script, as no-break spaces
    known = df.select(text.alias("_raw")).filter("_raw is not null").distinct().withColumns({"_key": key, "_exact": _literal_map(exact), "_tight": _literal_map(tight)})
    number = _class_number(F.col("_key"), SEPARATORS, F.col("_exact"), F.col("_tight"))
    known = known.select("_raw", F.get(F.array(*map(F.lit, PREFERENCE)), number).alias("_class"))
    joined = df.drop(out).join(known, df[raw].cast("string") == F.col("_raw"), "left")
    return joined.withColumn(out, F.coalesce("_class", F.lit("Unknown"))).drop("_raw", "_class")


def fold_rare(df: DataFrame, label: str, least: int = 5, out: str | None = None, name: str = "RARE") -> DataFrame:
    """Classes of fewer than least rows become name. Counts are aggregated first and join back, so no class meets in one task."""
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    joined = df.join(counts, df[label].eqNullSafe(counts["_label"]))
    return joined.withColumn(out or label, F.when(F.col("_n") < least, name).otherwise(F.col(label))).drop("_label", "_n")


def label_coverage(df: DataFrame, raw: str) -> DataFrame:
    """Different raw labels with their class and whether that is unknown."""
    return normalize_labels(df.select(raw).distinct(), raw, "label_class").withColumn("is_unknown", F.col("label_class") == "Unknown")


def _lookup(key: Column, groups: dict[str, list[str]], default: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in _inverse(groups).items() for x in pair))[key], default)


def first_token_class(label: Column) -> Column:
    """Class of the first token of a label; tokens without a class stay as they are."""
    token = F.translate(F.split(F.upper(F.trim(label)), r"[|/+,:]")[0], "- ", "")
    return F.when(label.isNull() | (F.trim(label) == ""), "UNKNOWN").otherwise(_lookup(token, TOKEN_GROUPS | {"UNKNOWN": ["UNKNOWN", ""]}, token))


def substring_class(label: Column) -> Column:
    """Class by ordered substring rules; the first that holds decides."""
    x = F.upper(F.trim(label))
    has = lambda *s: _any(x.contains(t) for t in s)
    starts = lambda s: x.startswith(s)
    rules = [
        (x.isNull() | x.isin("", "UNKNOWN", ","), "UNKNOWN"), (has("ROT"), "Rotational"), (starts("RS"), "RS_CVn"), (starts("BY"), "BY_Dra"), (has("DSCT"), "Delta_Scuti"), (has("RR"), "RR_Lyrae"), (starts("E") | has("EB", "EA", "ECLIPSING"), "Eclipsing"), (has("SR", "M", "LPV", "LB"), "Irregular"),
        (has("CV", "UG", "NL"), "Cataclysmic"), (has("WD"), "White_Dwarf"), (has("BCEP", "SPB"), "Beta_Cep"), (has("GDOR"), "Gamma_Dor"), (has("HADS"), "Delta_Scuti"), (x.isin("S", "L") | has("VAR", "MISC"), "Irregular"), (has("YSO"), "YSO"),
    ]
    out = F.lit("RARE")
    for rule, name in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def merged_class(label: Column) -> Column:
    """Class by the plain map of a merged catalog, else Other."""
    return _lookup(label, MERGE_MAP, F.lit("Other"))


def short_class(label: Column) -> Column:
    """Class by published abbreviation, else null."""
    return _lookup(label, SHORT_MAP, F.lit(None).cast("string"))


def origin_of(ident: Column) -> Column:
    """Survey that an id names."""
    return F.when(ident.contains("ASASSN"), "ASAS-SN").when(ident.contains("ZTF"), "ZTF").when(ident.contains("TIC_"), "TESS").otherwise("Otros")


def band_of(code: Column) -> Column:
    """Filter name of a band code."""
    return F.when(code == 1, "g").when(code == 2, "r").otherwise("unknown")
