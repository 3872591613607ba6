"""Fill-in-middle transformation by escaped marker injection, in SQL functions alone.

A delimiter that the text cannot hold is written behind each unit: ESCAPE and DELIMITER become two-character sequences,
one regexp_replace appends the delimiter to every unit (an escaped sequence is one unit, as the character it stands for),
the delimiters are counted, and substring_index takes the units up to a rank. Delimiters then go, the escapes are undone
and the parts are put together. Work and memory are linear in the text; no row meets another, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle in the output; a text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are rearranged, and of 100 rearranged ones so many begin with the suffix.
REARRANGED, SUFFIX_FIRST = 90, 20
ESCAPE, DELIMITER = "\x01", "\x02"
_ESCAPED = {ESCAPE: ESCAPE + "\x03", DELIMITER: ESCAPE + "\x04"}
UNIT = f"[A-Za-z]+|{ESCAPE}[\x03\x04]|[^A-Za-z]"


def mark_units(text: Column) -> Column:
    """The text, escaped, with the delimiter behind each unit."""
    for plain, escaped in _ESCAPED.items():
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.regexp_replace(text, UNIT, "$0" + DELIMITER)


def unmark(marked: Column) -> Column:
    """The plain text of marked units."""
    text = F.replace(marked, F.lit(DELIMITER), F.lit(""))
    for plain, escaped in reversed(_ESCAPED.items()):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def count_units(marked: Column) -> Column:
    return (F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit(DELIMITER), F.lit("")))).cast("long")


def _index(text: Column, delimiter: str, count: Column) -> Column:
    """The text before the count-th delimiter, from the end where count is negative."""
    return F.call_function("substring_index", text, F.lit(delimiter), count.cast("int"))


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output of every row.

    n: units ([A-Za-z]+ or one other code point). The cuts and the form come from the first four 32-bit groups of the
    sha256 of "seed:id": form plain (the text itself), psm (prefix, suffix, middle) or spm (suffix, prefix, middle).
    Defined cases: null text is empty; an empty text and one that holds a mark stay plain, with null lengths; a null id
    is hashed as no digits; rows that share an id share cuts and form as far as their texts allow; other columns are not
    read; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_text"), key.alias("_key"))
    group = lambda i: F.conv(F.substring("_key", 8 * i + 1, 8), 16, 10).cast("long")
    rows = rows.select("_id", "_text", *(group(i).alias(f"_h{i + 1}") for i in range(4)), mark_units(F.col("_text")).alias("_marked"))
    rows = rows.withColumn("_n", count_units(F.col("_marked")))
    cut = [F.pmod(F.col(h), F.col("_n") + 1) for h in ("_h1", "_h2")]
    holds = F.contains("_text", F.lit(PREFIX)) | F.contains("_text", F.lit(SUFFIX)) | F.contains("_text", F.lit(MIDDLE))
    plain = (F.col("_n") == 0) | holds | (F.col("_h3") % 100 >= rearranged)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("_id", "_text", "_marked", "_n", F.least(*cut).alias("_a"), F.greatest(*cut).alias("_b"), form.alias("_form"))
    # units up to the second cut, and those behind it: the marked text ends with a delimiter, so its last piece is empty
    upto = F.when(F.col("_form") != "plain", _index(F.col("_marked"), DELIMITER, F.col("_b")))
    rest = F.when(F.col("_form") != "plain", unmark(_index(F.col("_marked"), DELIMITER, F.col("_b") - F.col("_n") - 1)))
    rows = rows.select("_id", "_text", "_n", "_a", "_b", "_form", upto.alias("_upto"), rest.alias("_suffix"))
    prefix = _index(F.col("_upto"), DELIMITER, F.col("_a"))
    middle = F.when(F.col("_upto").isNull(), None).when(F.col("_a") == F.col("_b"), "").otherwise(_index(F.col("_upto"), DELIMITER, F.col("_a") - F.col("_b")))
    rows = rows.select("_id", "_text", "_n", "_form", "_suffix", unmark(prefix).alias("_prefix"), unmark(middle).alias("_middle"))
    psm = F.concat(F.lit(PREFIX), "_prefix", F.lit(SUFFIX), "_suffix", F.lit(MIDDLE), "_middle")
    spm = F.concat(F.lit(SUFFIX), "_suffix", F.lit(PREFIX), "_prefix", F.lit(MIDDLE), "_middle")
    output = F.when(F.col("_form") == "plain", F.col("_text")).when(F.col("_form") == "psm", psm).otherwise(spm)
    return rows.select(F.col("_id").alias(id_col), F.col("_n").alias("n"), F.col("_form").alias("form"), F.length("_prefix").cast("long").alias("prefix_chars"), F.length("_middle").cast("long").alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that output was made from. Marks are found by their first place, as no text in them holds one."""
    before = lambda x, mark: F.substring_index(x, mark, 1)
    after = lambda x, mark: F.substring_index(x, mark, -1)
    inside = F.substr(output, F.lit(len(PREFIX) + 1))
    psm = F.concat(before(inside, SUFFIX), after(inside, MIDDLE), before(after(inside, SUFFIX), MIDDLE))
    spm = F.concat(before(after(inside, PREFIX), MIDDLE), after(inside, MIDDLE), before(inside, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
