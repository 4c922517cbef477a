"""INI and .env texts as Spark jobs: lines, carried sections and continued values by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What reads as true and false.
TRUE, FALSE = ("1", "yes", "true", "on"), ("0", "no", "false", "off")


def ini_entries(texts: DataFrame, key: str, text: str, delimiters: str = "=:", comments: str = "#;") -> DataFrame:
    """key, section (null before the first), name (lower case), value (null for a name alone) and error of INI texts.

    A line indented deeper than its name's line continues the value; blank lines
    inside a value are kept and those behind it dropped. A repeated section or
    name has DuplicateField.
    """
    rows = texts.select(key, F.posexplode(F.split(text, "\n")).alias("p", "raw"))
    order = Window.partitionBy(key).orderBy("p")
    rows = rows.withColumn("raw", F.when(F.col("p") == 0, F.regexp_replace("raw", "^﻿", "")).otherwise(F.col("raw")))
    rows = rows.withColumn("comment", F.regexp_like("raw", F.lit(rf"^\s*[{comments}]")))
    rows = rows.withColumn("body", F.when(F.col("comment"), "").otherwise(F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))))
    rows = rows.withColumn("depth", F.char_length(F.regexp_extract("raw", r"^(\s*)", 1)))
    filled = F.col("body") != ""
    # A line at most as deep as some earlier head starts a new head; the depth of heads is carried along.
    flat = rows.withColumn("head", filled & ((F.col("depth") == 0) | (F.col("depth") <= F.coalesce(F.last(F.when(filled & (F.col("depth") == 0), F.col("depth")), True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("depth")))))
    flat = flat.withColumn("entry", F.sum(F.col("head").cast("int")).over(order))
    flat = flat.withColumn("is_section", F.col("head") & F.regexp_like("body", F.lit(r"^\[.+\]")))
    flat = flat.withColumn("section", F.last(F.when(F.col("is_section"), F.regexp_extract("body", r"^\[(.+)\]", 1)), True).over(order))
    heads = Window.partitionBy(key, "entry").orderBy("p")
    flat = flat.where(F.col("entry") > 0).withColumn("section_entry", F.first("is_section").over(heads))
    entry = flat.where(~F.col("section_entry")).groupBy(key, "section", "entry").agg(
        F.sort_array(F.collect_list(F.struct("p", "head", "body", "comment"))).alias("parts")
    )
    first = F.get(F.col("parts"), F.lit(0))["body"]
    has_value = F.regexp_like(first, F.lit(f"[{delimiters}]"))
    name = F.lower(F.regexp_extract(first, rf"^([^{delimiters}]*?)\s*(?:[{delimiters}]|$)", 1))
    start = F.regexp_extract(first, rf"^[^{delimiters}]*[{delimiters}]\s*(.*)$", 1)
    rest = F.transform(F.filter(F.slice("parts", 2, F.size("parts")), lambda x: ~x["comment"]), lambda x: x["body"])
    value = F.regexp_replace(F.array_join(F.concat(F.array(start), rest), "\n"), r"\n+$", "")
    continued = F.exists(rest, lambda x: x != "")
    entry = entry.select(key, "section", "entry", name.alias("name"), F.when(has_value, value).alias("value"), F.when(~has_value & continued, "SyntaxError").alias("broken"))
    again = F.count("*").over(Window.partitionBy(key, "section", "name")) > 1
    return entry.select(key, "section", "name", "value", F.coalesce(F.col("broken"), F.when(again, "DuplicateField")).alias("error"))


def boolean_word(text: Column) -> Column:
    """A boolean by its word in any case; null for other words."""
    word = F.lower(text)
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


_NAME = r"(?:'[^']+'|[^=#\s']+)"
_DOUBLE, _SINGLE = r'"(?:[^"\\]|\\(?s:.))*+"', r"'(?:[^'\\]|\\(?s:.))*+'"
#: The escapes of a double-quoted value, besides those of the quotes and the backslash.
ESCAPES = {"a": "\x07", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\x0b"}
_BINDING = rf"(?m)^[ \t]*(?:export[ \t]+)?({_NAME})(?:[ \t]*=[ \t]*({_DOUBLE}|{_SINGLE}|(?![\"'])[^\r\n]*+))?[ \t]*(?:#[^\r\n]*)?\r?$"


def dotenv_entries(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, position, name, value (null for a name alone) and error of .env texts, without expansion.

    Quoted values may run across lines; an unquoted one ends at white space before a #.
    A line that is no binding, comment or blank is an entry without a name and with SyntaxError.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), r"(?m)^[ \t]*#.*$", "")
    found = F.regexp_extract_all(clean, F.lit(_BINDING), F.lit(0))
    rows = texts.select(key, F.posexplode(found).alias("position", "binding"))
    name = F.regexp_replace(F.regexp_extract("binding", _BINDING, 1), "^'|'$", "")
    raw = F.regexp_extract("binding", _BINDING, 2)
    bound = F.regexp_like("binding", F.lit(rf"(?s)^[ \t]*(?:export[ \t]+)?{_NAME}[ \t]*="))
    plain = F.regexp_replace(F.regexp_replace(raw, r"\s+#.*$", ""), r"^\s+|\s+$", "")
    body = F.regexp_replace(F.substr(raw, F.lit(2), F.char_length(raw) - 2), "\r\n?", "\n")
    single = F.regexp_replace(body, r"\\([\\'])", "$1")
    double = body
    for code, out in ESCAPES.items():
        double = F.regexp_replace(double, rf"(?<!\\)((?:\\\\)*)\\{code}", "$1" + out)
    double = F.regexp_replace(double, r"\\([\\'\"])", "$1")
    value = F.when(F.startswith(raw, F.lit('"')), double).when(F.startswith(raw, F.lit("'")), single).otherwise(plain)
    out = rows.select(key, "position", name.alias("name"), F.when(bound, value).alias("value"))
    again = F.count("*").over(Window.partitionBy(key, "name")) > 1
    out = out.withColumn("error", F.when(again, "DuplicateField"))
    rest = F.filter(F.split(F.regexp_replace(clean, _BINDING, ""), r"[\r\n]+"), lambda x: F.regexp_like(x, F.lit(r"[^ \t]")))
    bad = texts.select(key, F.explode(rest)).select(key, F.lit(None).cast("int").alias("position"), *[F.lit(None).cast("string").alias(n) for n in ("name", "value")], F.lit("SyntaxError").alias("error"))
    return out.unionByName(bad)


def dotenv_line(name: Column, value: Column) -> Column:
    """One .env binding: bare where the value is plain, quoted where it is not; null is the name alone."""
    plain = F.regexp_like(value, F.lit(r"^[A-Za-z0-9_./:@%+,-]+$"))
    body = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code, raw in ESCAPES.items():
        body = F.replace(body, F.lit(raw), F.lit("\\" + code))
    quoted = F.concat(F.lit('"'), body, F.lit('"'))
    return F.when(value.isNull(), name).otherwise(F.concat(name, F.lit("="), F.when(plain | (value == ""), value).otherwise(quoted)))


def ini_line(name: Column, value: Column) -> Column:
    """One INI entry; further lines of a value are indented under it, null is the name alone."""
    return F.when(value.isNull(), name).otherwise(F.concat(name, F.lit(" = "), F.replace(value, F.lit("\n"), F.lit("\n\t"))))
