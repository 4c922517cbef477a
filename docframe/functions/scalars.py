"""Scalar texts of several formats: times, resolved scalars, escapes and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docframe.functions.arrays import let

_RFC3339 = r"^(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:\.(\d+))?([Zz]|[+-]\d\d:\d\d)$"


def days_in_month(year: Column, month: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def rfc3339(text: Column) -> Column:
    """struct<seconds, nanos, offset_minutes> of an offset date-time; null where a part is out of range.

    The written offset is kept beside the instant; fractions are cut at nanoseconds.
    """
    return let(text, _rfc3339)


def _rfc3339(text: Column) -> Column:
    # the pattern fixes where the parts from year to second stand
    at = {1: (1, 4), 2: (6, 2), 3: (9, 2), 4: (12, 2), 5: (15, 2), 6: (18, 2)}
    numbers = F.struct(*[F.substr(text, F.lit(start), F.lit(n)).try_cast("int").alias(f"_{i}") for i, (start, n) in at.items()])
    zone = F.upper(F.regexp_extract(text, _RFC3339, 8))
    return F.when(F.regexp_like(text, F.lit(_RFC3339)), let(F.struct(text.alias("text"), numbers.alias("numbers"), zone.alias("zone")), _instant))


def _instant(s: Column) -> Column:
    text, zone = s["text"], s["zone"]
    number = lambda i: s["numbers"][f"_{i}"]
    minutes = F.when(zone == "Z", 0).otherwise(
        F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1) * (F.substr(zone, F.lit(2), F.lit(2)).try_cast("int") * 60 + F.substr(zone, F.lit(5), F.lit(2)).try_cast("int"))
    )
    ok = (
        number(2).between(1, 12)
        & (number(3) >= 1)
        & (number(3) <= days_in_month(number(1), number(2)))
        & (number(4) <= 23)
        & (number(5) <= 59)
        & (number(6) <= 60)
        & ((zone == "Z") | ((F.substr(zone, F.lit(2), F.lit(2)).try_cast("int") <= 23) & (F.substr(zone, F.lit(5), F.lit(2)).try_cast("int") <= 59)))
    )
    day = F.unix_date(F.make_date(number(1), number(2), F.least(number(3), F.lit(28)))) + F.greatest(number(3) - 28, F.lit(0))
    seconds = day.cast("bigint") * 86400 + number(4) * 3600 + number(5) * 60 + number(6) - minutes * 60
    nanos = F.rpad(F.substr(F.regexp_extract(text, _RFC3339, 7), F.lit(1), F.lit(9)), 9, "0").cast("int")
    return F.when(ok, F.struct(seconds.alias("seconds"), F.coalesce(nanos, F.lit(0)).alias("nanos"), minutes.alias("offset_minutes")))


def yaml_kind(text: Column) -> Column:
    """What a plain YAML 1.2 scalar is under the core schema: null, bool, int, float or str."""
    like = lambda p: F.regexp_like(text, F.lit(p))
    return (
        F.when(like(r"^(~|null|Null|NULL|)$"), "null")
        .when(like(r"^(true|True|TRUE|false|False|FALSE)$"), "bool")
        .when(like(r"^([-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$"), "int")
        .when(like(r"^([-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?|[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN))$"), "float")
        .otherwise("str")
    )


def yaml_int(text: Column) -> Column:
    """A core schema integer in any of its bases; null for other scalars and beyond 64 bits."""
    body = F.substr(text, F.lit(3))
    return (
        F.when(F.regexp_like(text, F.lit("^0x[0-9a-fA-F]{1,15}$")), F.conv(body, 16, 10).try_cast("bigint"))
        .when(F.regexp_like(text, F.lit("^0o[0-7]{1,20}$")), F.conv(body, 8, 10).try_cast("bigint"))
        .when(F.regexp_like(text, F.lit("^[-+]?[0-9]+$")), text.try_cast("bigint"))
    )


def yaml_text(text: Column) -> Column:
    """A YAML scalar that reads back as the same text: plain where that is safe, double-quoted where not."""
    plain = (yaml_kind(text) == "str") & F.regexp_like(text, F.lit(r"^[A-Za-z0-9_./][A-Za-z0-9_./ -]*$")) & ~F.endswith(text, F.lit(" "))
    return F.when(plain, text).otherwise(F.concat(F.lit('"'), _escaped(text), F.lit('"')))


def toml_text(text: Column) -> Column:
    """A TOML basic string."""
    return F.concat(F.lit('"'), _escaped(text), F.lit('"'))


def _escaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, code in (("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\f", "\\f"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def xml_text(text: Column, attribute: bool = False) -> Column:
    """Text with the characters escaped that would end or change it."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    out = F.replace(out, F.lit("\r"), F.lit("&#xD;"))
    if attribute:
        for raw, code in (('"', "&quot;"), ("\t", "&#x9;"), ("\n", "&#xA;")):
            out = F.replace(out, F.lit(raw), F.lit(code))
    return out


_XML_TOKEN = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|</[^>]*>|<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]++"


def xml_tokens(text: Column) -> Column:
    """Array of kind, name and token of a markup text, in order: comment, cdata, instruction, declaration, end, empty, start, text."""

    def token(t: Column) -> Column:
        kind = (
            F.when(F.startswith(t, F.lit("<!--")), "comment")
            .when(F.startswith(t, F.lit("<![CDATA[")), "cdata")
            .when(F.startswith(t, F.lit("<?")), "instruction")
            .when(F.startswith(t, F.lit("<!")), "declaration")
            .when(F.startswith(t, F.lit("</")), "end")
            .when(F.startswith(t, F.lit("<")), F.when(F.endswith(t, F.lit("/>")), "empty").otherwise("start"))
            .otherwise("text")
        )
        return F.struct(kind.alias("kind"), F.regexp_extract(t, r"^</?([^\s/>!?]+)", 1).alias("name"), t.alias("token"))

    return F.transform(F.regexp_extract_all(text, F.lit(_XML_TOKEN), F.lit(0)), token)


def xml_attributes(token: Column) -> Column:
    """Array of name and raw value of a start tag's attributes."""
    names = F.regexp_extract_all(token, F.lit(r"\s([^\s=/>]+)\s*=\s*(?:\"[^\"]*\"|'[^']*')"), F.lit(1))
    values = F.regexp_extract_all(token, F.lit(r"\s[^\s=/>]+\s*=\s*(\"[^\"]*\"|'[^']*')"), F.lit(1))
    return F.transform(names, lambda n, i: F.struct(n.alias("name"), F.substr(F.get(values, i), F.lit(2), F.char_length(F.get(values, i)) - 2).alias("value")))
