import math
import struct

import pytest
from pyspark.sql import functions as F

from docframe.functions import documents, scalars


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


# The number samples of RFC 8785, appendix B.
NUMBERS = [
    ("0000000000000000", "0"), ("8000000000000000", "0"), ("0000000000000001", "5e-324"), ("7fefffffffffffff", "1.7976931348623157e+308"), ("4340000000000000", "9007199254740992"),
    ("4430000000000000", "295147905179352830000"), ("44b52d02c7e14af5", "9.999999999999997e+22"), ("444b1ae4d6e2ef4e", "999999999999999700000"), ("444b1ae4d6e2ef50", "1e+21"),
    ("3eb0c6f7a0b5ed8c", "9.999999999999997e-7"), ("3eb0c6f7a0b5ed8d", "0.000001"), ("41b3de4355555555", "333333333.3333333"), ("becbf647612f3696", "-0.0000033333333333333333"),
]


@pytest.mark.parametrize("bits,text", NUMBERS)
def test_canonical_numbers(bits, text):
    assert documents.canonical_double(struct.unpack(">d", bytes.fromhex(bits))[0]) == text


def test_numbers_without_a_form():
    for x in (math.inf, -math.inf, math.nan):
        with pytest.raises(ValueError):
            documents.canonical_double(x)


@pytest.mark.parametrize(
    "raw,want",
    [('{"b":1.0,"a":[ true,null,"\\u00e9\\n"]}', '{"a":[true,null,"é\\n"],"b":1}'), ('{"a":1,"a":2}', None), ('{"\U0001f600":1,"דּ":2}', '{"\U0001f600":1,"דּ":2}'), ("[1,]", None), ('"\\ud800"', None), ("NaN", None), (None, None)],
)
def test_canonical_json(spark, raw, want):
    assert one(spark, raw, documents.canonical_json) == want


DOC = '{ "a": [1, 2 , {"x/y": "z"}],\n  "b": {} }'


@pytest.mark.parametrize(
    "action,pointer,value,want",
    [
        ("set", "/a/1", "9", '{ "a": [1, 9 , {"x/y": "z"}],\n  "b": {} }'),
        ("set", "/a/2/x~1y", "true", '{ "a": [1, 2 , {"x/y": true}],\n  "b": {} }'),
        ("set", "/b/new", "1", '{ "a": [1, 2 , {"x/y": "z"}],\n  "b": {"new":1} }'),
        ("insert", "/a/0", "0", '{ "a": [0,1, 2 , {"x/y": "z"}],\n  "b": {} }'),
        ("insert", "/a/-", "3", '{ "a": [1, 2 , {"x/y": "z"},3],\n  "b": {} }'),
        ("insert", "/a", "3", None),
        ("remove", "/a/1", None, '{ "a": [1, {"x/y": "z"}],\n  "b": {} }'),
        ("remove", "/b", None, '{ "a": [1, 2 , {"x/y": "z"}] }'),
        ("remove", "/c", None, None),
        ("set", "/a/7", "1", None),
        ("set", "bad", "1", None),
        ("set", "/a/0", "{", None),
        ("set", "", "5", "5"),
    ],
)
def test_edits_leave_other_bytes(spark, action, pointer, value, want):
    assert one(spark, DOC, lambda c: documents.edit_json(c, action, pointer, None if value is None else F.lit(value))) == want


@pytest.mark.parametrize(
    "raw,want",
    [("1979-05-27T07:32:00Z", (296638320, 0, 0)), ("1979-05-27 00:32:00.999999999999-07:00", (296638320, 999999999, -420)), ("2024-02-29t23:59:60+00:00", (1709251200, 0, 0)), ("2023-02-29T00:00:00Z", None), ("2024-13-01T00:00:00Z", None), ("2024-01-01T24:00:00Z", None), ("2024-01-01T00:00:00", None)],
)
def test_offset_times(spark, raw, want):
    got = one(spark, raw, scalars.rfc3339)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("raw,kind", [("", "null"), ("Null", "null"), ("nULL", "str"), ("true", "bool"), ("yes", "str"), ("0x1F", "int"), ("0o17", "int"), ("0b1", "str"), ("1.10", "float"), (".5", "float"), ("-.inf", "float"), ("1_000", "str"), ("+12", "int"), ("1e3", "float")])
def test_yaml_kinds(spark, raw, kind):
    assert one(spark, raw, scalars.yaml_kind) == kind


def test_escapes(spark):
    assert one(spark, 'a<b>&"\r', lambda c: scalars.xml_text(c, True)) == "a&lt;b&gt;&amp;&quot;&#xD;"
    assert one(spark, 'x"\\\n', scalars.toml_text) == '"x\\"\\\\\\n"'
    assert one(spark, "plain text", scalars.yaml_text) == "plain text" and one(spark, "true", scalars.yaml_text) == '"true"'
    assert one(spark, "0x1F", scalars.yaml_int) == 31 and one(spark, "0o17", scalars.yaml_int) == 15


def test_markup_tokens(spark):
    got = one(spark, '<?xml v?><!-- < --><a x="1>" y=\'q\'>t<b/><![CDATA[<x>]]></a>', scalars.xml_tokens)
    assert [(t["kind"], t["name"]) for t in got] == [("instruction", ""), ("comment", ""), ("start", "a"), ("text", ""), ("empty", "b"), ("cdata", ""), ("end", "a")]
    assert "".join(t["token"] for t in got).startswith("<?xml")
    attributes = one(spark, '<a x="1>" y=\'q\'>', scalars.xml_attributes)
    assert [(a["name"], a["value"]) for a in attributes] == [("x", "1>"), ("y", "q")]
