"""Records that are read from the text: usual lines take one pass of Spark's parser, and all lines read as the whole judgement reads them."""

import pytest
from pyspark.sql import functions as F

from docframe.operators import records
from docframe.spec import FieldSpec, ListOf, RecordSpec

INNER = RecordSpec((FieldSpec("a"), FieldSpec("b", "bigint", default=7)))
FIELDS = (FieldSpec("n", "bigint", maximum=99), FieldSpec("s", default="none"), FieldSpec("o", "double", nullable=True))
NESTED = (FieldSpec("r", INNER, default=None), FieldSpec("l", ListOf("int"), nullable=True), FieldSpec("n", "u8", default=3))
SPECS = {
    "first": RecordSpec(FIELDS, duplicates="first", unknown_fields="ignore"),
    "last": RecordSpec(FIELDS, duplicates="last"),
    "fold": RecordSpec(FIELDS, names="fold"),
    "fold last": RecordSpec(FIELDS, names="fold", duplicates="last", unknown_fields="ignore"),
    "merge": RecordSpec(NESTED, duplicates="merge"),
    "nested first": RecordSpec(NESTED, duplicates="first", unknown_fields="ignore"),
    "raw": RecordSpec((*FIELDS, FieldSpec("d", "raw", nullable=True)), unknown_fields="ignore"),
    "raw last": RecordSpec((FieldSpec("n", "int", default=0), FieldSpec("d", "raw")), duplicates="last"),
}
#: A usual line of each; none of them needs the whole judgement.
USUAL = {
    "first": ('{"n":1,"n":"x","z":[{}]}', (1, "none", None)), "last": ('{"n":"x", "s":"a,}", "n":2}', (2, "a,}", None)), "fold": ('{"N":3,"O":1.5}', (3, "none", 1.5)),
    "fold last": ('{"N":1,"Z":0,"n":4}', (4, "none", None)), "merge": ('{"r":{"a":"x","b":1},"l":[1,2,3],"r":{"a":"y"},"l":[9]}', (("y", 1), [9, 2, 3], 3)),
    "nested first": ('{"r":{"a":"x"},"r":5,"n":255}', (("x", 7), None, 255)), "raw": ('{"n":1, "d" : {"x" : 1.50, "y":[ 1 ]} }', (1, "none", None, '{"x" : 1.50, "y":[ 1 ]}')),
    "raw last": ('{"d":[1,"," ] ,"n":1,"n":2}', (2, '[1,"," ]')),
}
ODD = [
    "", "null", "[1]", "{}", " {} ", '{"n":1', '{"n":1}}', '{"n":1} {"n":2}', '{"n":1},{}],{"n":2}', "{'n':1}", '{"n":NaN}', '{"n":01}', '{"n":"1"}', '{"n":1.0}', '{"n":1e1}', '{"n":100}', '{"n":null}',
    '{"n":99999999999999999999}', '{"n":-1}', '{"n":1,"n":2}', '{"n":1,"N":2}', '{"N":1,"n":2,"N":3}', '{"n":1,"\\u006e":2}', '{"n":1,"s":"\\ud800"}', '{"n":1,"s":"a\\nb"}', '{"n":1,"s":null}', '{"n":1,"s":5}',
    '{"n":1,"o":null}', '{"n":1,"o":null,"o":2}', '{"n":1,"o":2,"o":null}', '{"n":1,"O":1e400}', '{"n":1,"o":3}', '{"n":1,"z":0}', '{"n":1,"Z":0,"z":0}', '{"n":1,"İ":0,"z":{"q":1,"q":2}}', '{"":1,"n":1}',
    '{"n":1,"d":null}', '{"n":1,"d":"é, ]"}', '{"n":1,"d":1,"d":[2 ]}', '{"d":{"n":2,"d":3},"n":1}', '{"x":{"d":0},"n":1,"d" : -1.50e3 }', '{"n":1,"d":' + "[" * 10 + "]" * 10 + "}", '{"n":1,"D":1}', '{"n":1,"d":{"e":1,"e":2}}',
    '{"r":{"a":"x","b":1},"r":{"b":2}}', '{"r":{"b":1},"r":{"a":"y"}}', '{"r":{"a":"x"},"r":{"a":null}}', '{"r":{"a":"x"},"r":1}', '{"r":1,"r":{"a":"x"}}', '{"r":{"a":"x"},"r":{"b":2},"r":{"a":"z"}}', '{"r":null}', '{"r":{"a":"x","c":1}}',
    '{"r":{"a":"x","a":"y"}}', '{"r":{"a":"x","b":"1"}}', '{"r":{}}', '{"l":[1,2],"l":[3]}', '{"l":[1],"l":[2,3]}', '{"l":[1],"l":[]}', '{"l":[],"l":[1]}', '{"l":[1,null]}', '{"l":[1,"2"]}', '{"l":[1.0,3000000000]}', '{"l":[3000000000]}', '{"l":{"a":1}}',
    '{"l":[1],"l":[2],"l":[3,4]}', '{"l":[1],"l":5}', '{"l":null,"r":{"a":"x","b":null}}', '{"n":256}', '{"l":[1,2],"l":[3,4]}', '{"s":"' + "x" * 50_000 + '","n":1}', '{"n":1,"d":[' + '"a",' * 20_000 + "1]}", "{" + "".join(f'"k{i}":{i},' for i in range(3000)) + '"n":1,"d":2}',
]


@pytest.mark.parametrize("name", list(SPECS))
def test_usual_lines_take_one_pass(spark, monkeypatch, name):
    line, want = USUAL[name]
    fail = lambda line, record: F.raise_error(F.lit("judged")).cast(f"struct<value:{records.type_of(record)},_error:{records.ERROR}>")
    monkeypatch.setattr(records, "judge_json_record", fail)
    got = spark.createDataFrame([(line,)], "t string").select(records.parse_json_record(F.col("t"), SPECS[name]).alias("p")).first()["p"]
    assert got["_error"] is None
    assert tuple(tuple(v) if isinstance(v, tuple) else v for v in got["value"]) == want


@pytest.mark.parametrize("name", list(SPECS))
def test_all_lines_read_as_they_are_judged(spark, name):
    lines = spark.createDataFrame([(t,) for t in ODD + [t for t, _ in USUAL.values()]] + [(None,)], "t string")
    both = lines.select("t", records.parse_json_record(F.col("t"), SPECS[name]).alias("quick"), records.judge_json_record(F.col("t"), SPECS[name]).alias("judged")).collect()
    assert [(r["t"][:80] if r["t"] else r["t"], r["quick"]) for r in both] == [(r["t"][:80] if r["t"] else r["t"], r["judged"]) for r in both]
