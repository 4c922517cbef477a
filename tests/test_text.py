import json

import pytest
from pyspark.sql import functions as F

from docframe.functions import binary, route, text
from docframe.operators import keyed_text, lines, sinks
from docframe.sources import csv
from docframe.sources import lines as sources
from docframe.spec import FieldSpec, RecordSpec


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("line,kind", [('{"kind":"open","at":17}', "kind"), ('  { "at" : 17 }', "at"), ("[1,2,3]", None), ("{}", None), ('{"a\\n":1}', None), ('{"a" 1}', None)])
def test_kind_of(spark, line, kind):
    assert one(spark, line, route.kind_of) == kind


@pytest.mark.parametrize("name,value", [("a", '"x"'), ("b", "1"), ("c", "true"), ("d", "null"), ("e", None), ("f", None), ("g", None)])
def test_member_of(spark, name, value):
    assert one(spark, '{"a":"x","b":1,"c":true,"d":null,"e":{"a":1},"f":[1]}', lambda c: route.member_of(c, name)) == value


@pytest.mark.parametrize("raw,kind,value", [("12", "bigint", 12), ("-0", "u8", 0), ("01", "bigint", None), ("1.0", "bigint", None), ("256", "u8", None), ("+1", "int", None), (" 1", "int", None), ("-128", "tinyint", -128)])
def test_int_of(spark, raw, kind, value):
    assert one(spark, raw, lambda c: route.int_of(c, kind)) == value


def test_control_offsets_are_bytes(spark):
    assert one(spark, "é\x00", route.index_of_control) == 2
    assert one(spark, "a\tb", route.index_of_control) is None
    assert one(spark, "ab\nc", route.first_control_or_end) == 2


def test_members_in_order(spark):
    got = one(spark, '{"b":1,"a":"x"}', route.members)
    assert [(m["ordinal"], m["name"], m["value"]) for m in got] == [(0, "b", "1"), (1, "a", "x")]


@pytest.mark.parametrize("raw,pairs", [("a=b+c&d=%26", [("a", "b c"), ("d", "&")]), ("a", [("a", "")]), ("&&a=1=2", [("a", "1=2")]), ("a=100%", None), ("", [])])
def test_form_pairs(spark, raw, pairs):
    got = one(spark, raw, text.form_pairs)
    assert (None if got is None else [(p["name"], p["value"]) for p in got]) == pairs


@pytest.mark.parametrize("name,path", [("a", ["a"]), ("a[b][]", ["a", "b", ""]), ("[a]", None), ("a]b", None), ("a[b]c", None)])
def test_form_path(spark, name, path):
    assert one(spark, name, text.form_path) == path


@pytest.mark.parametrize("line,fields", [('a,"b ""q"",",', ["a", 'b "q",', None]), ('""', [""]), ('a"b', None), ('"a"b', None), ("", [None])])
def test_csv_fields(spark, line, fields):
    assert one(spark, line, text.csv_fields) == fields


def test_checksum_member(spark):
    import zlib

    made = one(spark, '{"a":1}', text.with_checksum)
    assert json.loads(made)["crc"] == zlib.crc32(b'{"a":1')


@pytest.mark.parametrize("raw,value", [("1m30s", 90 * 10**9), ("64", None), ("5ms", 5 * 10**6), ("1x", None)])
def test_durations(spark, raw, value):
    assert one(spark, raw, text.duration_nanos) == value


def test_framing(spark):
    rules = lines.Framing(separator=True)
    get = lambda s, at=5: one(spark, s, lambda c: lines.frame(c, F.lit(at), rules)).asDict()
    assert get('x\x1e{"a":1}\x1e{"b":2}') == {"record": '{"b":2}', "torn": 2, "fault": None}
    assert get("{}")["fault"] == "MissingSeparator"
    assert get(" \t") == {"record": None, "torn": 0, "fault": None}
    plain = lambda s, at=5, **k: one(spark, s, lambda c: lines.frame(c, F.lit(at), lines.Framing(**k))).asDict()
    assert plain("﻿{}\r", 0)["record"] == "{}"
    assert plain("abc", max_line_bytes=2)["fault"] == "LineTooLong"


def test_lines_of_agrees_with_exploded_lines(spark):
    rows = [(1, "a\né\n\nb"), (2, "x\n"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    a = {(r["k"], r["number"], r["offset"], r["line"]) for r in lines.explode_lines(df, "k", "t").collect()}
    b = {(r["k"], r["x"]["number"], r["x"]["offset"], r["x"]["line"]) for r in df.where("t is not null").select("k", F.explode(lines.lines_of(F.col("t"))).alias("x")).collect()}
    assert a == b == {(1, 1, 0, "a"), (1, 2, 2, "é"), (1, 3, 5, ""), (1, 4, 6, "b"), (2, 1, 0, "x")}


def test_files_keep_numbers_and_offsets_over_splits(spark, tmp_path):
    held = [f'{{"n":{i},"pad":"{"x" * (i % 7)}"}}' for i in range(500)]
    (tmp_path / "a.jsonl").write_text("\n".join(held) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = sources.read_lines(spark, str(tmp_path)).orderBy("number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    at = 0
    for i, r in enumerate(got):
        assert (r["number"], r["offset"], r["line"]) == (i + 1, at, held[i])
        at += len(held[i]) + 1
    assert len(got) == 500


def test_ini(spark):
    body = "﻿top = 1\n[Main]\nName = a\n\tb\n\n\tc\n; note\nflag\n[Main2] tail\nname: x\nname = y\n"
    got = keyed_text.ini_entries(spark.createDataFrame([(1, body)], "k int, t string"), "k", "t").collect()
    found = {(r["section"], r["name"], r["value"], r["error"]) for r in got}
    assert (None, "top", "1", None) in found
    assert ("Main", "name", "a\nb\n\nc", None) in found
    assert ("Main", "flag", None, None) in found
    assert ("Main2", "name", "x", "DuplicateField") in found


def test_dotenv(spark):
    body = "# c\nA=1 # x\nexport B='it\\'s'\nC=\"l1\nl2\\t\\\"q\\\"\"\nD=\nE\nF=#v\n"
    got = keyed_text.dotenv_entries(spark.createDataFrame([(1, body)], "k int, t string"), "k", "t").orderBy("position").collect()
    assert [(r["name"], r["value"]) for r in got] == [("A", "1"), ("B", "it's"), ("C", 'l1\nl2\t"q"'), ("D", ""), ("E", None), ("F", "#v")]


def test_dotenv_refuses_what_is_no_binding(spark):
    body = 'A=1\nno binding here\nB="x" junk\nC="open\n  \n# fine\nD=\'y\' # ok\r\n=z\n'
    got = keyed_text.dotenv_entries(spark.createDataFrame([(1, body)], "k int, t string"), "k", "t").collect()
    assert {r["name"]: r["value"] for r in got if r["error"] is None} == {"A": "1", "D": "y"}
    assert sum(r["error"] == "SyntaxError" for r in got) == 4


def test_dotenv_values_read_back(spark):
    values = ["plain", "", "a b#c", 'q"\'\\', "".join(keyed_text.ESCAPES.values()), "\\n", "é"]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v string").select("k", "v", keyed_text.dotenv_line(F.lit("X"), F.col("v")).alias("t"))
    got = {r["k"]: r["value"] for r in keyed_text.dotenv_entries(df, "k", "t").collect()}
    assert got == dict(enumerate(values))


@pytest.mark.parametrize("n,cbor,msgpack", [(0, "00", "00"), (24, "1818", "18"), (-1, "20", "FF"), (-33, "3820", "D0DF"), (65536, "1A00010000", "CE00010000"), (-(2**40), "3B000000FFFFFFFFFF", "D3FFFFFF0000000000"), (300, "19012C", "CD012C")])
def test_binary_integers(spark, n, cbor, msgpack):
    assert one(spark, n, lambda c: F.hex(binary.cbor_int(c)), "bigint") == cbor
    assert one(spark, n, lambda c: F.hex(binary.msgpack_int(c)), "bigint") == msgpack


def test_json_lines_and_csv_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("", 'x,"y"')], "k string, v string").coalesce(1)
    sinks.write_json_lines(df, str(tmp_path / "j"), text.json_object(F.col("k"), F.col("v")), separator=True)
    assert sorted(b"".join(p.read_bytes() for p in (tmp_path / "j").glob("part*")).split(b"\n")) == [b"", b'\x1e{"k":"","v":"x,\\"y\\""}', b'\x1e{"k":"a","v":null}']
    sinks.write_csv(df, str(tmp_path / "c"))
    assert b"".join(p.read_bytes() for p in (tmp_path / "c").glob("part*")) == b'k,v\r\na,\r\n"","x,""y"""\r\n'
    with pytest.raises(Exception, match="LineTooLong"):
        sinks.write_json_lines(df, str(tmp_path / "b"), F.col("v"), max_line_bytes=2)


READING = RecordSpec((FieldSpec("station"), FieldSpec("celsius", "double", aliases=("t",)), FieldSpec("note", nullable=True), FieldSpec("n", "bigint", default=7)))


def test_csv_by_the_rules(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfnote,celsius,station\r\n"",1.5,a\r\n,01,b\r\n"l1\r\nl2 ""q""",2,c\r\n\r\nx,3,d,e\r\ny,4\r\n,5,z"z\r\n')
    (tmp_path / "b.csv").write_text("station,t,n\ne,1e1,9223372036854775807\nf,2,9223372036854775808\ng,3,12.5\n,4,1.0\n")
    (tmp_path / "c.csv").write_text("station,t,wrong\nh,1,2\n")
    for size in ("1000", "40"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            good, bad = csv.read_csv(spark, str(tmp_path), READING)
            rows, refused = good.collect(), bad.collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(map(tuple, rows)) == [("", 4.0, None, 1), ("a", 1.5, "", 7), ("c", 2.0, 'l1\r\nl2 "q"', 7), ("e", 10.0, None, 2**63 - 1)]
        found = sorted((r["path"][-5:], r["row"], r["line"], r["code"], r["field"]) for r in refused)
        assert found == [
            ("a.csv", 2, 3, "UnexpectedType", "celsius"), ("a.csv", 4, 7, "SyntaxError", None), ("a.csv", 5, 8, "SyntaxError", None), ("a.csv", 6, 9, "SyntaxError", None),
            ("b.csv", 2, 3, "NumberOutOfRange", "n"), ("b.csv", 3, 4, "NumberOutOfRange", "n"), ("c.csv", 1, 2, "UnknownField", "wrong"),
        ]
    good, bad = csv.read_csv(spark, str(tmp_path / "b.csv"), RecordSpec((FieldSpec("a"), FieldSpec("b"), FieldSpec("c"))), header=False)
    assert good.count() == 5 and bad.count() == 0


def test_csv_round_trip_of_files(spark, tmp_path):
    rows = [("a\nb", 1), ('x,"y"', 2**63 - 1), ("", -5), (None, 0), ("\r", 3), ("z;é", None)]
    df = spark.createDataFrame(rows, "`k;1` string, v long")
    for delimiter in (",", ";", "\t"):
        path = str(tmp_path / f"d{ord(delimiter)}")
        sinks.write_csv(df, path, delimiter)
        assert not any(b"\0" in p.read_bytes() for p in (tmp_path / f"d{ord(delimiter)}").glob("part*"))
        spec = RecordSpec((FieldSpec("k", name="k;1", nullable=True), FieldSpec("v", "bigint", nullable=True)))
        good, bad = csv.read_csv(spark, path, spec, delimiter)
        assert bad.count() == 0 and sorted(map(repr, map(tuple, good.collect()))) == sorted(map(repr, rows))


def test_records_of_files(spark, tmp_path):
    from pyspark.sql import Observation

    p = tmp_path / "a.jsonl"
    p.write_text('{"a":1}\r\n\n{"b":2}\n{"c":\x01}\n{"half"')
    seen = Observation()
    good, bad = sources.read_records(spark, str(p), lines.Framing(require_terminator=True), counter=seen)
    # a sort would run the plan twice, and the counter with it
    assert sorted((r["number"], r["record"], r["offset"]) for r in good.collect()) == [(1, '{"a":1}', 0), (3, '{"b":2}', 10)]
    assert seen.get["skipped"] == 1
    assert [(r["number"], r["fault"]) for r in bad.collect()] == [(4, "ControlByte")]
    good, _ = sources.read_records(spark, str(p), start_offset=10)
    assert [(r["record"], r["number"]) for r in good.orderBy("number").collect()] == [('{"b":2}', 3), ('{"half"', 5)]
    with pytest.raises(Exception, match="ControlByte at line 4"):
        sources.read_records(spark, str(p), on_malformed="fail")[0].collect()


def test_pretty_records_of_files(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('{\n "a": "}]",\n "b": [1,\n 2]\n}\n{"c":1}\n{"open": [\n\n{\n"d":2}\n7\n')
    for size in ("1000", "12"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = sources.read_records(spark, str(p), pretty=True)[0].orderBy("number").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [(r["record"], r["number"]) for r in got] == [('{\n "a": "}]",\n "b": [1,\n 2]\n}', 1), ('{"c":1}', 6), ('{"open": [', 7), ('{\n"d":2}', 9), ("7", 11)]


@pytest.mark.parametrize("n,head", [(0, "80"), (15, "8F"), (16, "DE0010"), (300, "DE012C")])
def test_msgpack_maps_of_any_width(spark, n, head):
    members = {f"k{i:03}": (F.lit(i % 2 == 1), binary.msgpack_int(F.lit(i % 100))) for i in range(n)}
    want = head + "".join("A4" + f"k{i:03}".encode().hex().upper() + ("C0" if i % 2 else f"{i % 100:02X}") for i in range(n))
    assert spark.range(1).select(F.hex(binary.msgpack_map(members))).first()[0] == want


def test_msgpack_map_heads():
    assert [binary._msgpack_map_head(n) for n in (15, 16, 65_535, 65_536)] == ["8F", "DE0010", "DEFFFF", "DF00010000"]


@pytest.mark.parametrize(
    "raw,value,end",
    [('{"a":[1,"}"]} tail', '{"a":[1,"}"]}', 13), (' é', None, None), ('  12,3', "12", 4), ('"é\\""x', '"é\\""', 6), ("[[]]]", "[[]]", 4), ("{", None, None), ("truefalse", "true", 4), ("", None, None), ("[1 2]", None, None)],
)
def test_prefix_value(spark, raw, value, end):
    got = one(spark, raw, route.prefix_value)
    assert (got and (got["value"], got["end"])) == (value and (value, end))


@pytest.mark.parametrize("unit", ["  ", "\t"])
def test_indented(spark, unit):
    for raw in ('{"a":[1,2,{"b":{}}],"c d":"x, {y}:","e":[]}', " [ ] ", '{ "k" : -1.50e+3 , "l" : [ true ,null ] }', "7", '"s"'):
        lower = json.dumps(json.loads(raw, parse_float=lambda x: f"@{x}@"), indent=unit, ensure_ascii=False).replace('"@', "").replace('@"', "")
        assert one(spark, raw, lambda c: route.indented(c, unit)) == lower, raw


@pytest.mark.parametrize("value,made", [(1.5, "1.5"), (float("inf"), "Infinity"), (-float("inf"), "-Infinity"), (float("nan"), "NaN"), (None, "null")])
def test_json5_numbers(spark, value, made):
    assert one(spark, value, text.json5_number, "double") == made
