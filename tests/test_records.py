import pytest
from pyspark.sql import functions as F

from docframe.errors import SpecError
from docframe.operators import records
from docframe.spec import LENIENT, FieldSpec, ListOf, MapOf, RecordSpec, TupleOf, UnionSpec, json_schema, rename

USAGE = RecordSpec(
    (
        FieldSpec("kind", aliases=("type",)),
        FieldSpec("at", "u64"),
        FieldSpec("note", nullable=True, omit="null_value"),
        FieldSpec("level", default="info", allowed=("info", "warn"), omit="default_value"),
    )
)


def parse(spark, lines, record=USAGE):
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("p", records.parse_json_record(F.col("line"), record))
    return {r["line"]: r["p"] for r in df.collect()}


@pytest.mark.parametrize("rule,name", [("snake", "log_entry"), ("camel", "logEntry"), ("pascal", "LogEntry"), ("kebab", "log-entry"), ("screaming_snake", "LOG_ENTRY")])
def test_renames(rule, name):
    assert rename("log_entry", rule) == name


def test_declarations_that_cannot_work():
    for bad in (
        lambda: RecordSpec((FieldSpec("a", omit="null_value"),)),
        lambda: RecordSpec((FieldSpec("a", omit="default_value"),)),
        lambda: RecordSpec((FieldSpec("a", skip_decode=True),)),
        lambda: RecordSpec((FieldSpec("a", "int", minimum=2, maximum=1),)),
        lambda: RecordSpec((FieldSpec("a"), FieldSpec("b", name="a"))),
        lambda: RecordSpec((FieldSpec("a", "nothing"),)),
        lambda: UnionSpec({"x": RecordSpec((FieldSpec("t"),))}, tag="t"),
    ):
        with pytest.raises(SpecError):
            bad()


def test_parse_tells_kinds_of_refusal_apart(spark):
    cases = {
        '{"kind":"open","at":18446744073709551615}': None,
        '{"type":"open","at":1.0,"note":null}': None,
        '{"kind":"open","at":1e2,"level":"warn"}': None,
        '{"kind":"open","at":-1}': "NumberOutOfRange",
        '{"kind":"open","at":18446744073709551616}': "NumberOutOfRange",
        '{"kind":"open","at":1.5}': "NumberOutOfRange",
        '{"kind":"open","at":"1"}': "UnexpectedType",
        '{"kind":7,"at":1}': "UnexpectedType",
        '{"kind":null,"at":1}': "UnexpectedType",
        '{"at":1}': "MissingField",
        '{"kind":"a","at":1,"x":2}': "UnknownField",
        '{"kind":"a","kind":"b","at":1}': "DuplicateField",
        '{"kind":"a","type":"b","at":1}': "DuplicateField",
        '{"kind":"a","at":1,"level":"loud"}': "UnknownVariant",
        '{"kind":"a","at":1} x': "SyntaxError",
        "[1]": "UnexpectedType",
    }
    got = parse(spark, cases)
    for line, code in cases.items():
        assert (got[line]["_error"]["code"] if got[line]["_error"] else None) == code, line
    assert got['{"kind":"open","at":1e2,"level":"warn"}']["value"].asDict() == {"kind": "open", "at": 100, "note": None, "level": "warn"}
    assert got['{"type":"open","at":1.0,"note":null}']["value"]["level"] == "info"


def test_write_follows_omission(spark):
    df = spark.createDataFrame([("open", 1, None, "info"), ("open", 2, 'a"b', "warn")], "kind string, at int, note string, level string")
    assert [r[0] for r in df.select(records.write_json_record(USAGE)).collect()] == ['{"kind":"open","at":1}', '{"kind":"open","at":2,"note":"a\\"b","level":"warn"}']


def test_unions_by_each_tagging(spark):
    arms = {"open": RecordSpec((FieldSpec("path"),)), "close": RecordSpec((FieldSpec("code", "u8"),))}
    cases = [
        (UnionSpec(arms, other=True), '{"open":{"path":"a"}}', "open"),
        (UnionSpec(arms, other=True), '{"gone":{"x":1}}', "other"),
        (UnionSpec(arms, tag="kind"), '{"code":3,"kind":"close"}', "close"),
        (UnionSpec(arms, tag="kind", content="data"), '{"kind":"open","data":{"path":"a"}}', "open"),
        (UnionSpec(arms, aliases={"shut": "close"}), '{"shut":{"code":1}}', "close"),
    ]
    for union, line, tag in cases:
        r = spark.createDataFrame([(line,)], "line string").select(records.parse_json_union(F.col("line"), union).alias("u")).first()["u"]
        assert r["_tag"] == tag and r["_error"] is None, line
        assert tag == "other" or r[tag] is not None
        assert (r["_other"] == line) if tag == "other" else r["_other"] is None
    r = spark.createDataFrame([('{"gone":1}',)], "line string").select(records.parse_json_union(F.col("line"), UnionSpec(arms)).alias("u")).first()["u"]
    assert r["_error"]["code"] == "UnknownVariant"


def test_schema_export():
    s = json_schema(USAGE)
    assert s["additionalProperties"] is False and s["required"] == ["at"]
    assert s["allOf"] == [{"anyOf": [{"required": ["kind"]}, {"required": ["type"]}]}]
    assert s["properties"]["at"] == {"type": "integer", "minimum": 0, "maximum": 2**64 - 1}
    assert json_schema(USAGE, "encode")["required"] == ["kind", "at"]


def test_capabilities():
    assert RecordSpec((FieldSpec("a", "u64"),)).describe("toml") and not RecordSpec((FieldSpec("a", "u64"),)).describe("json")


def test_refused_rows_are_kept(spark):
    df = spark.createDataFrame([('{"kind":"a","at":1}',), ("{",)], "line string").withColumn("parsed", records.parse_json_record(F.col("line"), USAGE))
    good, bad = records.split_refused(df)
    assert good.count() == 1 and bad.first()["_error"]["code"] == "SyntaxError"


def outcome(got, line):
    p = got[line]
    return (p["_error"]["code"], p["_error"]["field"]) if p["_error"] else p["value"].asDict(recursive=True)


def test_one_value_and_no_repeats_at_any_depth(spark):
    spec = RecordSpec((FieldSpec("k", "bigint"), FieldSpec("s", nullable=True)), unknown_fields="ignore")
    cases = {
        '{"nested":{"k":"x"},"k":1}': {"k": 1, "s": None},
        '{"k":1} {"z":2}': ("SyntaxError", None),
        '{"k":1},{"z":2}': ("SyntaxError", None),
        '{"k":1}]': ("SyntaxError", None),
        '{"k":1}\x00': ("SyntaxError", None),
        '{"k":1,"z":{"a":1,"a":2}}': ("DuplicateField", None),
        '{"k":1,"\\u006b":2}': ("DuplicateField", None),
        '{"\\u006b":1}': {"k": 1, "s": None},
        '{"k":9223372036854775807}': {"k": 2**63 - 1, "s": None},
        '{"k":9223372036854775808}': ("NumberOutOfRange", "k"),
        '{"k":1.00000000001}': ("NumberOutOfRange", "k"),
        '{"k":1e400}': ("NumberOutOfRange", "k"),
        "{'k':1}": ("SyntaxError", None),
        '{"k":NaN}': ("SyntaxError", None),
        '{"k":1,"s":"\\ud83d\\ude00 \\\\ud800"}': {"k": 1, "s": "😀 \\ud800"},
        '{"k":1,"s":"\\ud800"}': ("InvalidUtf8", None),
        '{"k":1,"s":"\\udc00\\ud800"}': ("InvalidUtf8", None),
        '{"k":1,"s":7}': ("UnexpectedType", "s"),
        '{"k":1,"s":null}': {"k": 1, "s": None},
        "": ("SyntaxError", None),
        " {\t} ": ("MissingField", "k"),
    }
    got = parse(spark, cases, spec)
    for line, want in cases.items():
        assert outcome(got, line) == want, line


def test_the_quick_way_and_the_whole_judgement_agree(spark):
    import random

    rng = random.Random(2)
    spec = RecordSpec((FieldSpec("a", "int", minimum=-3), FieldSpec("b", nullable=True), FieldSpec("c", "double", default=1.5), FieldSpec("d", "u8"), FieldSpec("e", "boolean", nullable=True, default=True)))
    pool = ["1", "-5", "300", "1.0", "1e1", "null", '"x"', '"1"', "true", "false", "[1]", "{}", "1e999", '"\\u0041"']
    lines = ["{" + ",".join(f'"{n}":{rng.choice(pool)}' for n in rng.sample("aabbccddeef", rng.randrange(7))) + rng.choice(["}", "}", "}", "} ", "}x"]) for _ in range(600)]
    lines += ['{"a":1,"b":"t","c":2,"d":3,"e":false}', '{"a":1,"d":255,"b":null}']
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    rows = df.select("line", records.parse_json_record(F.col("line"), spec).alias("q"), records.judge_json_record(F.col("line"), spec).alias("j")).collect()
    assert all(r["q"] == r["j"] for r in rows), next(r for r in rows if r["q"] != r["j"])
    assert sum(r["q"]["_error"] is None for r in rows) >= 2


PLACE = RecordSpec((FieldSpec("host"), FieldSpec("port", "u16", default=80)))
NEST = RecordSpec(
    (
        FieldSpec("at", "timestamp", nullable=True),
        FieldSpec("day", "date", nullable=True),
        FieldSpec("blob", "binary", nullable=True),
        FieldSpec("price", "decimal(6,2)", nullable=True),
        FieldSpec("places", ListOf(PLACE, max_items=2), default=()),
        FieldSpec("by", MapOf(PLACE), nullable=True),
        FieldSpec("pair", TupleOf(("int", "string")), nullable=True),
    )
)


def test_nested_kinds_and_the_path_of_an_error(spark):
    cases = {
        '{"places":[{"host":"a"},{"port":1,"host":"b"}],"by":{"x":{"host":"c"}}}': None,
        '{"places":[{"host":"a"},{"port":70000,"host":"b"}]}': ("NumberOutOfRange", "places[1].port"),
        '{"places":[{"host":"a"},null]}': ("UnexpectedType", "places[1]"),
        '{"places":[{"host":"a"},{"host":"a"},{"host":"a"}]}': ("ItemLimit", "places"),
        '{"by":{"x":{"port":1}}}': ("MissingField", "by.x.host"),
        '{"by":{"x":{"host":"a","z":1}}}': ("UnknownField", "by.x.z"),
        '{"by":{"x":{"host":"a"},"x":{"host":"b"}}}': ("DuplicateField", None),
        '{"by":[1]}': ("UnexpectedType", "by"),
        '{"pair":[1,"x",2]}': ("UnexpectedType", "pair"),
        '{"pair":["1","x"]}': ("UnexpectedType", "pair[0]"),
        '{"day":"2024-02-30"}': ("UnsupportedValue", "day"),
        '{"price":1.005}': ("InexactNumber", "price"),
        '{"price":12345678.5}': ("NumberOutOfRange", "price"),
        '{"blob":"a-b"}': ("UnsupportedValue", "blob"),
    }
    got = parse(spark, cases, NEST)
    for line, want in cases.items():
        assert (outcome(got, line) if want else got[line]["_error"]) == want, line
    first = got['{"places":[{"host":"a"},{"port":1,"host":"b"}],"by":{"x":{"host":"c"}}}']["value"]
    assert [tuple(p) for p in first["places"]] == [("a", 80), ("b", 1)] and first["by"]["x"]["host"] == "c"


def test_written_records_read_back(spark):
    line = '{"at":"2024-02-29T10:00:00.5Z","day":"2024-02-29","blob":"AQI=","price":1.50,"places":[{"host":"a\\"é","port":1}],"by":{"x":{"host":"c","port":80}},"pair":[1,"y"]}'
    df = spark.createDataFrame([(line,)], "line string").select(records.parse_json_record(F.col("line"), NEST).alias("p")).select("p.value.*")
    made = df.select(records.write_json_record(NEST).alias("line"))
    again = made.select(records.parse_json_record(F.col("line"), NEST).alias("p")).select("p.value.*")
    assert again.collect() == df.collect() and '"price":1.50,' in made.first()[0]


def test_policies_of_repeats_names_nulls_and_integers(spark):
    inner = RecordSpec((FieldSpec("a", nullable=True), FieldSpec("b", "int", default=0)))
    one = lambda line, *fields, **k: outcome(parse(spark, [line], RecordSpec(fields, **k)), line)
    k = FieldSpec("k", "bigint")
    assert one('{"k":"x","k":1}', k, duplicates="last") == {"k": 1}
    assert one('{"k":1,"k":"x"}', k, duplicates="first") == {"k": 1}
    assert one('{"k":1} x', k, duplicates="first") == ("SyntaxError", None)
    r = FieldSpec("r", inner)
    assert one('{"r":{"a":"x","b":1},"r":{"b":2}}', r, duplicates="merge") == {"r": {"a": "x", "b": 2}}
    assert one('{"r":{"a":"x","b":1},"r":{"b":2}}', r, duplicates="last") == {"r": {"a": None, "b": 2}}
    assert one('{"m":{"x":1,"y":2},"m":{"y":3}}', FieldSpec("m", MapOf("int")), duplicates="merge") == {"m": {"x": 1, "y": 3}}
    assert one('{"l":[{"a":"p"},{"b":1}],"l":[{"b":7}]}', FieldSpec("l", ListOf(inner)), duplicates="merge") == {"l": [{"a": "p", "b": 7}, {"a": None, "b": 1}]}
    assert one('{"USER":"x"}', FieldSpec("user"), names="fold") == {"user": "x"}
    assert one('{"USER":"x"}', FieldSpec("user")) == ("UnknownField", "USER")
    assert one('{"k":null}', k, nulls="keep") == {"k": 0}
    assert one('{"k":null}', FieldSpec("k", "bigint", default=4), nulls="keep") == {"k": 4}
    for line, ok in (('{"k":1.0}', False), ('{"k":1e1}', False), ('{"k":12}', True)):
        assert ("k" in one(line, k, integers="digits")) == ok if ok else one(line, k, integers="digits") == ("NumberOutOfRange", "k")
    assert one('{"s":"a\\ud800"}', FieldSpec("s"), unicode="replace") == {"s": "a�"}
    assert one('{"k":"a"}', FieldSpec("k", constant="a")) == {"k": "a"} and one('{"k":"b"}', FieldSpec("k", constant="a")) == ("UnexpectedType", "k")
    assert one('{"U":null,"u":"7"}', FieldSpec("u", decode=lambda c: c.try_cast("int"), decoded="int"), **{**LENIENT, "duplicates": "last"}) == {"u": 7}
    assert one('{"u":"x"}', FieldSpec("u", decode=lambda c: c.try_cast("int"), decoded="int", code="NotANumber")) == ("NotANumber", "u")
    assert one("{}", FieldSpec("n", "int", default=lambda: F.lit(5))) == {"n": 5}


def test_raw_members_keep_their_bytes(spark):
    spec = RecordSpec((FieldSpec("id", "int"), FieldSpec("é", "raw"), FieldSpec("in", RecordSpec((FieldSpec("x", "raw", nullable=True),)), nullable=True)))
    line = '{"é": { "a" : 1.50, "b":"\\u0041" } ,"id":1, "in":{"x": [ 1 ,2]}}'
    df = spark.createDataFrame([(line,)], "line string").select(records.parse_json_record(F.col("line"), spec).alias("p")).select("p.value.*")
    r = df.first()
    assert r["é"] == '{ "a" : 1.50, "b":"\\u0041" }' and r["in"]["x"] == "[ 1 ,2]"
    assert df.select(records.write_json_record(spec)).first()[0] == '{"id":1,"é":{ "a" : 1.50, "b":"\\u0041" },"in":{"x":[ 1 ,2]}}'


def test_schema_export_of_nested_records():
    s = json_schema(RecordSpec((FieldSpec("a", PLACE), FieldSpec("b", ListOf(PLACE)), FieldSpec("c", TupleOf(("int", "string"))))))
    assert s["properties"]["a"] == s["properties"]["b"]["items"] == {"$ref": "#/$defs/record0"}
    assert s["$defs"]["record0"]["required"] == ["host"] and s["properties"]["c"]["items"] is False


def test_unions_refuse_what_is_no_single_object(spark):
    union = UnionSpec({"open": RecordSpec((FieldSpec("path"),))})
    code = lambda line: spark.createDataFrame([(line,)], "line string").select(records.parse_json_union(F.col("line"), union)["_error"]["code"]).first()[0]
    assert code('{"open":{"path":"a"}} x') == "SyntaxError" and code('{"open":{"path":"a"},"b":1}') == "UnknownField" and code('{"open":{"path":"a"}}') is None
