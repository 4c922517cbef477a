"""The query catalogue over the driver's tables, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions import binary, documents, route, scalars, text
from docframe.operators import keyed_text, lines, records
from docframe.spec import FieldSpec, ListOf, MapOf, RecordSpec, TupleOf, UnionSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PROPS = RecordSpec((FieldSpec("k", "bigint", minimum=0),))


@query(f"SELECT event_id, {K} AS k FROM events")
def q01_typed_parse(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("parsed", records.parse_json_record(F.col("props"), PROPS))
    return events.select("event_id", F.col("parsed.value.k").alias("k"))


@query(r"""SELECT event_id, regexp_extract(props, '^\s*\{\s*"([^"\\]*)"\s*:', 1) AS kind FROM events""")
def q02_first_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", route.kind_of(F.col("props")).alias("kind"))


def _event_line():
    return F.to_json(F.struct("event_type", "user_id", F.struct(F.col("event_id").alias("id")).alias("nested")))


@query("""SELECT event_id, '"' || event_type || '"' AS member, event_type AS member_text, CAST(user_id AS VARCHAR) AS number_text, CAST(NULL AS VARCHAR) AS nested_text FROM events""")
def q03_member_of(spark, sf_dir):
    line = _event_line()
    return table(spark, sf_dir, "events").select(
        "event_id",
        route.member_of(line, "event_type").alias("member"),
        route.member_string_of(line, "event_type").alias("member_text"),
        route.member_of(line, "user_id").alias("number_text"),
        route.member_of(line, "nested").alias("nested_text"),
    )


EVENT_UNION = UnionSpec(
    {"purchase": RecordSpec((FieldSpec("k", "bigint"),)), "click": RecordSpec((FieldSpec("k", "bigint"),)), "signup": RecordSpec((FieldSpec("k", "bigint"),))},
    other=True,
)


@query(
    f"""SELECT event_id, CASE WHEN event_type IN ('purchase', 'click', 'signup') THEN event_type ELSE 'other' END AS tag,
        CASE WHEN event_type = 'purchase' THEN CAST({K} AS VARCHAR) END AS purchase_k, CASE WHEN event_type = 'click' THEN CAST({K} AS VARCHAR) END AS click_k,
        CASE WHEN event_type NOT IN ('purchase', 'click', 'signup') THEN '{{"' || event_type || '":' || props || '}}' END AS other_line FROM events"""
)
def q04_union_routing(spark, sf_dir):
    line = F.concat(F.lit('{"'), F.col("event_type"), F.lit('":'), F.col("props"), F.lit("}"))
    events = table(spark, sf_dir, "events").withColumn("u", records.parse_json_union(line, EVENT_UNION))
    return events.select("event_id", F.col("u._tag").alias("tag"), F.col("u.purchase.k").cast("string").alias("purchase_k"), F.col("u.click.k").cast("string").alias("click_k"), F.col("u._other").alias("other_line"))


@query(f"SELECT event_id, {K} AS k, CASE WHEN event_id % 3 = 0 THEN 'warn' ELSE 'info' END AS level FROM events")
def q05_default_when_missing(spark, sf_dir):
    spec = RecordSpec((FieldSpec("k", "bigint"), FieldSpec("level", default="info", allowed=("info", "warn"))))
    line = F.when(F.col("event_id") % 3 == 0, text.with_member(F.col("props"), "level", F.lit('"warn"'))).otherwise(F.col("props"))
    events = table(spark, sf_dir, "events").withColumn("p", records.parse_json_record(line, spec))
    return events.select("event_id", F.col("p.value.k").alias("k"), F.col("p.value.level").alias("level"))


@query(
    f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'DuplicateField' END AS refused, {K} AS first_k,
        CASE WHEN event_id % 2 = 0 THEN event_id ELSE {K} END AS last_k FROM events"""
)
def q06_duplicate_members(spark, sf_dir):
    line = F.when(F.col("event_id") % 2 == 0, text.with_member(F.col("props"), "k", F.col("event_id").cast("string"))).otherwise(F.col("props"))
    parse = lambda how: records.parse_json_record(line, RecordSpec((FieldSpec("k", "bigint"),), duplicates=how))
    events = table(spark, sf_dir, "events").select("event_id", parse("reject").alias("r"), parse("first").alias("f"), parse("last").alias("l"))
    return events.select("event_id", F.col("r._error.code").alias("refused"), F.col("f.value.k").alias("first_k"), F.col("l.value.k").alias("last_k"))


@query(
    """WITH n AS (SELECT n_nationkey, n_name, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS r FROM nation)
    SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || coalesce(CAST(r AS VARCHAR), 'null') || '}' AS with_nulls,
    sha256('{"n_name":"' || n_name || '"' || coalesce(',"n_regionkey":' || CAST(r AS VARCHAR), '') || '}') AS without_nulls_sha FROM n"""
)
def q07_json_write_nulls(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("n_regionkey", F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")))
    cols = [F.col("n_name"), F.col("n_regionkey")]
    return n.select("n_nationkey", text.json_object(*cols).alias("with_nulls"), F.sha2(text.json_object(*cols, nulls=False), 256).alias("without_nulls_sha"))


@query(
    f"""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 2 = 0 THEN 'app' ELSE event_type END AS scope_,
        CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST({K} AS VARCHAR) END AS at_, event_id % 2 = 0 OR event_id % 5 = 4 AS migrated,
        CASE WHEN event_id % 5 = 4 THEN 'UnknownVariant' END AS refused FROM events"""
)
def q08_versioned_migrate(spark, sf_dir):
    now = RecordSpec((FieldSpec("scope", default="app"), FieldSpec("at", "bigint")))
    old = RecordSpec((FieldSpec("at"),))
    migrate = lambda v: F.struct(F.lit("app").alias("scope"), route.int_of(v["at"]).alias("at"))
    k = F.get_json_object("props", "$.k")
    v2 = F.concat(F.lit('{"v":2,"data":{"scope":"'), F.col("event_type"), F.lit('","at":'), k, F.lit("}}"))
    v1 = F.concat(F.lit('{"data":{"at":"'), k, F.lit('"},"v":1}'))
    v7 = F.concat(F.lit('{"v":7,"data":'), F.col("props"), F.lit("}"))
    line = F.when(F.col("event_id") % 5 == 4, v7).when(F.col("event_id") % 2 == 0, v1).otherwise(v2)
    events = table(spark, sf_dir, "events").withColumn("p", records.parse_versioned(line, 2, now, {1: (old, migrate)}))
    return events.select("event_id", F.col("p.value.scope").alias("scope_"), F.col("p.value.at").cast("string").alias("at_"), F.col("p.migrated").alias("migrated"), F.col("p._error.code").alias("refused"))


@query("""SELECT p_partkey, p_name, p_type || ',"' || p_brand AS odd, p_size FROM part""")
def q09_csv_round_trip(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("odd", F.concat("p_type", F.lit(',"'), "p_brand"))
    back = text.csv_fields(text.csv_line(F.col("p_name"), F.col("odd"), F.col("p_size")))
    return part.select("p_partkey", F.get(back, F.lit(0)).alias("p_name"), F.get(back, F.lit(1)).alias("odd"), F.get(back, F.lit(2)).cast("int").alias("p_size"))


@query(r"""SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref FROM pages WHERE url LIKE '%?%'""")
def q10_form_pairs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where(F.contains("url", F.lit("?")))
    pairs = text.form_pairs(F.regexp_extract("url", r"\?([^#]*)", 1))
    one = lambda n: F.coalesce(F.get(text.form_values(pairs, n), F.lit(0)), F.lit(""))
    return pages.select("page_id", one("page").alias("page"), one("ref").alias("ref"))


@query("SELECT event_id, props FROM events ORDER BY event_id DESC LIMIT 100")
def q11_tail(spark, sf_dir):
    return lines.last_lines(table(spark, sf_dir, "events").select("event_id", "props"), 100, "event_id")


@query("SELECT event_type, count(*) FILTER (WHERE value BETWEEN 1 AND 50) AS good, count(*) FILTER (WHERE NOT value BETWEEN 1 AND 50) AS refused FROM events GROUP BY event_type")
def q12_validation_counts(spark, sf_dir):
    spec = RecordSpec((FieldSpec("value", "double", minimum=1.0, maximum=50.0),))
    line = F.concat(F.lit('{"value":'), F.col("value").cast("decimal(18,2)").cast("string"), F.lit("}"))
    events = table(spark, sf_dir, "events").withColumn("bad", records.parse_json_record(line, spec)["_error"]["code"])
    return events.groupBy("event_type").agg(F.count_if(F.col("bad").isNull()).alias("good"), F.count_if(F.col("bad") == "NumberOutOfRange").alias("refused"))


@query("""SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}') AS canonical_sha FROM nation""")
def q13_canonical_hash(spark, sf_dir):
    members = {"name": text.json_string(F.col("n_name")), "region": text.canonical_number(F.col("n_regionkey")), "key": text.canonical_number(F.col("n_nationkey"))}
    return table(spark, sf_dir, "nation").select("n_nationkey", F.sha2(text.canonical_object(members), 256).alias("canonical_sha"))


_INT_TEXT = "CASE WHEN event_id % 4 = 0 THEN '0' || user_id WHEN event_id % 4 = 1 THEN user_id || '.0' WHEN event_id % 4 = 2 THEN '-' || user_id ELSE CAST(user_id AS VARCHAR) END"


@query(
    f"""SELECT event_id, CASE WHEN regexp_matches({_INT_TEXT}, '^-?(0|[1-9][0-9]*)$') THEN CAST(TRY_CAST({_INT_TEXT} AS BIGINT) AS VARCHAR) END AS digits_only,
        CAST(CASE WHEN event_id % 4 = 1 THEN user_id WHEN regexp_matches({_INT_TEXT}, '^-?(0|[1-9][0-9]*)$') THEN TRY_CAST({_INT_TEXT} AS BIGINT) END AS VARCHAR) AS whole FROM events"""
)
def q14_strict_integers(spark, sf_dir):
    u = F.col("user_id").cast("string")
    m = F.col("event_id") % 4
    spelled = F.when(m == 0, F.concat(F.lit("0"), u)).when(m == 1, F.concat(u, F.lit(".0"))).when(m == 2, F.concat(F.lit("-"), u)).otherwise(u)
    return table(spark, sf_dir, "events").select("event_id", route.int_of(spelled).cast("string").alias("digits_only"), route.whole_of(spelled).cast("string").alias("whole"))


@query("""SELECT r_regionkey, '{"name":"' || r_name || '","len":' || length(r_name) || '}' AS with_length FROM region""")
def q15_computed_member(spark, sf_dir):
    obj = text.json_object(F.col("r_name").alias("name"))
    return table(spark, sf_dir, "region").select("r_regionkey", text.with_member(obj, "len", F.char_length("r_name").cast("string")).alias("with_length"))


@query(
    """WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
    x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS number FROM s)
    SELECT doc_id, number, line, CAST(coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM x"""
)
def q16_lines_of_text(spark, sf_dir):
    found = lines.explode_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "number", "line", F.col("offset").alias("byte_offset"))


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment FROM customer")
def q17_cbor_round_trip(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("segment", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")))
    coded = binary.cbor_map({
        "name": (F.lit(False), binary.cbor_text(F.col("c_name"))),
        "nation": (F.lit(False), binary.cbor_int(F.col("c_nationkey"))),
        "segment": (F.col("segment").isNull(), binary.cbor_text(F.col("segment"))),
    })
    back = c.withColumn("m", binary.cbor_flat(coded))
    return back.select("c_custkey", F.col("m")["name"].alias("c_name"), F.col("m")["nation"].cast("int").alias("c_nationkey"), F.col("m")["segment"].alias("segment"))


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'yes' ELSE 'no' END = 'yes' AS active FROM supplier")
def q18_ini_entries(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    body = F.concat(
        F.lit("; supplier\n[main]\nName = "), "s_name", F.lit("\n[place]\nnation: "), F.col("s_nationkey").cast("string"), F.lit("\nactive="), F.when(F.col("s_suppkey") % 2 == 0, "Yes").otherwise("off"), F.lit("\n")
    )
    entries = keyed_text.ini_entries(s.select("s_suppkey", body.alias("body")), "s_suppkey", "body").where(F.col("error").isNull())
    pick = lambda section, name: F.max(F.when((F.col("section") == section) & (F.col("name") == name), F.col("value")))
    wide = entries.groupBy("s_suppkey").agg(pick("main", "name").alias("s_name"), pick("place", "nation").cast("int").alias("s_nationkey"), pick("place", "active").alias("a"))
    return wide.select("s_suppkey", "s_name", "s_nationkey", keyed_text.boolean_word(F.col("a")).alias("active"))


@query("SELECT c_custkey, c_name, c_mktsegment, 'a' || chr(10) || 'b' AS note FROM customer")
def q19_dotenv_entries(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    body = F.concat_ws(
        "\n", F.concat(F.lit("export NAME='"), "c_name", F.lit("' # who")), F.concat(F.lit("SEGMENT="), "c_mktsegment", F.lit(" # kind")), keyed_text.dotenv_line(F.lit("NOTE"), F.lit("a\nb"))
    )
    entries = keyed_text.dotenv_entries(c.select("c_custkey", body.alias("body")), "c_custkey", "body").where(F.col("error").isNull())
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    return entries.groupBy("c_custkey").agg(pick("NAME").alias("c_name"), pick("SEGMENT").alias("c_mktsegment"), pick("NOTE").alias("note"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q20_xml_round_trip(spark, sf_dir):
    xml = F.to_xml(F.struct(F.col("n_nationkey").alias("@id"), F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("@key")).alias("region")), {"rowTag": "nation", "attributePrefix": "@"})
    back = F.from_xml(xml, "`@id` int, name string, region struct<`@key`:int>", {"attributePrefix": "@", "valueTag": "$text"})
    n = table(spark, sf_dir, "nation").select(back.alias("x"))
    return n.select(F.col("x.`@id`").alias("n_nationkey"), F.col("x.name").alias("n_name"), F.col("x.region.`@key`").alias("n_regionkey"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'UnknownField' END AS refused, CASE WHEN event_id % 2 = 0 THEN 'extra' END AS refused_field FROM events")
def q21_unknown_fields(spark, sf_dir):
    line = F.when(F.col("event_id") % 2 == 0, text.with_member(F.col("props"), "extra", F.lit("1"))).otherwise(F.col("props"))
    e = table(spark, sf_dir, "events").withColumn("e", records.parse_json_record(line, PROPS)["_error"])
    return e.select("event_id", F.col("e.code").alias("refused"), F.col("e.field").alias("refused_field"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'ControlByte' WHEN event_id % 3 = 2 THEN 'MissingSeparator' END AS fault, CASE WHEN event_id % 3 = 0 THEN props END AS record, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS torn FROM events")
def q22_framing(spark, sf_dir):
    m = F.col("event_id") % 3
    line = F.when(m == 0, F.concat(F.lit('{"torn\x1e'), "props", F.lit("\r"))).when(m == 1, F.concat(F.lit("\x1e"), "props", F.lit("\x01"))).otherwise(F.col("props"))
    f = table(spark, sf_dir, "events").withColumn("f", lines.frame(line, F.lit(10), lines.Framing(separator=True)))
    return f.select("event_id", F.col("f.fault").alias("fault"), F.col("f.record").alias("record"), F.col("f.torn").alias("torn"))


@query("SELECT event_id, event_id * 1000000000 + 1500000 AS nanos, event_id * 1048576 AS bytes FROM events")
def q23_durations_and_sizes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id").cast("string")
    return e.select("event_id", text.duration_nanos(F.concat(i, F.lit("s1500us"))).alias("nanos"), text.byte_size(F.concat(i, F.lit("MiB"))).alias("bytes"))


@query("""SELECT c_custkey, 'q=' || replace(replace(c_name, '#', '%23'), ' ', '+') || CASE WHEN c_custkey % 2 = 0 THEN '&segment=' || c_mktsegment ELSE '' END AS form FROM customer""")
def q24_form_write(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.form_write({"q": F.col("c_name"), "segment": F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))}).alias("form"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"k": ' || event_id || '}' ELSE '{"k": ' || CAST(json_extract_string(props, '$.k') AS VARCHAR) || ',"type":"' || event_type || '"}' END AS edited FROM events""")
def q25_edit_by_pointer(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    changed = documents.edit_json(F.col("props"), "set", "/k", F.col("event_id").cast("string"))
    grown = documents.edit_json(F.col("props"), "insert", "/type", F.concat(F.lit('"'), "event_type", F.lit('"')))
    return events.select("event_id", F.when(F.col("event_id") % 2 == 0, changed).otherwise(grown).alias("edited"))


@query("""SELECT event_id, '{"a":[1,' || event_id || '],"z":{"k":' || CAST(json_extract_string(props, '$.k') AS VARCHAR) || ',"type":"' || event_type || '"}}' AS canonical FROM events""")
def q26_canonical_nested(spark, sf_dir):
    inner = text.with_member(F.concat(F.lit('{ "type" :"'), F.col("event_type"), F.lit('"}')), "k", F.concat(F.get_json_object("props", "$.k"), F.lit(".0")))
    doc = F.concat(F.lit('{"z": '), inner, F.lit(', "a":[1e0, '), F.col("event_id").cast("string"), F.lit("] }"))
    return table(spark, sf_dir, "events").select("event_id", documents.canonical_json(doc).alias("canonical"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '</a>')) AS BIGINT) AS link_ends, CAST(len(regexp_extract_all(html, '<!--')) AS BIGINT) AS comments FROM pages""")
def q27_markup_tokens(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("t", scalars.xml_tokens(F.col("html")))
    count = lambda kind, name: F.size(F.filter("t", lambda x: (x["kind"] == kind) & (F.lit(name is None) | (x["name"] == F.lit(name))))).cast("long")
    return pages.select("page_id", count("start", "a").alias("links"), count("end", "a").alias("link_ends"), count("comment", None).alias("comments"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'str' WHEN 3 THEN 'null' WHEN 4 THEN 'bool' ELSE 'str' END AS kind FROM events""")
def q28_yaml_scalars(spark, sf_dir):
    i, m = F.col("event_id").cast("string"), F.col("event_id") % 6
    plain = F.when(m == 0, i).when(m == 1, F.concat(i, F.lit(".5e3"))).when(m == 2, F.lit("yes")).when(m == 3, F.lit("~")).when(m == 4, F.lit("True")).otherwise(F.concat(F.lit("0b"), i))
    return table(spark, sf_dir, "events").select("event_id", scalars.yaml_kind(plain).alias("kind"))


@query("""SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - 7200 AS seconds, 120 AS offset_minutes FROM events""")
def q29_offset_times(spark, sf_dir):
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123456789123+02:00"))
    t = scalars.rfc3339(written)
    return table(spark, sf_dir, "events").select("event_id", t["seconds"].alias("seconds"), t["offset_minutes"].alias("offset_minutes"))


@query("""SELECT event_id, 0 AS ordinal, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 1, 'type', event_type FROM events""")
def q30_members(spark, sf_dir):
    line = text.with_member(F.col("props"), "type", F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    return table(spark, sf_dir, "events").select("event_id", F.inline(route.members(line))).drop("raw")


ORDER = RecordSpec(
    (
        FieldSpec("key", "u64"),
        FieldSpec("buyer", RecordSpec((FieldSpec("name"), FieldSpec("segment", nullable=True)))),
        FieldSpec("prices", ListOf("double", nullable=True)),
        FieldSpec("marks", MapOf("int")),
        FieldSpec("pair", TupleOf(("bigint", "string"))),
        FieldSpec("at", "timestamp"),
        FieldSpec("total", "decimal(12,2)"),
    ),
    unknown_fields="ignore",
)


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'UnexpectedType' WHEN 1 THEN 'MissingField' WHEN 2 THEN 'DuplicateField' END AS code,
        CASE o_orderkey % 5 WHEN 0 THEN 'marks.b' WHEN 1 THEN 'buyer.name' END AS field,
        CASE WHEN o_orderkey % 5 > 2 THEN CAST(o_orderkey AS VARCHAR) END AS key, CASE WHEN o_orderkey % 5 > 2 THEN 'Ann "' || o_custkey || '"' END AS buyer,
        CASE WHEN o_orderkey % 5 > 2 THEN 2 END AS prices, CASE WHEN o_orderkey % 5 > 2 THEN CAST(o_custkey % 1000 AS INTEGER) END AS mark,
        CASE WHEN o_orderkey % 5 > 2 THEN o_orderpriority END AS second, CASE WHEN o_orderkey % 5 > 2 THEN CAST(floor(epoch(o_orderdate)) AS BIGINT) - 5400 END AS at_seconds,
        CASE WHEN o_orderkey % 5 > 2 THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS total FROM orders"""
)
def q31_nested_records(spark, sf_dir):
    m = F.col("o_orderkey") % 5
    buyer = F.when(m == 1, F.lit('{"segment":null}')).otherwise(F.concat(F.lit('{"n\\u0061me":"Ann \\"'), "o_custkey", F.lit('\\"" , "segment":null}')))
    last = F.when(m == 2, F.lit(',"extra":{"x":[{"y":1,"y":2}]}}')).otherwise(F.lit(',"extra":{"key":"no","x":[1,{"y":null}]} }'))
    line = F.concat(
        F.lit('{"extra0":{"key":1},"key":'), "o_orderkey", F.lit('.0,"buyer":'), buyer, F.lit(',"prices":[1.5,null],"marks":{"a":'), F.col("o_custkey") % 1000,
        F.lit(',"b":'), F.when(m == 0, F.lit('"1"')).otherwise(F.lit("1e1")), F.lit('},"pair":['), "o_custkey", F.lit(',"'), "o_orderpriority",
        F.lit('"],"at":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('+01:30","total":'), F.col("o_totalprice").cast("decimal(12,2)"), last,
    )
    p = table(spark, sf_dir, "orders").withColumn("p", records.parse_json_record(line, ORDER)).select("o_orderkey", "p.*")
    v = lambda n: F.col(f"value.{n}")
    return p.select(
        "o_orderkey", F.col("_error.code").alias("code"), F.col("_error.field").alias("field"), v("key").cast("string").alias("key"), v("buyer.name").alias("buyer"),
        F.when(v("prices").isNotNull(), F.size(v("prices"))).alias("prices"), F.try_element_at(v("marks"), F.lit("a")).alias("mark"), v("pair._1").alias("second"),
        F.unix_timestamp(v("at")).alias("at_seconds"), v("total").cast("string").alias("total"),
    )


@query(
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'SyntaxError' WHEN 1 THEN 'DuplicateField' WHEN 2 THEN 'UnknownField' WHEN 3 THEN 'InvalidUtf8' WHEN 4 THEN 'SyntaxError' WHEN 6 THEN 'NumberOutOfRange' END AS code,
        CASE WHEN event_id % 7 = 5 THEN CAST(event_id AS BIGINT) END AS k FROM events"""
)
def q32_strict_lines(spark, sf_dir):
    m, i = F.col("event_id") % 7, F.col("event_id").cast("string")
    put = lambda head, tail: F.concat(F.lit(head), i, F.lit(tail))
    line = (
        F.when(m == 0, put('{"k":', '} {"z":2}')).when(m == 1, put('{"k":', ',"\\u006b":1}')).when(m == 2, put('{"nested":{"k":"x"},"k":', "}")).when(m == 3, put('{"s":"\\ud800","k":', "}"))
        .when(m == 4, put('{"k":0', "}")).when(m == 5, put('{"\\u006b":', ".0e0}")).otherwise(put('{"k":', ".00000000001}"))
    )
    spec = RecordSpec((FieldSpec("k", "bigint"), FieldSpec("s", nullable=True)))
    e = table(spark, sf_dir, "events").withColumn("p", records.parse_json_record(line, spec))
    return e.select("event_id", F.col("p._error.code").alias("code"), F.col("p.value.k").alias("k"))


@query(
    """SELECT event_id, 'last' AS first_kind, event_id AS last_n, '{"a" : 1.50, "b":[ 1 ]}' AS kept, 'x' || event_id AS merged_a, event_id AS merged_b, 2 AS merged_list, event_id % 100 AS folded FROM events"""
)
def q33_member_policies(spark, sf_dir):
    i = F.col("event_id").cast("string")
    twice = F.concat(F.lit('{"n":"last","n":'), i, F.lit("}"))
    raw = F.concat(F.lit('{"id":'), i, F.lit(', "data": {"a" : 1.50, "b":[ 1 ]} }'))
    merged = F.concat(F.lit('{"r":{"a":"old","b":'), i, F.lit('},"l":[1,2],"r":{"a":"x'), i, F.lit('"},"l":[9]}'))
    folded = F.concat(F.lit('{"USER_ID":'), F.col("event_id") % 100, F.lit("}"))
    read = lambda line, **k: records.parse_json_record(line, RecordSpec(**k))["value"]
    inner = RecordSpec((FieldSpec("a"), FieldSpec("b", "bigint")))
    m = read(merged, fields=(FieldSpec("r", inner), FieldSpec("l", ListOf("int"))), duplicates="merge")
    e = table(spark, sf_dir, "events").select("event_id", m.alias("m"), read(raw, fields=(FieldSpec("id", "bigint"), FieldSpec("data", "raw"))).alias("raw"), read(twice, fields=(FieldSpec("n"),), duplicates="first").alias("f"),
        read(twice, fields=(FieldSpec("n", "bigint"),), duplicates="last").alias("l"), read(folded, fields=(FieldSpec("user_id", "bigint"),), names="fold").alias("u"))
    return e.select("event_id", F.col("f.n").alias("first_kind"), F.col("l.n").alias("last_n"), F.col("raw.data").alias("kept"), F.col("m.r.a").alias("merged_a"), F.col("m.r.b").alias("merged_b"), F.element_at("m.l", 2).alias("merged_list"), F.col("u.user_id").alias("folded"))


@query(
    """SELECT c_custkey, c_custkey || ',' || CASE c_custkey % 5 WHEN 0 THEN '""' WHEN 1 THEN '' WHEN 2 THEN '"a"",' || chr(10) || c_name || '"' WHEN 3 THEN '"' || chr(13) || '"' ELSE c_name END AS line FROM customer"""
)
def q34_csv_lines(spark, sf_dir):
    m = F.col("c_custkey") % 5
    value = F.when(m == 0, "").when(m == 2, F.concat(F.lit('a",\n'), "c_name")).when(m == 3, "\r").when(m == 4, F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.csv_line(F.col("c_custkey"), value).alias("line"))


_SEGMENT = "CASE WHEN c_custkey % 3 > 0 THEN printf('%02X', {0} + length(c_mktsegment)) || hex(c_mktsegment) ELSE '{1}' END"


@query(
    f"""SELECT c_custkey, 'A3646E616D65' || printf('%02X', 96 + length(c_name)) || hex(c_name) || '666E6174696F6E' || CASE WHEN c_nationkey < 24 THEN printf('%02X', c_nationkey) ELSE '18' || printf('%02X', c_nationkey) END
        || '677365676D656E74' || {_SEGMENT.format(96, "F6")} AS cbor,
        '83A46E616D65' || printf('%02X', 160 + length(c_name)) || hex(c_name) || 'A66E6174696F6E' || printf('%02X', c_nationkey) || 'A77365676D656E74' || {_SEGMENT.format(160, "C0")} AS msgpack FROM customer"""
)
def q35_binary_bytes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("segment", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")))
    member = lambda put, n: (F.col(n).isNull(), put(F.col(n)))
    coded = lambda whole, put_text, put_int: F.hex(whole({"segment": member(put_text, "segment"), "nation": member(put_int, "c_nationkey"), "name": member(put_text, "c_name")}))
    return c.select("c_custkey", coded(binary.cbor_map, binary.cbor_text, binary.cbor_int).alias("cbor"), coded(binary.msgpack_map, binary.msgpack_text, binary.msgpack_int).alias("msgpack"))


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'DuplicateField' WHEN 1 THEN 'UnknownField' WHEN 2 THEN 'MissingField' WHEN 3 THEN 'UnexpectedType' END AS code,
        CASE WHEN event_id % 6 > 3 THEN event_id % 6 = 4 END AS migrated, CASE WHEN event_id % 6 = 4 THEN '0:' || event_id WHEN event_id % 6 = 5 THEN CAST(event_id AS VARCHAR) END AS name,
        CASE WHEN event_id % 6 = 4 THEN '{"v":2,"data":{"name":"0:' || event_id || '"}}' WHEN event_id % 6 = 5 THEN '{"v":2,"data":{"name":"' || event_id || '"}}' END AS rewritten FROM events"""
)
def q36_version_envelopes(spark, sf_dir):
    m, i = F.col("event_id") % 6, F.col("event_id").cast("string")
    now, old = RecordSpec((FieldSpec("name"),)), RecordSpec((FieldSpec("id", "bigint"),))
    put = lambda head, tail: F.concat(F.lit(head), i, F.lit(tail))
    line = (
        F.when(m == 0, put('{"v":2,"v":2,"data":{"name":"', '"}}')).when(m == 1, put('{"v":2,"data":{"name":"', '"},"more":1}')).when(m == 2, F.lit('{"v":2}'))
        .when(m == 3, put('{"v":"2","data":{"name":"', '"}}')).when(m == 4, put('{"data":{"id":', "}}")).otherwise(put('{ "data" : {"name":"', '"}, "v" : 2 }'))
    )
    p = table(spark, sf_dir, "events").withColumn("p", records.parse_versioned(line, 2, now, {0: (old, lambda v: F.struct(F.concat(F.lit("0:"), v["id"].cast("string")).alias("name")))}))
    good = F.col("p._error").isNull()
    return p.select(
        "event_id", F.col("p._error.code").alias("code"), F.when(good, F.col("p.migrated")).alias("migrated"), F.col("p.value.name").alias("name"),
        F.when(good, records.write_versioned(2, now, lambda n: F.col(f"p.value.{n}"))).alias("rewritten"),
    )


@query(
    """SELECT s_suppkey, '{"Key":' || s_suppkey || ',"place":{"nation":' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN ',"note":"a\\"b"' ELSE '' END || '},"tags":["' || s_name || '",null],"by":{"' || s_name || '":' || s_nationkey || '},"pair":[' || s_suppkey || ',"x"],"raw":{"k" : 1.50}'
        || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ',"level":' || (s_suppkey % 3) END || '}' AS line FROM supplier"""
)
def q37_written_records(spark, sf_dir):
    place = RecordSpec((FieldSpec("nation", "int"), FieldSpec("note", nullable=True, omit="null_value")))
    fields = (FieldSpec("key", "bigint", name="Key"), FieldSpec("place", place), FieldSpec("tags", ListOf("string", nullable=True)), FieldSpec("by", MapOf("int")), FieldSpec("pair", TupleOf(("bigint", "string"))), FieldSpec("raw", "raw"), FieldSpec("level", "int", default=0, omit="default_value"))
    s = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_suppkey").alias("key"), F.struct(F.col("s_nationkey").alias("nation"), F.when(F.col("s_suppkey") % 2 == 0, 'a"b').alias("note")).alias("place"),
        F.array(F.col("s_name"), F.lit(None)).alias("tags"), F.create_map("s_name", "s_nationkey").alias("by"), F.struct(F.col("s_suppkey").alias("_0"), F.lit("x").alias("_1")).alias("pair"),
        F.lit('{"k" : 1.50}').alias("raw"), (F.col("s_suppkey") % 3).cast("int").alias("level"),
    )
    return s.select("s_suppkey", records.write_json_record(RecordSpec(fields)).alias("line"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE CAST(event_id AS VARCHAR) END AS value, CAST(1 + length(CASE WHEN event_id % 2 = 0 THEN props ELSE CAST(event_id AS VARCHAR) END) AS INTEGER) AS end_ FROM events""")
def q38_prefix_values(spark, sf_dir):
    written = F.concat(F.lit("\t"), F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("event_id").cast("string")), F.lit(" {}] tail"))
    return table(spark, sf_dir, "events").select("event_id", route.prefix_value(written).alias("p")).select("event_id", F.col("p.value").alias("value"), F.col("p.end").alias("end_"))


@query("""SELECT event_id, '{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || ',' || chr(10) || '  "of": [' || chr(10) || '    "' || event_type || '",' || chr(10) || '    {}' || chr(10) || '  ]' || chr(10) || '}' AS laid_out FROM events""")
def q39_indented(spark, sf_dir):
    line = text.with_member(F.col("props"), "of", F.concat(F.lit('[ "'), "event_type", F.lit('",{ }]')))
    return table(spark, sf_dir, "events").select("event_id", route.indented(line).alias("laid_out"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
