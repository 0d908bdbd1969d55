"""More named queries: spellings, decoding, files, positions, messages, kinds and described classes.

Their documents are built from the events, so that each answer can be had from
the table by plain SQL.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import make, positions
from ..functions import variant as V
from ..operators import aggregates, compare, conformance, descriptions, jtd
from ..path import first, nodes
from ..session import shared_folder, spread, table
from ..sources import corpus
from ..sources import documents as D
from .queries import ORACLES, QUERIES, _cases, _events, _orders, query


def _id() -> Column:
    return F.col("event_id").cast("string")


def _e(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value", "props"))


def _spelled(e: DataFrame) -> DataFrame:
    """(event_id, doc): escapes in names and texts, and the words of the grammar."""
    doc = F.concat(F.lit(r'{ "name" : "café 😀\n\"'), F.col("event_type"), F.lit(r'\"\\\/" , "yes":true,"no":false,"nil":null,"id":'), _id(), F.lit(',"list":[ [ ] , { } , -0.5e1 ]}'))
    return e.select("event_id", "event_type", doc.alias("doc"))


@query("select event_id, 'café 😀' || chr(10) || '\"' || event_type || '\"\\/' as name, true as yes, false as no, true as nil, event_id as id, -5.0 as number, 3 as n from events")
def parse_spellings(spark, d):
    v = _spelled(_e(spark, d)).withColumn("v", V.parse_strict(F.col("doc")))
    at = lambda p: first(F.col("v"), p)
    return v.select(
        "event_id", V.as_string(at("$.name")).alias("name"), V.as_boolean(at("$.yes")).alias("yes"), V.as_boolean(at("$.no")).alias("no"),
        F.is_variant_null(at("$.nil")).alias("nil"), V.as_long(at("$.id")).alias("id"), V.as_double(at("$.list[2]")).alias("number"), F.size(V.as_elements(at("$.list"))).alias("n"),
    )


@query("select event_id, 'café 😀' || event_type as name from events")
def parse_chars(spark, d):
    """Text that arrives as bytes is parsed the same."""
    doc = F.concat(F.lit('{"name":"café 😀'), F.col("event_type"), F.lit('"}')).cast("binary")
    v = _e(spark, d).select("event_id", V.parse_strict(doc.cast("string")).alias("v"))
    return v.select("event_id", V.as_string(first(F.col("v"), "$.name")).alias("name"))


#: Texts that are no documents, each behind the id and a space: what, and where after these.
BROKEN = (("{\"a\":1} {}", 8), ("[1,\n2,,3]", None), ("{\"a\":1,\"a\":2}", 7), ("[1 2]", 3), ("\"x", 0), ("NaN", 0))


@query(
    "select event_id, case event_id % 7 when 1 then 1 else 0 end as line, case event_id % 7 when 1 then 2 else length(event_type) + 3 + case event_id % 7 when 0 then 9 when 2 then 8 when 3 then 4 when 4 then 1 else 1 end end as position from events where event_id % 7 <> 6"
)
def parse_positions(spark, d):
    """Line and position of what is wrong; whole documents give nothing."""
    g = F.col("event_id") % 7
    part = F.element_at(F.array(*[F.lit(t) for t, _ in BROKEN], F.lit("[]")), (g + 1).cast("int"))
    doc = F.concat(F.lit('["'), F.col("event_type"), F.lit('",'), part, F.lit("]"))
    inner = F.when(g == 0, F.concat(F.lit('["'), F.col("event_type"), F.lit('",{"a":1} {}]'))).otherwise(doc)
    found = _e(spark, d).select("event_id", positions.diagnose(inner).alias("x"))
    return found.where("x is not null").select("event_id", "x.line", "x.position")


@query(
    """select event_id, case event_id % 3 when 0 then 'JsonString is not a JsonNumber. Path: "{a[1{b". Location: line 1, position ' || (length(cast(event_id as varchar)) + 6) || '.' when 1 then 'JsonNull is not a JsonNumber. Path: "{a[1{b". Location: line 1, position ' || (length(cast(event_id as varchar)) + 6) || '.' end as said from events"""
)
def kind_errors(spark, d):
    """What a strict reading of a value says, with the way to it and its place in the text."""
    x = F.when(F.col("event_id") % 3 == 0, '"1"').when(F.col("event_id") % 3 == 1, "null").otherwise("1")
    e = _e(spark, d).select("event_id", F.concat(F.lit('{"a":[\n'), _id(), F.lit(',{"b":'), x, F.lit("}]}")).alias("doc"))
    v = V.parse_tolerant(F.col("doc"))
    return e.select("event_id", positions.kind_error(v, F.col("doc"), "$.a[1].b", "number").alias("said"))


@query("select doc_id, md5(cast(to_json(text) as varchar)) as escaped from documents where text is not null")
def escape_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(V.escaped(F.col("text")).cast("binary")).alias("escaped"))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, event_type, v): documents with truth values and times."""
    i = F.col("event_id")
    when = F.when(i % 3 == 0, "2024-02-29T23:59:60Z").when(i % 3 == 1, "2023-02-29T10:00:00Z").otherwise("yesterday")
    even = F.when(i % 5 == 0, F.lit('"true"')).otherwise((i % 2 == 0).cast("string"))
    doc = F.concat(F.lit('{"even":'), even, F.lit(',"when":"'), when, F.lit('","big":'), (i * 7 - 30000).cast("string"), F.lit(',"props":{"k":'), (i % 300).cast("string"), F.lit(',"j":'), (i % 2).cast("string"), F.lit('},"mixed":'), F.when(i % 3 == 0, "{}").when(i % 3 == 1, "[]").otherwise('{"a":1}'), F.lit("}"))
    return _e(spark, d).select("event_id", "event_type", V.parse_tolerant(doc).alias("v"))


@query("select event_id, case when event_id % 5 <> 0 then event_id % 2 = 0 end as even from events")
def conv_boolean(spark, d):
    return _flags(spark, d).select("event_id", V.as_boolean_or_null(first(F.col("v"), "$.even")).alias("even"))


def _flag_filter(name: str, test: str, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        listed = _flags(spark, d).select("event_id", F.array("v").alias("vs"))
        as_list = listed.select("event_id", V.parse_tolerant(F.concat(F.lit("["), F.to_json(F.get("vs", F.lit(0))), F.lit("]"))).alias("v"))
        return as_list.where(F.size(nodes(F.col("v"), f"$[?({test})]")) > 0).select("event_id")

    QUERIES[name], ORACLES[name] = run, f"select event_id from events where {where}"


_flag_filter("filter_true", "@.even == true", "event_id % 5 <> 0 and event_id % 2 = 0")
_flag_filter("filter_not_false", "@.even != false", "event_id % 5 = 0 or event_id % 2 = 0")
_flag_filter("filter_ordered_booleans", "!(@.even < true) && !(@.even >= false) && @.even != false", "event_id % 5 = 0 or event_id % 2 = 0")
_flag_filter("filter_text_is_no_boolean", "@.even == 'true'", "event_id % 5 = 0")


def _valid(name: str, path: str, schema: dict, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _flags(spark, d).select("event_id", jtd.valid(first(F.col("v"), path), jtd.compile_schema(schema)).alias("ok"))

    QUERIES[name], ORACLES[name] = run, f"select event_id, {where} as ok from events"


_valid("jtd_type_boolean", "$.even", {"type": "boolean"}, "event_id % 5 <> 0")
_valid("jtd_type_timestamp", "$.when", {"type": "timestamp"}, "event_id % 3 = 0")
_valid("jtd_type_int16", "$.big", {"type": "int16"}, "event_id * 7 - 30000 between -32768 and 32767")
_valid("jtd_type_uint8", "$.props.k", {"type": "uint8"}, "event_id % 300 <= 255")
_valid("jtd_properties_kind", "$.mixed", {"properties": {}, "additionalProperties": True}, "event_id % 3 <> 1")


@query("select 'type' as code, '/properties/props/values/type' as schema, '#→field:props→field:k' as via, 'expected uint8, got out of range' as message, count(*) as n from events where event_id % 300 > 255 having count(*) > 0")
def jtd_values(spark, d):
    schema = jtd.compile_schema({"properties": {"props": {"values": {"type": "uint8"}}}, "additionalProperties": True})
    e = _flags(spark, d).select(F.explode(jtd.errors(F.col("v"), schema)).alias("e")).select("e.*")
    return e.groupBy("code", "schema", "via", "message").agg(F.count("*").alias("n"))


@query(
    """with t as (select event_id % 5 as g, user_id, event_type from events), found as (
    select '[off=-1 ptr=#/value via=#→field:value] expected float64, got string' as line from t where g = 0
    union all select '[off=-1 ptr=#/value via=#→field:value] expected float64, got null' from t where g = 1
    union all select '[off=-1 ptr=# via=#] missing required property: ''value''' from t where g = 2
    union all select '[off=-1 ptr=#/value via=#→field:value] expected float64, got array' from t where g = 3
    union all select '[off=-1 ptr=#/user_id via=#→field:user_id] additional property not allowed: ''user_id''' from t
    union all select '[off=-1 ptr=#/event_type via=#→field:event_type] value ''' || event_type || ''' not in enum: [view, click]' from t where event_type not in ('view', 'click'))
    select line, count(*) as n from found group by 1"""
)
def jtd_messages(spark, d):
    schema = jtd.compile_schema({"properties": {"value": {"type": "float64"}, "event_type": {"enum": ["view", "click"]}}})
    lines = D.parsed(D.dirty_docs(spark, d)).select(F.explode(jtd.rendered(jtd.errors(F.col("v"), schema))).alias("line"))
    return lines.groupBy("line").agg(F.count("*").alias("n"))


@query(
    """select event_id, '[off=' || (22 + length(event_type)) || ' ptr=#/n via=#→field:n] expected integer, got float (was: 1.5)' as line from events where event_id % 2 = 0
    union all select event_id, '[off=6 ptr=#/t via=#→field:t] expected boolean, got string (was: "' || event_type || '")' from events"""
)
def jtd_messages_verbose(spark, d):
    schema = jtd.compile_schema({"properties": {"t": {"type": "boolean"}, "n": {"type": "uint8"}}, "additionalProperties": True})
    doc = F.concat(F.lit('{"t": "'), F.col("event_type"), F.lit('", "pad":0,"n":'), F.when(F.col("event_id") % 2 == 0, "1.5").otherwise("1"), F.lit("}"))
    e = _e(spark, d).select("event_id", doc.alias("doc")).withColumn("v", V.parse_tolerant(F.col("doc")))
    found = e.select("event_id", "doc", jtd.errors(F.col("v"), schema, verbose=True).alias("errors"))
    return found.select("event_id", F.explode(jtd.rendered(F.col("errors"), F.col("doc"))).alias("line"))


#: A schema for each rule, and whether it is accepted.
RULES = (
    ("empty", "{}", True), ("not an object", "[]", False), ("definitions below the root", '{"elements":{"definitions":{}}}', False), ("forward reference", '{"definitions":{"a":{"ref":"b"},"b":{}},"ref":"a"}', True),
    ("two forms", '{"type":"string","enum":["a"]}', False), ("properties of both kinds", '{"properties":{"a":{}},"optionalProperties":{"b":{}}}', True), ("foreign keyword", '{"elements":{},"additionalProperties":true}', False),
    ("mapping alone", '{"mapping":{}}', False), ("discriminator alone", '{"discriminator":"t"}', False), ("unknown keyword", '{"colour":1}', False), ("nullable", '{"nullable":true}', True), ("nullable as text", '{"nullable":"yes"}', False),
    ("reference to nothing", '{"ref":"a"}', False), ("unknown type", '{"type":"int64"}', False), ("repeated enum", '{"enum":["a","a"]}', False), ("empty enum", '{"enum":[]}', False), ("elements", '{"elements":{"type":"int8"}}', True),
    ("values", '{"values":{"type":"int8"}}', True), ("property twice", '{"properties":{"a":{}},"optionalProperties":{"a":{}}}', False), ("additional as number", '{"properties":{},"additionalProperties":1}', False),
    ("tag redefined", '{"discriminator":"t","mapping":{"a":{"properties":{"t":{}}}}}', False), ("nullable variant", '{"discriminator":"t","mapping":{"a":{"properties":{},"nullable":true}}}', False), ("tagged", '{"discriminator":"t","mapping":{"a":{"properties":{}}}}', True),
)


#: Paths, and their canonical text or the position at which they cannot be read.
SPELLINGS = (("$", "$", -1), ("$['a'].b", "$.a.b", -1), ("$[*]", "$.*", -1), ("$..[0]", "$..[0]", -1), ("$[1:5:2]", "$[1:5:2]", -1), ("$['a','b c']", "$['a','b c']", -1), ("$[?(@.a<1&&!@.b)]", "$[?((@.a < 1 && !@.b))]", -1), ("$['b c']", "$['b c']", -1), ("a", None, 0), ("$.", None, 2), ("$[1", None, 1), ("$x", None, 1))


@query("select event_id, cast(2 + event_id % 2 as integer) as members, cast(event_id % 4 as integer) as elements, event_id % 2 = 1 as has from events")
def members_and_elements(spark, d):
    i = F.col("event_id")
    doc = F.concat(F.lit('{"a":1,"list":['), F.array_join(F.array_repeat(F.lit("0"), (i % 4).cast("int")), ","), F.lit("]"), F.when(i % 2 == 1, F.lit(',"more":null}')).otherwise("}"))
    v = _e(spark, d).select("event_id", V.parse_strict(doc).alias("v"))
    members = V.as_members(F.col("v"))
    return v.select("event_id", F.size(members).alias("members"), F.size(V.as_elements(V.member(F.col("v"), "list"))).alias("elements"), F.map_contains_key(members, F.lit("more")).alias("has"))


@query("select o_orderkey, min(l_partkey) filter (where i = 1) as first, max(l_partkey) filter (where i = n) as last from (select l.*, o_orderkey, row_number() over w as i, count(*) over (partition by l_orderkey) as n from lineitem l join orders on o_orderkey = l_orderkey window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag)) group by 1")
def agg_first_last(spark, d):
    o = _orders(spark, d).select("o_orderkey", nodes(F.col("v"), "$.items[*].l_partkey").alias("xs")).where(F.size("xs") > 0)
    return o.select("o_orderkey", V.as_long(F.get("xs", F.lit(0))).alias("first"), V.as_long(aggregates.last(F.col("xs"))).alias("last"))


@query("select case when event_id % 6 = 4 then 'y_' else 'n_' end || event_id || '.json' as name, case when event_id % 6 = 4 then 'accept' else 'reject' end as expected from events where event_id % 6 in (2, 4)")
def report_failures(spark, d):
    return conformance.failures(conformance.outcomes(_cases(_events(spark, d))))


@query("select event_id, event_id % 3 = 0 as expected, cast(case when event_id % 4 <> 3 then event_id % 2 = 0 end as boolean) as actual from events where event_id % 4 = 3 or (event_id % 3 = 0) <> (event_id % 2 = 0)")
def expected_and_actual(spark, d):
    e = _e(spark, d)
    doc = F.concat(F.lit('{"n":'), F.when(F.col("event_id") % 2 == 0, _id()).otherwise('"x"'), F.lit("}"))
    found = e.where("event_id % 4 <> 3").select("event_id", jtd.valid(V.parse_tolerant(doc), jtd.compile_schema({"properties": {"n": {"type": "uint32"}}})).alias("valid"))
    return conformance.mismatches(e.select("event_id", (F.col("event_id") % 3 == 0).alias("valid")), found, "event_id")


@query("select o_orderkey, l_partkey as partkey, l_extendedprice as price from lineitem join orders on o_orderkey = l_orderkey order by price desc, o_orderkey, partkey limit 20")
def top_matches(spark, d):
    m = aggregates.matches(_orders(spark, d), "v", "$.items[*]", "o_orderkey")
    flat = m.select("o_orderkey", V.as_long_or_null(V.member(F.col("match"), "l_partkey")).alias("partkey"), V.as_double_or_null(V.member(F.col("match"), "l_extendedprice")).alias("price"))
    return aggregates.top(flat, F.col("price"), 20, "o_orderkey", "partkey")


@query("select o_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), '') as common, count(*) > count(distinct l_returnflag) as repeated from orders join lineitem on l_orderkey = o_orderkey group by 1 having count(*) > 0")
def set_operations(spark, d):
    o = _orders(spark, d).select("o_orderkey", F.transform(nodes(F.col("v"), "$.items[*].l_returnflag"), V.as_string).alias("xs")).where(F.size("xs") > 0)
    return o.select("o_orderkey", F.array_join(F.array_sort(make.common(F.col("xs"), F.reverse("xs"))), "").alias("common"), make.has_duplicates(F.col("xs")).alias("repeated"))


@query("select o_orderkey, array_to_string(list_sort(list_intersect(list(l_linenumber), list(cast(l_quantity as integer)))), ',') as both from orders join lineitem on l_orderkey = o_orderkey group by 1")
def set_intersection(spark, d):
    """The line numbers of an order that are quantities of it as well."""
    of = lambda c: F.transform(nodes(F.col("v"), f"$.items[*].{c}"), V.as_long)
    o = _orders(spark, d).select("o_orderkey", of("l_linenumber").alias("a"), of("l_quantity").alias("b")).where(F.size("a") > 0)
    return o.select("o_orderkey", F.array_join(F.transform(F.array_sort(make.common(F.col("a"), F.col("b"))), lambda x: x.cast("string")), ",").alias("both"))


@query("with t as (select l.*, o_orderkey, row_number() over w as i from lineitem l join orders on o_orderkey = l_orderkey window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag)) select o_orderkey, l_returnflag as flag, arg_max(l_partkey, i) as partkey from t group by all")
def merge_last_wins(spark, d):
    pair = lambda x: F.struct(V.as_string(V.member(x, "l_returnflag")).alias("key"), V.as_long(V.member(x, "l_partkey")).alias("value"))
    o = _orders(spark, d).select("o_orderkey", F.transform(nodes(F.col("v"), "$.items[*]"), pair).alias("es"))
    return o.select("o_orderkey", F.explode(make.last_wins(F.col("es"))).alias("flag", "partkey"))


@query("select event_id, event_type as simple, 'core/' || event_type || '.java' as path, cast(power(user_id % 12, event_id % 7) as bigint) as power, strftime(ts, '%Y-%m-%d') as day from events")
def scalar_functions(spark, d):
    name = F.concat(F.lit("org.sample."), F.col("event_type"))
    return _e(spark, d).select(
        "event_id", compare.simple_name(F.concat(name, F.lit("<T>"))).alias("simple"), descriptions.source_path(name, {"org.sample": "core"}).alias("path"),
        make.power(F.col("user_id") % 12, (F.col("event_id") % 7).cast("int")).alias("power"), descriptions.day(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("day"),
    )


@query("select event_id, 'local ' || event_type || ' x' as text from events")
def rewrite_text(spark, d):
    return _e(spark, d).select("event_id", make.rewrite(F.concat(F.lit("global  "), F.col("event_type"), F.lit("\t\tx")), [(r"\bglobal\b", "local"), (r"\s+", " ")]).alias("text"))


@query("select event_id, '{' || chr(10) || '  \"id\": ' || event_id || ',' || chr(10) || '  \"list\": [' || chr(10) || '    1,' || chr(10) || '    \"é\"' || chr(10) || '  ]' || chr(10) || '}' as text from events")
def display_text(spark, d):
    doc = F.concat(F.lit('{"id":'), _id(), F.lit(',"list":[1,"é"]}'))
    return _e(spark, d).select("event_id", make.display(V.parse_strict(doc)).alias("text"))


@query("select event_id, user_id as u, case when event_id % 2 = 0 then event_id * 1.0 + 0.5 end as x from events")
def make_values(spark, d):
    """Objects from maps, and numbers from their text."""
    number = make.json_number(F.concat(_id(), F.when(F.col("event_id") % 2 == 0, ".5").otherwise("x")))
    e = _e(spark, d).select("event_id", make.json_map(F.create_map(F.lit("u"), F.col("user_id"))).alias("v"), number.alias("n"))
    return e.select("event_id", V.as_long(V.member(F.col("v"), "u")).alias("u"), V.as_double_or_null(F.col("n")).alias("x"))


@query("select event_id, 'é' || event_type || case when event_id % 4 = 3 then 'ÿ' else '' end as name, case event_id % 4 when 1 then 'utf-16-be' when 2 then 'utf-8' end as mark from events")
def decode_bytes(spark, d):
    """Documents as bytes of several encodings, with and without a mark, and with a broken byte."""
    g = F.col("event_id") % 4
    doc = F.concat(F.lit('{"name":"é'), F.col("event_type"))
    whole = F.concat(doc, F.lit('"}'))
    content = (
        F.when(g == 0, F.encode(whole, "UTF-16LE"))
        .when(g == 1, F.encode(whole, "UTF-16"))  # big-endian with a mark
        .when(g == 2, F.concat(F.unhex(F.lit("EFBBBF")), whole.cast("binary")))
        .otherwise(F.concat(doc.cast("binary"), F.unhex(F.lit("FF")), F.lit('"}').cast("binary")))
    )
    e = corpus.decoded(_e(spark, d).select("event_id", content.alias("content")))
    return e.select("event_id", V.as_string(first(V.parse_tolerant(F.col("text")), "$.name")).alias("name"), corpus.byte_order_mark(F.col("content")).alias("mark"))


@query(
    """select event_type as path, 'a.json' as member, count(*) as n, null as error from events group by 1 union all select event_type, 'b/c.json', 1, null from (select distinct event_type from events)
    union all select event_type, 'e.json', null, 'broken member' from (select distinct event_type from events) union all select event_type || '-cut', null, null, 'no archive' from (select distinct event_type from events)"""
)
def zip_scan(spark, d):
    """Archives with a document, one deeper, a file of another kind and a broken member; and the same archives cut short."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    z.writestr("a.json", f'{{"n":{n}}}')
                    z.writestr("b/c.json", '{"n":1}')
                    z.writestr("d.txt", "{}")
                    z.writestr("e.json", "spoilt")
                whole = held.getvalue().replace(b"spoilt", b"spoilT")
                yield pa.RecordBatch.from_arrays([pa.array([name, f"{name}-cut"]), pa.array([whole, whole[:-30]])], names=["path", "content"])

    archives = _e(spark, d).groupBy("event_type").agg(F.count("*").alias("n")).mapInArrow(pack, "path string, content binary")
    found = corpus.decoded(corpus.zip_members(archives))
    return found.select(F.split_part("path", F.lit("!"), F.lit(1)).alias("path"), F.nullif(F.split_part("path", F.lit("!"), F.lit(2)), F.lit("")).alias("member"), V.as_long_or_null(first(V.parse_tolerant(F.col("text")), "$.n")).alias("n"), F.split_part("error", F.lit(":"), F.lit(1)).alias("error"))


@query("select * from (values ('events.parquet', true, null), ('nation.parquet', true, null), ('none.json', false, 'LOCAL_FILE_NOT_FOUND: none.json')) t(name, found, error)")
def scan_folder(spark, d):
    """Files that are wanted, by name; a missing one is a row with an error."""
    wanted = spark.createDataFrame([("events.parquet",), ("nation.parquet",), ("none.json",)], "name string")
    return corpus.wanted_files(spark, d, wanted).select("name", F.col("error").isNull().alias("found"), "error").orderBy("name")


def _described(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two collections of described classes that differ by the id."""
    e = _e(spark, d).where("event_id is not null")
    i = F.col("event_id")
    method = lambda returns, *ps: F.struct(F.lit(returns).alias("returns"), F.array(*map(F.lit, ps)).alias("parameters"))
    common = [F.concat(F.lit("org.sample.C"), _id()).alias("class_name"), F.lit(False).alias("is_enum"), F.lit(False).alias("is_record"), F.lit(False).alias("is_sealed")]
    local = e.select(
        *common, i.alias("i"), F.lit(True).alias("is_interface"), F.array(F.lit("public"), F.lit("final")).alias("modifiers"), F.array(F.lit("org.sample.Base")).alias("extends"),
        F.create_map(F.lit("get"), method("java.lang.String", "int i"), F.lit("put"), method("void", "org.sample.Key k", "int i")).alias("methods"), F.array(F.lit("x"), F.lit("y")).alias("fields"), F.lit(1).alias("constructors"),
    ).drop("i")
    g = i % 11
    upstream = e.where(g != 10).select(
        *common, (g != 1).alias("is_interface"), F.when(g == 2, F.array(F.lit("public"))).otherwise(F.array(F.lit("final"), F.lit("public"))).alias("modifiers"),
        F.array(F.when(g == 3, "up.Other").otherwise("up.Base")).alias("extends"),
        F.when(g == 4, F.create_map(F.lit("get"), method("String", "int i"), F.lit("del"), method("void")))
        .when(g == 5, F.create_map(F.lit("get"), method("String", "int j"), F.lit("put"), method("void", "up.Key k", "int i")))
        .otherwise(F.create_map(F.lit("get"), method("String", "int i"), F.lit("put"), method("void", "up.Key k", "int i"))).alias("methods"),
        F.when(g == 6, F.array(F.lit("x"))).otherwise(F.array(F.lit("y"), F.lit("x"))).alias("fields"), F.when(g == 7, 2).otherwise(1).alias("constructors"),
        F.when(g == 8, "HTTP 404").alias("error"), F.when(g == 9, "NOT_IMPLEMENTED").alias("status"),
    )
    return local, upstream


@query(
    "select 'org.sample.C' || event_id as class_name, case when event_id % 11 = 0 then 'MATCHING' when event_id % 11 in (8, 10) then 'UPSTREAM_ERROR' when event_id % 11 = 9 then 'PARSE_NOT_IMPLEMENTED' else 'DIFFERENT' end as status, case event_id % 11 when 8 then 'HTTP 404' when 10 then 'NOT_FOUND' end as error from events"
)
def diff_classes(spark, d):
    return descriptions.compare_classes(*_described(spark, d)).select("class_name", "status", "error").orderBy("class_name")


@query(
    """select 'org.sample.C' || event_id || ':' || change as line from events join (values (1, 'attributeChanged:'), (2, 'modifiersChanged:'), (3, 'inheritanceChanged:'), (4, 'methodRemoved:put'), (4, 'methodAdded:del'),
    (5, 'methodChanged:get'), (6, 'fieldsChanged:'), (7, 'constructorsChanged:')) t(g, change) on event_id % 11 = g"""
)
def diff_class_changes(spark, d):
    return descriptions.change_lines(descriptions.compare_classes(*_described(spark, d))).select("line")


@query(
    """with t as (select count(*) as n, count(*) filter (where event_id % 11 = 0) as m, count(*) filter (where event_id % 11 between 1 and 7) as f, count(*) filter (where event_id % 11 in (8, 10)) as u from events)
    select '## API Comparison Summary' || chr(10) || chr(10) || '| Metric | Count |' || chr(10) || '|--------|-------|' || chr(10) || '| Total Classes | ' || n || ' |' || chr(10) || '| Matching | ' || m || ' |' || chr(10) || '| Different | ' || f || ' |' || chr(10) || '| Missing Upstream | ' || u || ' |' || chr(10) || chr(10) as text, f > 0 as has_differences from t"""
)
def diff_summary(spark, d):
    row = descriptions.totals(descriptions.compare_classes(*_described(spark, d)))
    return row.select(descriptions.heading_text().alias("text"), "has_differences")


@query(
    """select 'org.sample.C' || event_id as class_name, '### org.sample.C' || event_id || chr(10) || chr(10) || case event_id % 11 when 1 then '- ❓ **attributeChanged**: `unknown`' when 2 then '- ❓ **modifiersChanged**: `unknown`' when 3 then '- 🔗 **inheritanceChanged**: `unknown`'
    when 4 then '- ➖ **methodRemoved**: `put`' || chr(10) || '- ➕ **methodAdded**: `del`' when 5 then '- 🔄 **methodChanged**: `get`' when 6 then '- 📦 **fieldsChanged**: `unknown`' else '- 🏗️ **constructorsChanged**: `unknown`' end || chr(10) || chr(10) as section from events where event_id % 11 between 1 and 7"""
)
def diff_sections(spark, d):
    return descriptions.class_sections(descriptions.compare_classes(*_described(spark, d)))


@query("select count(*) as total, count(*) filter (where event_id % 11 = 0) as matching, count(*) filter (where event_id % 11 between 1 and 7) as different, count(*) filter (where event_id % 11 in (8, 10)) as missing, '2024-05-06' as made from events")
def report_files(spark, d):
    """The report's files, written to the shared folder and read back."""
    folder = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    descriptions.write_report(descriptions.compare_classes(*_described(spark, d)), folder, made="2024-05-06T07:08:09")
    return spark.read.schema("total long, matching long, different long, missing long, made string").json(f"{descriptions.current_report(spark, folder)}/totals")


@query(
    """with t as (select count(*) as n, count(*) filter (where event_id % 11 = 0) as m, count(*) filter (where event_id % 11 between 1 and 7) as f, count(*) filter (where event_id % 11 in (8, 10)) as u from events), parts as (
    select 0 as part, null as class_name, '## API Comparison Summary' || chr(10) || chr(10) || '| Metric | Count |' || chr(10) || '|--------|-------|' || chr(10) || '| Total Classes | ' || n || ' |' || chr(10) || '| Matching | ' || m || ' |' || chr(10) || '| Different | ' || f || ' |' || chr(10) || '| Missing Upstream | ' || u || ' |' || chr(10) || chr(10) as text from t
    union all select 1, null, '## Changes Detected' || chr(10) || chr(10) from t where f > 0
    union all select 2, 'org.sample.C' || event_id, '### org.sample.C' || event_id || chr(10) || chr(10) || case event_id % 11 when 1 then '- ❓ **attributeChanged**: `unknown`' when 2 then '- ❓ **modifiersChanged**: `unknown`' when 3 then '- 🔗 **inheritanceChanged**: `unknown`'
    when 4 then '- ➖ **methodRemoved**: `put`' || chr(10) || '- ➕ **methodAdded**: `del`' when 5 then '- 🔄 **methodChanged**: `get`' when 6 then '- 📦 **fieldsChanged**: `unknown`' else '- 🏗️ **constructorsChanged**: `unknown`' end || chr(10) || chr(10) from events where event_id % 11 between 1 and 7
    union all select 3, null, '---' || chr(10) || '*Generated by API Tracker on 2024-05-06*' || chr(10))
    select * from parts"""
)
def report_summary(spark, d):
    """The whole Markdown summary, in pieces that make one text in their order."""
    return descriptions.summary(descriptions.compare_classes(*_described(spark, d)), "2024-05-06T07:08:09")


@query("select left(sha256(string_agg('org.sample.C' || event_id || ':' || change, chr(10) order by 'org.sample.C' || event_id || ':' || change)), 7) as digest from events join (values (1, 'attributeChanged:'), (2, 'modifiersChanged:'), (3, 'inheritanceChanged:'), (4, 'methodRemoved:put'), (4, 'methodAdded:del'), (5, 'methodChanged:get'), (6, 'fieldsChanged:'), (7, 'constructorsChanged:')) t(g, change) on event_id % 11 = g where event_id < 4000")
def report_fingerprint(spark, d):
    """The fingerprint of a report whose lines one row holds is that of its sorted lines."""
    local, upstream = _described(spark, d)
    few = F.split_part("class_name", F.lit("C"), F.lit(2)).cast("long") < 4000
    return compare.sorted_digest(descriptions.change_lines(descriptions.compare_classes(local.where(few), upstream.where(few))), F.col("line"))


__all__ = ["ORACLES", "QUERIES"]
