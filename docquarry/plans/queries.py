"""Named queries over documents built from the test tables, each with the relational SQL that must agree."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import make
from ..functions import variant as V
from ..operators import aggregates, compare, conformance, jtd, tree
from ..path import exists, first, nodes
from ..session import shared_folder, table
from ..sources import documents as D
from ..streaming import documents as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: An order's items in the order of its document.
ITEMS = "select l.*, o_orderkey, row_number() over w as i, count(*) over (partition by l_orderkey) as n from lineitem l join orders on o_orderkey = l_orderkey window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag)"


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return D.parsed(D.order_docs(spark, d)).select("o_orderkey", "v")


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    return D.parsed(D.dirty_docs(spark, d))


def _bundles(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, v): each user's events as {"events": [...]}, some of them with odd values."""
    e = D.dirty_docs(spark, d).join(table(spark, d, "events").select("event_id", "user_id"), "event_id")
    listed = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "doc"))).alias("es"))
    text = F.concat(F.lit('{"events":['), F.array_join(F.transform("es", lambda x: x["doc"]), ","), F.lit("]}"))
    return listed.select("user_id", V.parse_tolerant(text).alias("v"))


_LONG, _TEXT, _REAL = V.as_long_or_null, V.as_string_or_null, V.as_double_or_null


def _scalar(name: str, path: str, convert, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _orders(spark, d).select("o_orderkey", convert(first(F.col("v"), path)).alias("x"))

    QUERIES[name], ORACLES[name] = run, sql


def _items(name: str, path: str, where: str) -> None:
    """Matches among an order's items, by their part and price; ``where`` picks the same of ITEMS."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        m = aggregates.matches(_orders(spark, d), "v", path, "o_orderkey")
        return m.select("o_orderkey", _LONG(V.member(F.col("match"), "l_partkey")).alias("partkey"), _REAL(V.member(F.col("match"), "l_extendedprice")).alias("price"))

    QUERIES[name] = run
    ORACLES[name] = f"select o_orderkey, l_partkey as partkey, l_extendedprice as price from ({ITEMS}) where {where}"


_scalar("path_root", "$", lambda v: _LONG(V.member(v, "o_custkey")), "select o_orderkey, o_custkey as x from orders")
_scalar("path_property", "$.o_orderpriority", _TEXT, "select o_orderkey, o_orderpriority as x from orders")
_scalar("path_property_quoted", "$['o_orderstatus']", _TEXT, "select o_orderkey, o_orderstatus as x from orders")
_scalar("path_index", "$.items[0].l_partkey", _LONG, f"select orders.o_orderkey, l_partkey as x from orders left join ({ITEMS}) t on t.o_orderkey = orders.o_orderkey and i = 1")
_scalar("path_index_negative", "$.items[-1].l_partkey", _LONG, f"select orders.o_orderkey, l_partkey as x from orders left join ({ITEMS}) t on t.o_orderkey = orders.o_orderkey and i = n")
_items("path_slice_first2", "$.items[:2]", "i <= 2")
_items("path_slice_last", "$.items[-1:]", "i = n")
_items("path_slice_step", "$.items[::2]", "i % 2 = 1")
_items("path_slice_middle", "$.items[1:-1]", "i > 1 and i < n")
_items("path_wildcard", "$.items[*]", "true")
_items("path_union_indices", "$.items[0,2,-1]", "i = 1 or i = 3 or i = n")
ORACLES["path_union_indices"] = " union all ".join(f"select o_orderkey, l_partkey as partkey, l_extendedprice as price from ({ITEMS}) where {w}" for w in ("i = 1", "i = 3", "i = n"))
_items("path_script_last", "$.items[(@.length-1)]", "i = n")
for _name, _op, _sql in (("eq", "==", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("le", "<=", "<="), ("gt", ">", ">"), ("ge", ">=", ">=")):
    _items(f"filter_num_{_name}", f"$.items[?(@.l_quantity {_op} 25)]", f"l_quantity {_sql} 25")
_items("filter_str_eq", "$.items[?(@.l_returnflag == 'R')]", "l_returnflag = 'R'")
_items("filter_str_lt", "$.items[?(@.l_returnflag < \"R\")]", "l_returnflag < 'R'")
for _name, _op, _sql in (("ne", "!=", "<>"), ("le", "<=", "<="), ("gt", ">", ">"), ("ge", ">=", ">=")):
    _items(f"filter_str_{_name}", f"$.items[?(@.l_returnflag {_op} 'N')]", f"l_returnflag {_sql} 'N'")
_items("filter_and", "$.items[?(@.l_quantity > 10 && @.l_returnflag == 'A')]", "l_quantity > 10 and l_returnflag = 'A'")
_items("filter_or", "$.items[?(@.l_quantity > 45 || @.l_linenumber == 1)]", "l_quantity > 45 or l_linenumber = 1")
_items("filter_not", "$.items[?(!@.l_quantity > 10)]", "not l_quantity > 10")
_items("filter_parens", "$.items[?((@.l_quantity > 40 || @.l_quantity < 5) && !(@.l_returnflag == 'N'))]", "(l_quantity > 40 or l_quantity < 5) and l_returnflag <> 'N'")
_items("filter_paths", "$.items[?(@.l_linenumber == @.l_quantity)]", "l_linenumber = l_quantity")


@query(f"select o_orderkey, cast(n - i as integer) as pos, l_partkey as partkey from ({ITEMS})")
def path_slice_reverse(spark, d):
    m = aggregates.matches(_orders(spark, d), "v", "$.items[::-1]", "o_orderkey")
    return m.select("o_orderkey", "pos", _LONG(V.member(F.col("match"), "l_partkey")).alias("partkey"))


@query("select c_custkey, name from (select c_custkey, c_name as name, c_nationkey from customer) c join nation on n_nationkey = c_nationkey union all select c_custkey, n_name from customer join nation on n_nationkey = c_nationkey union all select c_custkey, r_name from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey")
def path_descent(spark, d):
    m = aggregates.matches(D.parsed(D.customer_docs(spark, d)), "v", "$..name", "c_custkey")
    return m.select("c_custkey", _TEXT(F.col("match")).alias("name"))


@query("select c_custkey, 9 as n from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey")
def path_descent_all(spark, d):
    return D.parsed(D.customer_docs(spark, d)).select("c_custkey", F.size(nodes(F.col("v"), "$..*")).alias("n"))


@query("select o_orderkey, o_orderkey as x from orders union all select o_orderkey, o_custkey from orders")
def path_union_names(spark, d):
    m = aggregates.matches(_orders(spark, d), "v", "$['o_orderkey','o_custkey']", "o_orderkey")
    return m.select("o_orderkey", _LONG(F.col("match")).alias("x"))


@query("select r_name as region, count(*) as n from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by 1")
def path_group_by_member(spark, d):
    v = D.parsed(D.customer_docs(spark, d))
    return v.groupBy(_TEXT(first(F.col("v"), "$.nation.region.name")).alias("region")).agg(F.count("*").alias("n"))


def _user_counts(name: str, path: str, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _bundles(spark, d).select("user_id", F.size(nodes(F.col("v"), path)).cast("long").alias("n"))

    QUERIES[name] = run
    ORACLES[name] = f"select user_id, count(*) filter (where {where}) as n from events group by user_id"


_user_counts("filter_exists", "$.events[?(@.value)]", "event_id % 5 <> 2")
_user_counts("filter_missing", "$.events[?(!@.value)]", "event_id % 5 = 2")
_user_counts("filter_null", "$.events[?(@.value == null)]", "event_id % 5 in (1, 2)")
_user_counts("filter_not_null", "$.events[?(@.value != null)]", "event_id % 5 in (0, 3, 4)")
_user_counts("filter_mixed_kinds", "$.events[?(@.value > 50)]", "event_id % 5 = 4 and value > 50")
_user_counts("filter_kind_differs", "$.events[?(@.value != 1)]", "event_id % 5 <> 4 or value <> 1")
_user_counts("filter_current", "$.events[?(@)]", "true")


@query("select o_orderkey, round(coalesce(sum(l_extendedprice), 0), 2) as total from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def agg_sum_lax(spark, d):
    return _orders(spark, d).select("o_orderkey", F.round(aggregates.sum_lax(nodes(F.col("v"), "$.items[*].l_extendedprice")), 2).alias("total"))


@query("select user_id, round(coalesce(sum(value) filter (where event_id % 5 = 4), 0), 2) as total from events group by 1")
def agg_sum_lax_dirty(spark, d):
    return _bundles(spark, d).select("user_id", F.round(aggregates.sum_lax(nodes(F.col("v"), "$.events[*].value")), 2).alias("total"))


@query("select o_orderkey, round(avg(l_quantity), 6) as mean from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def agg_avg_strict(spark, d):
    return _orders(spark, d).select("o_orderkey", F.round(aggregates.mean_strict(nodes(F.col("v"), "$.items[*].l_quantity")), 6).alias("mean"))


@query("select o_orderkey, count(l_quantity) as n, round(coalesce(sum(l_quantity), 0), 2) as total, min(l_quantity) as least, max(l_quantity) as most, round(avg(l_quantity), 6) as mean from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def agg_summary(spark, d):
    s = _orders(spark, d).select("o_orderkey", aggregates.summary(nodes(F.col("v"), "$.items[*].l_quantity")).alias("s"))
    return s.select("o_orderkey", "s.n", F.round("s.total", 2).alias("total"), "s.least", "s.most", F.round("s.mean", 6).alias("mean"))


@query("select o_orderkey, cast(count(l_orderkey) as integer) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def agg_count(spark, d):
    return _orders(spark, d).select("o_orderkey", F.size(nodes(F.col("v"), "$.items[*]")).alias("n"))


@query("select l_returnflag as flag, count(*) as n, round(sum(l_extendedprice), 0) as total from lineitem join orders on o_orderkey = l_orderkey group by 1")
def agg_over_documents(spark, d):
    m = aggregates.matches(_orders(spark, d), "v", "$.items[*]", "o_orderkey")
    flat = m.select(_TEXT(V.member(F.col("match"), "l_returnflag")).alias("flag"), _REAL(V.member(F.col("match"), "l_extendedprice")).alias("price"))
    return flat.groupBy("flag").agg(F.count("*").alias("n"), F.round(F.sum("price"), 0).alias("total"))


@query("select o_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') as flags from orders join lineitem on l_orderkey = o_orderkey group by 1")
def agg_distinct(spark, d):
    found = _orders(spark, d).select("o_orderkey", aggregates.distinct_text(nodes(F.col("v"), "$.items[*].l_returnflag")).alias("f")).where(F.size("f") > 0)
    return found.select("o_orderkey", F.replace(F.array_join("f", ","), F.lit('"'), F.lit("")).alias("flags"))


@query("select count(*) as n from (select distinct o_orderkey from orders join lineitem on l_orderkey = o_orderkey where l_quantity >= 49)")
def exists_any_match(spark, d):
    return _orders(spark, d).where(exists(F.col("v"), "$.items[?(@.l_quantity >= 49)]")).agg(F.count("*").alias("n"))


@query("select case event_id % 5 when 0 then 'string' when 1 then 'null' when 2 then 'absent' when 3 then 'array' else 'number' end as kind, count(*) as n from events group by 1")
def kind_counts(spark, d):
    found = _dirty(spark, d).select(V.member(F.col("v"), "value").alias("x"))
    return found.groupBy(F.coalesce(V.kind(F.col("x")), F.lit("absent")).alias("kind")).agg(F.count("*").alias("n"))


@query("select event_id, case when event_id % 5 = 4 then value end as d, case when event_id % 5 = 4 and value = floor(value) then cast(value as bigint) end as l, case when event_id % 5 = 0 then cast(event_id as varchar) end as s, cast(null as boolean) as b from events")
def conv_or_null(spark, d):
    x = first(F.col("v"), "$.value")
    return _dirty(spark, d).select("event_id", V.as_double_or_null(x).alias("d"), V.as_long_or_null(x).alias("l"), V.as_string_or_null(x).alias("s"), V.as_boolean_or_null(x).alias("b"))


@query("select event_id, value as d, user_id as l, event_type as s from events")
def conv_strict(spark, d):
    e = D.parsed(D.event_docs(spark, d))
    at = lambda p: first(F.col("v"), p)
    return e.select("event_id", V.as_double(at("$.value")).alias("d"), V.as_long(at("$.user_id")).alias("l"), V.as_string(at("$.event_type")).alias("s"))


@query("select count(*) as n, count(*) filter (where event_id % 2 = 0) as good from events")
def parse_tolerant(spark, d):
    e = D.event_docs(spark, d)
    text = F.when(F.col("event_id") % 2 == 0, F.col("doc")).otherwise(F.concat("doc", F.lit(" {}")))
    return e.agg(F.count("*").alias("n"), F.count_if(V.parse_tolerant(text).isNotNull()).alias("good"))


@query("select count(*) as n from events")
def equal_documents(spark, d):
    """Members in another order make an equal document."""
    e = table(spark, d, "events")
    a = F.to_json(F.struct("event_id", "event_type"))
    b = F.to_json(F.struct("event_type", "event_id"))
    return e.where(V.same(V.parse_tolerant(a), V.parse_tolerant(b))).agg(F.count("*").alias("n"))


EVENT = {"properties": {"event_type": {"enum": ["signup", "purchase", "view", "click", "error"]}, "user_id": {"type": "uint32"}, "value": {"type": "float64"}}}


def _codes(name: str, schema: dict, make, sql: str) -> None:
    """Errors by code over all documents."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = make(spark, d).select(F.explode(jtd.errors(F.col("v"), jtd.compile_schema(schema))).alias("e"))
        return e.groupBy(F.col("e.code").alias("code")).agg(F.count("*").alias("n"))

    QUERIES[name], ORACLES[name] = run, sql


def _events(spark: SparkSession, d: str) -> DataFrame:
    return D.parsed(D.event_docs(spark, d))


_codes("jtd_properties", EVENT, _dirty, "select case when event_id % 5 = 2 then 'missing' else 'type' end as code, count(*) as n from events where event_id % 5 <> 4 group by 1")
_codes("jtd_nullable", {"properties": {**EVENT["properties"], "value": {"type": "float64", "nullable": True}}}, _dirty, "select case when event_id % 5 = 2 then 'missing' else 'type' end as code, count(*) as n from events where event_id % 5 in (0, 2, 3) group by 1")
_codes("jtd_additional", {"properties": {"event_type": {}, "user_id": {}}, "optionalProperties": {"props": {}}}, _events, "select 'additional' as code, count(*) as n from events")
_codes("jtd_enum", {"properties": {"event_type": {"enum": ["view", "click"]}}, "additionalProperties": True}, _events, "select 'enum' as code, count(*) as n from events where event_type not in ('view', 'click')")
_codes("jtd_elements", {"properties": {"items": {"elements": {"properties": {"l_quantity": {"type": "int8"}, "l_returnflag": {"enum": ["A", "R"]}}, "additionalProperties": True}}}, "additionalProperties": True}, _orders, "select 'enum' as code, count(*) as n from lineitem join orders on o_orderkey = l_orderkey where l_returnflag not in ('A', 'R') group by 1")
_codes("jtd_discriminator", {"discriminator": "event_type", "mapping": {t: {"properties": {"user_id": {"type": "uint32"}, "value": {"type": t2}, "props": {"properties": {"k": {"type": "uint8"}}}}} for t, t2 in (("view", "float64"), ("click", "float64"), ("purchase", "int32"), ("signup", "float32"))}}, _events, "select 'mapping' as code, count(*) as n from events where event_type = 'error' union all select 'type', count(*) from events where event_type = 'purchase' and value <> floor(value)")
_codes("jtd_ref", {"definitions": {"place": {"properties": {"name": {"type": "string"}, "key": {"type": "uint8"}}, "optionalProperties": {"region": {"ref": "area"}}}, "area": {"properties": {"name": {"enum": ["EUROPE", "ASIA"]}, "key": {"type": "int8"}}}}, "properties": {"nation": {"ref": "place"}}, "additionalProperties": True}, lambda s, d: D.parsed(D.customer_docs(s, d)), "select 'enum' as code, count(*) as n from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where r_name not in ('EUROPE', 'ASIA')")
for _type, _where in (("int8", "c_acctbal = floor(c_acctbal) and c_acctbal between -128 and 127"), ("uint16", "c_acctbal = floor(c_acctbal) and c_acctbal between 0 and 65535"), ("int32", "c_acctbal = floor(c_acctbal)"), ("float64", "true"), ("string", "false")):

    def _typed(spark, d, t=_type):
        v = D.parsed(D.customer_docs(spark, d))
        return v.select("c_custkey", jtd.valid(first(F.col("v"), "$.balance"), jtd.compile_schema({"type": t})).alias("ok"))

    QUERIES[f"jtd_type_{_type}"], ORACLES[f"jtd_type_{_type}"] = _typed, f"select c_custkey, {_where} as ok from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey"


@query("select event_id, event_type, user_id, value, cast(json_extract(props, '$.k') as bigint) as k from events")
def jtd_spark_type(spark, d):
    """Documents as typed columns, by the type made from a schema."""
    schema = jtd.compile_schema({"properties": {"event_type": {"type": "string"}, "user_id": {"type": "uint32"}, "value": {"type": "float64"}, "props": {"properties": {"k": {"type": "uint32"}}}}})
    e = D.event_docs(spark, d).select("event_id", F.from_json("doc", jtd.spark_type(schema)).alias("x"))
    return e.select("event_id", "x.event_type", "x.user_id", "x.value", "x.props.k")


@query("""with t as (select event_id % 6 as g from events)
select count(*) filter (where g = 0) as accept_pass, count(*) filter (where g = 4) as accept_fail, count(*) filter (where g = 1) as reject_pass, count(*) filter (where g = 2) as reject_fail, count(*) filter (where g = 3) as either_accept, count(*) filter (where g = 5) as either_reject,
round(100.0 * count(*) filter (where g in (0, 1)) / count(*) filter (where g in (0, 1, 2, 4)), 1) as percent from t""")
def report_conformance(spark, d):
    e = D.event_docs(spark, d)
    return conformance.report(conformance.outcomes(_cases(e)))


def _cases(e: DataFrame) -> DataFrame:
    """(name, text): by the id, documents that are to be accepted, rejected or either, half of each as they should be."""
    g = F.col("event_id") % 6
    name = F.concat(F.when(g.isin(0, 4), "y_").when(g.isin(3, 5), "i_").otherwise("n_"), F.col("event_id").cast("string"), F.lit(".json"))
    return e.select(name.alias("name"), F.when(g.isin(1, 4, 5), F.expr("substr(doc, 2)")).otherwise(F.col("doc")).alias("text"))


@query("""select status, count(*) as n from (select case when event_id % 7 = 0 then 'left_only' when event_id % 7 = 1 then 'right_only' when event_id % 7 = 2 then 'different' else 'matching' end as status from events) group by 1""")
def diff_members(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.array("event_type", "props").alias("names"), (F.col("event_id") % 7).alias("g"))
    right = e.where("g <> 0").withColumn("names", F.reverse("names")).withColumn("event_type", F.when(F.col("g") == 2, "other").otherwise(F.col("event_type")))
    return compare.status_counts(compare.compare_items(e.where("g <> 1"), right, ["event_id"], ["event_type", "names"], ("names",)))


@query("select o_orderkey, left(sha256(string_agg(l_partkey || ':' || l_returnflag, chr(10) order by l_partkey || ':' || l_returnflag)), 7) as digest from lineitem join orders on o_orderkey = l_orderkey group by 1")
def fingerprint(spark, d):
    m = aggregates.matches(_orders(spark, d), "v", "$.items[*]", "o_orderkey")
    line = F.concat(_LONG(V.member(F.col("match"), "l_partkey")).cast("string"), F.lit(":"), _TEXT(V.member(F.col("match"), "l_returnflag")))
    return compare.digest(m, line, "o_orderkey")


@query("select date_trunc('hour', ts) as start, count(*) as n, round(sum(value), 2) as total from events group by 1")
def stream_windows(spark, d):
    """The same path on a stream of the events' files, run until they are all read."""
    events = S.read_events(spark, d, "events.parquet")
    doc = F.to_json(F.struct("event_type", "value"))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    S.run_to_table(S.windowed_sums(events.withColumn("doc", doc), "ts", "doc", "$.value"), f"{folder}/rows", f"{folder}/state")
    return S.latest(spark, f"{folder}/rows", "start").select("start", "n", F.round("total", 2).alias("total"))


@query("""select c_custkey, ptr, depth, kind, text, case ptr when '/balance' then round(c_acctbal, 2) end as number from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey,
lateral (values ('', 0, 'object', null), ('/name', 1, 'string', c_name), ('/segment', 1, 'string', c_mktsegment), ('/balance', 1, 'number', null), ('/nation', 1, 'object', null), ('/nation/name', 2, 'string', n_name), ('/nation/key', 2, 'number', cast(n_nationkey as varchar)),
('/nation/region', 2, 'object', null), ('/nation/region/name', 3, 'string', r_name), ('/nation/region/key', 3, 'number', cast(r_regionkey as varchar))) t(ptr, depth, kind, text)""")
def tree_nodes(spark, d):
    v = D.parsed(D.customer_docs(spark, d))
    t = tree.node_table(v, "v", "c_custkey", depth=6)
    balance = F.col("ptr") == "/balance"  # spelled by each engine in its own way, so compared as a number
    return t.select("c_custkey", "ptr", "depth", "kind", F.when(~balance, F.col("text")).alias("text"), F.when(balance, F.round(F.col("text").cast("double"), 2)).alias("number"))


@query("select c_custkey, count(*) as n from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey, generate_series(1, 5) group by 1")
def tree_descendants(spark, d):
    v = tree.node_table(D.parsed(D.customer_docs(spark, d)), "v", "c_custkey", depth=6)
    return tree.descendants(v, "/nation").groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("select event_id, user_id, event_type from events")
def make_objects(spark, d):
    """Values built from columns read back as they were."""
    v = table(spark, d, "events").select("event_id", make.json_object(u=F.col("user_id"), t=F.col("event_type")).alias("v"))
    return v.select("event_id", _LONG(V.member(F.col("v"), "u")).alias("user_id"), _TEXT(V.member(F.col("v"), "t")).alias("event_type"))
