"""A query for every operator, over the whole tables, and the SQL that each equals.

Nested fixtures are written once per session and data folder, below the shared
folder, by the engine's own writer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .operators import advise, distinct, nest, rows
from .plans.project import ALL
from .schema import Map, Set, Tag
from .sources.files import scratch
from .sources.reader import FilesReader, Reader
from .sources.writer import rejects, validate, write
from .types import CustomType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_written: dict[tuple, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_NATION = "{:name string :region {:name string}}"
LINE_ITEM = f"""
#req {{:orderkey #req long :linenumber #req int :quantity double :extendedprice double :discount double :tax double
      :returnflag string :linestatus string :shipdate inst :partkey long :suppkey long
      :order {{:orderkey long :orderstatus string :totalprice double :orderdate inst :orderpriority string
              :customer {{:name string :acctbal double :mktsegment string :nation {_NATION}}}}}
      :part {{:partkey long :name string :brand string :type string :size int :retailprice double}}
      :supplier {{:suppkey long :name string :acctbal double :nation {_NATION}}}}}"""
CUSTOMER = """
{:custkey #req long :name string :acctbal double :mktsegment string :nationkey int
 :orders [{:orderkey #req long :orderstatus string :totalprice double
           :items [{:linenumber int :partkey long :quantity double :extendedprice double}]}]}"""
USER = "{:user_id #req long :events [{:event_type string :value double}] :meta {#req string long} :kinds #{string}}"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    listed = nest.group(events.select("user_id", "event_id", "event_type", "value"), "user_id", ["event_id"], "events", ["event_type", "value"])
    counted = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id")
    maps = counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("meta"), F.collect_set("event_type").alias("kinds"))
    return listed.join(maps, "user_id")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in order, for a folder of five part files."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    return events.repartitionByRange(5, "event_id").sortWithinPartitions("event_id")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the fields of the schema."""
    return nest.customers(spark, sf_dir, ["orderkey", "orderstatus", "totalprice"], ["linenumber", "partkey", "quantity", "extendedprice"])


FIXTURES = {"line_items": (nest.line_items, LINE_ITEM), "customers": (customers, CUSTOMER), "users": (users, USER), "parts": (parts, "{:event_id #req long :user_id long :event_type string :value double}")}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> Reader:
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _written:
        make, schema = FIXTURES[name]
        path = f"{scratch(spark)}/nested-{uuid.uuid4().hex}/{name}"
        write(make(spark, sf_dir), schema, path)
        _written[at] = path
    return Reader.open(spark, _written[at])


def flat(spark: SparkSession, sf_dir: str, name: str) -> Reader:
    return Reader.open(spark, f"{sf_dir}/{name}.parquet")


def money(c) -> F.Column:
    """Exact sums of two-digit amounts."""
    return F.sum(c.cast("decimal(28,4)")).cast("decimal(28,4)")


_LINES = """lineitem l left join orders o on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey
left join nation cn on cn.n_nationkey = c_nationkey left join region cr on cr.r_regionkey = cn.n_regionkey
left join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey
left join nation sn on sn.n_nationkey = s_nationkey left join region sr on sr.r_regionkey = sn.n_regionkey"""


@query(f"""select l_orderkey as orderkey, l_linenumber as linenumber, l_quantity as quantity, l_extendedprice as price, o_totalprice as total,
c_name as customer, cn.n_name as nation, cr.r_name as region, p_brand as brand, p_size as size, s_name as supplier, sr.r_name as supplier_region from {_LINES}""")
def read_full(spark, sf_dir):
    df = fixture(spark, sf_dir, "line_items").read().df
    c = F.col
    return df.select(
        "orderkey", "linenumber", "quantity", c("extendedprice").alias("price"), c("order.totalprice").alias("total"), c("order.customer.name").alias("customer"),
        c("order.customer.nation.name").alias("nation"), c("order.customer.nation.region.name").alias("region"), c("part.brand").alias("brand"), c("part.size").alias("size"),
        c("supplier.name").alias("supplier"), c("supplier.nation.region.name").alias("supplier_region"),
    )


@query(f"""select l_orderkey as orderkey, l_linenumber as linenumber, c_name as customer, p_name as part, s_name as supplier from {_LINES}""")
def denormalise(spark, sf_dir):
    df = nest.line_items(spark, sf_dir)
    return df.select("orderkey", "linenumber", F.col("order.customer.name").alias("customer"), F.col("part.name").alias("part"), F.col("supplier.name").alias("supplier"))


@query(f"select cr.r_name as name, count(*) as n from {_LINES} group by 1")
def sub_schema(spark, sf_dir):
    df = fixture(spark, sf_dir, "line_items").read(sub_schema_in=["order", "customer", "nation", "region"]).df
    return df.groupBy("name").agg(F.count("*").alias("n"))


SKELETON = "{:order {:customer {:nation {:region {:name _}}}} :extendedprice _ :returnflag _}"


@query(f"""select cr.r_name as region, sum(l_extendedprice::decimal(28,4))::decimal(28,4) as price, count(*) as n from {_LINES} where l_returnflag = 'R' group by 1""")
def skeleton_query(spark, sf_dir):
    df = fixture(spark, sf_dir, "line_items").read(SKELETON).df
    return df.where("returnflag = 'R'").groupBy(F.col("order.customer.nation.region.name").alias("region")).agg(money(F.col("extendedprice")).alias("price"), F.count("*").alias("n"))


@query(f"select c_mktsegment as mktsegment, cn.n_name as nation, count(*) as n from {_LINES} group by all")
def sub_schema_plus_query(spark, sf_dir):
    df = fixture(spark, sf_dir, "line_items").read({"mktsegment": ALL, "nation": {"name": ALL}}, ["order", "customer"]).df
    return df.groupBy("mktsegment", F.col("nation.name").alias("nation")).agg(F.count("*").alias("n"))


@query("select o_custkey as custkey, o_totalprice as totalprice from orders")
def vector_query(spark, sf_dir):
    df = fixture(spark, sf_dir, "customers").read({"custkey": ALL, "orders": [{"totalprice": ALL}]}).df
    return df.select("custkey", F.explode("orders").alias("o")).select("custkey", "o.totalprice")


@query("select o_custkey as custkey, sum(l_extendedprice::decimal(28,4))::decimal(28,4) as price, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by 1")
def nested_vector_query(spark, sf_dir):
    df = fixture(spark, sf_dir, "customers").read("{:custkey _ :orders [{:items [{:extendedprice _}]}]}").df
    items = df.select("custkey", F.explode("orders").alias("o")).select("custkey", F.explode("o.items").alias("i"))
    return items.groupBy("custkey").agg(money(F.col("i.extendedprice")).alias("price"), F.count("*").alias("n"))


@query("select user_id, count(*) as n, min(value) as low from events group by 1")
def list_query(spark, sf_dir):
    df = fixture(spark, sf_dir, "users").read({"user_id": ALL, "events": ({"value": ALL},)}).df
    return df.select("user_id", F.size("events").cast("long").alias("n"), F.array_min(F.transform("events", lambda e: e["value"])).alias("low"))


@query("select distinct user_id, event_type as kind from events")
def set_query(spark, sf_dir):
    df = fixture(spark, sf_dir, "users").read({"user_id": ALL, "kinds": Set(ALL)}).df
    return df.select("user_id", F.explode("kinds").alias("kind"))


@query("select distinct user_id, left(event_type, 1) as letter from events")
def set_projection(spark, sf_dir):
    """Projected elements are made distinct again."""
    view = fixture(spark, sf_dir, "users").read({"user_id": ALL, "kinds": Set(Tag("first", ALL))}, readers={"first": lambda c: F.substring(c, 1, 1)})
    return view.df.select("user_id", F.explode("kinds").alias("letter"))


@query("select user_id, event_type as kind, count(*) as n from events group by all")
def map_query(spark, sf_dir):
    df = fixture(spark, sf_dir, "users").read({"user_id": ALL, "meta": Map(ALL, ALL)}).df
    return df.select("user_id", F.explode("meta").alias("kind", "n"))


@query("select user_id, count(distinct event_type) as kinds, max(n) as most from (select user_id, event_type, count(*) as n from events group by all) group by 1")
def map_as_vector(spark, sf_dir):
    df = fixture(spark, sf_dir, "users").read({"user_id": ALL, "meta": [{"val": ALL}]}).df
    return df.select("user_id", F.size("meta").cast("long").alias("kinds"), F.array_max(F.transform("meta", lambda e: e["value"])).alias("most"))


@query("select user_id, left(event_type, 1) as letter, arg_max(n, event_type) as n from (select user_id, event_type, count(*) as n from events group by all) group by all")
def map_key_projection(spark, sf_dir):
    """Keys that meet after projection: one of them stays, the last."""
    view = fixture(spark, sf_dir, "users").read({"user_id": ALL, "meta": Map(Tag("first", ALL), ALL)}, readers={"first": lambda c: F.substring(c, 1, 1)})
    return view.df.select("user_id", F.explode("meta").alias("letter", "n"))


@query("select p_partkey, p_size, cast(null as integer) as p_weight, cast(null as varchar) as maker from part")
def missing_as_nil(spark, sf_dir):
    df = flat(spark, sf_dir, "part").read({"p_partkey": ALL, "p_size": "int", "p_weight": "int", "p_maker": {"name": "string"}}).df
    return df.select("p_partkey", "p_size", "p_weight", F.col("p_maker.name").alias("maker"))


@query("select 'missing' as kind, '[:p_weight]' as field union all select 'type', 'p_size'")
def strict_query(spark, sf_dir):
    """Strict reads and typed leaves fail before anything runs."""
    found, r = [], flat(spark, sf_dir, "part")
    for kind, field, q in (("missing", "[:p_weight]", {"p_weight": ALL}), ("type", "p_size", {"p_size": "long"})):
        try:
            r.read(q, missing_fields_as_nil=False)
        except ValueError as e:
            found += [(kind, field)] if field in str(e) else []
    return spark.createDataFrame(found, "kind string, field string")


@query("select count(*) as n, 0::bigint as values from lineitem")
def empty_query(spark, sf_dir):
    df = flat(spark, sf_dir, "lineitem").read({}).df
    return df.agg(F.count("*").alias("n"), F.count("value").alias("values"))


@query("""select o_orderkey as orderkey, o_orderkey % 3 = 0 as nil, case when o_orderkey % 3 <> 0 and o_orderkey % 2 <> 0 then o_orderstatus end as status,
case when o_orderkey % 3 <> 0 then o_totalprice end as price from orders""")
def collapse_empty_record(spark, sf_dir):
    """A record whose fields are all null reads as null."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    status = F.when((F.col("o_orderkey") % 3 != 0) & (F.col("o_orderkey") % 2 != 0), F.col("o_orderstatus"))
    path = f"{scratch(spark)}/collapse-{uuid.uuid4().hex}"
    write(o.select(F.col("o_orderkey").alias("orderkey"), F.struct(status.alias("status"), price.alias("price")).alias("info")), "{:orderkey long :info {:status string :price double}}", path)
    df = Reader.open(spark, path).read().df
    return df.select("orderkey", F.col("info").isNull().alias("nil"), "info.status", "info.price")


@query("""select o_custkey as custkey, count(*) as n, count(case when o_orderkey % 2 = 0 then 1 end) as kept from orders group by 1""")
def nil_elements_kept(spark, sf_dir):
    """Elements of which nothing is selected are null but hold their place."""
    view = fixture(spark, sf_dir, "customers").read({"custkey": ALL, "orders": [{"orderkey": Tag("even", ALL)}]}, readers={"even": lambda c: F.when(c % 2 == 0, c)})
    df = view.df.where("orders is not null")
    return df.select("custkey", F.size("orders").cast("long").alias("n"), F.size(F.filter("orders", lambda e: e.isNotNull())).cast("long").alias("kept"))


@query("""select case when c_custkey % 5 = 0 then 'empty' when n is null then 'nil' else 'some' end as state, count(*) as customers, sum(case when c_custkey % 5 = 0 then 0 else n end)::bigint as orders
from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey group by 1""")
def nil_vs_empty_collection(spark, sf_dir):
    empty = F.when(F.col("custkey") % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.transform("orders", lambda o: o["orderkey"]))
    path = f"{scratch(spark)}/nil-{uuid.uuid4().hex}"
    write(nest.customers(spark, sf_dir, ["orderkey"], ["linenumber"]).select("custkey", empty.alias("orders")), "{:custkey long :orders [long]}", path)
    df = Reader.open(spark, path).read().df
    state = F.when(F.col("orders").isNull(), "nil").when(F.size("orders") == 0, "empty").otherwise("some").alias("state")
    return df.groupBy(state).agg(F.count("*").alias("customers"), F.sum(F.when(F.col("orders").isNotNull(), F.size("orders"))).cast("long").alias("orders"))


@query("select event_id, user_id from events where event_id % 10 = 0")
def sample_mod(spark, sf_dir):
    return flat(spark, sf_dir, "events").read({"event_id": ALL, "user_id": ALL}).sample(lambda i: i % 10 == 0).df


@query("select o_orderkey, o_totalprice from orders where o_orderkey between 100 and 199")
def sample_range(spark, sf_dir):
    return flat(spark, sf_dir, "orders").read({"o_orderkey": ALL, "o_totalprice": ALL}).sample(lambda i: i.between(100, 199)).df


@query("select o_orderkey * 10 + length(o_orderstatus) as value from orders")
def index_by(spark, sf_dir):
    return flat(spark, sf_dir, "orders").read({"o_orderstatus": ALL}).index_by(lambda i, c: i * 10 + F.length(c("o_orderstatus"))).df


@query("select p_partkey as i, p_name as name from part where p_partkey % 7 = 3")
def sample_then_index(spark, sf_dir):
    view = flat(spark, sf_dir, "part").read({"p_name": ALL}).sample(lambda i: i % 7 == 3)
    return view.index_by(lambda i, c: F.struct(i.alias("i"), c("p_name").alias("name"))).df.select("value.*")


@query("select event_id from events order by event_id limit 25")
def head_n(spark, sf_dir):
    return fixture(spark, sf_dir, "parts").read({"event_id": ALL}).head(25).df


@query("select event_id from (select event_id from events order by event_id desc limit 25)")
def tail_n(spark, sf_dir):
    return flat(spark, sf_dir, "events").read({"event_id": ALL}).tail(25).df


_PLACE = "select *, row_number() over (order by event_id) - 1 as i from events"


@query(f"select i, event_id, user_id from ({_PLACE}) where i % 7 = 3")
def sample_parts(spark, sf_dir):
    """Positions run on through the part files of a folder."""
    view = fixture(spark, sf_dir, "parts").read({"event_id": ALL, "user_id": ALL}).sample(lambda i: i % 7 == 3)
    return view.with_index("i")


@query("select event_id from (select event_id from events order by event_id desc limit 700)")
def tail_parts(spark, sf_dir):
    return fixture(spark, sf_dir, "parts").read({"event_id": ALL}).tail(700).df


@query(f"select i * 10 + length(event_type) as value from ({_PLACE})")
def index_parts(spark, sf_dir):
    return fixture(spark, sf_dir, "parts").read({"event_type": ALL}).index_by(lambda i, c: i * 10 + F.length(c("event_type"))).df


@query(f"""select file, i, event_id from (select 0 as file, i, event_id from ({_PLACE}) union all select 1, i, event_id from ({_PLACE})) where i in (0, 99, (select count(*) - 1 from events))""")
def several_folders(spark, sf_dir):
    """Positions begin anew in each folder of a list."""
    path = fixture(spark, sf_dir, "parts").path
    last = Reader.open(spark, path).num_records() - 1
    view = FilesReader.open(spark, [path, path]).read({"event_id": ALL}).sample(lambda i: i.isin(0, 99, last))
    return view.frame.select(F.col("_file").alias("file"), F.col("_index").alias("i"), "event_id")


@query("select length(p_name)::integer as value from part")
def edu_map(spark, sf_dir):
    return flat(spark, sf_dir, "part").read({"p_name": ALL}).eduction(rows.map_(F.length("p_name"))).df


@query("select p_partkey, p_size from part where p_size > 40")
def edu_filter(spark, sf_dir):
    return flat(spark, sf_dir, "part").read({"p_partkey": ALL, "p_size": ALL}).eduction(rows.filter_(F.col("p_size") > 40)).df


@query("select p_partkey, p_size from part where not p_size > 40")
def edu_remove(spark, sf_dir):
    return flat(spark, sf_dir, "part").read({"p_partkey": ALL, "p_size": ALL}).eduction(rows.remove(F.col("p_size") > 40)).df


@query("select p_size as value from part where p_size % 2 = 0")
def edu_keep(spark, sf_dir):
    return flat(spark, sf_dir, "part").read({"p_size": ALL}).eduction(rows.keep(F.when(F.col("p_size") % 2 == 0, F.col("p_size")))).df


@query("select o_orderkey as value from orders join customer on c_custkey = o_custkey")
def edu_cat(spark, sf_dir):
    view = fixture(spark, sf_dir, "customers").read([{"orderkey": ALL}], ["orders"])
    return view.eduction(rows.cat(), rows.map_(F.col("value.orderkey"))).df


@query("select o_orderkey * 2 as value from orders join customer on c_custkey = o_custkey where o_orderkey % 3 = 0")
def edu_chain(spark, sf_dir):
    view = fixture(spark, sf_dir, "customers").read({"orders": [{"orderkey": ALL}]})
    return view.eduction(rows.mapcat(F.col("orders")), rows.filter_(F.col("value.orderkey") % 3 == 0)).eduction(rows.map_(F.col("value.orderkey") * 2)).df


@query("select distinct user_id from events")
def edu_distinct(spark, sf_dir):
    return flat(spark, sf_dir, "events").read({"user_id": ALL}).eduction(rows.distinct()).df


@query("select sum(l_extendedprice::decimal(28,4))::decimal(28,4) as price from lineitem")
def fold_sum(spark, sf_dir):
    return flat(spark, sf_dir, "lineitem").read({"l_extendedprice": ALL}).aggregate(money(F.col("l_extendedprice")).alias("price"))


@query("select sum(l_extendedprice::decimal(28,4))::decimal(28,4) as price from lineitem where l_quantity > 30")
def fold_filter_sum(spark, sf_dir):
    view = flat(spark, sf_dir, "lineitem").read({"l_extendedprice": ALL, "l_quantity": ALL}).eduction(rows.filter_(F.col("l_quantity") > 30))
    return view.aggregate(money(F.col("l_extendedprice")).alias("price"))


@query("select sum(o_totalprice::decimal(28,4))::decimal(28,4) as price, count(*) as n from orders join customer on c_custkey = o_custkey")
def fold_cat_sum(spark, sf_dir):
    view = fixture(spark, sf_dir, "customers").read([{"totalprice": ALL}], ["orders"]).eduction(rows.cat())
    return view.aggregate(money(F.col("value.totalprice")).alias("price"), F.count("*").alias("n"))


@query("select 1000 + count(*) as total from orders")
def reduce_init(spark, sf_dir):
    """A left fold from a first value, part after part."""
    total = flat(spark, sf_dir, "orders").read({"o_orderkey": ALL}).reduce(lambda a, _: a + 1, 1000)
    return spark.createDataFrame([(total,)], "total long")


def _chain(first: str = "") -> str:
    """A left fold whose result depends on the order of the rows."""
    return f"select list_reduce({first}list(event_id order by event_id){')' if first else ''}, lambda a, b: (a * 31 + b) % 1000003) as chain from events"


@query(_chain())
def reduce_ordered(spark, sf_dir):
    """Without a first value the first record is the seed."""
    ids = fixture(spark, sf_dir, "parts").read({"event_id": ALL}).eduction(rows.map_(F.col("event_id")))
    return spark.createDataFrame([(ids.reduce(lambda a, b: (a * 31 + b) % 1000003),)], "chain long")


@query("select min(value) as low, max(value) as high, count(*) as n from events")
def fold_custom_monoid(spark, sf_dir):
    """A Python monoid, folded in the tasks."""
    def combine(*states):
        some = [s for s in states if s[2]] or [(None, None, 0)]
        return min((s[0] for s in some), default=None), max((s[1] for s in some), default=None), sum(s[2] for s in some)

    found = fixture(spark, sf_dir, "parts").read({"value": ALL}).fold(combine, lambda s, r: combine(s, (r["value"], r["value"], 1)))
    return spark.createDataFrame([tuple(None if x is None else float(x) for x in found[:2]) + (found[2],)], "low double, high double, n long")


def _affine(*maps):
    """Maps x -> m x + a, one after the other: associative, not commutative."""
    m, a = 1, 0
    for n, b in maps:
        m, a = m * n % 1000003, (a * n + b) % 1000003
    return m, a


@query(_chain("list_prepend(0::bigint, "))
def fold_ordered(spark, sf_dir):
    """Parts are folded in the tasks and combined in the order of positions, over several part files."""
    found = fixture(spark, sf_dir, "parts").read({"event_id": ALL}).fold(_affine, lambda s, r: _affine(s, (31, int(r["event_id"]))))
    return spark.createDataFrame([(found[1],)], "chain long")


@query(f"with e as (select * from events where value > 20) select a.chain, b.n from ({_chain('list_prepend(0::bigint, ').replace('from events', 'from e')}) a, (select count(*) as n from e) b")
def fold_cached(spark, sf_dir):
    """Folds over what a view has kept: the steps before it run once."""
    view = fixture(spark, sf_dir, "parts").read({"event_id": ALL, "value": ALL}).eduction(rows.filter_(F.col("value") > 20)).cache()
    n = view.count()
    found = view.fold(_affine, lambda s, r: _affine(s, (31, int(r["event_id"]))))
    view.frame.unpersist()
    return spark.createDataFrame([(found[1], n)], "chain long, n long")


@query("select event_type as value, count(*) as n from events group by 1")
def frequencies(spark, sf_dir):
    return flat(spark, sf_dir, "events").read({"event_type": ALL}).eduction(rows.map_(F.col("event_type")), rows.frequencies()).df


@query("select count(*) as num_records from lineitem")
def num_records(spark, sf_dir):
    """From the footers, without a scan."""
    return spark.createDataFrame([(flat(spark, sf_dir, "lineitem").num_records(),)], "num_records long")


@query("select p_partkey, upper(p_brand) as p_brand from part")
def tag_leaf(spark, sf_dir):
    return flat(spark, sf_dir, "part").read({"p_partkey": ALL, "p_brand": Tag("up", ALL)}, readers={"up": F.upper}).df


@query("select o_orderkey as orderkey, case when o_orderkey % 3 = 0 then -1 else o_totalprice end as price from orders")
def tag_nil_leaf(spark, sf_dir):
    """A tag on a leaf outside collections sees null as well."""
    path = f"{scratch(spark)}/nil-{uuid.uuid4().hex}"
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    write(o.select(F.col("o_orderkey").alias("orderkey"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price")), "{:orderkey long :price double}", path)
    return Reader.open(spark, path).read("{:orderkey _ :price #dflt _}", readers={"dflt": lambda c: F.coalesce(c, F.lit(-1.0))}).df


@query(f"select l_orderkey as orderkey, l_linenumber as linenumber, p_brand || '/' || p_size as part from {_LINES}")
def tag_record(spark, sf_dir):
    view = fixture(spark, sf_dir, "line_items").read("{:orderkey _ :linenumber _ :part #label {:brand _ :size _}}", readers={"label": lambda c: F.concat_ws("/", c["brand"], c["size"])})
    return view.df


@query("select c_custkey as custkey, count(o_orderkey) as orders from customer left join orders on o_custkey = c_custkey group by 1")
def tag_collection(spark, sf_dir):
    """A tag on a collection sees null too."""
    size = lambda c: F.when(c.isNull(), 0).otherwise(F.size(c)).cast("long")
    return fixture(spark, sf_dir, "customers").read({"custkey": ALL, "orders": Tag("size", [{"orderkey": ALL}])}, readers={"size": size}).df


@query("select user_id, count(*) as meta from events group by 1")
def tag_map(spark, sf_dir):
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, b: a + b)
    return fixture(spark, sf_dir, "users").read({"user_id": ALL, "meta": Tag("total", Map(ALL, ALL))}, readers={"total": total}).df


@query("select p_partkey, 'none' as p_colour, true as empty from part")
def tag_missing(spark, sf_dir):
    view = flat(spark, sf_dir, "part").read({"p_partkey": ALL, "p_colour": Tag("dflt", ALL), "p_box": Tag("empty", {"size": ALL})}, readers={"dflt": lambda c: F.coalesce(c.cast("string"), F.lit("none")), "empty": lambda c: c.isNull()})
    return view.df.select("p_partkey", "p_colour", F.col("p_box").alias("empty"))


@query("""select c_custkey as custkey, sum(case when o_orderkey is null then 0 else o_totalprice::decimal(28,4) * 2 end)::decimal(28,4) as price
from customer left join orders on o_custkey = c_custkey group by 1""")
def tag_in_collection(spark, sf_dir):
    view = fixture(spark, sf_dir, "customers").read({"custkey": ALL, "orders": [{"totalprice": Tag("twice", ALL)}]}, readers={"twice": lambda c: c.cast("decimal(28,4)") * 2})
    price = F.aggregate("orders", F.lit(0).cast("decimal(28,4)"), lambda a, e: (a + e["totalprice"]).cast("decimal(28,4)"))
    return view.df.select("custkey", F.coalesce(price, F.lit(0).cast("decimal(28,4)")).alias("price"))


@query("select event_id, reverse(event_type) as event_type from events")
def tag_distinct_udf(spark, sf_dir):
    """A Python function runs once per distinct value."""
    df = flat(spark, sf_dir, "events").read({"event_id": ALL, "event_type": ALL}).df
    return distinct.apply_distinct(df, "event_type", lambda s: None if s is None else s[::-1], "string")


@query("select o_orderkey as id, o_orderkey::varchar as text, (o_orderkey % 2 = 0)::varchar as flag from orders")
def coerce_string(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    df = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("text"), (F.col("o_orderkey") % 2 == 0).alias("flag"))
    return validate(df, "{:id long :text string :flag string}").drop("_errors")


@query("""select o_orderkey as id, trunc(o_totalprice)::integer as whole, o_totalprice::float as single, o_orderkey::decimal(38,0) as big,
case when o_orderkey % 2 = 0 then null else o_orderkey::integer end as small, o_orderkey % 2 = 0 as failed from orders""")
def coerce_numeric(spark, sf_dir):
    """Numbers among numbers, with range checks; never from text."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    df = o.select(key.alias("id"), F.col("o_totalprice").alias("whole"), F.col("o_totalprice").alias("single"), key.alias("big"), F.when(key % 2 == 0, key + 2**33).otherwise(key).alias("small"))
    out = validate(df, "{:id long :whole int :single float :big bigint :small int}")
    return out.select("id", "whole", "single", "big", "small", (F.size("_errors") > 0).alias("failed"))


@query("select event_id, date_trunc('milliseconds', ts) as ts from events")
def coerce_inst_ms(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return validate(e.select("event_id", "ts"), "{:event_id long :ts inst}").drop("_errors")


@query("select event_id, case when event_id % 4 <> 0 then user_id end as user_id, case when event_id % 4 = 0 then 'Required value at path ''[:user_id]'' is missing' end as reason from events")
def invalid_split(spark, sf_dir):
    """Bad records are diverted, the others written."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = f"{scratch(spark)}/split-{uuid.uuid4().hex}"
    bad = write(e.select("event_id", F.when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("user_id")), "{:event_id #req long :user_id #req long}", path, invalid="reject")
    valid = Reader.open(spark, path).read().df.select("event_id", "user_id", F.lit(None).cast("string").alias("reason"))
    return valid.unionByName(bad.select("event_id", "user_id", F.array_join("_errors", "; ").alias("reason")))


@query("""select o_orderkey as orderkey, case when o_orderkey % 10 = 0 then 'Required value at path ''[:info :status]'' is missing'
when o_orderkey % 15 = 5 then 'Required record at path ''[:info]'' is missing' else '' end as reason from orders""")
def required_check(spark, sf_dir):
    """A required field is asked for only where its parent is there."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    info = F.when((key % 15 != 5) | (key % 10 == 0), F.struct(F.when(key % 10 != 0, F.col("o_orderstatus")).alias("status")))
    out = validate(o.select(key.alias("orderkey"), info.alias("info")), "{:orderkey long :info #req {:status #req string}}")
    return out.select("orderkey", F.array_join("_errors", "; ").alias("reason"))


_CENTS = CustomType("cents", "long", to_base=lambda c: F.round(c * 100).cast("long"), from_base=lambda c: (c / 100).cast("decimal(18,2)"))


def _cents(spark, sf_dir) -> str:
    path = f"{scratch(spark)}/cents-{uuid.uuid4().hex}"
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    write(o, "{:orderkey long :price cents}", path, custom_types=(_CENTS,))
    return path


@query("select o_orderkey as orderkey, round(o_totalprice, 2)::decimal(18,2) as price from orders")
def custom_type_roundtrip(spark, sf_dir):
    return Reader.open(spark, _cents(spark, sf_dir), [_CENTS]).read().df


@query("select o_orderkey as orderkey, round(o_totalprice * 100)::bigint as price from orders")
def custom_type_as_base(spark, sf_dir):
    """Without its definition a custom type reads as its base type."""
    return Reader.open(spark, _cents(spark, sf_dir)).read({"orderkey": ALL, "price": "long"}).df


@query("select 0 as file, n_nationkey as key, n_name as name from nation union all select 1, n_nationkey, null from nation where n_nationkey < 10")
def multi_file_union(spark, sf_dir):
    """Files in a stated order; a field that one of them lacks is null there."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    paths = [f"{scratch(spark)}/multi-{uuid.uuid4().hex}" for _ in range(2)]
    write(n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), "{:key int :name string}", paths[0])
    write(n.select(F.col("n_nationkey").alias("key")).where("key < 10"), "{:key int}", paths[1])
    view = FilesReader.open(spark, paths).read({"key": ALL, "name": "string"})
    return view.frame.select(F.col("_file").alias("file"), "key", "name")


@query("select p_partkey as partkey, upper(p_name) as name from part where p_size > 25")
def write_xform(spark, sf_dir):
    path = f"{scratch(spark)}/xform-{uuid.uuid4().hex}"
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    step = lambda df: df.where("p_size > 25").select(F.col("p_partkey").alias("partkey"), F.upper("p_name").alias("name"))
    write(p, "{:partkey #req long :name string}", path, xform=step)
    return Reader.open(spark, path).read().df


@query("select s_suppkey as suppkey, (s_suppkey::bigint << 1) as zig, (-s_suppkey)::bigint as back, length(bin(s_suppkey))::integer as bits from supplier where s_suppkey > 0")
def integer_coding(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey > 0")
    k = F.col("s_suppkey")
    return s.select(k.alias("suppkey"), fn.zig_zag(k).alias("zig"), fn.un_zig_zag(fn.zig_zag(-k)).alias("back"), fn.bit_width(k).cast("int").alias("bits"))


@query("select md5('part' || p_partkey)::uuid::varchar as id, p_partkey as partkey from part")
def uuid_roundtrip(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    made = fn.bytes_to_uuid(F.unhex(F.md5(F.concat(F.lit("part"), F.col("p_partkey").cast("string")))))
    out = validate(p.select(made.alias("id"), F.col("p_partkey").alias("partkey")), "{:id uuid :partkey long}")
    return out.select(fn.bytes_to_uuid(fn.uuid_to_bytes(F.col("id"))).alias("id"), "partkey")


@query("select 'users' as name, count(distinct user_id) as num_records, 6::bigint as num_columns, true as grouped, true as adds_up, true as headed from events")
def stats_global(spark, sf_dir):
    found = fixture(spark, sf_dir, "users").stats()["global"]
    c = F.col
    adds_up = (c("length") == c("data_length") + c("dictionary_length") + c("metadata_length")) & (c("metadata_length") > 0)
    inner = c("data_header_length") + c("repetition_levels_length") + c("definition_levels_length")
    headed = (c("data_header_length") > 0) & (inner < c("data_length")) & (c("dictionary_header_length") < c("dictionary_length")) & (c("repetition_levels_length") > 0)
    return found.select(F.lit("users").alias("name"), "num_records", "num_columns", (c("num_record_groups") >= c("num_files")).alias("grouped"), adds_up.alias("adds_up"), headed.alias("headed"))


@query("""with kinds as (select count(distinct event_type) as n from events)
select 'user_id' as path, 'INT64' as type, 0 as max_repetition_level, count(distinct user_id) as num_values, count(distinct user_id) as num_non_nil_values, true as paged, 0::bigint as entries from events
union all select 'events.list.element.value', 'DOUBLE', 1, count(*), count(value), true, null from events
union all select 'events.list.element.event_type', 'BYTE_ARRAY', 1, count(*), count(event_type), true, (select n from kinds) from events""")
def stats_columns(spark, sf_dir):
    """Entries of the dictionary per chunk, of a column of ids (which the fixture's size leaves without one) and of one of names."""
    found = fixture(spark, sf_dir, "users").stats()["columns"].where(F.col("path").isin("user_id", "events.list.element.value", "events.list.element.event_type"))
    per_chunk = F.round(F.col("num_dictionary_values") / F.col("num_column_chunks")).cast("long")
    entries = F.when(F.col("path") == "user_id", F.lit(0).cast("long")).when(F.col("path").endswith("event_type"), per_chunk)
    return found.select("path", "type", "max_repetition_level", "num_values", "num_non_nil_values", (F.col("num_pages") >= F.col("num_column_chunks")).alias("paged"), entries.alias("entries"))


@query("select count(*) as num_records, true as numbered, true as measured from lineitem")
def stats_record_groups(spark, sf_dir):
    found = flat(spark, sf_dir, "lineitem").stats()["record_groups"]
    return found.agg(F.sum("num_records").alias("num_records"), (F.max("record_group") == F.count("*") - 1).alias("numbered"), F.min((F.col("length") > F.col("data_header_length")) & (F.col("num_column_chunks") == 11)).alias("measured"))


_WHOLE, _REAL, _TEXT = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ("l_returnflag", "l_linestatus")


def _advice() -> str:
    def of(name: str, plain: str, width: str, vlq: str) -> str:
        return f"select '{name}' as path, '{plain}' as plain, count({name})::double as n, greatest(1, count(distinct {name}))::double as d, avg({width})::double as w, {vlq}::double as v from lineitem"

    each = [of(c, "plain", f"case when typeof({c}) = 'BIGINT' then 8 else 4 end", f"avg(greatest(1, ceil(length(bin({c}::bigint * 2)) / 7.0)))") for c in _WHOLE]
    each += [of(c, "plain", "8", "null") for c in _REAL] + [of(c, "delta-length", f"length({c}) + 4", "null") for c in _TEXT]
    return f"""with s as ({' union all '.join(each)}),
costs as (select path, plain as encoding, n * w as cost from s union all select path, 'vlq', n * v from s where v is not null
  union all select path, 'dictionary', d * w + n * greatest(1, length(bin((d - 1)::bigint)) - case when d = 1 then 1 else 0 end) / 8 from s where d * w <= 262144)
select path, n::bigint as num_values, arg_min(encoding, cost) as encoding from costs join s using (path) group by all"""


@query(_advice())
def storage_advice(spark, sf_dir):
    df = flat(spark, sf_dir, "lineitem").read({c: ALL for c in (*_WHOLE, *_REAL, *_TEXT)}).df
    return advise.advise(df).select("path", "num_values", "encoding")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per region from nested line items, by a skeleton query."""
    return skeleton_query(spark, sf_dir)
