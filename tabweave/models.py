"""Models of the sample tables, used by the driver queries, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tabweave.plans.model import Model, Registry
from tabweave.plans.query import Catalog

NATION = Model.of("nation", ("n_nationkey", "int32", "pk"), ("n_name", "string", "unique=uix_nation_name"), ("n_regionkey", "int32", "references=region(r_regionkey)"))
CUSTOMER = Model.of("customer", ("c_custkey", "int64", "pk"), ("c_name", "string"), ("c_nationkey", "int32", "index=idx_customer_nation;references=nation(n_nationkey)"), ("c_acctbal", "float64"), ("c_mktsegment", "string", "default='BUILDING'"))
SUPPLIER = Model.of("supplier", ("s_suppkey", "int64", "pk;auto"), ("s_name", "string"), ("s_nationkey", "int32?", "references=nation(n_nationkey);on_delete=SET NULL"), ("s_acctbal", "float64", "default=0.0"))
PART = Model.of("part", ("p_partkey", "int64", "pk"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int32"), ("p_retailprice", "float64?"))
ORDERS = Model.of("orders", ("o_orderkey", "int64", "pk"), ("o_custkey", "int64", "references=customer(c_custkey)"), ("o_orderstatus", "string"), ("o_totalprice", "float64"), ("o_orderdate", "time_ntz"), ("o_orderpriority", "string"))
LINEITEM = Model.of("lineitem", ("l_orderkey", "int64", "pk"), ("l_partkey", "int64"), ("l_suppkey", "int64"), ("l_linenumber", "int32", "pk"), ("l_quantity", "float64"), ("l_extendedprice", "float64"), ("l_discount", "float64"), ("l_tax", "float64"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "time_ntz"))
EVENTS = Model.of("events", ("event_id", "int64", "pk"), ("ts", "time_ntz"), ("user_id", "int64", "index=idx_events_user"), ("event_type", "string"), ("value", "float64"), ("props", "json"))
CONVERSATIONS = Model.of("conversations", ("conv_id", "int64", "pk"), ("turn", "int64", "pk"), ("role", "string"), ("text", "string"))
REGISTRY = Registry(NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM, EVENTS, CONVERSATIONS)


def catalog(spark: SparkSession, folder: str) -> Catalog:
    """The sample tables of a folder of Parquet files."""
    return Catalog(spark, REGISTRY, lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))
