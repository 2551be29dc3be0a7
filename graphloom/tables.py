"""The driver's tables as a graph."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .engine import Engine
from .sources.mapping import MappedSource, Property, TableMap
from .terms import STRING

P = Property
MAPS = [
    TableMap("region", "region/{}", ("r_regionkey",), (P("r_name"),), "Region"),
    TableMap("nation", "nation/{}", ("n_nationkey",), (P("n_name"), P("n_regionkey", iri="region/{}")), "Nation"),
    TableMap("customer", "customer/{}", ("c_custkey",), (P("c_name"), P("c_nationkey", iri="nation/{}"), P("c_acctbal"), P("c_mktsegment")), "Customer"),
    TableMap("supplier", "supplier/{}", ("s_suppkey",), (P("s_name"), P("s_nationkey", iri="nation/{}"), P("s_acctbal")), "Supplier"),
    TableMap("part", "part/{}", ("p_partkey",), (P("p_name"), P("p_brand"), P("p_type"), P("p_size"), P("p_retailprice")), "Part"),
    TableMap("orders", "order/{}", ("o_orderkey",), (P("o_custkey", iri="customer/{}"), P("o_orderstatus"), P("o_totalprice"), P("o_orderdate"), P("o_orderpriority")), "Order"),
    TableMap(
        "lineitem", "lineitem/{}", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        (P("l_orderkey", iri="order/{}"), P("l_partkey", iri="part/{}"), P("l_suppkey", iri="supplier/{}"), P("l_quantity"), P("l_extendedprice"), P("l_discount"), P("l_returnflag"), P("l_shipdate")),
        "Lineitem", distinct=True,
    ),
    # direct edges, one a pair however many line items have it
    TableMap("lineitem", "order/{}", ("l_orderkey",), (P("l_partkey", "hasPart", iri="part/{}"), P("l_suppkey", "hasSupplier", iri="supplier/{}")), distinct=True),
    TableMap("events", "event/{}", ("event_id",), (P("ts"), P("user_id", iri="user/{}"), P("event_type"), P("value"), P("props", tag=STRING))),
    TableMap("documents", "document/{}", ("doc_id",), (P("text", lang="lang"), P("lang"), P("source"), P("n_chars")), "Document"),
    TableMap("labels", "document/{}", ("doc_id",), (P("quality"), P("toxic"))),
    TableMap("pages", "page/{}", ("page_id",), (P("url", iri="{}"), P("html")), "Page"),
    TableMap("benchmark", "item/{}", ("item_id",), (P("text", "item_text"),), "Item"),
    TableMap("conversations", "conversation/{}", ("conv_id", "turn"), (P("role"), P("text", "said"), P("conv_id", "of", iri="thread/{}")), distinct=True),
]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    names = {m.table for m in MAPS}
    return Engine(MappedSource(spark, {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in sorted(names)}, MAPS))
