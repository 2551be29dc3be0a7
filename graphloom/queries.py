"""The registered queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators.relations import Binding, Relation
from .operators.statistics import characteristic_sets, join_partner_counts, pattern_counts, star_counts
from .plans.algebra import Pattern, Var
from .scratch import scratch_path
from .sources.dictionary import build_dictionary, decode, encode, predicates
from .sources.triples import TripleSource, TripleStore, from_source
from .sources.turtle import ntriples, ntriples_lines, turtle_frame
from .tables import engine
from .terms import INTEGER, URI, Iri, Term

Query = Callable[[SparkSession, str], DataFrame]

#: name: (query text, SQL)
SELECTS: dict[str, tuple[str, str]] = {
    "flagship": (
        "select count ?nname where { ?o <o_custkey> ?c . ?c <c_nationkey> ?n . ?n <n_name> ?nname }",
        "select n_name as nname, count(*) as count from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1",
    ),
    # scans
    "bgp_scan_po_const": ('select ?c where { ?c <c_mktsegment> "BUILDING" }', "select 'customer/' || c_custkey as c from customer where c_mktsegment = 'BUILDING'"),
    "bgp_scan_p_const": ("select ?s ?o where { ?s <n_name> ?o }", "select 'nation/' || n_nationkey as s, n_name as o from nation"),
    "bgp_scan_s_const": (
        "select ?p ?o where { <nation/7> ?p ?o }",
        "select 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' as p, 'Nation' as o from nation where n_nationkey = 7 union all select 'n_name', n_name from nation where n_nationkey = 7 union all select 'n_regionkey', 'region/' || n_regionkey from nation where n_nationkey = 7",
    ),
    "bgp_scan_sp_const": ("select ?o where { <customer/11> <c_mktsegment> ?o }", "select c_mktsegment as o from customer where c_custkey = 11"),
    "bgp_scan_so_const": ('select ?p where { <region/3> ?p "EUROPE" }', "select 'r_name' as p from region where r_regionkey = 3 and r_name = 'EUROPE'"),
    "bgp_scan_o_const": ('select ?s ?p where { ?s ?p "BUILDING" }', "select 'customer/' || c_custkey as s, 'c_mktsegment' as p from customer where c_mktsegment = 'BUILDING'"),
    "bgp_scan_object_iri": ("select ?s where { ?s <c_nationkey> <nation/3> }", "select 'customer/' || c_custkey as s from customer where c_nationkey = 3"),
    "bgp_spo_probe": ('select ?n where { <region/1> <r_name> "AMERICA" . ?n <n_regionkey> <region/1> }', "select 'nation/' || n_nationkey as n from nation where n_regionkey = 1 and exists (select 1 from region where r_regionkey = 1 and r_name = 'AMERICA')"),
    "scan_p_unbound": (
        'select count ?p where { ?s <c_mktsegment> "MACHINERY" . ?s ?p [] }',
        "select p, count(*) as count from customer, (values ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment')) v(p) where c_mktsegment = 'MACHINERY' group by 1",
    ),
    "agg_scan_count_object": ("select count ?seg where { [] <c_mktsegment> ?seg }", "select c_mktsegment as seg, count(*) as count from customer group by 1"),
    "agg_scan_subject": (
        "select ?p where { ?p <l_returnflag> [] }",
        "select 'lineitem/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as p from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag from lineitem) l",
    ),
    "known_empty": ('select ?c where { ?c <c_mktsegment> "NO SUCH SEGMENT" . ?c <no_such_predicate> ?x }', "select 'x' as c where false"),
    "singleton": ("select ?x where { }", "select null::varchar as x"),
    "type_scan": ("select count ?t where { ?r a ?t . ?r <r_name> ?name }", "select 'Region' as t, count(*) as count from region group by 1"),
    # joins
    "star_join": (
        "select ?o ?status ?price ?prio where { ?o <o_orderstatus> ?status ; <o_totalprice> ?price ; <o_orderpriority> ?prio . filter(?price > 400000) }",
        "select 'order/' || o_orderkey as o, o_orderstatus as status, o_totalprice as price, o_orderpriority as prio from orders where o_totalprice > 400000",
    ),
    "chain_join": (
        "select count ?rname where { ?o <o_custkey> ?c . ?c <c_nationkey> ?n . ?n <n_regionkey> ?r . ?r <r_name> ?rname }",
        "select r_name as rname, count(*) as count from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1",
    ),
    "cycle_join": (
        "select count ?n where { ?o <o_custkey> ?c . ?c <c_nationkey> ?n . ?o <hasSupplier> ?s . ?s <s_nationkey> ?n }",
        "select 'nation/' || c_nationkey as n, count(*) as count from orders join customer on o_custkey = c_custkey join (select distinct l_orderkey, l_suppkey from lineitem) l on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey where s_nationkey = c_nationkey group by 1",
    ),
    "self_join": (
        "select count ?n where { ?a <s_nationkey> ?n . ?b <s_nationkey> ?n . filter(?a != ?b) }",
        "select 'nation/' || a.s_nationkey as n, count(*) as count from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey group by 1",
    ),
    "object_object_join": (
        "select ?x ?y where { ?x <quality> ?v . ?y <r_name> ?w . ?x <lang> ?l . ?d <lang> ?l . ?d <toxic> 1 . filter(?v = 1 && ?w = \"ASIA\" && ?d = ?x) }",
        "select 'document/' || d.doc_id as x, 'region/' || r_regionkey as y from labels l join documents d using (doc_id), region where quality = 1 and toxic = 1 and r_name = 'ASIA'",
    ),
    "predicate_join": (
        "select count ?p where { <nation/1> ?p [] . <nation/2> ?p [] }",
        "select p, count(*) as count from (values ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type'), ('n_name'), ('n_regionkey')) v(p) group by 1",
    ),
    "two_var_join": (
        "select count ?seg where { ?o <o_custkey> ?c ; <hasSupplier> ?s . ?c <c_mktsegment> ?seg ; <c_nationkey> ?n . ?s <s_nationkey> ?n ; <s_acctbal> ?b . filter(?b > 0) }",
        "select c_mktsegment as seg, count(*) as count from (select distinct l_orderkey, l_suppkey from lineitem) l join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey and s_nationkey = c_nationkey where s_acctbal > 0 group by 1",
    ),
    "gjoin_bushy": (
        'select count ?seg where { { ?o <o_custkey> ?c . ?o <o_orderstatus> "F" } gjoin { ?c <c_mktsegment> ?seg . ?c <c_nationkey> ?n . ?n <n_name> "NATION_3" } }',
        "select c_mktsegment as seg, count(*) as count from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus = 'F' and n_name = 'NATION_3' group by 1",
    ),
    "gjoin_three": (
        "select count ?rn where { { ?c <c_nationkey> ?n } gjoin { ?n <n_regionkey> ?r } gjoin { ?r <r_name> ?rn } }",
        "select r_name as rn, count(*) as count from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1",
    ),
    "gjoin_beside_patterns": (
        "select ?nn ?rn where { ?n <n_name> ?nn { ?n <n_regionkey> ?r } gjoin { ?r <r_name> ?rn } }",
        "select n_name as nn, r_name as rn from nation join region on n_regionkey = r_regionkey",
    ),
    "cross_product": ("select ?r ?st where { ?r <r_name> ?name . [] <n_name> ?st }", "select 'region/' || r_regionkey as r, n_name as st from region, nation"),
    "repeated_variable": ("select ?x where { ?x <n_regionkey> ?x }", "select 'x' as x where false"),
    # optional
    "optional_single": (
        "select ?o ?p where { ?o <o_orderstatus> \"P\" optional { ?o <hasPart> ?p } }",
        "select 'order/' || o_orderkey as o, 'part/' || l_partkey as p from orders left join (select distinct l_orderkey, l_partkey from lineitem) l on l_orderkey = o_orderkey where o_orderstatus = 'P'",
    ),
    "optional_multi_var": (
        "select ?c ?s where { ?c <c_nationkey> ?n . ?c <c_mktsegment> \"BUILDING\" . ?n <n_regionkey> <region/2> optional { ?s <s_nationkey> ?n . ?n <n_regionkey> <region/2> . ?s <s_acctbal> ?b . filter(?b > 5000) } }",
        "select 'customer/' || c_custkey as c, 'supplier/' || s_suppkey as s from customer join nation on c_nationkey = n_nationkey and n_regionkey = 2 left join supplier on s_nationkey = n_nationkey and s_acctbal > 5000 where c_mktsegment = 'BUILDING'",
    ),
    "optional_two_shared": (
        "select ?a ?b ?x where { ?a <s_nationkey> ?n . ?b <s_nationkey> ?n . filter(?a = <supplier/1>) optional { ?a <s_nationkey> ?n . ?b <s_name> ?x . filter(?b != <supplier/1>) } }",
        "select 'supplier/' || a.s_suppkey as a, 'supplier/' || b.s_suppkey as b, case when b.s_suppkey <> 1 then b.s_name end as x from supplier a join supplier b on a.s_nationkey = b.s_nationkey where a.s_suppkey = 1",
    ),
    "optional_nested": (
        "select ?d ?q ?t where { ?d <source> \"src1\" optional { ?d <quality> ?q optional { ?d <toxic> ?t . filter(?q = 1) } } }",
        "select 'document/' || d.doc_id as d, quality::bigint as q, case when quality = 1 then toxic::bigint end as t from documents d left join labels l on l.doc_id = d.doc_id where d.source = 'src1'",
    ),
    "optional_chain": (
        "select ?d ?q ?t where { ?d <lang> \"de\" optional { ?d <quality> ?q } optional { ?d <toxic> ?t } }",
        "select 'document/' || d.doc_id as d, quality::bigint as q, toxic::bigint as t from documents d left join labels l on l.doc_id = d.doc_id where d.lang = 'de'",
    ),
    "optional_filter_inner": (
        "select ?n ?s where { ?n <n_name> ?nn optional { ?s <s_nationkey> ?n . ?s <s_acctbal> ?b . filter(?b < 0 && ?nn != \"NATION_1\") } }",
        "select 'nation/' || n_nationkey as n, 'supplier/' || s_suppkey as s from nation left join supplier on s_nationkey = n_nationkey and s_acctbal < 0 and n_name <> 'NATION_1'",
    ),
    "optional_not_bound": (
        "select ?o where { ?o a <Order> optional { ?o <hasPart> ?p } filter(!bound(?p)) }",
        "select 'order/' || o_orderkey as o from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)",
    ),
    "optional_with_union": (
        "select ?d ?q where { { ?d <lang> \"fr\" } union { ?d <lang> \"es\" } optional { ?d <quality> ?q } }",
        "select 'document/' || d.doc_id as d, quality::bigint as q from documents d left join labels l on l.doc_id = d.doc_id where d.lang in ('fr', 'es')",
    ),
    # unions
    "union_two": (
        "select ?x where { { ?x <c_mktsegment> \"BUILDING\" } union { ?x <s_nationkey> <nation/4> } }",
        "select 'customer/' || c_custkey as x from customer where c_mktsegment = 'BUILDING' union all select 'supplier/' || s_suppkey from supplier where s_nationkey = 4",
    ),
    "union_four": (
        "select count ?x where { { [] <o_orderstatus> ?x } union { [] <c_mktsegment> ?x } union { [] <r_name> ?x } union { [] <o_orderpriority> ?x } }",
        "select x, count(*) as count from (select o_orderstatus as x from orders union all select c_mktsegment from customer union all select r_name from region union all select o_orderpriority from orders) u group by 1",
    ),
    "union_missing_vars": (
        "select ?n ?s ?c where { { ?s <s_nationkey> ?n } union { ?c <c_nationkey> ?n . ?c <c_mktsegment> \"FURNITURE\" } }",
        "select 'nation/' || s_nationkey as n, 'supplier/' || s_suppkey as s, null as c from supplier union all select 'nation/' || c_nationkey, null, 'customer/' || c_custkey from customer where c_mktsegment = 'FURNITURE'",
    ),
    "union_join": (
        "select count ?nn where { ?n <n_name> ?nn { ?x <s_nationkey> ?n } union { ?x <c_nationkey> ?n } }",
        "select n_name as nn, count(*) as count from nation join (select s_nationkey as k from supplier union all select c_nationkey from customer) u on k = n_nationkey group by 1",
    ),
    "union_unbound_join": (
        "select ?x ?n ?r where { { ?x <s_nationkey> ?n . ?x <s_acctbal> ?b . filter(?b < -500) } union { ?x <r_name> \"ASIA\" } ?n <n_regionkey> ?r }",
        "select x, 'nation/' || n_nationkey as n, 'region/' || n_regionkey as r from (select 'supplier/' || s_suppkey as x, s_nationkey as k from supplier where s_acctbal < -500 union all select 'region/' || r_regionkey, null from region where r_name = 'ASIA') u join nation on k is null or k = n_nationkey",
    ),
    "union_mixed_kinds": (
        "select ?v where { { <nation/3> <n_name> ?v } union { <nation/3> <n_regionkey> ?v } union { <customer/3> <c_custkey> ?v } union { <part/3> <p_size> ?v } }",
        "select n_name as v from nation where n_nationkey = 3 union all select 'region/' || n_regionkey from nation where n_nationkey = 3 union all select p_size::varchar from part where p_partkey = 3",
    ),
    # duplicates
    "distinct": ("select distinct ?seg ?n where { ?c <c_mktsegment> ?seg . ?c <c_nationkey> ?n }", "select distinct c_mktsegment as seg, 'nation/' || c_nationkey as n from customer"),
    "reduced": ("select reduced ?st where { [] <o_orderstatus> ?st }", "select distinct o_orderstatus as st from orders"),
    "count": ("select count ?st ?prio where { ?o <o_orderstatus> ?st . ?o <o_orderpriority> ?prio }", "select o_orderstatus as st, o_orderpriority as prio, count(*) as count from orders group by 1, 2"),
    "duplicates": ("select duplicates ?n where { ?s <s_nationkey> ?n }", "select 'nation/' || s_nationkey as n, count(*) as count from supplier group by 1 having count(*) >= 2"),
    "all_duplicates": ("select ?n where { ?s <s_nationkey> ?n }", "select 'nation/' || s_nationkey as n from supplier"),
    "select_star": ("select * where { ?r <r_name> ?name . ?n <n_regionkey> ?r }", "select 'nation/' || n_nationkey as n, r_name as name, 'region/' || r_regionkey as r from nation join region on n_regionkey = r_regionkey"),
    "unbound_projection": ("select ?r ?nothing where { ?r <r_name> ?n }", "select 'region/' || r_regionkey as r, null::varchar as nothing from region"),
    # order and limit
    "order_asc": ("select ?n ?nn where { ?n <n_name> ?nn } order by ?nn", "select 'nation/' || n_nationkey as n, n_name as nn from nation order by n_name"),
    "order_desc_mixed": (
        "select ?c ?seg ?b where { ?c <c_mktsegment> ?seg ; <c_acctbal> ?b } order by asc(?seg) desc(?b) ?c limit 25",
        "select 'customer/' || c_custkey as c, c_mktsegment as seg, c_acctbal as b from customer order by c_mktsegment, c_acctbal desc, 'customer/' || c_custkey limit 25",
    ),
    "order_by_count": (
        "select count ?n where { ?c <c_nationkey> ?n } order by desc(count) ?n limit 7",
        "select 'nation/' || c_nationkey as n, count(*) as count from customer group by 1 order by 2 desc, 1 limit 7",
    ),
    "top_k": ("select ?o ?p where { ?o <o_totalprice> ?p } order by desc(?p) ?o limit 10", "select 'order/' || o_orderkey as o, o_totalprice as p from orders order by 2 desc, 1 limit 10"),
    "order_unbound_first": (
        "select ?d ?q where { ?d <source> \"src2\" optional { ?d <quality> ?q } } order by ?q ?d limit 20",
        "select 'document/' || d.doc_id as d, quality::bigint as q from documents d left join labels l using (doc_id) where source = 'src2' order by quality nulls first, 'document/' || d.doc_id limit 20",
    ),
    # filters
    "filter_eq": ("select ?o where { ?o <o_orderstatus> ?s . filter(?s = \"P\") }", "select 'order/' || o_orderkey as o from orders where o_orderstatus = 'P'"),
    "filter_eq_iri": ("select ?c where { ?c <c_nationkey> ?n . filter(?n = <nation/5>) }", "select 'customer/' || c_custkey as c from customer where c_nationkey = 5"),
    "filter_ne_const": ("select count ?s where { ?o <o_orderstatus> ?s . filter(?s != \"F\") }", "select o_orderstatus as s, count(*) as count from orders where o_orderstatus <> 'F' group by 1"),
    "filter_ne_var": (
        "select count ?x where { ?s <s_nationkey> ?x . ?t <s_nationkey> ?y . ?s <s_name> ?u . filter(?x != ?y && ?u = \"Supplier#000000001\") }",
        "select 'nation/' || a.s_nationkey as x, count(*) as count from supplier a join supplier b on a.s_nationkey <> b.s_nationkey where a.s_name = 'Supplier#000000001' group by 1",
    ),
    "filter_in": ("select ?n where { ?n <n_name> ?x . filter(in(?x, \"NATION_1\", \"NATION_7\", \"NATION_99\")) }", "select 'nation/' || n_nationkey as n from nation where n_name in ('NATION_1', 'NATION_7', 'NATION_99')"),
    "filter_in_iri": ("select ?c where { ?c <c_nationkey> ?n . filter(in(?n, <nation/1>, <nation/2>, <region/1>)) }", "select 'customer/' || c_custkey as c from customer where c_nationkey in (1, 2)"),
    "filter_lt": ("select ?p where { ?p <p_size> ?s . filter(?s < 3) }", "select 'part/' || p_partkey as p from part where p_size < 3"),
    "filter_le": ("select ?p where { ?p <p_size> ?s . filter(?s <= 3) }", "select 'part/' || p_partkey as p from part where p_size <= 3"),
    "filter_gt": ("select ?p ?s where { ?p <p_retailprice> ?s . filter(?s > 915.25) }", "select 'part/' || p_partkey as p, p_retailprice as s from part where p_retailprice > 915.25"),
    "filter_ge": ("select ?p where { ?p <p_size> ?s . filter(?s >= 48) }", "select 'part/' || p_partkey as p from part where p_size >= 48"),
    "filter_date": (
        "select count ?s where { ?o <o_orderdate> ?d ; <o_orderstatus> ?s . filter(?d >= 1996Y01M01D && ?d < 1996Y07M01D) }",
        "select o_orderstatus as s, count(*) as count from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1996-07-01' group by 1",
    ),
    "filter_and_or_not": (
        "select ?c where { ?c <c_acctbal> ?b ; <c_mktsegment> ?s . filter((?b < 0 || ?b > 9000) && !(?s = \"BUILDING\")) }",
        "select 'customer/' || c_custkey as c from customer where (c_acctbal < 0 or c_acctbal > 9000) and c_mktsegment <> 'BUILDING'",
    ),
    "filter_arith": (
        "select ?p where { ?p <p_size> ?s ; <p_retailprice> ?r . filter(?s * 2 + 1 > 60 - -?s / 2 && +?s - 1 < 49) }",
        "select 'part/' || p_partkey as p from part where p_size * 2 + 1 > 60 + p_size / 2.0 and p_size - 1 < 49",
    ),
    "filter_divide_by_zero": ("select ?p where { ?p <p_size> ?s . filter(10 / (?s - ?s) > 1) }", "select 'x' as p where false"),
    "filter_boolean_text": ("select ?p where { ?p <p_size> ?s . filter(true && ?s = 7) }", "select 'part/' || p_partkey as p from part where p_size = 7"),
    # functions
    "fn_str": ("select ?c where { ?c <c_nationkey> ?n . filter(str(?n) = \"nation/12\") }", "select 'customer/' || c_custkey as c from customer where c_nationkey = 12"),
    "fn_lang": ("select ?d where { ?d <text> ?t . filter(lang(?t) = \"es\") }", "select 'document/' || doc_id as d from documents where lang = 'es'"),
    "fn_langmatches": ("select count ?l where { ?d <text> ?t . ?d <lang> ?l . filter(langmatches(lang(?t), \"EN\") || langmatches(lang(?t), \"fr\")) }", "select lang as l, count(*) as count from documents where lang in ('en', 'fr') group by 1"),
    "fn_langmatches_any": ("select count ?l where { ?d <text> ?t . ?d <lang> ?l . filter(langmatches(lang(?t), \"*\")) }", "select lang as l, count(*) as count from documents group by 1"),
    "fn_datatype": (
        "select count ?p where { <order/1> ?p ?v . filter(datatype(?v) = \"http://www.w3.org/2001/XMLSchema#double\") }",
        "select 'o_totalprice' as p, count(*) as count from orders where o_orderkey = 1 group by 1",
    ),
    "fn_bound": ("select ?d where { ?d <lang> \"en\" optional { ?d <toxic> ?t } filter(bound(?t)) }", "select 'document/' || doc_id as d from documents join labels using (doc_id) where lang = 'en'"),
    "fn_sameterm": ("select ?a ?b where { ?a <n_regionkey> ?r . ?b <n_regionkey> ?q . filter(sameterm(?r, ?q) && ?a != ?b) }", "select 'nation/' || a.n_nationkey as a, 'nation/' || b.n_nationkey as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey"),
    "fn_isiri": ("select count ?p where { <order/7> ?p ?v . filter(isiri(?v)) }", "select p, count(*) as count from (select 'o_custkey' as p from orders where o_orderkey = 7 union all select 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' from orders where o_orderkey = 7 union all select 'hasPart' from (select distinct l_partkey from lineitem where l_orderkey = 7) a union all select 'hasSupplier' from (select distinct l_suppkey from lineitem where l_orderkey = 7) b) u group by 1"),
    "fn_isblank": ("select ?s where { ?s <r_name> ?v . filter(!isblank(?s)) }", "select 'region/' || r_regionkey as s from region"),
    "fn_isliteral": ("select count ?p where { <nation/7> ?p ?v . filter(isliteral(?v)) }", "select 'n_name' as p, count(*) as count from nation where n_nationkey = 7 group by 1"),
    "fn_regex": ("select ?d where { ?d <text> ?t . filter(regex(str(?t), \"LICENSE|akia[0-9a-z]\", \"i\")) }", "select 'document/' || doc_id as d from documents where regexp_matches(text, 'LICENSE|akia[0-9a-z]', 'i')"),
    "fn_regex_bad_pattern": ("select ?n where { ?n <n_name> ?t . filter(regex(?t, \"(\") || regex(?t, \"9$\") || regex(?t, ?t)) }", "select 'nation/' || n_nationkey as n from nation"),
    "fn_regex_plain": ("select ?p where { ?p <p_type> ?t . filter(regex(?t, \"^S.*D$|OMY$\")) }", "select 'part/' || p_partkey as p from part where regexp_matches(p_type, '^S.*D$|OMY$')"),
    # shapes of published query sets
    "shape_count_types": ("select count ?t where { ?x a ?t }", "select t, count(*) as count from (select 'Region' as t from region union all select 'Nation' from nation union all select 'Customer' from customer union all select 'Supplier' from supplier union all select 'Part' from part union all select 'Order' from orders union all select 'Lineitem' from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem) l union all select 'Document' from documents union all select 'Page' from pages union all select 'Item' from benchmark) u group by 1"),
    "shape_star_with_in": (
        'select count ?p where { ?x a <Customer> . ?x ?p ?o . filter(in(?p, <c_name>, <c_mktsegment>, <c_acctbal>)) }',
        "select p, count(*) as count from customer, (values ('c_name'), ('c_mktsegment'), ('c_acctbal')) v(p) group by 1",
    ),
    "shape_union_with_pattern": (
        'select count ?p where { ?x <c_mktsegment> "AUTOMOBILE" . { ?x ?p [] } union { ?y <o_custkey> ?x . ?y ?p "F" } }',
        "select p, count(*) as count from (select p from customer, (values ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment')) v(p) where c_mktsegment = 'AUTOMOBILE' union all select 'o_orderstatus' from orders join customer on o_custkey = c_custkey where c_mktsegment = 'AUTOMOBILE' and o_orderstatus = 'F') u group by 1",
    ),
    "shape_long_chain": (
        'select ?cn ?sn where { ?l <l_orderkey> ?o . ?o <o_custkey> ?c . ?c <c_name> ?cn . ?c <c_nationkey> ?n . ?n <n_name> "NATION_2" . ?l <l_suppkey> ?s . ?s <s_name> ?sn . ?s <s_nationkey> ?m . ?m <n_regionkey> ?r . ?r <r_name> "ASIA" . ?l <l_returnflag> "R" . ?l <l_quantity> ?q . filter(?q > 45 && ?n != ?m) }',
        "select c_name as cn, s_name as sn from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem where l_returnflag = 'R' and l_quantity > 45) l join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation cn on cn.n_nationkey = c_nationkey join supplier on s_suppkey = l_suppkey join nation sn on sn.n_nationkey = s_nationkey join region on r_regionkey = sn.n_regionkey where cn.n_name = 'NATION_2' and r_name = 'ASIA' and cn.n_nationkey <> sn.n_nationkey",
    ),
    "shape_variable_predicates": (
        "select distinct ?p ?q where { ?a ?p ?b . ?b ?q ?r . ?r <r_name> \"EUROPE\" }",
        "select p, 'n_regionkey' as q from (select 'c_nationkey' as p from customer join nation on c_nationkey = n_nationkey join region on r_regionkey = n_regionkey where r_name = 'EUROPE' union select 's_nationkey' from supplier join nation on s_nationkey = n_nationkey join region on r_regionkey = n_regionkey where r_name = 'EUROPE') u",
    ),
    "shape_nested_blank": (
        'prefix x: <> select ?o where { ?o <o_custkey> [ <c_mktsegment> "HOUSEHOLD" ; <c_nationkey> [ <n_name> "NATION_9" ] ] }',
        "select 'order/' || o_orderkey as o from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where c_mktsegment = 'HOUSEHOLD' and n_name = 'NATION_9'",
    ),
    "shape_events": (
        "select count ?t where { ?e <event_type> ?t ; <value> ?v ; <user_id> ?u . filter(?v > 50) }",
        "select event_type as t, count(*) as count from events where value > 50 group by 1",
    ),
    "shape_conversation_roles": ("select count ?r where { ?x <role> ?r . ?x <of> ?c }", "select role as r, count(*) as count from (select distinct conv_id, turn, role from conversations) c group by 1"),
}


def select(text: str) -> Query:
    return lambda spark, sf_dir: engine(spark, sf_dir).query(text)


#: Predicates of the graph that the store's queries are over, as SQL.
GRAPH = {
    "n_name": "select 'nation/' || n_nationkey as s, 'n_name' as p, n_name as o from nation",
    "n_regionkey": "select 'nation/' || n_nationkey, 'n_regionkey', 'region/' || n_regionkey from nation",
    "r_name": "select 'region/' || r_regionkey, 'r_name', r_name from region",
    "c_nationkey": "select 'customer/' || c_custkey, 'c_nationkey', 'nation/' || c_nationkey from customer",
    "c_mktsegment": "select 'customer/' || c_custkey, 'c_mktsegment', c_mktsegment from customer",
    "o_custkey": "select 'order/' || o_orderkey, 'o_custkey', 'customer/' || o_custkey from orders",
    "o_orderstatus": "select 'order/' || o_orderkey, 'o_orderstatus', o_orderstatus from orders",
    "hasPart": "select distinct 'order/' || l_orderkey, 'hasPart', 'part/' || l_partkey from lineitem",
}


def _geography(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """The triples of some predicates of nations, customers, orders and line items, materialised: a set, since each predicate is of one table. repeats: as often as tables have them."""
    source = engine(spark, sf_dir).source
    if repeats:
        source.maps = [replace(m, distinct=False) for m in source.maps]
    out = None
    for p in GRAPH:
        rel = source.match(Pattern(Var("s"), Term(p, URI), Var("o")))
        own = TripleSource(spark, from_source(_One(spark, rel, p)), unique=True).df
        out = own if out is None else out.unionByName(own)
    return out


class _One:
    """A single predicate's triples as a source."""

    def __init__(self, spark, rel, predicate):
        df = rel.df.withColumn("v_p", F.lit(predicate))
        self.spark, self.rel = spark, Relation(df, {**rel.vars, "p": Binding("v_p", Iri())})

    def match(self, pattern):
        return self.rel


def materialised_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(TripleSource(spark, _geography(spark, sf_dir), unique=True)).query("select count ?rn where { ?n <n_regionkey> ?r . ?r <r_name> ?rn }")


def materialised_variable_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(TripleSource(spark, _geography(spark, sf_dir), unique=True)).query("select count ?p where { ?s ?p ?o }")


def _changed(spark: SparkSession, sf_dir: str):
    from .engine import Engine
    store = TripleStore.create(spark, scratch_path(spark, "store"), _geography(spark, sf_dir), unique=True)
    return Engine(store)


_NATIONS = "select ?n ?name where { ?n <n_name> ?name }"


def delta_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _changed(spark, sf_dir)
    e.insert_data('<nation/100> <n_name> "ATLANTIS" ; <n_regionkey> <region/1> . <nation/1> <n_name> "NATION_1" .')
    return e.query(_NATIONS)


def delta_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _changed(spark, sf_dir)
    e.delete_data('<nation/1> <n_name> "NATION_1" . <nation/2> <n_name> "NO SUCH NAME" .')
    e.store.commit()
    return e.query(_NATIONS)


def delta_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _changed(spark, sf_dir)
    e.insert_data('<nation/100> <n_name> "ATLANTIS" .')
    e.execute("rollback")
    return e.query(_NATIONS)


def version_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions 0 to 3 and a compacted base, counted."""
    e = _changed(spark, sf_dir)
    e.insert_data('<nation/100> <n_name> "ATLANTIS" .')
    e.store.commit()
    e.delete_data('<nation/100> <n_name> "ATLANTIS" . <nation/1> <n_name> "NATION_1" .')
    e.store.sync()
    e.insert_data('<nation/1> <n_name> "NATION_1" .')
    e.store.commit()
    out = None
    for v in range(4):
        own = e.store.as_of(v).agg(F.lit(v).cast("long").alias("version"), F.count(F.lit(1)).alias("triples"))
        out = own if out is None else out.unionByName(own)
    return out


def schema_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = characteristic_sets(_geography(spark, sf_dir))
    return sets.select(F.array_join("predicates", ",").alias("predicates"), "subjects", "triples")


def pred_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_counts(_geography(spark, sf_dir), "p")


def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_counts(_geography(spark, sf_dir), "po").select("p", F.col("o_v").alias("o"), "count")


def join_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _geography(spark, sf_dir)
    orders, customers = g.where("p = 'o_custkey'"), g.where("p = 'c_mktsegment'")
    partners = join_partner_counts(orders, "o", customers, "s").select(F.col("partners").cast("long").alias("partners"))
    return partners.crossJoin(star_counts(g, ["o_custkey", "hasPart"]).select(F.col("star").cast("long").alias("star")))  # of one row each


_SHIFT = '<order/1> <o_orderstatus> "X" . <order/2> <o_orderstatus> "O" . <order/1000000000> <o_orderstatus> "X" , "Y" .'
_LOSS = "".join(f'<order/{i}> <o_orderstatus> "{x}" . ' for i in range(3, 40) for x in "FOP")


def _shifted(spark: SparkSession, sf_dir: str):
    """A store with a committed and a pending change of orders' states."""
    e = _changed(spark, sf_dir)
    e.insert_data(_SHIFT)
    e.store.commit()
    e.delete_data(_LOSS)
    return e


def delta_count_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shifted(spark, sf_dir).query("select count ?st where { ?o <o_orderstatus> ?st }")


def delta_count_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shifted(spark, sf_dir).query("select count ?p where { ?s ?p ?o }")


def delta_count_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shifted(spark, sf_dir).query("select duplicates ?s where { ?s <o_orderstatus> ?st }")


def delta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shifted(spark, sf_dir).query('select count ?seg where { ?o <o_orderstatus> "O" . ?o <o_custkey> ?c . ?c <c_mktsegment> ?seg }')


def rendered_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in N-Triples syntax."""
    return engine(spark, sf_dir).query("select ?s ?n ?r ?b where { ?s <s_name> ?n ; <s_nationkey> ?r ; <s_acctbal> ?b . filter(?b < 0) }", "terms")


_BLANKS = '''@prefix x: <urn:x:> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @base <http://base.org/a/> .
_:a x:knows _:b . _:b x:name "Bo"@en , "Bo"@de ; x:age 5 . x:c x:knows _:a ; x:name """a long
"name\\"""" ; x:when "soon"^^x:time ; x:list ( 1 x:two ) . <rel> x:name "rel" .'''


def _blanks(spark: SparkSession):
    return Engine(TripleSource(spark, turtle_frame(spark, _BLANKS)))


def blank_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled blank nodes in data and query, declared prefixes and isBLANK."""
    return _blanks(spark).query("prefix x: <urn:x:> select ?n where { _:k x:knows ?b . ?b x:name ?n . filter(isblank(?b)) }")


def tagged_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blanks(spark).query('prefix x: <urn:x:> select ?s where { { _:q x:name "Bo"@de . _:q x:age ?s } union { ?s x:when "soon"^^<urn:x:time> } union { ?s x:name "rel" . filter(!false) } }')


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blanks(spark).query("prefix x: <urn:x:> prefix r: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> select ?a ?b where { x:c x:list ?l . ?l r:first ?a ; r:rest ?m . ?m r:first ?b ; r:rest r:nil }")


def anonymous_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query("select count ?c where { ?c [] <nation/3> }")


def unbound_order_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query("select ?r ?none where { ?r <r_name> ?x } order by ?none ?r")


def merged_braces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query('select ?n where { { ?n <n_regionkey> ?r . { ?r <r_name> "ASIA" } } }')


def dictionary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = build_dictionary(_geography(spark, sf_dir, repeats=True))
    known = predicates(d)
    return decode(encode(_geography(spark, sf_dir), d, known), d, known).select("s", "p", F.col("o_v").alias("o"))


def ntriples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntriples_lines(ntriples(_geography(spark, sf_dir))).select("s", "p", F.col("o_v").alias("o"))


def turtle_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '@prefix n: <nation/> . n:1 <knows> n:2 , n:3 ; <likes> "x"@en , 5 . n:2 <knows> [ <likes> 5 ] .'
    return turtle_frame(spark, text).select("s", "p", F.col("o_v").alias("o")).where("not startswith(s, '_:') and not startswith(o, '_:')")


def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.register_function("urn:length", lambda c: F.length(c), INTEGER)
    return e.query("select ?n where { ?n <n_name> ?x . filter(<urn:length>(?x) = 9) }")


def udtf_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.register_table_function("split", lambda text: ((w,) for w in text.split(" ")))
    return e.query('select count ?w where { ?p <p_name> ?t . filter <urn:graphloom:tableFunction>("split", "1", ?t, ?w) }')


def subst_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of a template's most frequent constants, and their results together."""
    e = engine(spark, sf_dir)
    out = None
    for text in e.expand_template("select count ?st where { ?o <o_custkey> ?c . ?c <c_mktsegment> @ . ?o <o_orderstatus> ?st }", limit=3):
        own = e.query(text)
        out = own if out is None else out.unionByName(own)
    return out


_GEO = "(" + " union all ".join(GRAPH.values()) + ")"
_STATES = (
    "(select 'order/' || o_orderkey as s, o_orderstatus as st from orders where o_orderkey not between 3 and 39"
    " union select 'order/1', 'X' union select 'order/2', 'O' union select 'order/1000000000', 'X' union select 'order/1000000000', 'Y')"
)
OTHERS: dict[str, tuple[Query, str | None]] = {
    "materialised_join": (materialised_join, "select r_name as rn, count(*) as count from nation join region on n_regionkey = r_regionkey group by 1"),
    "materialised_variable_predicate": (materialised_variable_predicate, f"select p, count(*) as count from {_GEO} g group by 1"),
    "delta_insert": (delta_insert, "select 'nation/' || n_nationkey as n, n_name as name from nation union all select 'nation/100', 'ATLANTIS'"),
    "delta_delete": (delta_delete, "select 'nation/' || n_nationkey as n, n_name as name from nation where n_nationkey <> 1"),
    "delta_rollback": (delta_rollback, "select 'nation/' || n_nationkey as n, n_name as name from nation"),
    "version_as_of": (version_as_of, f"select v::bigint as version, n + d as triples from (select count(*) as n from {_GEO} g) a, (values (0, 0), (1, 1), (2, -1), (3, 0)) b(v, d)"),
    "schema_charsets": (schema_charsets, f"select predicates, count(*) as subjects, sum(n)::bigint as triples from (select s, string_agg(p, ',' order by p) as predicates, sum(n) as n from (select s, p, count(*) as n from {_GEO} g group by 1, 2) y group by 1) x group by 1"),
    "pred_stats": (pred_stats, f"select p, count(*) as count from {_GEO} g group by 1"),
    "pair_stats": (pair_stats, f"select p, o, count(*) as count from {_GEO} g group by 1, 2"),
    "join_stats": (join_stats, "select (select count(*) from orders join customer on o_custkey = c_custkey) as partners, (select count(*) from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey)) as star"),
    "dictionary_round_trip": (dictionary_round_trip, f"select s, p, o from {_GEO} g"),
    "ntriples_round_trip": (ntriples_round_trip, f"select s, p, o from {_GEO} g"),
    "delta_count_object": (delta_count_object, f"select st, count(*) as count from {_STATES} x group by 1"),
    "delta_count_predicate": (delta_count_predicate, f"select p, count(*) as count from (select p from {_GEO} g where p <> 'o_orderstatus' union all select 'o_orderstatus' from {_STATES} x) y group by 1"),
    "delta_count_subject": (delta_count_subject, f"select s, count(*) as count from {_STATES} x group by 1 having count(*) > 1"),
    "delta_join": (delta_join, f"select c_mktsegment as seg, count(*) as count from {_STATES} x join orders on s = 'order/' || o_orderkey join customer on o_custkey = c_custkey where st = 'O' group by 1"),
    "rendered_terms": (
        rendered_terms,
        "select '<supplier/' || s_suppkey || '>' as s, '\"' || s_name || '\"' as n, '<nation/' || s_nationkey || '>' as r, '\"' || s_acctbal || '\"^^<http://www.w3.org/2001/XMLSchema#double>' as b from supplier where s_acctbal < 0",
    ),
    "blank_nodes": (blank_nodes, "select n from (values ('Bo'), ('Bo')) v(n)"),
    "tagged_constants": (tagged_constants, "select s from (values ('5'), ('urn:x:c'), ('http://base.org/a/rel')) v(s)"),
    "collections": (collections, "select '1' as a, 'urn:x:two' as b"),
    "anonymous_predicate": (anonymous_predicate, "select c, count(*) as count from (select 'customer/' || c_custkey as c from customer where c_nationkey = 3 union all select 'supplier/' || s_suppkey from supplier where s_nationkey = 3) x group by 1"),
    "unbound_order_key": (unbound_order_key, "select 'region/' || r_regionkey as r, null::varchar as none from region"),
    "merged_braces": (merged_braces, "select 'nation/' || n_nationkey as n from nation join region on r_regionkey = n_regionkey where r_name = 'ASIA'"),
    "turtle_data": (turtle_data, "select * from (values ('nation/1', 'knows', 'nation/2'), ('nation/1', 'knows', 'nation/3'), ('nation/1', 'likes', 'x'), ('nation/1', 'likes', '5')) v(s, p, o)"),
    "udf_scalar": (udf_scalar, "select 'nation/' || n_nationkey as n from nation where length(n_name) = 9"),
    "udtf_tokens": (udtf_tokens, "select w, count(*) as count from (select unnest(string_split(p_name, ' ')) as w from part) x group by 1"),
    "subst_template": (
        subst_template,
        "with top as (select c_mktsegment as seg from orders join customer on o_custkey = c_custkey group by 1 order by count(*) desc, 1 limit 3) select o_orderstatus as st, count(*) as count from orders join customer on o_custkey = c_custkey where c_mktsegment in (select seg from top) group by c_mktsegment, o_orderstatus",
    ),
}

QUERIES: dict[str, Query] = {**{n: select(t) for n, (t, _) in SELECTS.items()}, **{n: q for n, (q, _) in OTHERS.items()}}
ORACLES: dict[str, str] = {**{n: s for n, (_, s) in SELECTS.items()}, **{n: s for n, (_, s) in OTHERS.items() if s is not None}}
