"""Queries over the standard tables, each with the SQL that must agree.

Most are texts of the language; a few call the operators directly.  Results
are flat (no arrays) so that they can be compared as rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import family_queries
from tessera.api import Engine
from tessera.functions import geo
from tessera.operators import graph, search

Query = Callable[[SparkSession, str], DataFrame]

CUSTOMER_ORDERS = "links (customers)->[places@e:CustomerPlacesOrder]->(orders@o:Order)"
ORDER_PARTS = "links (orders)->[contains@c:OrderContainsPart]->(parts@p:Part)"
JOIN_CO = "customer c join orders o on o.o_custkey = c.c_custkey"

#: name: (query text, SQL)
TEXTS: dict[str, tuple[str, str]] = {
    # -- scans, projections, filters, order and range
    "scan_filter_project": (
        "select orders@o[*].{id: o.o_orderkey, total: o.o_totalprice} from orders@o:Order where o.o_totalprice > 300000.0 and o.o_orderstatus == 'O'",
        "select o_orderkey as id, o_totalprice as total from orders where o_totalprice > 300000 and o_orderstatus = 'O'",
    ),
    "order_range": (
        "select orders@o[*].{id: o.o_orderkey, total: o.o_totalprice} from orders@o:Order where o.o_totalprice > 300000.0 order by o.o_totalprice desc, o.o_orderkey range ..10",
        "select o_orderkey as id, o_totalprice as total from orders where o_totalprice > 300000 order by o_totalprice desc, o_orderkey limit 10",
    ),
    "range_offset": (
        "select orders@o[*].{id: o.o_orderkey} from orders@o:Order order by o.o_totalprice, o.o_orderkey range 5..12",
        "select o_orderkey as id from orders order by o_totalprice, o_orderkey limit 7 offset 5",
    ),
    "range_inclusive": (
        "select orders@o[*].{id: o.o_orderkey} from orders@o:Order order by o.o_orderkey range 3..=6",
        "select o_orderkey as id from orders order by o_orderkey limit 4 offset 3",
    ),
    "index_at": (
        "select orders@o[order by o.o_totalprice desc, o.o_orderkey][0].{o_orderkey, o_totalprice} from orders@o:Order",
        "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 1",
    ),
    "index_negative": (
        "select orders@o[order by o.o_orderkey][-1].{o_orderkey, o_totalprice} from orders@o:Order",
        "select o_orderkey, o_totalprice from orders order by o_orderkey desc limit 1",
    ),
    "scalar_projection": ("select 1 from orders@o:Order", "select 1 as value"),
    "record_scan": ("select customers@c[*].{id: c.c_custkey, name: c.c_name} from customers@c:Customer:7", "select c_custkey as id, c_name as name from customer where c_custkey = 7"),
    "scan_modifiers": (
        "select customers@c[*].{id: c.c_custkey} from (customers@c:Customer where c.c_acctbal > 0.0 order by c.c_acctbal desc, c.c_custkey range ..20)",
        "select c_custkey as id from customer where c_acctbal > 0 order by c_acctbal desc, c_custkey limit 20",
    ),
    "spread_projection": ("select nations@n[*].{..n, key2: n.n_nationkey * 2} from nations@n:Nation", "select n_nationkey, n_name, n_regionkey, n_nationkey * 2 as key2 from nation"),
    "shorthand_projection": ("select nations@n[*].{n_name, n_regionkey} from nations@n:Nation", "select n_name, n_regionkey from nation"),
    "conditional": (
        "select parts@p[*].{id: p.p_partkey, size: if p.p_size > 25 { 'large' } else if p.p_size > 10 { 'medium' } else { 'small' }} from parts@p:Part",
        "select p_partkey as id, case when p_size > 25 then 'large' when p_size > 10 then 'medium' else 'small' end as size from part",
    ),
    "match_case": (
        "select parts@p[*].{id: p.p_partkey, k: match p.p_size { 1 | 2 | 3 => 'tiny', 4..20 => 'mid', n if n > 40 => 'huge', _ => 'big' }} from parts@p:Part",
        "select p_partkey as id, case when p_size in (1,2,3) then 'tiny' when p_size >= 4 and p_size < 20 then 'mid' when p_size > 40 then 'huge' else 'big' end as k from part",
    ),
    "let_block": (
        "select parts@p[*].{id: p.p_partkey, v: { let a = p.p_size * 2; let b = a + 1; a * b }} from parts@p:Part",
        "select p_partkey as id, (p_size * 2) * (p_size * 2 + 1) as v from part",
    ),
    "interpolated_string": (
        "select customers@c[*].{id: c.c_custkey, s: i\"${c.c_name} of {c.c_mktsegment}\"} from customers@c:Customer",
        "select c_custkey as id, c_name || ' of ' || c_mktsegment as s from customer",
    ),
    "int_division_bucket": (
        "select parts@p[*].{id: p.p_partkey, bucket: (p.p_size / 10) * 10, rest: p.p_size % 10} from parts@p:Part",
        "select p_partkey as id, (p_size // 10) * 10 as bucket, p_size % 10 as rest from part",
    ),
    "arithmetic": (
        "select parts@p[*].{id: p.p_partkey, a: p.p_size ** 2, b: -p.p_size + 3 << 1, c: p.p_size & 6 | 1, d: p.p_size ^ 5} from parts@p:Part",
        "select p_partkey as id, p_size * p_size as a, (-p_size + 3) * 2 as b, (p_size & 6) | 1 as c, xor(p_size, 5) as d from part",
    ),
    "in_list": (
        "select orders@o[*].{id: o.o_orderkey} from orders@o:Order where o.o_orderpriority in ['1-URGENT', '2-HIGH'] and o.o_orderstatus not in ['F']",
        "select o_orderkey as id from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus not in ('F')",
    ),
    "in_range": ("select parts@p[*].{id: p.p_partkey} from parts@p:Part where p.p_size in 5..=9", "select p_partkey as id from part where p_size between 5 and 9"),
    "in_subquery": (
        "select customers@c[*].{id: c.c_custkey} from customers@c:Customer where c.c_custkey in (select orders@o[*].o_custkey from orders@o:Order where o.o_totalprice > 450000.0)",
        "select c_custkey as id from customer where c_custkey in (select o_custkey from orders where o_totalprice > 450000)",
    ),
    "like_ilike_regex": (
        "select customers@c[*].{id: c.c_custkey, a: c.c_mktsegment like 'BU%', b: c.c_mktsegment ~~* 'ma%', r: c.c_name =~ '[02468]$'} from customers@c:Customer",
        "select c_custkey as id, c_mktsegment like 'BU%' as a, c_mktsegment ilike 'ma%' as b, regexp_matches(c_name, '[02468]$') as r from customer",
    ),
    "cast": ("select orders@o[*].{id: o.o_orderkey, t: math::floor(o.o_totalprice) as i64, s: o.o_orderkey as str} from orders@o:Order", "select o_orderkey as id, cast(floor(o_totalprice) as bigint) as t, cast(o_orderkey as varchar) as s from orders"),
    "date_filter": ("select orders@o[*].{id: o.o_orderkey} from orders@o:Order where o.o_orderdate >= dt'1998-01-01'", "select o_orderkey as id from orders where o_orderdate >= timestamp '1998-01-01'"),
    "duration_filter": (
        "select events@e[*].{id: e.event_id} from events@e:Event where e.ts < dt'2024-01-03T00:00:00' - du'12h'",
        "select event_id as id from events where ts < timestamp '2024-01-02 12:00:00'",
    ),
    # -- groups
    "group_single": (
        "select g@x[*].{priority: x.priority, n: len(x.orders)} from orders@o:Order group by {priority: o.o_orderpriority} into g",
        "select o_orderpriority as priority, count(*) as n from orders group by 1",
    ),
    "group_composite": (
        "select g@x[*].{p: x.p, s: x.s, total: x.orders@o[*].o_totalprice.sum().round(2)} from orders@o:Order group by {p: o.o_orderpriority, s: o.o_orderstatus} into g",
        "select o_orderpriority as p, o_orderstatus as s, round(sum(o_totalprice), 2) as total from orders group by 1, 2",
    ),
    "group_computed_key": (
        "select g@x[*].{bucket: x.bucket, seg: x.seg, n: len(x.customers)} from customers@c:Customer group by {bucket: (math::floor(c.c_acctbal) as i64 / 1000) * 1000, seg: c.c_mktsegment} into g",
        "select cast(trunc(floor(c_acctbal) / 1000) * 1000 as bigint) as bucket, c_mktsegment as seg, count(*) as n from customer group by 1, 2",
    ),
    "group_having": (
        "select g@x[where len(x.orders) > 12][*].{c: x.c, n: len(x.orders), top: x.orders@o[*].o_totalprice.max()} from orders@o:Order group by {c: o.o_custkey} into g",
        "select o_custkey as c, count(*) as n, max(o_totalprice) as top from orders group by 1 having count(*) > 12",
    ),
    "group_members_filtered": (
        "select g@x[*].{s: x.s, urgent: len(x.orders@o[where o.o_orderpriority == '1-URGENT']), dear: x.orders@o.any(|o| o.o_totalprice > 499000.0)} from orders@o:Order group by {s: o.o_orderstatus} into g",
        "select o_orderstatus as s, count(*) filter (o_orderpriority = '1-URGENT') as urgent, bool_or(o_totalprice > 499000) as dear from orders group by 1",
    ),
    "group_distinct_count": (
        "select g@x[*].{s: x.s, n: x.orders@o[*].o_custkey.distinct().count()} from orders@o:Order group by {s: o.o_orderstatus} into g",
        "select o_orderstatus as s, count(distinct o_custkey) as n from orders group by 1",
    ),
    "group_stats": (
        "select g@x[*].{s: x.s, mean: x.orders@o[*].o_totalprice.avg().round(4), lo: x.orders@o[*].o_totalprice.min(), hi: x.orders@o[*].o_totalprice.max()} from orders@o:Order group by {s: o.o_orderstatus} into g",
        "select o_orderstatus as s, round(avg(o_totalprice), 4) as mean, min(o_totalprice) as lo, max(o_totalprice) as hi from orders group by 1",
    ),
    "group_tail_order": (
        "select g@x[*].{c: x.c, n: len(x.orders)} from orders@o:Order group by {c: o.o_custkey} into g order by g.c range ..7",
        "select o_custkey as c, count(*) as n from orders group by 1 order by 1 limit 7",
    ),
    "group_link_derived_key": (
        "select g@x[*].{n: x.n, orders: len(x.orders)} from orders@o:Order " + ORDER_PARTS + " group by {n: len(o.contains)} into g",
        "select n, count(*) as orders from (select o_orderkey, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1) group by 1",
    ),
    "group_method": (
        "select orders.group_by(|o| {p: o.o_orderpriority}).map(|g| {p: g.p, n: g.items().len()}) from orders@o:Order",
        "select o_orderpriority as p, count(*) as n from orders group by 1",
    ),
    "group_topk": (
        "select g@x[*].items()[order by o.o_totalprice desc, o.o_orderkey][0..2][*].{c: o.o_custkey, id: o.o_orderkey} from orders@o:Order group by {c: o.o_custkey} into g".replace("items()[", "items()@o["),
        "select o_custkey as c, o_orderkey as id from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2",
    ),
    # -- links
    "links_forward_leaf": (
        "select customers@c[*].places@e[**].orders@o[**].{id: c.c_custkey, o: o.o_orderkey} from customers@c:Customer " + CUSTOMER_ORDERS,
        f"select c_custkey as id, o_orderkey as o from {JOIN_CO}",
    ),
    "links_backward_leaf": (
        "select orders@o[*].placed@e[**].by@c[**].{o: o.o_orderkey, name: c.c_name} from orders@o:Order links (orders)<-[placed@e:CustomerPlacesOrder]<-(by@c:Customer)",
        f"select o_orderkey as o, c_name as name from {JOIN_CO}",
    ),
    "links_bidirectional": (
        "select nations@n[*].near@e[**].{a: n.n_nationkey, f: e._from, t: e._to} from nations@n:Nation links (nations)<->[near@e:NationNeighbours]<->(m@m:Nation)",
        "with e as (select a.n_nationkey as f, b.n_nationkey as t from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey) select f as a, f, t from e union all select t as a, f, t from e where f <> t",
    ),
    "links_inner": (
        "select orders@o[*].{id: o.o_orderkey} from orders@o:Order links inner (orders)->[contains@c:OrderContainsPart]->(parts@p:Part)",
        "select o_orderkey as id from orders where o_orderkey in (select l_orderkey from lineitem)",
    ),
    "links_optional_counts": (
        "select orders@o[*].{id: o.o_orderkey, n: len(o.contains)} from orders@o:Order " + ORDER_PARTS,
        "select o_orderkey as id, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1",
    ),
    "links_base_gate": (
        "select customers@c[*].{id: c.c_custkey, n: len(c.places)} from customers@c:Customer links (customers where c.c_acctbal > 5000.0)->[places@e:CustomerPlacesOrder]->(orders@o:Order)",
        "select c_custkey as id, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey and c_acctbal > 5000 group by 1",
    ),
    "links_edge_filter": (
        "select orders@o[*].{id: o.o_orderkey, q: o.contains@c[*].l_quantity.sum()} from orders@o:Order links (orders)->[contains@c:OrderContainsPart where c.l_discount > 0.05]->(parts@p:Part)",
        "select o_orderkey as id, coalesce(sum(l_quantity), 0) as q from orders left join lineitem on l_orderkey = o_orderkey and l_discount > 0.05 group by 1",
    ),
    "links_node_filter": (
        "select orders@o[*].{id: o.o_orderkey, n: o.contains@c[*].parts@p[**].count()} from orders@o:Order links (orders)->[contains@c:OrderContainsPart]->(parts@p:Part where p.p_size > 25)",
        "select o_orderkey as id, count(p_partkey) as n from orders left join (lineitem join part on p_partkey = l_partkey and p_size > 25) on l_orderkey = o_orderkey group by 1",
    ),
    "links_multi_hop": (
        "select customers@c[*].places@e[**].orders@o[**].contains@l[**].parts@p[**].{id: c.c_custkey, part: p.p_partkey, q: l.l_quantity} from customers@c:Customer where c.c_acctbal > 9000.0".replace(
            " where", " links (customers)->[places@e:CustomerPlacesOrder]->(orders@o:Order)->[contains@l:OrderContainsPart]->(parts@p:Part) where"
        ),
        f"select c_custkey as id, p_partkey as part, l_quantity as q from {JOIN_CO} join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where c_acctbal > 9000",
    ),
    "links_multi_path": (
        "select customers@c[*].{id: c.c_custkey, orders: len(c.places), events: len(c.did)} from customers@c:Customer links (customers)->[places@e:CustomerPlacesOrder]->(orders@o:Order), (customers)->[did@d:CustomerDidEvent]->(events@v:Event)",
        "select c_custkey as id, (select count(*) from orders where o_custkey = c_custkey) as orders, (select count(*) from events where user_id = c_custkey) as events from customer",
    ),
    "links_topk_per_parent": (
        "select customers@c[*].places@e[**].{id: c.c_custkey, o: e.o_orderkey} from customers@c:Customer links (customers)->[places@e:CustomerPlacesOrder order by e.o_totalprice desc, e.o_orderkey range ..2]->(orders@o:Order)",
        "select o_custkey as id, o_orderkey as o from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2",
    ),
    "links_nested_flattened": (
        "select customers@c[*].{id: c.c_custkey, top: c.places@e[order by e.o_orderkey][*].o_orderkey}@r[where len(r.top) > 2][*].{id: r.id, first: r.top[0], n: len(r.top)} from customers@c:Customer " + CUSTOMER_ORDERS,
        "select o_custkey as id, min(o_orderkey) as first, count(*) as n from orders group by 1 having count(*) > 2",
    ),
    "links_union_edges": (
        "select parts@p[*].{id: p.p_partkey, n: len(p.moved)} from parts@p:Part links (parts)<-[moved@m:(OrderContainsPart | SupplierShipsPart)]<-(x@x:Order)",
        "select p_partkey as id, 2 * count(l_partkey) as n from part left join lineitem on l_partkey = p_partkey group by 1",
    ),
    "hops_bounded": (
        "select nations@n[*].near@e[**].{a: n.n_nationkey, b: e._to} from nations@n:Nation links (nations)->[near@e:NationNeighbours hops 1..=3]->(m@m:Nation)",
        "with e as (select a.n_nationkey as f, b.n_nationkey as t from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey), w as (select f, t from e union all select x.f, y.t from e x join e y on y.f = x.t union all select x.f, z.t from e x join e y on y.f = x.t join e z on z.f = y.t) select f as a, t as b from w",
    ),
    # -- existence, correlation
    "semi_any": (
        "select customers@c[*].{id: c.c_custkey} from customers@c:Customer " + CUSTOMER_ORDERS + " where c.places@e[*].orders@o[**].any(|o| o.o_totalprice > 450000.0)",
        "select c_custkey as id from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)",
    ),
    "anti_none": (
        "select orders@o[*].{id: o.o_orderkey} from orders@o:Order " + ORDER_PARTS + " where is_empty(o.contains)",
        "select o_orderkey as id from orders where o_orderkey not in (select l_orderkey from lineitem)",
    ),
    "anti_all": (
        "select customers@c[*].{id: c.c_custkey} from customers@c:Customer " + CUSTOMER_ORDERS + " where c.places.all(|e| e.o_totalprice < 450000.0)",
        "select c_custkey as id from customer where not exists (select 1 from orders where o_custkey = c_custkey and not (o_totalprice < 450000))",
    ),
    "mark_exists_flag": (
        "select customers@c[*].{id: c.c_custkey, big: c.places.any(|e| e.o_totalprice > 450000.0), quiet: c.did.none(|d| d.event_type == 'purchase')} from customers@c:Customer links (customers)->[places@e:CustomerPlacesOrder]->(orders@o:Order), (customers)->[did@d:CustomerDidEvent]->(events@v:Event)",
        "select c_custkey as id, exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000) as big, not exists (select 1 from events where user_id = c_custkey and event_type = 'purchase') as quiet from customer",
    ),
    "corr_scalar_top1": (
        "select customers@c[*].{id: c.c_custkey, last: (select orders@o[*].o_orderkey from orders@o:Order where o.o_custkey == c.c_custkey order by o.o_orderdate desc, o.o_orderkey range ..1).first()} from customers@c:Customer",
        "select c_custkey as id, (select o_orderkey from orders where o_custkey = c_custkey order by o_orderdate desc, o_orderkey limit 1) as last from customer",
    ),
    "corr_aggregate": (
        "select customers@c[*].{id: c.c_custkey, spent: (select orders@o[*].o_totalprice from orders@o:Order where o.o_custkey == c.c_custkey and o.o_orderstatus == 'F').sum().round(2)} from customers@c:Customer",
        "select c_custkey as id, round(coalesce((select sum(o_totalprice) from orders where o_custkey = c_custkey and o_orderstatus = 'F'), 0), 2) as spent from customer",
    ),
    "uncorrelated_scalar": (
        "select orders@o[*].{id: o.o_orderkey} from orders@o:Order where o.o_totalprice > (select all@a[*].o_totalprice from all@a:Order).avg() * 1.9",
        "select o_orderkey as id from orders where o_totalprice > (select avg(o_totalprice) from orders) * 1.9",
    ),
    # -- joins, sets, positions
    "join_by": (
        "select suppliers.join_by(nations, |s, n| s.s_nationkey == n.n_nationkey).map(|p| {id: p.left.s_suppkey, nation: p.right.n_name}) from suppliers@s:Supplier, nations@n:Nation",
        "select s_suppkey as id, n_name as nation from supplier join nation on s_nationkey = n_nationkey",
    ),
    "left_join_by": (
        "select docs.left_join_by(labels, |d, l| d.doc_id == l.doc_id).map(|p| {id: p.left.doc_id, q: p.right.quality}) from docs@d:Document, labels@l:Label",
        "select d.doc_id as id, quality as q from documents d left join labels l on l.doc_id = d.doc_id",
    ),
    "semi_join_by": (
        "select customers.semi_join_by(events, |c, e| c.c_custkey == e.user_id).map(|c| {id: c.c_custkey}) from customers@c:Customer, events@e:Event",
        "select c_custkey as id from customer where c_custkey in (select user_id from events)",
    ),
    "anti_join_by": (
        "select customers.anti_join_by(events, |c, e| c.c_custkey == e.user_id).map(|c| {id: c.c_custkey}) from customers@c:Customer, events@e:Event",
        "select c_custkey as id from customer where c_custkey not in (select user_id from events)",
    ),
    "theta_join_by": (
        "select a.join_by(b, |x, y| x.n_regionkey == y.n_regionkey && x.n_nationkey < y.n_nationkey).map(|p| {a: p.left.n_name, b: p.right.n_name}) from a@a:Nation, b@b:Nation",
        "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    ),
    "zip_positional": (
        "select a[order by a.n_nationkey].zip(b[order by b.n_name]).map(|p| {a: p.left.n_name, b: p.right.n_name}) from a@a:Nation, b@b:Nation",
        "select a.n_name as a, b.n_name as b from (select n_name, row_number() over (order by n_nationkey) r from nation) a join (select n_name, row_number() over (order by n_name) r from nation) b using (r)",
    ),
    "distinct": ("select orders@o[*].{p: o.o_orderpriority, s: o.o_orderstatus}[distinct] from orders@o:Order", "select distinct o_orderpriority as p, o_orderstatus as s from orders"),
    "distinct_by": (
        "select orders@o[order by o.o_totalprice, o.o_orderkey][distinct by o.o_custkey][*].{c: o.o_custkey, id: o.o_orderkey} from orders@o:Order",
        "select o_custkey as c, o_orderkey as id from orders qualify row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) = 1",
    ),
    "union": ("select a@a[*].c_nationkey.union(b@b[*].s_nationkey) from a@a:Customer, b@b:Supplier", "select c_nationkey as value from customer union select s_nationkey from supplier"),
    "intersect": ("select a@a[*].c_custkey.intersect(b@b[*].user_id) from a@a:Customer, b@b:Event", "select c_custkey as value from customer intersect select user_id from events"),
    "except": ("select a@a[*].c_custkey.except(b@b[*].user_id) from a@a:Customer, b@b:Event", "select c_custkey as value from customer except select user_id from events"),
    "union_all": ("select a@a[*].n_name.union_all(b@b[*].r_name) from a@a:Nation, b@b:Region", "select n_name as value from nation union all select r_name from region"),
    "enumerate": (
        "select nations@n[order by n.n_name desc][enumerate]@x[*].{i: x.index, name: x.value.n_name} from nations@n:Nation",
        "select row_number() over (order by n_name desc) - 1 as i, n_name as name from nation",
    ),
    "rank_by": (
        "select parts.rank_by(|p| p.p_size)@r[*].{id: r.value.p_partkey, rank: r.rank, dense: r.dense_rank} from parts@p:Part",
        "select p_partkey as id, rank() over (order by p_size) as rank, dense_rank() over (order by p_size) as dense from part",
    ),
    "rank_partitioned": (
        "select g@x[*].items().rank_by(|o| desc(o.o_totalprice))@r[*].{id: r.value.o_orderkey, rank: r.rank} from orders@o:Order group by {c: o.o_custkey} into g",
        "select o_orderkey as id, rank() over (partition by o_custkey order by o_totalprice desc) as rank from orders",
    ),
    "skip_take": ("select orders.order_by(|o| (order::desc(o.o_totalprice), o.o_orderkey)).skip(3).take(4).map(|o| {id: o.o_orderkey}) from orders@o:Order", "select o_orderkey as id from orders order by o_totalprice desc, o_orderkey limit 4 offset 3"),
    "reversed_first": ("select orders@o[order by o.o_orderkey].reversed().first().{o_orderkey} from orders@o:Order", "select max(o_orderkey) as o_orderkey from orders"),
    "top_k": ("select orders.top_k(5, |o| o.o_totalprice).map(|o| {id: o.o_orderkey}) from orders@o:Order", "select o_orderkey as id from orders order by o_totalprice desc limit 5"),
    "index_by": (
        "select orders.index_by(|o| o.o_custkey)@e[*].{k: e.key, n: len(e.values)} from orders@o:Order",
        "select o_custkey as k, count(*) as n from orders group by 1",
    ),
    "associate_by": (
        "select nations.associate_by(|n| n.n_nationkey, |n| n.n_name) from nations@n:Nation",
        "select n_nationkey as key, n_name as value from nation",
    ),
    "partition_split": (
        "select { let p = orders.partition(|o| o.o_totalprice > 250000.0); {a: len(p.matched), b: len(p.rest)} } from orders@o:Order",
        "select cast(count(*) filter (o_totalprice > 250000) as integer) as a, cast(count(*) filter (not o_totalprice > 250000) as integer) as b from orders",
    ),
    "filter_map": (
        "select orders.filter_map(|o| if o.o_orderstatus == 'P' { o.o_orderkey }) from orders@o:Order",
        "select o_orderkey as value from orders where o_orderstatus = 'P'",
    ),
    "contains": ("select {a: nations@n[*].n_name.contains('NATION_7'), b: nations.contains_by(|n| n.n_nationkey == 99)} from nations@n:Nation", "select coalesce(bool_or(n_name = 'NATION_7'), false) as a, coalesce(bool_or(n_nationkey = 99), false) as b from nation"),
    # -- sequences
    "fold_sum": (
        "select customers@c[*].{id: c.c_custkey, v: c.places@e[order by e.o_orderkey][*].o_orderkey.fold(0, |a, x| a * 3 % 1000 + x)} from customers@c:Customer " + CUSTOMER_ORDERS,
        "select c_custkey as id, list_reduce(list_prepend(cast(0 as bigint), coalesce(list(o_orderkey order by o_orderkey) filter (o_orderkey is not null), [])), lambda a, x: a * 3 % 1000 + x) as v from customer left join orders on o_custkey = c_custkey group by 1",
    ),
    "scan_running": (
        "select { let s = nations@n[order by n.n_nationkey][*].n_nationkey.scan(0, |a, x| {left: a + x, right: a + x}); {last: s.last(), n: len(s)} } from nations@n:Nation",
        "select cast(sum(n_nationkey) as integer) as last, cast(count(*) as integer) as n from nation",
    ),
    "reduce": ("select {m: nations@n[*].n_nationkey.reduce(|a, x| if a > x { a } else { x })} from nations@n:Nation", "select max(n_nationkey) as m from nation"),
    "flatten_depth2": (
        "select orders@o[*].{k: [[o.o_orderkey, o.o_custkey], [o.o_orderkey]]}@r[*].k[***] from orders@o:Order",
        "select o_orderkey as value from orders union all select o_custkey from orders union all select o_orderkey from orders",
    ),
    "comprehension": (
        "select parts@p[*].{id: p.p_partkey, n: [x * 2 for x in [p.p_size, 1, 7] if x > 5].sum()} from parts@p:Part",
        "select p_partkey as id, (case when p_size > 5 then p_size * 2 else 0 end) + 14 as n from part",
    ),
    "array_selectors": (
        "select parts@p[*].{id: p.p_partkey, a: [3, p.p_size, 9]@x[where x > 4][order by x desc][0], b: [1, 1, p.p_size][distinct].len(), c: [5, 6, 7][1..].sum()} from parts@p:Part",
        "select p_partkey as id, greatest(9, p_size) as a, case when p_size = 1 then 1 else 2 end as b, 13 as c from part",
    ),
    # -- statistics, time, math, text, decimal
    "stats_variance_stddev": (
        "select {v: orders@o[*].o_totalprice.variance().round(2), s: orders@o[*].o_totalprice.stddev().round(4)} from orders@o:Order",
        "select round(var_samp(o_totalprice), 2) as v, round(stddev_samp(o_totalprice), 4) as s from orders",
    ),
    "stats_median_quantile": (
        "select {m: orders@o[*].o_totalprice.median(), q: orders@o[*].o_totalprice.quantile(0.9).round(4)} from orders@o:Order",
        "select median(o_totalprice) as m, round(quantile_cont(o_totalprice, 0.9), 4) as q from orders",
    ),
    "stats_correlation": (
        "select {c: lines.correlation(|l| l.l_quantity, |l| l.l_extendedprice).round(6), v: lines.covariance(|l| l.l_quantity, |l| l.l_extendedprice).round(2)} from lines@l:Lineitem",
        "select round(corr(l_quantity, l_extendedprice), 6) as c, round(covar_samp(l_quantity, l_extendedprice), 2) as v from lineitem",
    ),
    "stats_regression": (
        "select { let r = lines.linear_regression(|l| l.l_quantity, |l| l.l_extendedprice); {slope: r.slope.round(4), intercept: r.intercept.round(3)} } from lines@l:Lineitem",
        "select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from lineitem",
    ),
    "moving_average": (
        "select { let m = nations@n[order by n.n_nationkey][*].n_nationkey.moving_average(3); {s: m.sum().round(6)} } from nations@n:Nation",
        "select round(sum(m), 6) as s from (select avg(n_nationkey) over (order by n_nationkey rows between 2 preceding and current row) m from nation)",
    ),
    "histogram": (
        "select parts@p[*].p_size.histogram(5) from parts@p:Part",
        "with b as (select min(p_size) lo, max(p_size) hi from part) select cast(least(floor((p_size - lo) / ((hi - lo) / 5.0)), 4) as integer) as cell, count(*) as count from part, b group by 1",
    ),
    "time_truncate": (
        "select events.group_by(|e| {day: time::truncate(e.ts, 'DAY')}).map(|g| {day: g.day, n: g.items().len()}) from events@e:Event",
        "select date_trunc('day', ts) as day, count(*) as n from events group by 1",
    ),
    "time_bucket": (
        "select events.group_by(|e| {t: time::bucket(e.ts, '6h')}).map(|g| {t: g.t, n: g.items().len()}) from events@e:Event",
        "select time_bucket(interval '6 hours', ts) as t, count(*) as n from events group by 1",
    ),
    "math_kernels": (
        "select parts@p[*].{id: p.p_partkey, a: math::abs(p.p_size - 25), b: math::clamp(p.p_size, 10, 20), c: math::sqrt(p.p_retailprice).round(6), d: math::log(p.p_retailprice).round(6), e: math::floor(p.p_retailprice), f: math::sign(p.p_size - 25.0), g: math::max(p.p_size, 30)} from parts@p:Part",
        "select p_partkey as id, abs(p_size - 25) as a, greatest(10, least(p_size, 20)) as b, round(sqrt(p_retailprice), 6) as c, round(ln(p_retailprice), 6) as d, cast(floor(p_retailprice) as bigint) as e, cast(sign(p_size - 25.0) as double) as f, greatest(p_size, 30) as g from part",
    ),
    "text_functions": (
        "select customers@c[*].{id: c.c_custkey, l: c.c_name.lower(), u: c.c_mktsegment.upper(), r: c.c_name.replace('Customer', 'C'), n: len(c.c_name), s: text::starts_with(c.c_mktsegment, 'B'), k: concat(c.c_mktsegment, '-', c.c_custkey), g: c.c_name.slugify()} from customers@c:Customer",
        "select c_custkey as id, lower(c_name) as l, upper(c_mktsegment) as u, replace(c_name, 'Customer', 'C') as r, cast(length(c_name) as integer) as n, starts_with(c_mktsegment, 'B') as s, c_mktsegment || '-' || c_custkey as k, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') as g from customer",
    ),
    "decimal_round": (
        "select orders@o[*].{id: o.o_orderkey, a: o.o_totalprice.round(1, HalfUp), b: decimal(o.o_orderkey, 2)} from orders@o:Order",
        "select o_orderkey as id, round(o_totalprice, 1) as a, cast(o_orderkey / 100.0 as decimal(38,2)) as b from orders",
    ),
    "money_add": (
        "select parts@p[*].{id: p.p_partkey, v: money(p.p_retailprice, currency('EUR')).add(money(1.5, currency('EUR'))).amount().round(2)} from parts@p:Part",
        "select p_partkey as id, round(p_retailprice + 1.5, 2) as v from part",
    ),
    "ranges": (
        "select parts@p[*].{id: p.p_partkey, a: (10..20).contains(p.p_size), b: (p.p_size..30).overlaps(20..25)} from parts@p:Part",
        "select p_partkey as id, p_size >= 10 and p_size < 20 as a, p_size < 25 and 20 < 30 as b from part",
    ),
    "json_field": (
        "select events@e[*].{id: e.event_id, k: json::get(e.props, '$.k') as i64} from events@e:Event",
        "select event_id as id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    ),
}


def _text(text: str) -> Query:
    return lambda spark, sf_dir: Engine.standard(spark, sf_dir).sql(text)


def _per_root(i: int) -> Query:
    """Two independent roots with their own blocks; one result for each."""
    label = ("orders", "parts")[i]
    pick = ("orders@o[*].{id: o.o_orderkey}", "parts@p[*].{id: p.p_partkey}")[i]
    text = f"select {pick} from orders@o:Order, parts@p:Part for orders {{ where o.o_totalprice > 490000.0 order by o.o_orderkey range ..9 }} for parts {{ where p.p_size == 7 }}"
    assert label in text
    return _text(text)


def _closure_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine.standard(spark, sf_dir).sql("select edges.transitive_closure({}) from edges@e:NationNeighbours")


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine.standard(spark, sf_dir).sql("select graph::connected_components(edges) from edges@e:NationNeighbours")


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = df.where("vec_id = 0").select("embedding")
    return search.nearest_vectors(df, "vec_id", "embedding", q, 10).select("id")


def _haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    lon, lat = (F.col("c_custkey") % 360 - 180).cast("double"), (F.col("c_custkey") % 170 - 85).cast("double")
    return c.select(F.col("c_custkey").alias("id"), F.round(geo.haversine(geo.point(lon, lat), geo.point(F.lit(2.35), F.lit(48.86))) / 1000, 3).alias("km"))


def _phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search.phrase(docs, "doc_id", "text", "of the", 0).groupBy("id").agg(F.count("*").alias("n"))


def _full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.full_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "license version idiot", 20).select("id", F.round("score", 6).alias("score"))


def _mutated(table: str, *statements: str) -> Query:
    """A table after some statements, run on snapshots."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine.standard(spark, sf_dir)
        for s in statements:
            engine.query(s)
        return engine.catalog[table].df

    return run


def _pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("_from"), F.col("n_regionkey").alias("_to"))
    return graph.pagerank(edges, 0.85, 5).select("node", F.round("rank", 9).alias("rank"))


def _ran(statement: str) -> Query:
    """What a statement gives back."""
    return lambda spark, sf_dir: Engine.standard(spark, sf_dir).sql(statement)


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of texts and of vectors of the same ids, fused."""
    texts = search.full_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "license version", 50)
    near = search.nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", [1.0] * 64, 50)
    return search.hybrid(texts, near, 20).select("id", F.round("score", 6).alias("score"))


#: Documents with their tokens.
_TOKENED = r"(select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') as t from documents)"


def _bm25(terms: str, limit: int) -> str:
    """(id, score) of the best documents."""
    listed = ", ".join(f"'{t}'" for t in terms.split())
    return f"""
        with d as materialized (select doc_id as id, len(t) as n, list_filter(t, lambda x: x in ({listed})) as t from {_TOKENED}),
        whole as (select count(*) as docs, avg(n) as mean from d), tf as (select id, n, term, count(*) as tf from (select id, n, unnest(t) as term from d) group by all),
        df as (select term, count(*) as df from tf group by 1)
        select id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) as score from tf join df using (term), whole group by id order by score desc, id limit {limit}
    """


_BM25_SQL = f"select id, round(score, 6) as score from ({_bm25('license version idiot', 20)})"
_ONES = "list_transform(range(64), lambda i: cast(1 as double))"
_HYBRID_SQL = f"""
    with t as (select id, row_number() over (order by score desc, id) as r from ({_bm25("license version", 50)})),
    v as (select vec_id as id, row_number() over (order by list_cosine_similarity(cast(embedding as double[]), {_ONES}) desc, vec_id) as r from embeddings qualify r <= 50)
    select id, round(sum(1.0::double / (60 + r)), 6) as score from (select * from t union all select * from v) group by id order by sum(1.0::double / (60 + r)) desc, id limit 20
"""
_PAGERANK_SQL = (
    "with e as (select n_nationkey as f, n_regionkey as t from nation), o as (select f, count(*) as k from e group by f), v as (select f as node from e union select t from e), c as (select count(*) as n from v), r0 as (select node, 1.0::double / n as rank from v, c)"
    + "".join(
        f", r{i} as (select v.node, 0.15::double / c.n + 0.85::double * (coalesce((select sum(r.rank / o.k) from e join r{i - 1} r on r.node = e.f join o on o.f = e.f where e.t = v.node), 0) + coalesce((select sum(rank) from r{i - 1} where node not in (select f from o)), 0) / c.n) as rank from v, c)"
        for i in range(1, 6)
    )
    + " select node, round(rank, 9) as rank from r5"
)
_HAVERSINE_SQL = (
    "select c_custkey as id, round(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(48.86 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.86)) * pow(sin(radians(2.35 - lon) / 2), 2)))) / 1000, 3) as km"
    " from (select c_custkey, cast(c_custkey % 360 - 180 as double) lon, cast(c_custkey % 170 - 85 as double) lat from customer)"
)

#: name: (builder, SQL or None)
BUILDERS: dict[str, tuple[Query, str | None]] = {
    "multi_root_orders": (_per_root(0), "select o_orderkey as id from orders where o_totalprice > 490000 order by o_orderkey limit 9"),
    "multi_root_parts": (_per_root(1), "select p_partkey as id from part where p_size = 7"),
    "transitive_closure": (
        _closure_of_all,
        "with recursive e as (select a.n_nationkey as f, b.n_nationkey as t from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey), r as (select f, t from e union select r.f, e.t from r join e on e.f = r.t) select f as _from, t as _to from r",
    ),
    "connected_components": (_components, "select n_nationkey as node, min(n_nationkey) over (partition by n_regionkey) as component from nation"),
    "pagerank": (_pagerank, _PAGERANK_SQL),
    "vector_knn": (
        _knn,
        "select vec_id as id from embeddings e, (select embedding q from embeddings where vec_id = 0) order by list_cosine_similarity(cast(e.embedding as double[]), cast(q as double[])) desc, vec_id limit 10",
    ),
    "haversine": (_haversine, _HAVERSINE_SQL),
    "phrase_search": (
        _phrase,
        f"select doc_id as id, cast(len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' and t[i + 1] = 'the')) as bigint) as n from {_TOKENED} where n > 0",
    ),
    "full_text_search": (_full_text, _BM25_SQL),
    "phrase_slop_search": (
        lambda spark, sf_dir: search.phrase(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "the of", 2).groupBy("id").agg(F.count("*").alias("n")),
        f"select doc_id as id, cast(len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'the' and list_contains(t[i + 1:i + 3], 'of'))) as bigint) as n from {_TOKENED} where n > 0",
    ),
    "hybrid_search": (_hybrid, _HYBRID_SQL),
    "update_patch": (
        _mutated("Customer", "update c@c:Customer { c_mktsegment: 'PATCHED', c_acctbal: 0.0 } where c.c_nationkey == 3"),
        "select c_custkey, c_name, c_nationkey, case when c_nationkey = 3 then 0.0 else c_acctbal end as c_acctbal, case when c_nationkey = 3 then 'PATCHED' else c_mktsegment end as c_mktsegment from customer",
    ),
    "update_minus": (
        _mutated("Customer", "update c@c:Customer set { c.c_acctbal -= 10.5 } where c.c_acctbal > 0.0"),
        "select c_custkey, c_name, c_nationkey, case when c_acctbal > 0 then c_acctbal - 10.5 else c_acctbal end as c_acctbal, c_mktsegment from customer",
    ),
    "update_counts": (_ran("update c@c:Customer set { c.c_acctbal = 1.0 } where c.c_nationkey == 5"), "select count(*) as value from customer where c_nationkey = 5"),
    "delete_counts": (_ran("delete c@c:Customer where c.c_acctbal < 0.0"), "select count(*) as value from customer where c_acctbal < 0"),
    "create_default_result": (_ran("create r@r:Region [{r_regionkey: 70, r_name: 'A'}, {r_regionkey: 71}]"), "select * from (values (70, 'A'), (71, null)) v(r_regionkey, r_name)"),
    "upsert_merge_none": (
        _mutated("Nation", "upsert n@n:Nation [{n_nationkey: 3, n_name: None}] on conflict (n_nationkey) merge"),
        "select n_nationkey, case when n_nationkey = 3 then null else n_name end as n_name, n_regionkey from nation",
    ),
    "link_on_condition": (
        _mutated("NationNeighbours", "link (a@a:Nation)->[e@e:NationNeighbours {}]->(b@b:Nation where b.n_nationkey == a.n_nationkey + 1)"),
        "select a.n_nationkey as _from, b.n_nationkey as _to from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey union all select n_nationkey, n_nationkey + 1 from nation where n_nationkey + 1 in (select n_nationkey from nation)",
    ),
    "create_rows": (_mutated("Region", "create r@r:Region [{r_regionkey: 90, r_name: 'NEW'}, {r_regionkey: 91, r_name: 'NEWER'}]"), "select r_regionkey, r_name from region union all values (90, 'NEW'), (91, 'NEWER')"),
    "upsert_merge": (
        _mutated("Nation", "upsert n@n:Nation [{n_nationkey: 3, n_name: 'CHANGED'}, {n_nationkey: 77, n_name: 'ADDED', n_regionkey: 1}] on conflict (n_nationkey) merge"),
        "select n_nationkey, case when n_nationkey = 3 then 'CHANGED' else n_name end as n_name, n_regionkey from nation union all values (77, 'ADDED', 1)",
    ),
    "upsert_replace": (
        _mutated("Region", "upsert r@r:Region {r_regionkey: 2, r_name: 'TWO'} on conflict (r_regionkey) replace"),
        "select r_regionkey, case when r_regionkey = 2 then 'TWO' else r_name end as r_name from region",
    ),
    "upsert_ignore": (
        _mutated("Region", "upsert r@r:Region [{r_regionkey: 2, r_name: 'TWO'}, {r_regionkey: 50, r_name: 'FIFTY'}] on conflict (r_regionkey) ignore"),
        "select r_regionkey, r_name from region union all values (50, 'FIFTY')",
    ),
    "update_set": (
        _mutated("Customer", "update c@c:Customer set { c.c_acctbal += 100.0; c.c_mktsegment = 'X' } where c.c_nationkey == 5"),
        "select c_custkey, c_name, c_nationkey, case when c_nationkey = 5 then c_acctbal + 100 else c_acctbal end as c_acctbal, case when c_nationkey = 5 then 'X' else c_mktsegment end as c_mktsegment from customer",
    ),
    "delete_where": (_mutated("Customer", "delete c@c:Customer where c.c_acctbal < 0.0"), "select * from customer where not c_acctbal < 0"),
    "link_rows": (
        _mutated("NationNeighbours", "link (a@a:Nation where a.n_nationkey == 1)->[e@e:NationNeighbours {}]->(b@b:Nation where b.n_regionkey == 4)"),
        "select a.n_nationkey as _from, b.n_nationkey as _to from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey union all select 1, n_nationkey from nation where n_regionkey = 4",
    ),
    "unlink_rows": (
        _mutated("NationNeighbours", "unlink (a@a:Nation where a.n_nationkey < 5)->[e@e:NationNeighbours]->(b@b:Nation)"),
        "select a.n_nationkey as _from, b.n_nationkey as _to from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey where a.n_nationkey >= 5",
    ),
}

TEXTS |= family_queries.TEXTS
#: The ranking alone.
TEXTS["search_method"] = (TEXTS["search_method"][0], f"select id from ({_BM25_SQL})")
QUERIES: dict[str, Query] = {n: _text(t) for n, (t, _) in TEXTS.items()} | {n: q for n, (q, _) in BUILDERS.items()}
ORACLE_SQL: dict[str, str] = {n: s for n, (_, s) in TEXTS.items()} | {n: s for n, (_, s) in BUILDERS.items() if s}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["order_range"](spark, sf_dir)
