"""Queries by family of functions, each over a whole table, with the SQL that
must agree: numbers, text, time, money, maps, sets, sequences, sorted arrays,
geometry, trees, graphs, search, and the methods of collections."""

from __future__ import annotations

_TREE = "customers@c[*].{id: c.c_custkey, parent: if c.c_custkey > 1 { c.c_custkey / 2 }}"
_EDGES = "customers@c[where c.c_custkey > 1][*].{_from: c.c_custkey, _to: c.c_custkey / 2, w: c.c_custkey % 7 + 1}"
_C = " from customers@c:Customer"
_UP = "with recursive t as (select c_custkey as id, case when c_custkey > 1 then c_custkey // 2 end as parent from customer)"
_BITS = "cast(floor(log2({0})) as integer)"
_TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_VECTOR = "[" + ", ".join(f"{(i * 7 % 11 - 5) / 4}" for i in range(64)) + "]"

#: name: (query text, SQL)
TEXTS: dict[str, tuple[str, str]] = {
    "math_functions": (
        "select parts@p[*].{id: p.p_partkey, a: math::pow(p.p_size, 2), b: math::log2(p.p_retailprice).round(6), c: math::log10(p.p_retailprice).round(6), d: math::exp(p.p_size / 10.0).round(4), e: math::sin(p.p_retailprice).round(6), f: math::cos(p.p_retailprice).round(6), g: math::tan(p.p_size / 100.0).round(6), h: math::ceil(p.p_retailprice), i: math::is_nan(p.p_retailprice), j: math::is_finite(p.p_retailprice), k: math::round(p.p_retailprice)} from parts@p:Part",
        "select p_partkey as id, pow(p_size, 2) as a, round(log2(p_retailprice), 6) as b, round(log10(p_retailprice), 6) as c, round(exp(p_size / 10.0), 4) as d, round(sin(p_retailprice), 6) as e, round(cos(p_retailprice), 6) as f, round(tan(p_size / 100.0), 6) as g, cast(ceil(p_retailprice) as bigint) as h, isnan(p_retailprice) as i, isfinite(p_retailprice) as j, round(p_retailprice) as k from part",
    ),
    "math_methods": (
        "select parts@p[*].{id: p.p_partkey, a: (p.p_size - 25).abs(), b: p.p_size.min(30), c: p.p_size.max(30), d: p.p_size.clamp(10, 20), e: p.p_size.pow(2), f: p.p_retailprice.sqrt().round(6), g: (p.p_size - 25.0).sign(), h: !(p.p_size > 25), i: p.p_size >> 2} from parts@p:Part",
        "select p_partkey as id, abs(p_size - 25) as a, least(p_size, 30) as b, greatest(p_size, 30) as c, greatest(10, least(p_size, 20)) as d, pow(p_size, 2) as e, round(sqrt(p_retailprice), 6) as f, cast(sign(p_size - 25.0) as double) as g, not p_size > 25 as h, p_size >> 2 as i from part",
    ),
    "text_library": (
        "select customers@c[*].{id: c.c_custkey, a: concat('  ', c.c_name, ' ').trim(), b: c.c_name.to_upper(), d: text::normalize(concat(' ', c.c_name, '   X ')), e: len(text::tokens(c.c_name)), f: text::ngrams(c.c_name, 2).len(), g: text::contains(c.c_name, '00'), h: text::ends_with(c.c_name, '7'), i: text::regex_match('0+1', c.c_name), j: text::regex_match(regex::email(), concat('a', c.c_custkey, '@x.org')), k: c.c_mktsegment.ends_with('Y')} from customers@c:Customer",
        f"select c_custkey as id, c_name as a, upper(c_name) as b, lower(c_name) || ' x' as d, cast(len({_TOKENS.format('c_name')}) as integer) as e, cast(greatest(len({_TOKENS.format('c_name')}) - 1, 0) as integer) as f, contains(c_name, '00') as g, ends_with(c_name, '7') as h, regexp_matches(c_name, '0+1') as i, true as j, ends_with(c_mktsegment, 'Y') as k from customer",
    ),
    "time_library": (
        "select events@e[*].{id: e.event_id, a: time::date(2024, 1, 5) as str, b: time::datetime('2024-01-05 06:07:08') as str, c: time::format(e.ts, 'yyyy-MM-dd HH:mm'), d: time::format(e.ts + time::duration('PT1H30M'), 'HH:mm:ss'), f: time::duration_seconds(90).total_seconds(), g: time::duration_parse('2h').total_seconds(), h: time::format(time::timezone(e.ts, 'Asia/Tokyo'), 'yyyy-MM-dd HH:mm'), i: time::now() > e.ts, j: time::format(e.ts - time::duration('3w'), 'yyyy-MM-dd'), k: time::datetime_parse('2024-02-29 00:00:00') as str} from events@e:Event",
        "select event_id as id, '2024-01-05' as a, '2024-01-05 06:07:08' as b, strftime(ts, '%Y-%m-%d %H:%M') as c, strftime(ts + interval '90 minutes', '%H:%M:%S') as d, cast(90 as double) as f, cast(7200 as double) as g, strftime(ts + interval '9 hours', '%Y-%m-%d %H:%M') as h, true as i, strftime(ts - interval '21 days', '%Y-%m-%d') as j, '2024-02-29 00:00:00' as k from events",
    ),
    "rounding_modes": (
        "select parts@p[*].{id: p.p_partkey, a: decimal(p.p_partkey, 2).round(1, HalfEven) as f64, b: decimal(p.p_partkey, 2).round(1, HalfUp) as f64, c: decimal(p.p_partkey, 2).round(1, Floor) as f64, d: decimal(p.p_partkey, 2).round(1, Ceil) as f64, e: decimal(-p.p_partkey, 2).round(1, Down) as f64, f: decimal(-p.p_partkey, 2).round(1, Up) as f64, g: decimal_parse(p.p_partkey as str, 3) as f64} from parts@p:Part",
        "select p_partkey as id, cast(case when p_partkey % 10 < 5 or (p_partkey % 10 = 5 and p_partkey // 10 % 2 = 0) then p_partkey // 10 else p_partkey // 10 + 1 end / 10.0 as double) as a, cast((p_partkey + 5) // 10 / 10.0 as double) as b, cast(p_partkey // 10 / 10.0 as double) as c, cast((p_partkey + 9) // 10 / 10.0 as double) as d, cast(-(p_partkey // 10) / 10.0 as double) as e, cast(-((p_partkey + 9) // 10) / 10.0 as double) as f, cast(p_partkey as double) as g from part",
    ),
    "decimal_parse_round": (
        "select orders@o[*].{id: o.o_orderkey, a: decimal_parse(o.o_totalprice as str, 4).round(1, HalfEven) as f64} from orders@o:Order",
        "with c as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as n from orders) select o_orderkey as id, cast(case when n % 10 < 5 or (n % 10 = 5 and n // 10 % 2 = 0) then n // 10 else n // 10 + 1 end / 10.0 as double) as a from c",
    ),
    "money_library": (
        "select parts.map(|p| { let m = money(p.p_retailprice, currency('EUR')); let u = m.convert(exchange_rate('EUR', 'USD', 1.25), 2, HalfUp); {id: p.p_partkey, a: m.round(0, HalfUp).amount(), b: m.currency(), c: u.currency(), d: u.amount().round(1)} }) from parts@p:Part",
        "select p_partkey as id, round(p_retailprice) as a, 'EUR' as b, 'USD' as c, round(round(p_retailprice * 1.25, 2), 1) as d from part",
    ),
    "lookups": (
        "select parts.map(|p| { let m = [p.p_size, 7, 9].index_by(|x| x % 3); {id: p.p_partkey, a: m.len(), b: m.is_empty(), c: m.entries().len(), d: m.keys().len(), e: m.values().flatten().sum(), f: m.get(1).sum(), g: m.get_many(5).len(), h: m.contains_key(2), i: m.map_values(|v| v.len()).get(0), j: m.into_array().len()} }) from parts@p:Part",
        "select p_partkey as id, n as a, false as b, n as c, n as d, p_size + 16 as e, case when p_size % 3 = 1 then p_size + 7 else 7 end as f, 0 as g, p_size % 3 = 2 as h, case when p_size % 3 = 0 then 2 else 1 end as i, n as j from (select *, case when p_size % 3 = 2 then 3 else 2 end as n from part)",
    ),
    "maps": (
        "select parts.map(|p| { let m = [p.p_size, p.p_size + 100].associate_by(|x| x, |x| x * 2); {id: p.p_partkey, a: m.len(), b: m.is_empty(), c: m.contains_key(7), d: m.get(7), e: m.get_or(7, -1), f: m.with(7, 1).len(), g: m.without(p.p_size).len(), h: m.keys().sum(), i: m.values().sum(), j: m.entries().len(), k: m.map_values(|v| v + 1).values().sum(), l: m.filter_entries(|k, v| k > 50).len(), m: m.merge(m, |a, b| a + b).values().sum(), n: m.to_array().len(), o: m.range(0..50).len(), q: m.lower_bound(50).key, r: m.upper_bound(p.p_size).value} }) from parts@p:Part",
        "select p_partkey as id, 2 as a, false as b, p_size = 7 as c, case when p_size = 7 then 14 end as d, case when p_size = 7 then 14 else -1 end as e, case when p_size = 7 then 2 else 3 end as f, 1 as g, 2 * p_size + 100 as h, 4 * p_size + 200 as i, 2 as j, 4 * p_size + 202 as k, 1 + (p_size > 50)::int as l, 8 * p_size + 400 as m, 2 as n, (p_size < 50)::int as o, case when p_size >= 50 then p_size else p_size + 100 end as q, 2 * p_size + 200 as r from part",
    ),
    "sets": (
        "select parts.map(|p| { let s = [p.p_size, 3, 3].to_hash_set(); let t = [3, 60, p.p_size + 1].to_btree_set(); {id: p.p_partkey, a: s.len(), b: s.is_empty(), c: s.contains(7), d: s.with(99).len(), e: s.without(3).len(), f: s.union(t).len(), g: s.intersect(t).len(), h: s.except(t).len(), i: s.symmetric_difference(t).len(), j: s.is_subset([p.p_size, 3, 8]), k: s.is_superset([3]), l: t.first(), m: t.last(), n: s.to_array().sum()} }) from parts@p:Part",
        "with b as (select p_partkey as id, p_size as z, list_distinct([p_size, 3]) as s, list_distinct([3, 60, p_size + 1]) as t from part), c as (select *, len(list_intersect(s, t)) as shared from b) select id, cast(len(s) as integer) as a, false as b, z = 7 as c, cast(len(s) + 1 as integer) as d, cast(len(s) - 1 as integer) as e, cast(len(s) + len(t) - shared as integer) as f, cast(shared as integer) as g, cast(len(s) - shared as integer) as h, cast(len(s) + len(t) - 2 * shared as integer) as i, true as j, true as k, list_min(t) as l, list_max(t) as m, cast(list_sum(s) as integer) as n from c",
    ),
    "deques": (
        "select parts.map(|p| { let d = [p.p_size, 5].push_front(1).push_back(9); {id: p.p_partkey, a: d.len(), b: d.is_empty(), c: d.front(), d: d.back(), e: d.pop_front().value, f: d.pop_front().rest.sum(), g: d.pop_back().value, h: d.pop_back().rest.sum(), i: d.to_array().sum()} }) from parts@p:Part",
        "select p_partkey as id, 4 as a, false as b, 1 as c, 9 as d, 1 as e, p_size + 14 as f, 9 as g, p_size + 6 as h, p_size + 15 as i from part",
    ),
    "heaps": (
        "select parts.map(|p| { let h = [p.p_size, 5].push(20); {id: p.p_partkey, a: h.len(), b: h.is_empty(), c: h.peek(), d: h.pop().value, e: h.pop().rest.sum(), f: h.into_sorted_array().first(), g: h.top_k(2).sum()} }) from parts@p:Part",
        "select p_partkey as id, 3 as a, false as b, greatest(p_size, 20) as c, greatest(p_size, 20) as d, p_size + 25 - greatest(p_size, 20) as e, least(p_size, 5) as f, p_size + 25 - least(p_size, 5) as g from part",
    ),
    "sorted_arrays": (
        "select parts.map(|p| { let s = [2, 10, 10, 30, 45]; {id: p.p_partkey, a: algo::binary_search(s, p.p_size), b: algo::lower_bound(s, p.p_size), c: algo::upper_bound(s, p.p_size), d: algo::equal_range(s, 10).start, e: s.equal_range(10).end, f: s.partition_point(|x| x < p.p_size), g: algo::top_k(s, 2).sum(), h: s.binary_search_by(|x| x * 2, p.p_size * 2), i: s.lower_bound(p.p_size), j: s.top_k(2, |x| 0 - x).sum()} }) from parts@p:Part",
        "with b as (select p_partkey as id, p_size as z, [2, 10, 10, 30, 45] as s from part) select id, list_position(s, z) - 1 as a, cast(len(list_filter(s, lambda x: x < z)) as integer) as b, cast(len(list_filter(s, lambda x: x <= z)) as integer) as c, 1 as d, 3 as e, cast(len(list_filter(s, lambda x: x < z)) as integer) as f, 75 as g, list_position(s, z) - 1 as h, cast(len(list_filter(s, lambda x: x < z)) as integer) as i, 12 as j from b",
    ),
    "array_statistics": (
        "select parts.map(|p| { let s = [p.p_size, 4, 10, 20]; {id: p.p_partkey, a: s.variance().round(6), b: s.stddev().round(6), c: s.median(), d: s.quantile(0.25), e: s.moving_average(2).sum().round(6), f: s.histogram(3)@h[*].count.sum(), g: s.mean().round(6), h: [5, 5].histogram(4)@h[*].cell.max(), i: s.min(), j: s.max()} }) from parts@p:Part",
        "with b as (select p_partkey as id, p_size as z, [p_size, 4, 10, 20] as s from part) select id, round(list_aggregate(s, 'var_samp'), 6) as a, round(list_aggregate(s, 'stddev_samp'), 6) as b, list_aggregate(s, 'median') as c, list_aggregate(s, 'quantile_cont', 0.25) as d, round(z + (z + 4) / 2.0 + 7 + 15, 6) as e, cast(4 as bigint) as f, round((z + 34) / 4.0, 6) as g, 0 as h, least(z, 4) as i, greatest(z, 20) as j from b",
    ),
    "array_methods": (
        "select parts.map(|p| { let s = [p.p_size, 4, 10, 4]; {id: p.p_partkey, a: s.map_indexed(|x, i| x * i).sum(), b: s.at(1), c: s.get(9), d: s.last(), e: s.order_by_desc(|x| x).first(), f: s.order_by_asc(|x| x).first(), g: [s, [1]].flatten().len(), h: s.flat_map(|x| [x, x]).len(), i: s.slice(1..3).sum(), j: s.range(1..=3).sum(), k: s.reversed().first(), l: s.distinct_by(|x| x % 2).len(), m: [None, 3].compact().len(), n: [7].expect_one(), o: s.filter(|x| x > 4).len(), q: [1; 3].sum(), r: (p.p_size, 'x').0, t: s.rank_by(|x| x)@r[*].rank.max()} }) from parts@p:Part",
        "with b as (select p_partkey as id, p_size as z, [p_size, 4, 10, 4] as s from part) select id, 4 + 20 + 12 as a, 4 as b, cast(null as integer) as c, 4 as d, greatest(z, 10) as e, least(z, 4) as f, 5 as g, 8 as h, 14 as i, 18 as j, 4 as k, cast(len(list_distinct([z % 2, 0])) as integer) as l, 1 as m, 7 as n, cast(len(list_filter(s, lambda x: x > 4)) as integer) as o, 3 as q, z as r, cast(len(list_filter(s, lambda x: x < list_max(s))) + 1 as integer) as t from b",
    ),
    "geo_shapes": (
        "select parts.map(|p| { let r = [geo::point(0, 0), geo::point(p.p_size, 0), geo::point(p.p_size, 4), geo::point(0, 4)]; let b = r.bounding_box(); {id: p.p_partkey, a: geo::area(r), b: geo::centroid(r).lon, c: geo::length(r), d: geo::distance(geo::point(0, 0), geo::point(3, p.p_size)).round(6), e: geo::contains(r, geo::point(10.5, 2)), f: geo::within(geo::point(2.5, 2), r), g: b.east, h: b.intersects(geo::bbox(10, 0, 20, 3)), i: b.overlaps(geo::bbox(10, 0, 20, 3)), j: b.touches(geo::bbox(10, 0, 20, 3)), k: geo::covering_cells(b, 2.0).len(), l: geo::tile_bounds(1, 0, 0).north.round(4), m: geo::simplify(r, 100.0).len(), n: geo::transform(geo::point(p.p_size, 0), 'EPSG:3857').lon.round(3)} }) from parts@p:Part",
        "select p_partkey as id, cast(4 * p_size as double) as a, p_size / 2.0 as b, cast(2 * p_size + 4 as double) as c, round(sqrt(9 + p_size * p_size), 6) as d, p_size > 10.5 as e, p_size > 2.5 as f, cast(p_size as double) as g, p_size >= 10 as h, p_size > 10 as i, p_size = 10 as j, cast((p_size // 2 + 1) * 3 as integer) as k, cast(85.0511 as double) as l, 2 as m, round(radians(cast(p_size as double)) * 6378137.0, 3) as n from part",
    ),
    "geo_within_radius": (
        "select geo::within_radius(customers@c[*].{id: c.c_custkey, lon: (c.c_custkey % 360 - 180) as f64, lat: (c.c_custkey % 170 - 85) as f64}, {x: 2.35, y: 48.86, radius: 6000000.0}).map(|r| {id: r.id, km: (r.distance / 1000).round(3)}) from customers@c:Customer",
        "select id, round(d / 1000, 3) as km from (select c_custkey as id, 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(48.86 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.86)) * pow(sin(radians(2.35 - lon) / 2), 2)))) as d from (select c_custkey, cast(c_custkey % 360 - 180 as double) lon, cast(c_custkey % 170 - 85 as double) lat from customer)) where d <= 6000000",
    ),
    "geo_nearest": (
        "select geo::nearest(customers@c[*].{id: c.c_custkey, lon: (c.c_custkey % 360 - 180) as f64, lat: (c.c_custkey % 170 - 85) as f64}, {x: 2.35, y: 48.86, k: 1}).map(|r| {km: (r.distance / 1000).round(3)}) from customers@c:Customer",
        "select round(min(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(48.86 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.86)) * pow(sin(radians(2.35 - lon) / 2), 2))))) / 1000, 3) as km from (select cast(c_custkey % 360 - 180 as double) lon, cast(c_custkey % 170 - 85 as double) lat from customer)",
    ),
    # -- trees: the heap of customers, whose parent is half of their number
    "tree_children": (f"select tree::children({_TREE}, 5){_C}", "select c_custkey as id from customer where c_custkey // 2 = 5"),
    "tree_parent": (f"select tree::parent({_TREE}, 77){_C}", "select cast(38 as bigint) as id"),
    "tree_ancestors": (f"select tree::ancestors({_TREE}, 99){_C}", f"{_UP}, u as (select parent as id, 1 as level from t where id = 99 union all select t.parent, u.level + 1 from u join t on t.id = u.id where t.parent is not null) select id, level from u"),
    "tree_descendants": (f"select tree::descendants({_TREE}, 3){_C}", f"select c_custkey as id, {_BITS.format('c_custkey')} - 1 as level from customer where c_custkey > 3 and c_custkey // cast(pow(2, {_BITS.format('c_custkey')} - 1) as bigint) = 3"),
    "tree_depth": (f"select tree::depth({_TREE}, 100){_C}", "select 6 as depth"),
    "tree_path_to_root": (f"select tree::path_to_root({_TREE}, 100).map(|r| {{n: r.path.len(), s: r.path.sum()}}){_C}", "select 7 as n, cast(100 + 50 + 25 + 12 + 6 + 3 + 1 as bigint) as s"),
    "tree_lowest_common_ancestor": (f"select tree::lowest_common_ancestor({_TREE}, {{a: 100, b: 55}}){_C}", "select cast(6 as bigint) as id"),
    "tree_preorder": (f"select tree::preorder({_TREE}, 1)[enumerate]@x[*].{{i: x.index, id: x.value.id}}{_C}", f"{_UP}, w as (select id, [id] as path from t where id = 1 union all select t.id, list_append(w.path, t.id) from t join w on t.parent = w.id) select row_number() over (order by path) - 1 as i, id from w"),
    "tree_postorder": (f"select tree::postorder({_TREE}, 1).map(|r| {{id: r.id, level: r.level}}){_C}", f"select c_custkey as id, {_BITS.format('c_custkey')} as level from customer where c_custkey > 0"),
    "tree_level_order": (f"select tree::level_order({_TREE}, 1)[enumerate]@x[*].{{i: x.index, id: x.value.id}}{_C}", "select c_custkey - 1 as i, c_custkey as id from customer where c_custkey > 0"),
    # -- graphs: the same heap as edges to the parent
    "graph_neighbors": (f"select graph::neighbors({_EDGES}, 10){_C}", "select unnest([5, 20, 21])::bigint as node"),
    "graph_out_edges": (f"select graph::out_edges({_EDGES}, 10).map(|e| {{t: e._to}}){_C}", "select cast(5 as bigint) as t"),
    "graph_in_edges": (f"select graph::in_edges({_EDGES}, 10).map(|e| {{f: e._from}}){_C}", "select unnest([20, 21])::bigint as f"),
    "graph_traverse": (f"select graph::traverse({_EDGES}, {{from: 100, lo: 1, hi: 3}}){_C}", "select * from (values (50::bigint, 1), (25, 2), (12, 3)) v(node, hops)"),
    "graph_shortest_path": (
        f"select graph::shortest_path({_EDGES}, {{source: 100, weight: 'w'}}){_C}",
        "with recursive p as (select cast(100 as bigint) as node, cast(0 as double) as distance union all select node // 2, distance + node % 7 + 1 from p where node > 1) select node, distance from p",
    ),
    "graph_scc": (
        "select graph::strongly_connected_components(edges) from edges@e:NationNeighbours",
        "select n_nationkey as node, min(n_nationkey) over (partition by n_regionkey) as component from nation",
    ),
    "graph_components_of_customers": (
        "select graph::connected_components(orders@o[*].{_from: o.o_custkey, _to: o.o_custkey + 7}).map(|r| {node: r.node, component: r.component}) from orders@o:Order",
        "with recursive e as (select distinct o_custkey as a from orders), n as (select a as node, exists (select 1 from e f where f.a = e.a - 7) as down from e union select a + 7, true from e), s as (select node, down, case when down then 0 else 1 end as root from n) select node, max(case when root = 1 then node end) over (partition by node % 7 order by node) as component from s",
    ),
    "graph_topological_sort": (f"select graph::topological_sort({_EDGES}){_C}", "with n as (select max(c_custkey) as top from customer) select c_custkey as node, cast(floor(log2(top / c_custkey)) as integer) as level from customer, n where c_custkey > 0"),
    # -- search
    "search_text": ("select search::text(docs, {column: 'text', text: 'license version'}).map(|d| {id: d.doc_id}) from docs@d:Document", f"select doc_id as id from documents where list_contains({_TOKENS.format('text')}, 'license') and list_contains({_TOKENS.format('text')}, 'version')"),
    "search_prefix": ("select search::prefix(customers, {column: 'c_mktsegment', prefix: 'BU'}).map(|c| {id: c.c_custkey}) from customers@c:Customer", "select c_custkey as id from customer where starts_with(c_mktsegment, 'BU')"),
    "search_regex": ("select search::regex(customers, {column: 'c_name', pattern: '[37]$'}).map(|c| {id: c.c_custkey}) from customers@c:Customer", "select c_custkey as id from customer where regexp_matches(c_name, '[37]$')"),
    "search_vector": (
        f"select search::vector(items, {{id: 'vec_id', embedding: {_VECTOR}, k: 15}}).map(|r| {{id: r.id, score: r.score.round(5)}}) from items@e:Embedding",
        f"select vec_id as id, round(list_cosine_similarity(cast(embedding as double[]), cast({_VECTOR} as double[])), 5) as score from embeddings order by list_cosine_similarity(cast(embedding as double[]), cast({_VECTOR} as double[])) desc, vec_id limit 15",
    ),
    # -- collections of rows
    "row_methods": (
        "select {a: orders[order by o.o_orderkey].at(3).o_orderkey, b: orders[order by o.o_orderkey].last().o_orderkey, c: orders[order by o.o_orderkey].get(2).o_orderkey, d: orders.order_by_desc(|o| o.o_orderkey).first().o_orderkey, e: orders.order_by_asc(|o| o.o_orderkey).first().o_orderkey, f: orders.filter(|o| o.o_orderkey > 10).len(), g: len(orders.flat_map(|o| [o.o_orderkey, o.o_custkey])), h: orders[where o.o_orderkey == 5].expect_one().o_custkey} from orders@o:Order".replace("orders[", "orders@o["),
        "with r as (select o_orderkey as k, row_number() over (order by o_orderkey) - 1 as i from orders) select max(k) filter (i = 3) as a, max(k) as b, max(k) filter (i = 2) as c, max(k) as d, min(k) as e, count(*) filter (k > 10) as f, 2 * count(*) as g, (select o_custkey from orders where o_orderkey = 5) as h from r",
    ),
    "map_indexed_rows": ("select orders@o[order by o.o_orderkey].map_indexed(|o, i| {i: i, id: o.o_orderkey}) from orders@o:Order", "select row_number() over (order by o_orderkey) - 1 as i, o_orderkey as id from orders"),
    "enumerate_orders": ("select orders@o[order by o.o_totalprice desc, o.o_orderkey][enumerate]@x[*].{i: x.index, id: x.value.o_orderkey} from orders@o:Order", "select row_number() over (order by o_totalprice desc, o_orderkey) - 1 as i, o_orderkey as id from orders"),
    "moving_average_orders": (
        "select { let m = orders@o[order by o.o_orderkey][*].o_totalprice.moving_average(7); {s: m.sum().round(2), n: m.len()} } from orders@o:Order",
        "select round(sum(m), 2) as s, count(*) as n from (select avg(o_totalprice) over (order by o_orderkey rows between 6 preceding and current row) m from orders)",
    ),
    "slice_from_end": ("select orders@o[order by o.o_orderkey][-5..][*].{id: o.o_orderkey} from orders@o:Order", "select o_orderkey as id from orders order by o_orderkey desc limit 5"),
    "range_of_count": ("select orders@o[*].{id: o.o_orderkey} from orders@o:Order, regions@r:Region for orders { order by o.o_orderkey range ..len(regions) }", "select o_orderkey as id from orders order by o_orderkey limit 5"),
    "partition_rows": (
        "select { let p = orders.partition(|o| o.o_totalprice > 250000.0); {a: p.matched.len(), b: p.rest.len(), c: p.rest@r[*].o_orderkey.max()} } from orders@o:Order",
        "select count(*) filter (o_totalprice > 250000) as a, count(*) filter (not o_totalprice > 250000) as b, max(o_orderkey) filter (not o_totalprice > 250000) as c from orders",
    ),
    "histogram_orders": (
        "select orders@o[*].o_totalprice.histogram(10) from orders@o:Order",
        "with b as (select min(o_totalprice) lo, max(o_totalprice) hi from orders) select cast(least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9) as integer) as cell, count(*) as count from orders, b group by 1",
    ),
    "key_by_rows": ("select nations.key_by(|n| n.n_nationkey).map(|e| {k: e.key, v: e.value.n_name}) from nations@n:Nation", "select n_nationkey as k, n_name as v from nation"),
    "rank_rows": ("select orders@o[*].o_totalprice.rank()@r[*].{v: r.value, rank: r.rank} from orders@o:Order", "select o_totalprice as v, rank() over (order by o_totalprice) as rank from orders"),
    "approx_sketches": (
        "select {a: orders@o[*].o_custkey.approx_count_distinct() > 0, b: orders@o[*].o_totalprice.approx_quantile(0.5) > 0.0} from orders@o:Order",
        "select true as a, true as b",
    ),
    "exists_and_type": ("select parts@p[*].{id: p.p_partkey, a: p.p_size is i32, b: p.p_name is str, c: p?.p_size} from parts@p:Part", "select p_partkey as id, true as a, true as b, p_size as c from part"),
    "destructured": ("select parts.map(|{p_partkey, p_size}| {id: p_partkey, s: p_size + 1}) from parts@p:Part", "select p_partkey as id, p_size + 1 as s from part"),
    "conversions": (
        "select parts.map(|p| { let e = [{key: p.p_size, value: 1}, {key: 99, value: 2}]; {id: p.p_partkey, a: e.to_hash_map().len(), b: e.to_btree_map().get(99), c: [3, 1, 3].to_btree_set().first(), d: [3, 1, 3].to_array().len()} }) from parts@p:Part",
        "select p_partkey as id, 2 as a, 2 as b, 1 as c, 4 - 1 as d from part",
    ),
    "exactly_one_row": ("select {a: (orders@o[where o.o_orderkey == 5].exactly_one()).ok.o_custkey} from orders@o:Order", "select o_custkey as a from orders where o_orderkey = 5"),
    "reversed_rows": ("select orders@o[order by o.o_orderkey].reversed()[enumerate]@x[*].{i: x.index, id: x.value.o_orderkey} from orders@o:Order", "select row_number() over (order by o_orderkey desc) - 1 as i, o_orderkey as id from orders"),
    "async_closure": ("select parts.map(async |p| {id: p.p_partkey, n: p.p_size + 1}) from parts@p:Part", "select p_partkey as id, p_size + 1 as n from part"),
    "node_attach": ("select regions@r[*].{id: r.r_regionkey, n: len(r.all)} from regions@r:Region links (regions)->(all@n:Nation)", "select r_regionkey as id, (select count(*) from nation) as n from region"),
    "endless_hops": ("select nations@n[*].{id: n.n_nationkey, k: len(n.near)} from nations@n:Nation links (nations)->[near@e:NationNeighbours hops 1..]->(ends@m:Nation)", "select n_nationkey as id, cast(5 as bigint) as k from nation"),
    "several_groupings": (
        "select {a: len(states), b: len(buyers), c: len(sizes)} from orders@o:Order, parts@p:Part group by {s: o.o_orderstatus} into states, {c: o.o_custkey} into buyers, {z: p.p_size} into sizes",
        "select count(distinct o_orderstatus) as a, count(distinct o_custkey) as b, (select count(distinct p_size) from part) as c from orders",
    ),
    "ascription": ("select parts@p[*].{id: p.p_partkey, a: (p.p_size : f64) / 2} from parts@p:Part", "select p_partkey as id, p_size / 2.0 as a from part"),
    "search_method": ("select docs.search(full_text_query({id: 'doc_id', text: 'license version idiot', limit: 20})).map(|r| {id: r.id}) from docs@d:Document", None),
    "function_items": (
        "fn double(x: i64) -> i64 { x * 2 } const fn taxed(x: f64, rate: f64) -> f64 { let t = x * rate; x + t } select parts@p[*].{id: p.p_partkey, a: double(p.p_size), b: taxed(p.p_retailprice, 0.5).round(4)} from parts@p:Part",
        "select p_partkey as id, p_size * 2 as a, round(p_retailprice * 1.5, 4) as b from part",
    ),
    "fragments": (
        "let spent = (select customers@c[*].{id: c.c_custkey, totals: c.places@e[*].o_totalprice} from customers@c:Customer links (customers)->[places@e:CustomerPlacesOrder]->(orders@o:Order)); select spent@s[*].{id: s.id, n: count(s.totals)} from spent",
        "select c_custkey as id, cast((select count(*) from orders where o_custkey = c_custkey) as integer) as n from customer",
    ),
    "closure_by_steps": (
        "select graph::transitive_closure({seed: nations@n[where n.n_nationkey == 3][*], step: |u| u.near@e[**].ends@m[*], key: |u| u.n_nationkey}).map(|u| {id: u.n_nationkey, name: u.n_name}) from nations@n:Nation links (nations)->[near@e:NationNeighbours]->(ends@m:Nation)",
        "select n_nationkey as id, n_name as name from nation where n_regionkey = (select n_regionkey from nation where n_nationkey = 3)",
    ),
    "open_hops": ("select nations@n[*].{id: n.n_nationkey, k: len(n.near)} from nations@n:Nation links (nations)->[near@e:NationNeighbours hops ..3]->(ends@m:Nation)", "select n_nationkey as id, cast(4 + 16 as bigint) as k from nation"),
    "merged_label": (
        "select customers@c[*].{id: c.c_custkey, n: len(c.all)} from customers@c:Customer links (customers)->[all@e:CustomerPlacesOrder]->(orders@o:Order), (customers)->[all@e2:CustomerPlacesOrder]->(orders2@o2:Order)",
        "select c_custkey as id, (select count(*) from orders where o_custkey = c_custkey) as n from customer",
    ),
    "group_selector": ("select orders@o[group by {s: o.o_orderstatus}]@g[*].{s: g.s, n: len(g.items)} from orders@o:Order", "select o_orderstatus as s, count(*) as n from orders group by 1"),
    "flatten_all_stars": ("select orders@o[*].{k: [[o.o_orderkey, o.o_custkey], [o.o_orderkey]]}@r[*].k[***] from orders@o:Order", "select o_orderkey as value from orders union all select o_custkey from orders union all select o_orderkey from orders"),
}
