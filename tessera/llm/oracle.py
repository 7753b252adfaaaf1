"""SQL of the queries that SQL can express."""

from __future__ import annotations

#: Lower-cased words and distinct five-word shingles of a table's texts.
_SHINGLES = """
    select {id} as id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                            when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
    from (select {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from {table})
"""

ORACLE_SQL: dict[str, str] = {
    "op3_jaccard_join": f"""
        with recursive sets as materialized ({_SHINGLES.format(id="doc_id", table="documents")}),
        rows as materialized (select id, len(s) as n, unnest(s) as x from sets),
        pairs as materialized (select a.id as a, b.id as b from rows a join rows b on a.x = b.x and a.id < b.id group by a.id, b.id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        edges as materialized (select a, b from pairs union select b, a from pairs),
        reach as (select a as id, b as other from edges union select reach.id, edges.b from reach join edges on edges.a = reach.other)
        select sets.id as doc_id, len(sets.s) as n_shingles, least(sets.id, coalesce((select min(other) from reach where reach.id = sets.id), sets.id)) as component_id from sets
    """,
    "op5_decontamination": f"""
        with docs as materialized ({_SHINGLES.format(id="doc_id", table="documents")}), items as materialized ({_SHINGLES.format(id="item_id", table="benchmark")}),
        d as materialized (select id, unnest(s) as x from docs), i as materialized (select id, len(s) as n, unnest(s) as x from items)
        select d.id as doc_id, i.id as item_id, i.n as n_item, count(*) as n_shared, count(*) / i.n as containment
        from d join i using (x) group by d.id, i.id, i.n having count(*) >= 0.8 * i.n
    """,
    "op8_mixing": """
        with d as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
                   md5('17:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as h from documents
        ), sources as (
            select source, sum(size) as n, (row_number() over (order by source is null, source) - 1) % 3 + 1 as w from d group by source
        ), filled as (
            select *, sum(n) over () as total, sum(w) over () as weights, coalesce(sum(3 * n) over lower, 0) as capped, coalesce(sum(w) over lower, 0) as done
            from sources window lower as (order by n / w, source rows between unbounded preceding and 1 preceding)
        ), level as (
            select min_by(total - capped, done) as rest, min_by(weights - done, done) as weights from filled where 3 * n * (weights - done) >= (total - capped) * w
        ), targets as (
            select source, n, case when 3 * n * level.weights < rest * w then cast(3 * n as double) else cast(rest * w as double) / cast(level.weights as double) end as target from sources, level
        ), placed as (
            select d.*, n, target, cast(floor(target) as bigint) as given, coalesce(sum(size) over (partition by d.source order by h rows between unbounded preceding and 1 preceding), 0) as place
            from d join targets on d.source is not distinct from targets.source
        )
        select doc_id, cast(size as bigint) as size, cast(n as bigint) as source_size, target,
               cast(case when n = 0 then 0 else size * (given // n + case when size > 0 and place < given % n and place + size / 2 <= given % n then 1 else 0 end) end as bigint) as taken
        from placed
    """,
    "op9_sharding": """
        with steps as (
            select i, list_reduce(list_transform(range(8), lambda k: cast(k as bigint)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, cast(i as bigint)) as c from range(256) r(i)
        ), crc as materialized (
            select list(c order by i) as t from steps
        ), d as (
            select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size, md5(coalesce(text, '')) as m, hex(encode(coalesce(text, ''))) as x from documents
        ), coded as (
            select doc_id, size, substr(m, 1, 3) as bin, md5(coalesce(cast(doc_id as varchar), '') || ':' || m) as r,
                   xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint)), lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]), cast(4294967295 as bigint)), 4294967295) as text_crc32
            from d, crc
        ), placed as (
            select *, sum(size) over (order by bin, r rows unbounded preceding) as upto, sum(size) over (partition by bin) as own, (sum(size) over ()) / 16.0 as target from coded
        ), binned as (
            select *, min(upto - size) over (partition by bin) as before from placed
        ), cut as (
            select *, least(15, cast(floor(case when own <= target * 0.015 then (before + own / 2) / target else (upto - size / 2) / target end) as integer)) as shard from binned
        )
        select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'bytes' as law, cast(shard as integer) as shard,
               row_number() over (partition by shard order by bin, r) - 1 as slot, cast(null as integer) as grown_shard from cut
    """,
    "op10_warc": """
        with digests as (
            select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages
        ), coded as (
            select *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(list_sum(list_transform(range(0, 5),
                lambda j: ((instr('0123456789abcdef', substr(h, cast(1 + (5 * k + j) // 4 as bigint), 1)) - 1) >> cast(3 - (5 * k + j) % 4 as integer)) % 2 * (16 >> cast(j as integer)))) as bigint), 1)), '') as payload_digest,
                max(page_id) over (partition by h) as last
            from digests
        )
        select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type,
               case when page_id <> last then last end as refers_to from coded
    """,
}
