"""The same results in DuckDB SQL, over the same tables.

Written as another formulation, not as a transcript of the Spark plans: no JSON,
no index tables, list merging by a self join.
"""

from __future__ import annotations

_INPUT_TABLES = """
  case when p_size % 10 = 0 then null
       when p_size % 10 = 5 then ''
       when p_size % 4 = 0 then k1 || ',' || k2
       when p_size % 7 = 0 then k1 || ', ' || k2
       when p_size % 11 = 0 then k1 || ','
       else k1 end"""

_PARTS = f"""
parts as (
  select *, {_INPUT_TABLES} as input_tables, (p_size % 13 = 0 or p_size % 17 = 0) as bad
  from (select *, 'silver:sales:T' || (p_partkey % 5 + 1) || ':1.0.0' k1,
          'silver:sales:T' || (p_size % 5 + 1) || ':1.0.0' k2 from part)
),
tenants as (select t, 't' || t tenant_id from range(10) r(t)),
runs as (
  select tenant_id, 'p' || p_partkey product_id, parts.* from parts join tenants on t % 2 = p_partkey % 2
)"""

_WANTS = """
wants as (
  select p_partkey, unnest(range(1, len(l) + 1)) pos, unnest(l) want
  from (select p_partkey, string_split(input_tables, ',') l from parts where input_tables <> '' and not bad)
)"""

_PORTS = """
ports as (
  select p_partkey, 1 port_ord, 's' || p_partkey share_id from part
  union all select p_partkey, 2, 's' || (p_partkey - p_size) from part
  union all select p_partkey, 3, 's' || p_partkey from part where p_size % 6 = 0
)"""

_LISTINGS = """
listings as materialized (
  select 't' || (o_orderkey % 10) tenant_id, 's' || o_custkey share_id,
    'silver:sales:T' || substring(o_orderpriority, 1, 1) || ':1.0.0' table_key,
    o_custkey % 11 <> 0 is_list, o_orderkey ord, '/lake/' || o_orderkey as location,
    o_orderstatus <> 'P' readable
  from orders
)"""

_RUN_PORTS = """
run_ports as materialized (
  select r.tenant_id, r.product_id, p.port_ord, p.share_id from runs r join ports p using (p_partkey)
)"""

# A port's entry survives if every later port of that table is a list, and it is
# a list itself or the last one.
_MERGED = """
entries as materialized (
  select r.tenant_id, r.product_id, r.port_ord, l.table_key, l.is_list, l.ord, l.location, l.readable
  from run_ports r join listings l using (tenant_id, share_id)
),
cells as (
  select distinct tenant_id, product_id, table_key, port_ord, is_list from entries
),
surviving as (
  select c.tenant_id, c.product_id, c.table_key, c.port_ord
  from cells c join cells x using (tenant_id, product_id, table_key)
  group by 1, 2, 3, 4
  having not bool_or(x.port_ord > c.port_ord and not (x.is_list and c.is_list))
),
merged as (
  select e.* from entries e join surviving s on s.tenant_id = e.tenant_id and s.product_id = e.product_id
    and s.table_key = e.table_key and s.port_ord = e.port_ord
),
firsts as (
  select * from (select *, row_number() over (partition by tenant_id, product_id, table_key
    order by port_ord, ord) rn from merged) where rn = 1
)"""

_READY = """
readiness as (
  select r.tenant_id, r.product_id, count(*) = count(k.share_id) ready
  from run_ports r left join (select distinct tenant_id, share_id from listings) k using (tenant_id, share_id)
  group by 1, 2
)"""

_GAPS = """
run_wants as materialized (
  select r.tenant_id, r.product_id, w.pos, w.want from runs r join wants w using (p_partkey)
),
gaps as materialized (
  select r.tenant_id, r.product_id, r.pos, r.want
  from run_wants r
  left join firsts f on f.tenant_id = r.tenant_id and f.product_id = r.product_id and f.table_key = r.want
  where f.readable is not true
)"""

_REGISTRY = """
registry as (
  select * exclude (rn) from (
    select 't' || (l_suppkey % 5) tenant_id, case when l_linestatus = 'O' then 'silver' else 'gold' end layer,
      'sales' namespace, 'T' || l_partkey as name,
      case l_linenumber % 3 when 0 then '1.0.0' when 1 then '2.0.0' else '1.0.0-rc' end as version,
      case when l_returnflag = 'R' then '' else '{"definitions":{"svc.T' || l_partkey || '":{}}}' end contract,
      '/lake/' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey as location, l_shipdate registered_at,
      row_number() over (
        partition by l_suppkey % 5, l_linestatus = 'O', l_partkey, l_linenumber % 3
        order by l_shipdate desc, '/lake/' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey desc) rn
    from lineitem) where rn = 1
),
requests as (
  select 'p' || p_partkey product_id, 't' || (p_partkey % 5) tenant_id,
    case when p_size % 2 = 0 then 'silver' else 'gold' end layer, 'sales' namespace, n req_ord,
    case n when 1 then 'T' || p_partkey else 'T' || (p_partkey - p_size % 3) end as name,
    case when n = 1 then (case p_size % 3 when 0 then '1.0.0' when 1 then '1.0.0-rc' else 'v2.0.0' end)
         else (case p_size % 3 when 0 then '1.0.0' when 1 then '2.0.0' else '1.0.0-rc' end) end as version
  from part cross join (values (1), (2)) v(n)
)"""

_EDITED = """
edited as (
  select case when o_orderkey % 11 = 0 then o_orderkey + 1000000000000 else o_orderkey end o_orderkey, o_custkey,
    case when o_orderkey % 13 = 0 then null else o_orderstatus end o_orderstatus,
    case when o_orderkey % 5 = 0 then o_totalprice + 1 else o_totalprice end o_totalprice,
    o_orderdate, o_orderpriority
  from orders
)"""

_CHANGES = """
select o.*, 'delete' change_type from orders o where o_orderkey not in (select o_orderkey from edited)
union all select e.*, 'insert' from edited e where o_orderkey not in (select o_orderkey from orders)
union all select o.*, 'update_preimage' from orders o join edited e using (o_orderkey)
  where o.o_totalprice <> e.o_totalprice or o.o_orderstatus is distinct from e.o_orderstatus
union all select e.*, 'update_postimage' from orders o join edited e using (o_orderkey)
  where o.o_totalprice <> e.o_totalprice or o.o_orderstatus is distinct from e.o_orderstatus"""

_STATES = """
first as (select * from orders where o_orderkey % 17 <> 0),
fourth as (
  select * replace (case when o_orderkey % 9 = 0 then -o_orderkey else o_custkey end as o_custkey)
  from orders where o_orderkey % 4 <> 0)"""

# Between the first and the last state; what happened in between does not show.
_NET = """
select o.*, 'delete' change_type from first o where o_orderkey not in (select o_orderkey from fourth)
union all select e.*, 'insert' from fourth e where o_orderkey not in (select o_orderkey from first)
union all select o.*, 'update_preimage' from first o join fourth e using (o_orderkey) where o.o_custkey <> e.o_custkey
union all select e.*, 'update_postimage' from first o join fourth e using (o_orderkey) where o.o_custkey <> e.o_custkey"""

_DOCS = """
docs as (
  select p_partkey doc_key, p_size, 'svc.Part' || p_partkey main, 'aux.' || p_type aux, 'old.' || p_type old_name,
    p_name, p_brand, p_type,
    case p_size % 4 when 0 then 'svc.Part' || p_partkey when 1 then 'Part' || p_partkey when 2 then p_type
      else 'Nope' end as name
  from part
)"""

_ADDRESS = """
parts as (
  select p_partkey, case when p_size % 3 = 0 then 'gold' else 'silver' end layer, p_brand namespace,
    case when p_size % 19 = 0 then '' else p_name end as name,
    case p_size % 4 when 0 then '1.0.0' when 1 then '1.0.0-rc' when 2 then 'v2.0.0' else '1.0.0' end as version,
    case when p_size % 23 = 0 then 'other' when p_size % 2 = 0 then 'coordinates' else 'short' end layout
  from part
)"""

_STATUS = """
latest as (
  select * exclude (rn) from (
    select 't' || (user_id % 5) tenant_id, event_type product_id,
      case when event_type = 'error' then 'ERROR' else 'INFO' end severity,
      case when value < 10 then 'active' when value < 50 then 'success' else 'error' end as text, ts, event_id,
      row_number() over (partition by user_id % 5, event_type order by ts desc, event_id desc) rn
    from events) where rn = 1
)"""

_FLEET = """
nations as (select 't' || n_nationkey tenant_id, n_nationkey from nation),
first_listing as (select s_nationkey, arg_min(s_acctbal >= 1000, s_suppkey) readable from supplier group by 1),
states as (
  select tenant_id, n_nationkey, case when f.s_nationkey is null then 'SKIP_SHARES'
    when not f.readable then 'SKIP_TABLES' else 'READY' end state
  from nations left join first_listing f on f.s_nationkey = n_nationkey
),
silver as (
  select 't' || c_nationkey tenant_id, o.* from orders o join customer on c_custkey = o_custkey
)"""

_UNION_TABLES = " union all ".join(
    f"select '{t}' table_name, count(*) n from {t}" for t in ("orders", "lineitem", "part", "customer")
)


def _with(*parts: str) -> str:
    return "with " + ",".join(parts)


ORACLE = {
    "scan_counts": _UNION_TABLES,
    "scan_by_location": "select * from orders",
    "product_projection": "select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice from orders",
    "launch_runs": _with(_PARTS)
    + """
select 'L' || p_partkey launch_id, tenant_id, product_id, 'gold-builder' transformer_id,
  case when p_partkey % 3 <> 0 then 'corr-' || p_partkey end correlation_id,
  'contracts/' || p_brand || '.json' contract_file from runs
union all select 'L' || p_partkey, tenant_id, 'q' || p_partkey, 'gold-builder', null, 'contracts/plain.json' from runs""",
    "product_shares": _with(_PORTS)
    + " select 'L' || p_partkey launch_id, 'p' || p_partkey product_id, port_ord, share_id from ports",
    "contract_columns": _with(_DOCS)
    + """
select doc_key, main entity, 0 pos, 'id' column_name, 'bigint' as type, false as nullable from docs
union all select doc_key, main, 1, 'name', 'string', true from docs
union all select doc_key, main, 2, 'price', 'decimal(12,' || (p_size % 5) || ')', true from docs
union all select doc_key, main, 3, 'made', case when p_size % 2 = 0 then 'date' else 'timestamp_ntz' end, true from docs
union all select doc_key, aux, 0, 'k', 'int', true from docs
union all select doc_key, old_name, 0, 'k', 'boolean', true from docs where p_size % 5 = 0""",
    "contract_annotations": _with(_DOCS)
    + """
select doc_key, main entity, '@title' as name, p_name as value from docs
union all select doc_key, aux, '@tier', p_brand from docs
union all select doc_key, null, 'creator', p_brand from docs
union all select doc_key, null, 'size', cast(p_size as varchar) from docs""",
    "entity_match": _with(_DOCS)
    + """
select doc_key, name,
  case when p_size % 4 <= 1 then main when p_size % 4 = 2 and p_size % 5 <> 0 then aux end entity,
  case when p_size % 4 = 3 then 'NONE' when p_size % 4 = 2 and p_size % 5 = 0 then 'SEVERAL' else 'ONE' end entity_match
from docs""",
    "contract_conform": """
select l_orderkey, cast(l_linenumber as bigint) line, cast(l_extendedprice as decimal(12,2)) price,
  cast(l_shipdate as date) ship_date, cast(null as varchar) note from lineitem""",
    "conform_rejects": """
select o_orderkey, case when o_orderstatus <> 'P' then cast(substring(o_orderpriority, 1, 1) as int) end code,
  case when o_orderstatus = 'F' or o_orderpriority <> '5-LOW' then o_custkey end customer,
  case when o_orderstatus = 'P' and o_orderpriority = '5-LOW' then 'code: type; customer: null'
       when o_orderstatus = 'P' then 'code: type'
       when o_orderstatus <> 'F' and o_orderpriority = '5-LOW' then 'customer: null' end reject_reason,
  case when o_orderstatus = 'P' then o_orderpriority end raw_code
from orders""",
    "product_params": _with(_PARTS)
    + """
select 'p' || p_partkey product_id, 'tier' k, case when p_size % 2 = 0 then p_brand else p_type end v from parts where not bad
union all select 'p' || p_partkey, 'enable_cdf', case p_size % 3 when 0 then 'FALSE' else 'True' end
  from parts where not bad and p_size % 3 <> 2
union all select 'p' || p_partkey, 'input_tables', input_tables from parts where not bad and input_tables is not null""",
    "product_flags": """
select 'p' || p_partkey product_id, p_size % 3 <> 0 change_feed from part
union all select 'q' || p_partkey, true from part""",
    "bad_params": """
select 'p' || p_partkey product_id, case when p_size % 13 = 0 then 'tier' else 'tier=a=b' end entry
from part where p_size % 13 = 0 or p_size % 17 = 0""",
    "expected_tables": _with(_PARTS)
    + """
select 'p' || p_partkey product_id, cast(pos as int) pos, want from (
  select p_partkey, unnest(range(1, len(l) + 1)) pos, unnest(l) want
  from (select p_partkey, string_split(input_tables, ',') l from parts where input_tables <> ''))""",
    "share_merge": _with(_PARTS, _PORTS, _RUN_PORTS, _LISTINGS, _MERGED)
    + """
select tenant_id, product_id, table_key, count(*) n,
  max(case when rn = 1 then location end) first_location
from (select *, row_number() over (partition by tenant_id, product_id, table_key order by port_ord, ord) rn from merged)
group by 1, 2, 3""",
    "share_locations": _with(_PARTS, _PORTS, _RUN_PORTS, _LISTINGS, _MERGED)
    + " select tenant_id, product_id, table_key, port_ord, ord, location from merged",
    "share_readiness": _with(_PARTS, _PORTS, _RUN_PORTS, _LISTINGS, _READY)
    + """
select * from readiness union all select tenant_id, 'q' || p_partkey, true from runs""",
    "dependency_gaps": _with(_PARTS, _WANTS, _PORTS, _RUN_PORTS, _LISTINGS, _MERGED, _GAPS)
    + " select tenant_id, product_id, count(*) n_missing, arg_min(want, pos) first_missing from gaps group by 1, 2",
    "run_plan": _with(_PARTS, _WANTS, _PORTS, _RUN_PORTS, _LISTINGS, _MERGED, _READY, _GAPS)
    + """
select 'L' || r.p_partkey launch_id, r.tenant_id, r.product_id,
  case when p_partkey % 3 <> 0 then 'corr-' || p_partkey end correlation_id,
  case when p_size % 19 = 0 then 'BAD_COORDINATES' when bad then 'BAD_PARAMS' when not y.ready then 'SKIP_SHARES'
    when coalesce(input_tables, '') = '' then 'READY_UNCHECKED'
    when g.product_id is not null then 'SKIP_TABLES' else 'READY' end state
from runs r join readiness y on y.tenant_id = r.tenant_id and y.product_id = r.product_id
left join (select distinct tenant_id, product_id from gaps) g on g.tenant_id = r.tenant_id and g.product_id = r.product_id
union all select 'L' || p_partkey, tenant_id, 'q' || p_partkey, null, 'READY_UNCHECKED' from runs""",
    "registry_upsert": _with(_REGISTRY) + " select * from registry",
    "registry_lookup": _with(_REGISTRY)
    + """
select q.*, r.location, r.contract,
  case when r.name is null then 'NOT_FOUND' when r.contract = '' then 'NO_CONTRACT' end problem
from requests q left join registry r using (tenant_id, layer, namespace, name, version)""",
    "registry_lookup_partial": _with(_REGISTRY)
    + """
, asked as (select *, cast(substring(product_id, 2) as bigint) % 3 m from requests where req_ord = 1)
select q.product_id, r.tenant_id, r.layer, r.namespace, r.name, r.version, r.location
from asked q join registry r on r.tenant_id = q.tenant_id and r.name = q.name
  and (m = 0 or r.layer = q.layer) and (m <> 2 or r.version = q.version)""",
    "coordinates_merge": _with(_REGISTRY)
    + """
, found as (select q.*, r.location, r.contract from requests q
  left join registry r using (tenant_id, layer, namespace, name, version))
select product_id, tenant_id, layer || ':' || namespace || ':' || name || ':' || version table_key,
  arg_max(location, req_ord) as location, arg_max(contract, req_ord) contract
from found where product_id not in (select product_id from found where location is null)
group by 1, 2, 3""",
    "address_layout": _with(_ADDRESS)
    + """
select p_partkey, layer, namespace, name, version,
  'lake/t' || (p_partkey % 5) || '/' || layer || '/' ||
    case when layout = 'short' then name else version || '/' || namespace || '/' || name end path
from parts where name <> '' and layout <> 'other'""",
    "address_rejects": _with(_ADDRESS)
    + """
select p_partkey, layout, case when name = '' then 'NO_NAME' else 'UNKNOWN_LAYOUT' end problem
from parts where name = '' or layout = 'other'""",
    "change_feed": _with(_EDITED) + _CHANGES,
    "document_changes": """
with edited as (
  select doc_id, case when doc_id % 4 = 0 then 'xx' else lang end lang, trim(text, ' ') as text from documents),
changed as (
  select d.doc_id, d.lang l0, d.text t0, e.lang l1, e.text t1 from documents d join edited e using (doc_id)
  where d.lang <> e.lang or d.text <> e.text)
select doc_id, l0 lang, t0 as text, 'update_preimage' change_type from changed
union all select doc_id, l1, t1, 'update_postimage' from changed""",
    "overwrite_feed": _with(_EDITED)
    + " select *, 'delete' change_type from orders union all select *, 'insert' from edited",
    "snapshot_write": _with(_EDITED) + " select *, 't' || (o_custkey % 7) tenant_id from edited",
    "reserved_columns": """
select 't' || (o_custkey % 7) tenant_id, o_orderkey, o_orderstatus = 'P' rejected, o_orderpriority "snapshot",
  case when o_orderstatus = 'F' then o_orderpriority end reject_reason from orders""",
    "reject_side": """
select 't' || (o_custkey % 7) tenant_id, o_orderkey, cast(null as int) code, o_custkey customer,
  'code: type' reason, o_orderpriority raw_code from orders where o_orderstatus = 'P'""",
    "registration_order": "select *, 't' || (o_custkey % 7) tenant_id from orders",
    "mixed_contracts": """
select 't' || (o_custkey % 7) tenant_id, o_orderkey,
  case when o_custkey % 7 = 1 then o_custkey else cast(substring(o_orderpriority, 1, 1) as bigint) end code from orders""",
    "snapshot_changes": _with(_EDITED) + f" select *, 't' || (o_custkey % 7) tenant_id from ({_CHANGES})",
    "run_status": _with(_STATUS) + " select * from latest",
    "status_counts": _with(_STATUS) + " select tenant_id, text, count(*) n from latest group by 1, 2",
    "fleet_publish": _with(_FLEET)
    + """
select tenant_id, o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
  cast(o_totalprice as decimal(12,2)) o_totalprice
from silver where tenant_id in (select tenant_id from states where state = 'READY')""",
    "fleet_unchecked": _with(_FLEET)
    + """
select tenant_id, o_orderkey, cast(o_orderdate as date) o_orderdate, o_totalprice, cast(null as varchar) remark
from silver""",
    "fleet_status": _with(_FLEET)
    + """
select tenant_id, 'checked' product_id, 'corr-1' correlation_id, 'INFO' severity,
  case when state = 'READY' then 'success' else state end as text from states
union all select tenant_id, 'unchecked', null, 'INFO', 'success' from nations""",
    "fleet_registry": _with(_FLEET)
    + """
select tenant_id, 'silver' layer, 'Orders' as name, '1.0.0' as version, true change_feed from nations
union all select tenant_id, 'gold', 'OrderBook', '1.0.0', true from states where state = 'READY'
union all select tenant_id, 'gold', 'OrderValues', '1.0.0', false from nations""",
    "product_levels": """
with recursive nodes as (select p_partkey p, p_size, k from part, range(6) r(k)),
edges as (
  select n.p, n.k, j from nodes n, range(6) q(j)
  where (j < k and (p_size * (j + 2) + k * 5 + p) % 4 = 0) or (k = 0 and j = 5 and p_size % 7 = 0)),
walks as (
  select p, k, 0 steps from nodes
  union select e.p, e.k, w.steps + 1 from walks w join edges e on e.p = w.p and e.j = w.k where w.steps < 6),
longest as (select p, k, max(steps) steps from walks group by 1, 2),
makers as (select p, k, string_agg('p' || j, ',' order by 'p' || j) producers from edges group by 1, 2)
select 'L' || l.p launch_id, 'p' || l.k product_id, case when steps < 6 then cast(steps as int) end as level,
  steps >= 6 in_cycle, coalesce(producers, '') producers
from longest l left join makers m on m.p = l.p and m.k = l.k""",
    "fleet_listed_inputs": """
select 't' || c_nationkey tenant_id, o_orderkey, o_custkey, o_orderstatus, o_totalprice, c_name
from orders join customer on c_custkey = o_custkey""",
    "fleet_levels": _with(_FLEET)
    + """
select tenant_id, o_orderkey, o_custkey, n from (
  select tenant_id, o_orderkey, o_custkey, o_totalprice, count(*) over c n, max(o_totalprice) over c most
  from silver window c as (partition by tenant_id, o_custkey))
where o_totalprice = most""",
    "fleet_levels_status": _with(_FLEET)
    + """
select t.tenant_id, product_id, severity, text from (select distinct tenant_id from silver) t,
  (values ('a_top', 'INFO', 'success'), ('b_totals', 'INFO', 'success'), ('c_book', 'INFO', 'success'),
    ('x', 'ERROR', 'BAD_CYCLE'), ('y', 'ERROR', 'BAD_CYCLE'), ('v', 'INFO', 'SKIP_TABLES'),
    ('w', 'INFO', 'SKIP_TABLES')) s(product_id, severity, text)""",
    "changes_folded": _with(_EDITED, _STATES) + _NET,
    "changes_applied": _with(_EDITED, _STATES) + " select * from fourth",
    "changes_between": _with(_EDITED, _STATES)
    + """
, old as (select * from first where o_custkey % 7 <> 3), new as (select * replace (abs(o_custkey) as o_custkey) from fourth),
pairs as (
  select o.o_orderkey k from old o join new n on o.o_orderkey = n.o_orderkey and o.o_custkey % 7 = n.o_custkey % 7),
changed as (
  select o.o_orderkey k from old o join new n on o.o_orderkey = n.o_orderkey and o.o_custkey % 7 = n.o_custkey % 7
  where o.o_custkey <> n.o_custkey),
images as (
  select *, 'delete' change_type from old where o_orderkey not in (select k from pairs)
  union all select *, 'insert' from new where o_orderkey not in (select k from pairs)
  union all select *, 'update_preimage' from old where o_orderkey in (select k from changed)
  union all select *, 'update_postimage' from new where o_orderkey in (select k from changed))
select *, 't' || (o_custkey % 7) tenant_id from images""",
    "registry_incremental": _with(_EDITED)
    + """
select *, 't' || (o_custkey % 7) tenant_id from orders where o_custkey % 7 in (2, 5)
union all select *, 't' || (o_custkey % 7) from edited where o_custkey % 7 not in (2, 5)""",
    "unreferenced_files": _with(_EDITED, _STATES)
    + " select *, 0 state from first union all select *, 1 from edited",
    "contract_diff": """
with c as (
  select p_partkey doc_key, n, p_size s,
    case when (p_size + n) % 3 = 0 then 'int' else 'bigint' end id_type, p_size % 2 <> n id_null,
    10 + (p_size * (2 + n)) % 7 p, (p_size + n) % 3 sc, p_size % 11 <> n has_price,
    case when n = 1 and p_size % 5 < 3 then 'timestamp_ntz' when p_size % 5 = 4 then 'string' else 'date' end made
  from part, (values (0), (1)) v(n)),
joined as (select o.doc_key, o.s, o, w from c o join c w on o.doc_key = w.doc_key and o.n = 0 and w.n = 1),
rows as (
  select doc_key, 'id' column_name, o.id_type old_type, w.id_type new_type,
    case when o.id_type = 'bigint' and w.id_type = 'int' then 'narrowed' when o.id_null and not w.id_null then 'now_required'
      when o.id_type <> w.id_type then 'widened' when w.id_null and not o.id_null then 'now_optional' else 'same' end change
  from joined
  union all
  select doc_key, 'price', case when o.has_price then 'decimal(' || o.p || ',' || o.sc || ')' end,
    case when w.has_price then 'decimal(' || w.p || ',' || w.sc || ')' end,
    case when not o.has_price then 'added' when not w.has_price then 'dropped'
      when o.p = w.p and o.sc = w.sc then 'same' when o.p - o.sc <= w.p - w.sc and o.sc <= w.sc then 'widened' else 'narrowed' end
  from joined where o.has_price or w.has_price
  union all select doc_key, 'made', o.made, w.made, case when o.made = w.made then 'same' else 'widened' end from joined
  union all select doc_key, 'k0', 'boolean', null, 'dropped' from joined
  union all select doc_key, 'k1', null, 'boolean', case when s % 4 = 0 then 'added_required' else 'added' end from joined)
select doc_key, 'svc.Part' entity, column_name, old_type, new_type, change,
  change in ('narrowed', 'now_required', 'added_required') breaking from rows""",
}
