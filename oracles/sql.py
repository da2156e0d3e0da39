"""DuckDB SQL with the expected result of every registered query.

Written from the rules, apart from the Spark code: windows instead of two-stage aggregates, plain
SQL joins instead of written intermediate tables. Each query gets the CTEs it refers to.
"""

import json
import re

from modelsift.functions import messages as M
from modelsift.sources.testdata import EXPECTED_COLUMNS, SAMPLE_SCHEMAS, scan_config

PREFIX = "00000000-0000-4000-8000-"
SCANNER = PREFIX + "000000009001"
SCAN = "fixture-scan-0001"
PRIOR = "fixture-scan-0000"
CLOCK = "timestamp '2024-02-01 00:00:00'"
PRIOR_CLOCK = "timestamp '2024-01-31 00:00:00'"
ROLES = "('ADMIN', 'CONTRIBUTOR', 'MEMBER')"
ROLES_SHOWN = "[''ADMIN'', ''CONTRIBUTOR'', ''MEMBER'']"


def guid(expr: str) -> str:
    return f"concat('{PREFIX}', lpad(cast({expr} as varchar), 12, '0'))"


def model(nation: str) -> str:
    return guid(f"1000 + {nation}")


def sha(*parts: str) -> str:
    return "sha256(" + " || '|' || ".join(f"coalesce(cast({p} as varchar), '')" for p in parts) + ")"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def js(**fields: str) -> str:
    return obj({k.replace("_", " "): v for k, v in fields.items()})


def obj(fields: dict[str, str]) -> str:
    return "cast(json_object(" + ", ".join(f"{lit(k)}, {v}" for k, v in sorted(fields.items())) + ") as varchar)"


CTE: dict[str, str] = {}

# ---- landed evidence -------------------------------------------------------------------------

CTE["fx_inventory"] = f"""
select {guid('n_regionkey')} as workspace_id, r_name as workspace_name, {model('n_nationkey')} as model_id,
 case when n_nationkey = 24 then 'ModelBPA' else n_name end as model_name,
 n_nationkey % 11 = 10 as is_default_model,
 case n_nationkey % 3 when 0 then 'DirectLake' when 1 then 'Import' else 'Import, DirectQuery' end as storage_mode
from nation join region on n_regionkey = r_regionkey"""

CTE["fx_access"] = f"""
select {guid('r_regionkey')} as workspace_id, r_name as workspace_name,
 case when r_regionkey = 4 then 'Viewer' else 'Contributor' end as workspace_role
from region where r_regionkey <> 3"""

CTE["fx_bpa"] = f"""
select l_orderkey * 10 + l_linenumber as source_ordinal, {model('c_nationkey')} as model_id,
 concat('Rule ', l_linenumber) as rule_name,
 case l_returnflag when 'A' then 'Performance' when 'R' then 'Formatting' end as category,
 case l_suppkey % 5 when 0 then 'Error' when 1 then ' warning ' when 2 then 'Info' when 3 then 'bogus' end as severity,
 case when l_linestatus = 'F' then 'Column' else 'Measure' end as object_type,
 concat('table_', l_suppkey) as table_name, concat('object_', l_partkey) as object_name,
 case when l_partkey % 7 <> 0 then concat('Review rule ', l_linenumber) end as description,
 cast(null as varchar) as url, l_shipdate as detected_at
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey"""

CTE["fx_vpa"] = f"""
select {model('s_nationkey')} as model_id, concat('table_', l_suppkey) as table_name,
 concat('object_', l_partkey % 50) as column_name,
 case l_partkey % 50 % 4 when 0 then 'DateTime' when 1 then 'String' when 2 then 'Int64' else 'Double' end as data_type,
 case when l_partkey % 50 % 2 = 0 then 'HASH' else 'VALUE' end as encoding,
 cast(count(distinct l_orderkey) * 100000 as bigint) as cardinality,
 cast(sum(l_quantity) as bigint) as data_kb,
 cast(sum(l_linenumber) * 4096 as bigint) as dictionary_size,
 count(*) as n,
 cast(count(*) * 9437184 * case when l_partkey % 50 = 7 then l_suppkey % 3 * 40 + 1 else 1 end as bigint) as total_size
from lineitem join supplier on l_suppkey = s_suppkey
group by s_nationkey, l_suppkey, l_partkey % 50"""

CTE["fx_tables"] = """
select model_id, table_name, cast(sum(n) as bigint) as row_count, cast(sum(total_size) as bigint) as total_size,
 cast(sum(data_kb) as bigint) as data_kb, cast(sum(dictionary_size) as bigint) as dictionary_size
from fx_vpa group by model_id, table_name"""

CTE["fx_partitions"] = f"""
select i.model_id, trim(unnest(string_split(i.storage_mode, ','))) as mode
from supplier join fx_inventory i on i.model_id = {model('s_nationkey')}"""

CTE["fx_size"] = "select model_id, cast(sum(total_size) as bigint) as model_size_bytes from fx_vpa group by model_id"

CTE["fx_uses"] = f"""
select {guid('1000 + user_id % 25')} as model_id, concat('table_', user_id % 100) as table_name,
 concat('object_', event_id % 50) as object_name, count(*) as usage_count
from events where ts >= {CLOCK} - interval 14 day and ts < {CLOCK}
group by all"""

CTE["fx_usage"] = """
select o.model_id, o.table_name, 'Column' as object_type, o.object_name, u.usage_count is not null as is_used,
 coalesce(u.usage_count, 0) as usage_count
from (select distinct model_id, table_name, column_name as object_name from fx_vpa) o
left join fx_uses u using (model_id, table_name, object_name)"""

CTE["fx_refresh"] = f"""
select o_orderkey as request_no, {model('c_nationkey')} as model_id,
 case when o_orderkey % 10 <> 0 then concat('req-', o_orderkey) end as request_id, o_orderpriority as refresh_type,
 case o_orderstatus when 'F' then 'Failed' when 'O' then 'Completed' else 'Unknown' end as status,
 o_orderdate as start_time, max(l_shipdate) as end_time
from orders join customer on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey
group by all"""

CTE["fx_fallback"] = f"""
select s_suppkey as source_ordinal, {model('s_nationkey')} as model_id, concat('table_', s_suppkey) as table_name,
 case s_suppkey % 5 when 0 then 'None' when 1 then 'no fallback' when 3 then 'View-based table'
  when 4 then 'Row level security' end as reason
from supplier"""

CTE["fx_item_access"] = f"""
select c_custkey as source_ordinal, {model('c_nationkey')} as model_id, c_name as principal_name,
 case c_custkey % 3 when 0 then 'User' when 1 then 'Group' else 'ServicePrincipal' end as principal_type,
 case when c_custkey % 3 = 0 then concat(c_name, '@Example.com') end as principal_upn, c_mktsegment as permissions
from customer"""

CTE["fx_errors"] = f"""
select {model('n_nationkey')} as model_id, 'bpa' as stage, '429 Too Many Requests' as message
 from nation where n_nationkey % 8 = 5
union all select {model('n_nationkey')}, 'vpa', 'operation timed out' from nation where n_nationkey % 16 = 5
union all select {model('n_nationkey')}, 'refresh', '403 Forbidden' from nation where n_nationkey % 9 = 1"""

# ---- targets and model states ------------------------------------------------------------------

CTE["targets"] = f"""
select i.workspace_id, coalesce(a.workspace_name, i.workspace_name) as workspace_name, model_id, model_name,
 'WORKSPACE' as scope_source,
 case when a.workspace_id is null then 'FAILED_NOT_IN_WORKSPACE' when upper(workspace_role) in {ROLES}
  then 'PASSED' else 'FAILED_INSUFFICIENT_ROLE' end as permission_precheck_status,
 workspace_role as scanner_workspace_role,
 case when a.workspace_id is null then 'The scanner SPN was not found as a direct principal in the target workspace.'
  when upper(workspace_role) in {ROLES}
  then concat('Scanner SPN has accepted workspace role: ', workspace_role, '.')
  else concat('Scanner SPN role ''', workspace_role, ''' is not in {ROLES_SHOWN}.')
  end as permission_precheck_message
from fx_inventory i left join fx_access a on i.workspace_id = a.workspace_id
where lower(model_name) not in ('modelbpa', 'fabric capacity metrics')
 and not (is_default_model and coalesce(upper(workspace_role) in {ROLES}, false))"""

CTE["modes"] = """
select model_id, string_agg(mode, ', ' order by mode) as storage_mode
from (select distinct model_id, mode from fx_partitions) group by model_id"""

CTE["raw_states"] = """
select t.*, t.permission_precheck_status <> 'PASSED' as gated,
 max(case when e.stage = 'bpa' then e.message end) as bpa_error,
 max(case when e.stage = 'vpa' then e.message end) as vpa_error,
 max(case when e.stage = 'refresh' then e.message end) as refresh_error
from targets t left join fx_errors e using (model_id)
group by all"""

CTE["mode_states"] = """
select r.*, case when not gated and vpa_error is null then coalesce(m.storage_mode, 'UNKNOWN') else 'UNKNOWN' end
 as storage_mode, case when not gated then z.model_size_bytes end as model_size_bytes,
 case when not gated then r.workspace_id end as capacity_id,
 case when not gated then (select min(region.r_name) from region
  where concat('""" + PREFIX + """', lpad(cast(r_regionkey as varchar), 12, '0')) = r.workspace_id) end as capacity_name
from raw_states r left join modes m using (model_id) left join fx_size z using (model_id)"""

CTE["states"] = """
select *, case when gated then 'SKIPPED_PERMISSION' when bpa_status = 'FAILED' and vpa_status = 'FAILED' then 'FAILED'
 when 'FAILED' in (bpa_status, vpa_status, refresh_status) then 'PARTIAL' else 'SUCCEEDED' end as overall_status
from (select *,
 case when gated then 'SKIPPED_PERMISSION' when bpa_error is null then 'SUCCEEDED' else 'FAILED' end as bpa_status,
 case when gated then 'SKIPPED_PERMISSION' when vpa_error is null then 'SUCCEEDED' else 'FAILED' end as vpa_status,
 case when gated then 'SKIPPED_PERMISSION' when refresh_error is null then 'SUCCEEDED' else 'FAILED' end
  as refresh_status,
 case when gated then 'SKIPPED_PERMISSION' else 'SUCCEEDED' end as usage_status,
 case when gated then 'SKIPPED_PERMISSION' when storage_mode like '%DirectLake%' then 'SUCCEEDED'
  else 'NOT_APPLICABLE' end as direct_lake_status,
 case when gated then 'NOT_RUN_PERMISSION_PRECHECK' else 'SUCCEEDED' end as access_snapshot_status
 from mode_states)"""

CTE["usable"] = "select * from states where overall_status in ('SUCCEEDED', 'PARTIAL')"

# ---- typed evidence ----------------------------------------------------------------------------

_column_json = js(
    Cardinality="v.cardinality", Column_Name="v.column_name", Data_Size="concat(v.data_kb, ' KB')",
    Data_Type="v.data_type", Dictionary_Size="v.dictionary_size", Encoding="v.encoding",
    Hierarchy_Size="cast(null as bigint)", Table_Name="v.table_name", Total_Size="v.total_size",
)
CTE["column_rows"] = f"""
select {sha(lit(SCAN), 'v.model_id', "'VPA_COLUMN'", 'v.table_name', 'v.column_name')} as evidence_id,
 '{SCAN}' as scan_id, s.workspace_id, v.model_id, v.table_name, v.column_name, v.data_type, v.encoding, v.cardinality,
 v.data_kb * 1024 as data_size_bytes, v.dictionary_size as dictionary_size_bytes,
 cast(null as bigint) as hierarchy_size_bytes, v.total_size as total_size_bytes,
 case when s.model_size_bytes > 0 then 100.0::double * v.total_size / s.model_size_bytes end as model_size_pct,
 {_column_json} as raw_json, {CLOCK} as detected_at, s.workspace_name, s.model_name, s.overall_status
from fx_vpa v join states s using (model_id) where s.vpa_status = 'SUCCEEDED'"""

_table_json = js(
    Data_Size="concat(v.data_kb, ' KB')", Dictionary_Size="v.dictionary_size", Hierarchy_Size="cast(null as bigint)",
    Rows="v.row_count", Table_Name="v.table_name", Total_Size="v.total_size",
)
CTE["table_rows"] = f"""
select {sha(lit(SCAN), 'v.model_id', "'VPA_TABLE'", 'v.table_name')} as evidence_id, '{SCAN}' as scan_id,
 s.workspace_id, v.model_id, v.table_name, v.row_count, v.data_kb * 1024 as data_size_bytes,
 v.dictionary_size as dictionary_size_bytes, cast(null as bigint) as hierarchy_size_bytes,
 v.total_size as total_size_bytes,
 case when s.model_size_bytes > 0 then 100.0::double * v.total_size / s.model_size_bytes end as model_size_pct,
 {_table_json} as raw_json, {CLOCK} as detected_at
from fx_tables v join states s using (model_id) where s.vpa_status = 'SUCCEEDED'"""

_usage_json = obj({
    "IsUsed": "u.is_used", "Object Name": "u.object_name", "Object Type": "u.object_type",
    "Table Name": "u.table_name", "UsageCount": "u.usage_count",
})
CTE["usage_rows"] = f"""
select {sha(lit(SCAN), 'u.model_id', "'USAGE'", 'u.table_name', 'u.object_type', 'u.object_name')} as usage_id,
 '{SCAN}' as scan_id, s.workspace_id, u.model_id, u.table_name, u.object_type, u.object_name, u.is_used, u.usage_count,
 'WorkspaceMonitoring' as usage_method, 14::integer as usage_window_days, {_usage_json} as raw_json,
 {CLOCK} as detected_at, s.workspace_name, s.model_name
from fx_usage u join states s using (model_id) where s.usage_status = 'SUCCEEDED'"""

_iso = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"
_refresh_json = js(
    End_Time=_iso("end_time"), Refresh_Type="refresh_type", Request_Id="request_id", Start_Time=_iso("start_time"),
    Status="r.status",
)
CTE["refresh_rows"] = f"""
select {sha(lit(SCAN), 'model_id', "'REFRESH'", 'coalesce(request_id, cast(n - 1 as varchar))')} as refresh_id,
 '{SCAN}' as scan_id, workspace_id, model_id, request_id, refresh_type, status, start_time, end_time, n,
 case when end_time is not null then greatest(0, epoch(end_time) - epoch(start_time)) end::double as duration_seconds, raw_json, {CLOCK} as captured_at
from (select r.*, s.workspace_id, {_refresh_json} as raw_json,
 row_number() over (partition by model_id order by start_time desc, request_no) as n
 from fx_refresh r join states s using (model_id) where s.refresh_status = 'SUCCEEDED')"""

_fallback_json = js(Fallback_Reason="f.reason", Table="f.table_name")
CTE["fallback_rows"] = f"""
select {sha(lit(SCAN), 'model_id', "'DIRECT_LAKE_FALLBACK'", 'table_name', 'pos')} as check_id, '{SCAN}' as scan_id,
 workspace_id, model_id, 'FALLBACK_REASON' as check_type, table_name,
 case when reason <> '' and lower(trim(reason)) not in ('none', 'n/a', 'no fallback') then 'ISSUE' else 'OK' end
  as status, reason, raw_json, {CLOCK} as detected_at, workspace_name, model_name, source_ordinal
from (select f.*, s.workspace_id, s.workspace_name, s.model_name, {_fallback_json} as raw_json,
 row_number() over (partition by f.model_id order by source_ordinal) - 1 as pos
 from fx_fallback f join states s using (model_id) where s.direct_lake_status = 'SUCCEEDED')"""

_access_json = js(
    Permissions="permissions", User_Name="principal_name", User_Principal_Name="principal_upn",
    User_Type="principal_type",
)
CTE["access_rows"] = f"""
select {sha(lit(SCAN), 'model_id', "''", 'principal_upn', 'pos')} as access_id, '{SCAN}' as scan_id, workspace_id,
 model_id, cast(null as varchar) as principal_id, principal_name, principal_type,
 lower(principal_upn) as principal_upn, permissions, cast(null as varchar) as additional_permissions, raw_json,
 {CLOCK} as captured_at
from (select a.*, s.workspace_id, {_access_json} as raw_json,
 row_number() over (partition by a.model_id order by source_ordinal) - 1 as pos
 from fx_item_access a join states s using (model_id) where s.access_snapshot_status = 'SUCCEEDED')"""

# ---- findings ----------------------------------------------------------------------------------

_BASE = {
    "category": "cast(null as varchar)", "severity": "'INFO'", "confidence": "'MEDIUM'",
    "impact_area": "'MODEL_QUALITY'", "finding_text": "cast(null as varchar)",
    "recommended_action": "cast(null as varchar)", "technical_evidence": "cast(null as varchar)",
    "evidence_json": "raw_json", "reclaimable_upper_bound_bytes": "cast(null as bigint)",
    "change_risk": "'MEDIUM'", "documentation_url": "cast(null as varchar)", "detected_at": CLOCK,
}


def finding(source: str, rank: int, rule: str, kind: str, table: str, name: str, ordinal: str, rows: str, **values):
    v = {**_BASE, **values}
    return f"""
select {sha(lit(SCAN), 'model_id', lit(source), rule, table, name)} as finding_id, '{SCAN}' as scan_id,
 '2.0.0' as scanner_version, 'OPPORTUNITY_DISCOVERY' as solution_stage, workspace_id, workspace_name, model_id,
 model_name, '{source}' as source, {v['category']} as category, {sha(lit(source), rule)} as rule_id,
 {rule} as rule_name, {v['severity']} as severity, {v['confidence']} as confidence,
 {v['impact_area']} as impact_area, {kind} as object_type, {table} as table_name, {name} as object_name,
 {v['finding_text']} as finding_text, {v['recommended_action']} as recommended_action,
 {v['technical_evidence']} as technical_evidence, {v['evidence_json']} as evidence_json,
 cast(null as bigint) as estimated_saving_bytes_low, cast(null as bigint) as estimated_saving_bytes_high,
 {v['reclaimable_upper_bound_bytes']} as reclaimable_upper_bound_bytes,
 'NOT_ESTIMATED_STAGE_2_REQUIRED' as cu_saving_status, 'NOT_STARTED' as benefit_validation_status,
 {v['change_risk']} as change_risk, true as validation_required, {v['documentation_url']} as documentation_url,
 {v['detected_at']} as detected_at, {rank}::integer as source_rank, cast({ordinal} as bigint) as evidence_ordinal
from {rows}"""


FINDING_COLUMNS = [
    "finding_id", "scan_id", "scanner_version", "solution_stage", "workspace_id", "workspace_name", "model_id",
    "model_name", "source", "category", "rule_id", "rule_name", "severity", "confidence", "impact_area", "object_type",
    "table_name", "object_name", "finding_text", "recommended_action", "technical_evidence", "evidence_json",
    "estimated_saving_bytes_low", "estimated_saving_bytes_high", "reclaimable_upper_bound_bytes", "cu_saving_status",
    "benefit_validation_status", "change_risk", "validation_required", "documentation_url", "detected_at",
]

_bpa_json = js(
    Category="category", Description="description", Object_Name="object_name", Object_Type="object_type",
    Rule_Name="rule_name", Severity="severity", Table_Name="table_name", URL="url",
)
_bpa_severity = "upper(trim(coalesce(severity, 'Warning')))"
CTE["f_bpa"] = finding(
    "BPA", 0, "rule_name", "object_type", "table_name", "object_name", "source_ordinal",
    f"(select b.*, s.workspace_id, s.workspace_name, s.model_name, {_bpa_json} as raw_json "
    "from fx_bpa b join states s using (model_id) where s.bpa_status = 'SUCCEEDED')",
    category="category",
    severity=f"case when {_bpa_severity} in ('INFO', 'WARNING', 'ERROR') then {_bpa_severity} else 'WARNING' end",
    confidence="'HIGH'",
    impact_area="case when lower(category) = 'performance' then 'PERFORMANCE' else 'MODEL_QUALITY' end",
    finding_text="coalesce(nullif(description, ''), rule_name)",
    recommended_action="description",
    technical_evidence="concat('Deterministic BPA rule violation: ', rule_name)",
    documentation_url="url",
    detected_at="detected_at",
)

_advice = (
    f"concat({lit(M.CONFIRM_USE)}, ' ', case when contains(lower(data_type), 'date') and "
    f"contains(lower(data_type), 'time') then {lit(M.ADVICE_DATETIME)} when contains(lower(data_type), 'string') "
    f"or contains(lower(data_type), 'text') then {lit(M.ADVICE_TEXT)} else {lit(M.ADVICE_OTHER)} end)"
)
CTE["f_vpa"] = finding(
    "VPA_HEURISTIC", 1,
    "case when cardinality >= 1000000 then 'Large high-cardinality column' else 'Large storage contributor' end",
    "'Column'", "table_name", "column_name", "-total_size_bytes",
    "(select * from column_rows where total_size_bytes >= 52428800 and (model_size_pct >= 10 or cardinality >= 1000000))",
    category="'Storage'",
    severity="case when coalesce(model_size_pct, 0) < 25 then 'WARNING' else 'ERROR' end",
    impact_area="'MODEL_SIZE'",
    finding_text=lit(M.STORAGE_FINDING),
    recommended_action=_advice,
    technical_evidence=(
        "concat('Column size=', printf('%.2f', total_size_bytes / 1048576.0::double), ' MB; model share=', "
        "printf('%.2f', model_size_pct), '%; cardinality=', format('{:,}', cardinality))"
    ),
    reclaimable_upper_bound_bytes="total_size_bytes",
    change_risk="'HIGH'",
)
CTE["f_usage"] = finding(
    "UNUSED_OBJECT_ANALYSIS", 2, "'Unused semantic model object'", "object_type", "table_name", "object_name", "0",
    """(select u.*, c.total_size_bytes as known_size from usage_rows u left join column_rows c
  on c.model_id = u.model_id and lower(c.table_name) = lower(u.table_name)
  and lower(c.column_name) = lower(u.object_name) where not u.is_used)""",
    category="'Usage'",
    severity="case when known_size >= 52428800 then 'WARNING' else 'INFO' end",
    impact_area="'MODEL_SIZE'",
    finding_text=lit(M.UNUSED_FINDING),
    recommended_action=lit(M.UNUSED_ACTION),
    technical_evidence="'No references in 14 days of Workspace Monitoring queries.'",
    reclaimable_upper_bound_bytes="known_size",
    change_risk="'HIGH'",
)
CTE["f_fallback"] = finding(
    "DIRECT_LAKE", 3, "'Direct Lake fallback risk'", "'Table'", "table_name", "table_name", "source_ordinal",
    "fallback_rows where status = 'ISSUE'",
    category="'Direct Lake'", severity="'WARNING'", confidence="'HIGH'", impact_area="'QUERY_CU'",
    finding_text="reason", recommended_action=lit(M.FALLBACK_ACTION), technical_evidence="reason",
)
CTE["all_findings"] = """
select * from f_bpa union all select * from f_vpa union all select * from f_usage union all select * from f_fallback"""

# ---- rollups -----------------------------------------------------------------------------------

_RANK = (
    "case upper({0}) when 'CRITICAL' then 5 when 'ERROR' then 4 when 'HIGH' then 4 when 'WARNING' then 3 "
    "when 'MEDIUM' then 3 when 'INFO' then 2 when 'LOW' then 1 else 0 end"
)
_RISK = "case upper(change_risk) when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end"
_SEEN = (
    "source_rank, evidence_ordinal, domain nulls first, source nulls first, rule_name nulls first, "
    "recommended_action nulls first, severity nulls first, change_risk nulls first"
)
CTE["keyed"] = f"""
select *, {sha('model_id', "'OPPORTUNITY'", 'source', 'domain')} as opportunity_id,
 {sha('model_id', "'RECOMMENDATION'", 'rule_id', 'recommended_action')} as recommendation_id,
 {_RANK.format('severity')} as severity_rank, {_RISK} as risk_rank
from (select f.*, coalesce(nullif(category, ''), nullif(impact_area, ''), 'General optimization') as domain
 from all_findings f where model_id in (select model_id from usable))"""

CTE["opportunities"] = f"""
select opportunity_id, '{SCAN}' as analysis_id, min(workspace_name) as workspace_name, model_id as semantic_model_id,
 min(model_name) as semantic_model_name, concat(min(domain) filter (first = 1), ' optimization') as opportunity_title,
 min(domain) filter (first = 1) as optimization_domain, min(source) filter (first = 1) as finding_source,
 min(severity) filter (worst = 1) as highest_severity, cast(count(*) as integer) as finding_count,
 cast(count(distinct recommendation_id) as integer) as recommendation_count,
 cast(sum(coalesce(estimated_saving_bytes_low, 0)) as bigint) as estimated_saving_bytes_low,
 cast(sum(coalesce(estimated_saving_bytes_high, 0)) as bigint) as estimated_saving_bytes_high,
 min(change_risk) filter (riskiest = 1) as change_risk,
 concat(count(*), ' finding(s) from ', min(source) filter (first = 1), ' require review in ',
  min(domain) filter (first = 1), '.') as opportunity_summary,
 cast(max(severity_rank) * 100 + least(count(*), 99) as integer) as priority_score, max(detected_at) as detected_at
from (select *, row_number() over (partition by opportunity_id order by {_SEEN}) as first,
 row_number() over (partition by opportunity_id order by severity_rank desc, {_SEEN}) as worst,
 row_number() over (partition by opportunity_id order by risk_rank desc, {_SEEN}) as riskiest from keyed)
group by opportunity_id, model_id"""

CTE["recommendations"] = f"""
select recommendation_id, '{SCAN}' as analysis_id, min(workspace_name) as workspace_name,
 model_id as semantic_model_id, min(model_name) as semantic_model_name,
 min(rule_name) filter (first = 1) as recommendation_title, min(domain) filter (first = 1) as optimization_domain,
 min(recommended_action) filter (first = 1) as recommended_action,
 min(change_risk) filter (riskiest = 1) as change_risk, bool_or(validation_required) as validation_required,
 cast(sum(coalesce(estimated_saving_bytes_low, 0)) as bigint) as estimated_saving_bytes_low,
 cast(sum(coalesce(estimated_saving_bytes_high, 0)) as bigint) as estimated_saving_bytes_high,
 min(source) filter (first = 1) as finding_source, cast(count(*) as integer) as affected_finding_count,
 max(detected_at) as detected_at
from (select *, row_number() over (partition by recommendation_id order by {_SEEN}) as first,
 row_number() over (partition by recommendation_id order by risk_rank desc, {_SEEN}) as riskiest from keyed)
group by recommendation_id, model_id"""

CTE["recommendation_links"] = f"""
select distinct '{SCAN}' as analysis_id, model_id as semantic_model_id, opportunity_id,
 recommendation_id as related_entity_id from keyed"""

CTE["finding_links"] = f"""
select '{SCAN}' as analysis_id, model_id as semantic_model_id, opportunity_id, finding_id as related_entity_id
from keyed"""

CTE["curated_findings"] = """
select finding_id, scan_id as analysis_id, workspace_name, model_id as semantic_model_id,
 model_name as semantic_model_name, source as finding_source, domain as optimization_domain, rule_name, severity,
 confidence, impact_area, object_type as affected_object_type, table_name as affected_table_name,
 object_name as affected_object_name, finding_text as finding_description, recommended_action, technical_evidence,
 estimated_saving_bytes_low, estimated_saving_bytes_high, change_risk, validation_required, detected_at
from keyed"""

CTE["column_storage"] = """
select evidence_id as column_storage_record_id, scan_id as analysis_id, workspace_name, model_id as semantic_model_id,
 model_name as semantic_model_name, table_name, column_name, data_type, encoding, cardinality, data_size_bytes,
 dictionary_size_bytes, hierarchy_size_bytes, total_size_bytes, model_size_pct as percentage_of_semantic_model_size,
 detected_at
from column_rows where overall_status in ('SUCCEEDED', 'PARTIAL')"""

CTE["overview_counts"] = """
select u.*,
 (select count(distinct opportunity_id) from keyed k where k.model_id = u.model_id) as n_opp,
 (select count(distinct recommendation_id) from keyed k where k.model_id = u.model_id) as n_rec,
 (select count(*) from keyed k where k.model_id = u.model_id) as n_finding,
 (select count(*) from keyed k where k.model_id = u.model_id and severity in ('HIGH', 'CRITICAL', 'ERROR')) as n_high,
 (select count(*) from refresh_rows r where r.model_id = u.model_id) as n_refresh,
 (select count(*) from usage_rows r where r.model_id = u.model_id) as n_usage,
 (select count(*) from fallback_rows r where r.model_id = u.model_id) as n_fallback,
 (select count(*) from access_rows r where r.model_id = u.model_id) as n_access
from usable u"""

CTE["overview"] = f"""
select '{SCAN}' as analysis_id, workspace_id, workspace_name, model_id as semantic_model_id,
 model_name as semantic_model_name, storage_mode, overall_status as analysis_status, {CLOCK} as analysis_completed_at,
 '2.0.0' as scanner_version, model_size_bytes as semantic_model_size_bytes,
 cast(n_opp as integer) as optimization_opportunity_count, cast(n_rec as integer) as optimization_recommendation_count,
 cast(n_finding as integer) as optimization_finding_count, cast(n_high as integer) as high_severity_finding_count,
 bpa_status as best_practice_analysis_status, vpa_status as storage_analysis_status,
 refresh_status as refresh_history_status, cast(n_refresh as integer) as refresh_history_record_count,
 usage_status as object_usage_analysis_status, cast(n_usage as integer) as object_usage_observation_count,
 direct_lake_status as direct_lake_analysis_status, cast(n_fallback as integer) as direct_lake_observation_count,
 access_snapshot_status as item_access_snapshot_status, cast(n_access as integer) as item_access_record_count,
 coalesce(nullif(concat_ws(' ',
  case when refresh_status = 'SUCCEEDED' and n_refresh = 0 then {lit(M.NOTE_REFRESH_EMPTY)} end,
  case when usage_status = 'SUCCEEDED' and n_usage = 0 then {lit(M.NOTE_USAGE_EMPTY)} end,
  case when direct_lake_status = 'NOT_APPLICABLE' then {lit(M.NOTE_DIRECT_LAKE_NA)}
   when direct_lake_status = 'SUCCEEDED' and n_fallback = 0 then {lit(M.NOTE_DIRECT_LAKE_EMPTY)} end,
  case when access_snapshot_status = 'SUCCEEDED' and n_access = 0 then {lit(M.NOTE_ACCESS_EMPTY)} end), ''),
  {lit(M.NOTE_DEFAULT)}) as data_availability_explanation
from overview_counts"""

_MODEL_ROW = f"""'{SCAN}' as scan_id, workspace_id, workspace_name, model_id, model_name, scope_source,
 '2.0.0' as scanner_version, 'OPPORTUNITY_DISCOVERY' as solution_stage, permission_precheck_status,
 scanner_workspace_role, permission_precheck_message, capacity_id, capacity_name, storage_mode, model_size_bytes,
 overall_status, bpa_status, vpa_status, refresh_status, usage_status, direct_lake_status, access_snapshot_status,
 {CLOCK} as started_at, {CLOCK} as completed_at, 0.0::double as duration_seconds,
 case when gated then cast(json_object('permission_precheck', permission_precheck_message) as varchar)
  when coalesce(bpa_error, refresh_error, vpa_error) is not null then '{{' || concat_ws(',',
   '"bpa":' || to_json(bpa_error), '"refresh":' || to_json(refresh_error), '"vpa":' || to_json(vpa_error)) || '}}'
  end as error_json"""


def with_ctes(query: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the CTEs it needs, in dependency order."""
    available = {**CTE, **(extra or {})}
    pattern = re.compile(r"\b(?:from|join)\s+\(*\s*(" + "|".join(available) + r")\b")
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in pattern.findall(sql):
            if name not in ordered:
                visit(available[name])
                if name not in ordered:
                    ordered.append(name)

    visit(query)
    if not ordered:
        return query.strip()
    # Read more than once; computing them once keeps the check quick.
    body = ",\n".join(f"{n} as materialized ({available[n].strip()})" for n in ordered)
    return f"with {body}\n{query.strip()}"


ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, extra: dict[str, str] | None = None) -> None:
    ORACLES[name] = with_ctes(sql, extra)


def plain(name: str, table: str, columns: list[str] | str = "*") -> None:
    oracle(name, f"select {columns if isinstance(columns, str) else ', '.join(columns)} from {table}")


# ---- targets over the estate: nations are workspaces, customers models, suppliers principals -----

CTE["estate_matches"] = f"""
select {guid('s_nationkey')} as workspace_id, s_suppkey as source_ordinal,
 case when s_suppkey % 2 = 1 then concat('Workspace ', s_nationkey) end as name,
 case when s_suppkey % 3 = 0 then 'user' when s_suppkey % 3 = 1 then 'serviceprincipal' else 'app' end as kind,
 case when s_suppkey % 4 = 1 then '{SCANNER}' end as scanner,
 case s_suppkey % 5 when 0 then 'Viewer' when 1 then 'member' when 2 then 'Admin' end as role
from supplier"""
CTE["estate_first"] = """
select workspace_id, min(source_ordinal) as at from estate_matches
where kind in ('serviceprincipal', 'app') and scanner is not null group by workspace_id"""
CTE["estate_precheck"] = f"""
select w.workspace_id,
 case when f.at is null then 'FAILED_NOT_IN_WORKSPACE' when upper(m.role) in {ROLES} then 'PASSED'
  else 'FAILED_INSUFFICIENT_ROLE' end as permission_precheck_status,
 (select arg_min(name, source_ordinal) from estate_matches n where n.workspace_id = w.workspace_id
  and n.name is not null and (f.at is null or n.source_ordinal <= f.at)) as access_workspace_name,
 m.role as scanner_workspace_role,
 case when f.at is null then 'The scanner SPN was not found as a direct principal in the target workspace.'
  when upper(m.role) in {ROLES} then concat('Scanner SPN has accepted workspace role: ', m.role, '.')
  else concat('Scanner SPN role ''', coalesce(m.role, 'UNKNOWN'), ''' is not in {ROLES_SHOWN}.')
  end as permission_precheck_message
from (select {guid('n_nationkey')} as workspace_id from nation) w
left join estate_first f on f.workspace_id = w.workspace_id
left join estate_matches m on m.workspace_id = f.workspace_id and m.source_ordinal = f.at"""
CTE["estate_models"] = f"""
select {guid('c_nationkey')} as workspace_id, coalesce(p.access_workspace_name, n_name) as workspace_name,
 {guid('c_custkey + 100000')} as model_id, c_custkey,
 case when c_custkey % 100 = 7 then ' fabric CAPACITY metrics ' else c_name end as model_name,
 c_custkey % 9 = 4 as is_default, permission_precheck_status, scanner_workspace_role, permission_precheck_message
from customer join nation on c_nationkey = n_nationkey
join estate_precheck p on p.workspace_id = {guid('c_nationkey')}"""
_TARGET = (
    "workspace_id, workspace_name, model_id, model_name, '{0}' as scope_source, permission_precheck_status, "
    "scanner_workspace_role, permission_precheck_message"
)
plain("workspace_precheck", "estate_precheck")
oracle(
    "targets_resolved",
    f"select {_TARGET.format('WORKSPACE')} from estate_models "
    "where c_custkey % 100 <> 7 and not (permission_precheck_status = 'PASSED' and is_default)",
)
oracle(
    "targets_requested_models",
    f"select {_TARGET.format('MODEL')} from estate_models "
    "where c_custkey between 10 and 49 and not (permission_precheck_status = 'PASSED' and is_default)",
)

# ---- evidence and findings -----------------------------------------------------------------------

plain("bpa_findings", "f_bpa", FINDING_COLUMNS)
plain("vpa_column_rows", "column_rows", "* exclude (workspace_name, model_name, overall_status)")
plain("vpa_table_rows", "table_rows")
oracle(
    "storage_findings_topk",
    f"select {', '.join(FINDING_COLUMNS)} from (select *, row_number() over (partition by model_id "
    "order by reclaimable_upper_bound_bytes desc, table_name, object_name) as nth from f_vpa) where nth <= 30",
)
plain("usage_rows", "usage_rows", "* exclude (workspace_name, model_name)")
plain("unused_objects", "fx_usage")
plain("unused_findings", "f_usage", FINDING_COLUMNS)
plain("refresh_latest", "refresh_rows where n <= 20", "* exclude (n)")
plain("direct_lake_checks", "fallback_rows", "* exclude (workspace_name, model_name, source_ordinal)")
plain("fallback_findings", "f_fallback", FINDING_COLUMNS)
plain("access_snapshot", "access_rows")
oracle(
    "storage_mode",
    "select model_id, storage_mode, contains(replace(lower(storage_mode), ' ', ''), 'directlake') as is_direct_lake "
    "from modes",
)

# ---- model and run rows --------------------------------------------------------------------------

oracle(
    "model_scan_rows",
    f"""select {_MODEL_ROW}, cast(coalesce(n, 0) as integer) as finding_count
from states left join (select model_id, count(*) as n from all_findings group by model_id) using (model_id)""",
)
# The scan before: user mode, no stage failed.
CTE["prior_targets"] = """
select workspace_id, workspace_name, model_id, model_name from fx_inventory
where model_name <> 'ModelBPA' and not is_default_model"""
oracle(
    "dim_model_latest",
    f"""select s.model_id, s.workspace_id, s.workspace_name, s.model_name, s.capacity_id, s.capacity_name,
 s.storage_mode, '{SCAN}' as latest_scan_id, s.overall_status as last_scan_status, {CLOCK} as last_scanned_at
from states s
union all
select p.model_id, p.workspace_id, p.workspace_name, p.model_name, p.workspace_id, p.workspace_name,
 coalesce(m.storage_mode, 'UNKNOWN'), '{PRIOR}', 'SUCCEEDED', {PRIOR_CLOCK}
from prior_targets p left join modes m using (model_id) where p.model_id not in (select model_id from states)""",
)
_PARAMETERS = json.dumps(scan_config().safe_parameters(), sort_keys=True, ensure_ascii=False)
_RUN_ROW = f"""select '{SCAN}' as scan_id, '{SCAN}' as request_id, 'owner@example.com' as requested_by_upn,
 'spn_secret' as auth_mode, 'deep' as analysis_profile, '2.0.0' as scanner_version,
 'OPPORTUNITY_DISCOVERY' as solution_stage,
 case when k > 0 then 'FAILED' when f + p > 0 then 'PARTIAL' else 'SUCCEEDED' end as status, {CLOCK} as started_at,
 {CLOCK} as completed_at, cast(n as integer) as target_count, cast(s as integer) as success_count,
 cast(p as integer) as partial_count, cast(f as integer) as failed_count, cast(k as integer) as skipped_count,
 'UNKNOWN' as semantic_link_version, 'UNKNOWN' as semantic_link_labs_version,
 sha256({lit(_PARAMETERS)}) as parameters_hash, case when k > 0 then 'AUTHORIZATION' end as error_category,
 case when k > 0 then concat(k, ' model(s) skipped because the SPN workspace access precheck did not pass.') end
  as error_message, cast(w as integer) as workspace_count
from (select count(*) as n, count(distinct workspace_id) as w, count(*) filter (overall_status = 'SUCCEEDED') as s,
 count(*) filter (overall_status = 'PARTIAL') as p, count(*) filter (overall_status = 'FAILED') as f,
 count(*) filter (overall_status = 'SKIPPED_PERMISSION') as k from states)"""
oracle("run_rollup", _RUN_ROW)
oracle(
    "run_summary_json",
    f"""select '{SCAN}' as scan_id, cast(to_json(struct_pack(scan_id := '{SCAN}', request_id := '{SCAN}',
 status := case when k > 0 then 'FAILED' when f + p > 0 then 'PARTIAL' else 'SUCCEEDED' end, target_count := n,
 success_count := s, partial_count := p, failed_count := f, skipped_count := k, duration_seconds := 0.0::double,
 model_results := entries, error := cast(null as varchar))) as varchar) as summary_json
from (select count(*) as n, count(*) filter (overall_status = 'SUCCEEDED') as s,
 count(*) filter (overall_status = 'PARTIAL') as p, count(*) filter (overall_status = 'FAILED') as f,
 count(*) filter (overall_status = 'SKIPPED_PERMISSION') as k,
 list(struct_pack(workspace_id := workspace_id, model_id := model_id, model_name := model_name,
  status := overall_status, permission_precheck_status := permission_precheck_status,
  scanner_workspace_role := scanner_workspace_role, finding_count := coalesce(finding_count, 0))
  order by workspace_id, model_id) as entries
 from states left join (select model_id, count(*) as finding_count from all_findings group by model_id)
  using (model_id))""",
)

# ---- current state -------------------------------------------------------------------------------

for _name in ("opportunities", "recommendations", "curated_findings", "column_storage", "overview"):
    plain(_name, _name)
plain("opportunity_recommendation_links", "recommendation_links")
plain("opportunity_finding_links", "finding_links")

_MB = "coalesce({0} / 1048576.0::double, 0)"


def measures_sql(findings: str, high: str, overview: str, columns: str, others: str) -> str:
    return f"""
select (select count(distinct semantic_model_id) from overview where {overview}) as models_scanned,
 (select max(analysis_completed_at) from overview where {overview}) as latest_analysis_at,
 (select count(*) from opportunities where {others}) as total_opportunities,
 (select count(*) from recommendations where {others}) as total_recommendations,
 (select count(*) from column_storage where {columns}) as columns_analyzed,
 (select {_MB.format('cast(sum(total_size_bytes) as double)')} from column_storage where {columns})
  as total_column_storage_mb,
 (select count(*) from curated_findings where {findings}) as total_findings,
 (select count(*) from curated_findings where {high}) as high_findings,
 (select {_MB.format('cast(sum(estimated_saving_bytes_low) as double)')} from curated_findings where {findings})
  as estimated_saving_mb_low,
 (select {_MB.format('cast(sum(estimated_saving_bytes_high) as double)')} from curated_findings where {findings})
  as estimated_saving_mb_high"""


_HIGH = "severity in ('HIGH', 'CRITICAL', 'ERROR')"
oracle("measures", measures_sql("true", _HIGH, "true", "true", "true"))
_KEPT = "semantic_model_id in (select semantic_model_id from overview where analysis_status = 'SUCCEEDED')"
oracle(
    "measures_sliced",
    measures_sql(
        f"severity = 'WARNING' and {_KEPT}",
        f"{_HIGH} and {_KEPT}",
        "analysis_status = 'SUCCEEDED'",
        f"data_type = 'DateTime' and {_KEPT}",
        _KEPT,
    ),
)

# ---- report --------------------------------------------------------------------------------------

oracle(
    "report_optimization_kpis",
    f"""select (select count(distinct semantic_model_id) from overview) as models_scanned,
 (select count(*) from opportunities) as total_opportunities, (select count(*) from curated_findings) as total_findings,
 (select count(*) from curated_findings where {_HIGH}) as high_findings""",
)
oracle(
    "report_opportunities_table",
    "select distinct semantic_model_name, opportunity_title, highest_severity, optimization_domain, finding_count, "
    "recommendation_count, opportunity_summary from opportunities",
)
oracle(
    "report_top_columns",
    f"select column_name, {_MB.format('cast(sum(total_size_bytes) as double)')} as total_column_storage_mb "
    "from column_storage group by column_name",
)
for _name, _table, _columns in [
    (
        "analysis_coverage", "overview",
        "workspace_name, semantic_model_name, analysis_status, refresh_history_status, object_usage_analysis_status, "
        "direct_lake_analysis_status, data_availability_explanation",
    ),
    ("severity_slicer", "opportunities", "highest_severity"),
    ("domain_slicer", "opportunities", "optimization_domain"),
    (
        "recommendations_table", "recommendations",
        "semantic_model_name, recommendation_title, recommended_action, change_risk, affected_finding_count",
    ),
    ("risk_slicer", "recommendations", "change_risk"),
    ("finding_severity_slicer", "curated_findings", "severity"),
    (
        "findings_table", "curated_findings",
        "semantic_model_name, severity, rule_name, affected_object_name, finding_description",
    ),
    ("storage_model_slicer", "column_storage", "semantic_model_name"),
    (
        "storage_table", "column_storage",
        "semantic_model_name, table_name, column_name, data_type, cardinality, total_size_bytes, "
        "percentage_of_semantic_model_size",
    ),
]:
    oracle(f"report_{_name}", f"select distinct {_columns} from {_table}")
for _name, _table, _category, _measure in [
    ("findings_by_severity", "curated_findings", "severity", "total_findings"),
    ("recommendations_by_domain", "recommendations", "optimization_domain", "total_recommendations"),
    ("findings_by_rule", "curated_findings", "rule_name", "total_findings"),
]:
    oracle(f"report_{_name}", f"select {_category}, count(*) as {_measure} from {_table} group by {_category}")
oracle(
    "report_top_columns_displayed",
    "select column_name, format('{:,.2f}', cast(sum(total_size_bytes) as double) / 1048576.0::double) "
    "as total_column_storage_mb from column_storage group by column_name",
)
oracle(
    "opportunity_navigation",
    """select o.opportunity_id, o.semantic_model_name, o.opportunity_title, o.highest_severity, l.related_kind,
 l.related_entity_id, l.related_title, l.link_count
from (
 select k.opportunity_id, 'recommendation' as related_kind, k.related_entity_id, r.recommendation_title as related_title,
  1::bigint as link_count
 from recommendation_links k join recommendations r on r.recommendation_id = k.related_entity_id
 union all
 select k.opportunity_id, 'finding', k.related_entity_id, k.rule_name, count(*)
 from (select opportunity_id, finding_id as related_entity_id, rule_name from keyed) k group by all) l
join opportunities o on o.opportunity_id = l.opportunity_id""",
)

# ---- table updates -------------------------------------------------------------------------------

_HISTORY = ["finding_id", "scan_id", "model_id", "rule_name", "severity", "object_type", "scanner_version", "detected_at"]
CTE["new_history"] = f"""
select * from f_bpa"""
CTE["prior_bpa"] = f"""
select {sha(lit(PRIOR), 'b.model_id', "'BPA'", 'b.rule_name', 'b.table_name', 'b.object_name')} as finding_id,
 '{PRIOR}' as scan_id, b.model_id, b.rule_name,
 case when {_bpa_severity} in ('INFO', 'WARNING', 'ERROR') then {_bpa_severity} else 'WARNING' end as severity,
 b.object_type, '2.0.0' as scanner_version, b.detected_at
from fx_bpa b where b.model_id in (select model_id from prior_targets)"""
oracle(
    "upsert_finding_history",
    f"select {', '.join(_HISTORY)} from prior_bpa union all select {', '.join(_HISTORY)} from new_history",
)
oracle(
    "replace_current_state",
    f"""select column_storage_record_id, analysis_id, semantic_model_id, table_name, column_name, total_size_bytes
from column_storage
union all
select {sha(lit(PRIOR), 'v.model_id', "'VPA_COLUMN'", 'v.table_name', 'v.column_name')}, '{PRIOR}', v.model_id,
 v.table_name, v.column_name, v.total_size
from fx_vpa v where v.model_id in (select model_id from prior_targets)
 and v.model_id not in (select model_id from usable)""",
)
# ---- stored tables -------------------------------------------------------------------------------

# Models whose refresh history was never collected have no outcome for it.
CTE["landed_states"] = f"""
select * replace (
 case when not gated and missed then 'NOT_RUN' else overall_status end as overall_status,
 case when not gated and missed then 'NOT_RUN' else refresh_status end as refresh_status,
 case when missed then 'The stage has no landed outcome.' else refresh_error end as refresh_error)
from (select s.*, (n_nationkey % 7 = 3 and n_nationkey % 9 <> 1) as missed
 from states s join nation on {model('n_nationkey')} = s.model_id)"""
oracle(
    "landed_model_scan_rows",
    f"""select {_MODEL_ROW}, cast(coalesce(n, 0) as integer) as finding_count
from landed_states left join (select model_id, count(*) as n from all_findings group by model_id) using (model_id)""",
)
oracle(
    "published_column_storage",
    f"""select c.* from column_storage c join landed_states s on s.model_id = c.semantic_model_id
where s.overall_status in ('SUCCEEDED', 'PARTIAL')
union all by name
select {sha(lit(PRIOR), 'v.model_id', "'VPA_COLUMN'", 'v.table_name', 'v.column_name')} as column_storage_record_id,
 '{PRIOR}' as analysis_id, p.workspace_name, v.model_id as semantic_model_id, p.model_name as semantic_model_name,
 v.table_name, v.column_name, v.data_type, v.encoding, v.cardinality, v.data_kb * 1024 as data_size_bytes,
 v.dictionary_size as dictionary_size_bytes, cast(null as bigint) as hierarchy_size_bytes,
 v.total_size as total_size_bytes,
 case when z.model_size_bytes > 0 then 100.0::double * v.total_size / z.model_size_bytes end
  as percentage_of_semantic_model_size, {PRIOR_CLOCK} as detected_at
from fx_vpa v join prior_targets p using (model_id) left join fx_size z using (model_id)
where v.model_id not in (select model_id from landed_states where overall_status in ('SUCCEEDED', 'PARTIAL'))""",
)
oracle(
    "stored_run_rows",
    """select * exclude (workspace_count) from ended
union all
select * replace ('RUNNING' as status, null as completed_at, null as error_category, null as error_message,
 0 as success_count, 0 as partial_count, 0 as failed_count, 0 as skipped_count)
from (select * exclude (workspace_count) from ended)""",
    {"ended": _RUN_ROW},
)
CTE["held_grants"] = f"""
select a.model_id, lower(a.principal_upn) as principal_upn,
 case when a.source_ordinal % 2 = 0 then 'SCAN_REQUEST_EXPLICIT' else 'MANUAL' end as source,
 a.source_ordinal % 5 <> 0 as is_active
from fx_item_access a where a.principal_upn is not null"""
CTE["asked_grants"] = f"""
select distinct a.model_id, t.workspace_id, concat(lower(a.principal_name), '@example.com') as principal_upn
from fx_item_access a join targets t using (model_id)
where t.permission_precheck_status = 'PASSED' and (a.source_ordinal % 12 = 0 or a.source_ordinal % 3 = 1)"""
CTE["asked_models"] = """
select distinct a.model_id from fx_item_access a join targets t using (model_id)
where t.permission_precheck_status = 'PASSED'"""
oracle(
    "access_grants_sync",
    f"""select {sha('model_id', 'principal_upn', "'SCAN_REQUEST_EXPLICIT'")} as access_key, workspace_id, model_id,
 principal_upn, 'SCAN_REQUEST_EXPLICIT' as source, true as is_active, {CLOCK} as valid_from,
 cast(null as timestamp) as valid_to, 'owner@example.com' as updated_by, {CLOCK} as updated_at
from asked_grants
union all
select access_key, workspace_id, model_id, principal_upn, source, is_active and not ends, {PRIOR_CLOCK},
 case when ends then {CLOCK} end, 'previous@example.com', case when ends then {CLOCK} else {PRIOR_CLOCK} end
from (
 select {sha('h.model_id', 'h.principal_upn', 'h.source')} as access_key, i.workspace_id, h.*,
  h.source = 'SCAN_REQUEST_EXPLICIT' and h.is_active and h.model_id in (select model_id from asked_models)
   and g.model_id is null as ends
 from held_grants h join fx_inventory i using (model_id)
 left join asked_grants g on g.model_id = h.model_id and g.principal_upn = h.principal_upn
 where not (h.source = 'SCAN_REQUEST_EXPLICIT' and g.model_id is not null))""",
)

# ---- profile and checks over the sample tables -----------------------------------------------------


def _profile_sql() -> str:
    parts = []
    for table, ddl in SAMPLE_SCHEMAS.items():
        for column in ddl.split(", "):
            name, kind = column.split(" ")
            text, width = f"cast({name} as varchar)", "octet_length(encode(v))"
            if kind == "array<float>":
                text, width = name, "4 * len(v)"
            if kind == "double":
                text = f"case when {name} = 0 then '0.0' else {text} end"
            parts.append(
                f"select '{table}' as table_name, '{name}' as column_name, '{kind}' as data_type, "
                f"sum(n) as row_count, coalesce(sum(n) filter (v is null), 0) as null_count, "
                f"count(v) as cardinality, coalesce(sum({width}), 0) as dictionary_size_bytes "
                f"from (select {text} as v, count(*) as n from {table} group by 1)"
            )
    return "\nunion all\n".join(parts)


CTE["profile_counts"] = _profile_sql()
CTE["profile"] = """
select 'sample-model' as model_id, table_name, column_name, data_type, cast(row_count as bigint) as row_count,
 cast(null_count as bigint) as null_count, cardinality,
 cast((row_count * length(bin(greatest(cardinality, 2) - 1)) + 7) // 8 as bigint) as data_size_bytes,
 cast(dictionary_size_bytes as bigint) as dictionary_size_bytes, cast(null as bigint) as hierarchy_size_bytes,
 cast((row_count * length(bin(greatest(cardinality, 2) - 1)) + 7) // 8 + dictionary_size_bytes as bigint)
  as total_size_bytes
from profile_counts"""
oracle(
    "column_profile",
    "select *, 100.0::double * total_size_bytes / cast(sum(total_size_bytes) over () as double) as model_size_pct "
    "from profile",
)
oracle(
    "rule_evaluation",
    """select model_id, r.rule as "Rule Name", 'Column' as "Object Type", table_name as "Table Name",
 column_name as "Object Name", r.category as "Category", r.severity as "Severity", r.description as "Description"
from profile, (values
 ('Constant column', 'Performance', 'Warning', 'Remove the column or replace it by a constant.'),
 ('Mostly empty column', 'Maintenance', 'Info', 'Check whether the column is still filled.'),
 ('Floating-point key', 'Performance', 'Error', 'Use an integer or decimal type for a column of unique values.'),
 ('Wide text column', 'Performance', 'Warning', 'Move long texts out of the model or shorten them.'))
 r(rule, category, severity, description)
where case r.rule when 'Constant column' then cardinality = 1 and null_count = 0 and row_count > 1
 when 'Mostly empty column' then null_count >= 0.9 * row_count
 when 'Floating-point key' then data_type = 'double' and cardinality = row_count and row_count > 1
 else data_type = 'string' and dictionary_size_bytes > 64 * cardinality end""",
)

oracle(
    "stored_profile",
    "select table_name, column_name, data_type, row_count, null_count, true as cardinality_near from profile",
)

oracle(
    "landed_rule_evaluation",
    """select model_id, r.rule as "Rule Name", 'Column' as "Object Type", table_name as "Table Name",
 column_name as "Object Name", r.category as "Category", r.severity as "Severity", r.description as "Description"
from profile, (values
 ('Constant column', 'Performance', 'Warning', 'Remove the column or replace it by a constant.'),
 ('Mostly empty column', 'Maintenance', 'Info', 'Check whether the column is still filled.'),
 ('Floating-point key', 'Performance', 'Error', 'Use an integer or decimal type for a column of unique values.'),
 ('Wide text column', 'Performance', 'Warning', 'Move long texts out of the model or shorten them.'),
 ('Dictionary outweighs data', 'Performance', 'Warning', 'Values are long for how often they repeat.'),
 ('Small category', 'Maintenance', 'Info', 'Consider a lookup table.'))
 r(rule, category, severity, description)
where case r.rule when 'Constant column' then cardinality = 1 and null_count = 0 and row_count > 1
 when 'Mostly empty column' then null_count >= 0.9 * row_count
 when 'Floating-point key' then data_type = 'double' and cardinality = row_count and row_count > 1
 when 'Wide text column' then data_type = 'string' and dictionary_size_bytes > 64 * cardinality
 when 'Dictionary outweighs data' then dictionary_size_bytes > 2 * data_size_bytes and cardinality >= 10
 else data_type = 'string' and 100 * (cardinality - 1) <= row_count and null_count < 1 end""",
)

KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey,l_linenumber", "events": "event_id",
    "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id",
    "conversations": "conv_id,turn",
}
_CURATED_KEYS = {
    "overview": ("overview", "semantic_model_id"), "opportunities": ("opportunities", "opportunity_id"),
    "recommendations": ("recommendations", "recommendation_id"), "findings": ("curated_findings", "finding_id"),
    "column_storage": ("column_storage", "column_storage_record_id"),
}


def _key_sql(shown: str, table: str, keys: str) -> str:
    return (
        f"select '{shown}' as table_name, '{keys}' as key_columns, cast(sum(n) as bigint) as row_count, "
        f"count(*) as distinct_keys, count(*) filter (n > 1) as duplicate_keys, "
        f"cast(coalesce(sum(n - 1) filter (n > 1), 0) as bigint) as surplus_rows "
        f"from (select {keys}, count(*) as n from {table} group by {keys})"
    )


oracle("key_uniqueness", "\nunion all\n".join(_key_sql(n, t, k) for n, (t, k) in _CURATED_KEYS.items()))
oracle("table_key_uniqueness", "\nunion all\n".join(_key_sql(t, t, k) for t, k in KEYS.items()))

FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("events", "user_id", "customer", "c_custkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]
_CURATED_FOREIGN_KEYS = [
    ("opportunities", "opportunities", "semantic_model_id", "overview", "overview", "semantic_model_id"),
    ("recommendations", "recommendations", "semantic_model_id", "overview", "overview", "semantic_model_id"),
    ("findings", "curated_findings", "semantic_model_id", "overview", "overview", "semantic_model_id"),
    ("column_storage", "column_storage", "semantic_model_id", "overview", "overview", "semantic_model_id"),
    (
        "opportunity_recommendation_links", "recommendation_links", "opportunity_id", "opportunities", "opportunities",
        "opportunity_id",
    ),
    (
        "opportunity_finding_links", "finding_links", "opportunity_id", "opportunities", "opportunities",
        "opportunity_id",
    ),
]


def _foreign_sql(child: str, table: str, column: str, parent: str, parent_table: str, parent_column: str) -> str:
    orphan = f"c.{column} not in (select {parent_column} from {parent_table})"
    return (
        f"select '{child}' as child_table, '{column}' as child_column, '{parent}' as parent_table, "
        f"'{parent_column}' as parent_column, count(*) as child_rows, count(*) filter ({orphan}) as orphan_rows, "
        f"count(distinct c.{column}) filter ({orphan}) as orphan_keys from {table} c where c.{column} is not null"
    )


oracle("relationship_integrity", "\nunion all\n".join(_foreign_sql(*r) for r in _CURATED_FOREIGN_KEYS))
oracle(
    "table_relationship_integrity",
    "\nunion all\n".join(_foreign_sql(c, c, k, p, p, q) for c, k, p, q in FOREIGN_KEYS),
)


def _contract_sql() -> str:
    shown = lambda x: lit(x) if x else "cast(null as varchar)"
    parts = []
    for table, declared in EXPECTED_COLUMNS.items():
        actual = dict(c.split(" ") for c in SAMPLE_SCHEMAS[table].split(", "))
        for name in dict.fromkeys([*declared, *actual]):
            kind, required = declared.get(name, (None, False))
            have = actual.get(name)
            status = "MISSING" if have is None else "EXTRA" if kind is None else "OK" if kind == have else "TYPE"
            nulls = f"count(*) - count({name})" if required and have else "0::bigint"
            parts.append(
                f"select '{table}' as table_name, count(*) as row_count, '{name}' as column_name, "
                f"{shown(kind)} as declared_type, {shown(have)} as actual_type, '{status}' as status, "
                f"{nulls} as null_rows from {table}"
            )
    return "\nunion all\n".join(parts)


oracle("schema_contract", _contract_sql())

# Table, then of each place: name, declared type, stored type, status, reason; a * marks required places.
CONTRACT_VERDICTS = {
    "region": "r_regionkey* int int OK -; r_name* string string OK -",
    "nation": "n_nationkey* int int OK -; n_name* string string OK -; n_regionkey* bigint int WIDENED narrower",
    "customer": "c_custkey* bigint bigint OK -; c_name* string string OK -; c_nationkey* bigint int WIDENED narrower; "
    "c_phone string - OK absent; c_acctbal double double OK -; c_mktsegment - string OK undeclared",
    "supplier": "s_suppkey* bigint bigint OK -; s_name* string string OK -; s_nationkey* int int OK -; "
    "s_acctbal decimal(12,2) double BROKEN type",
    "part": "p_partkey* bigint bigint OK -; p_name string string OK -; p_brand string string OK -; "
    "p_type string string OK -; p_size bigint int WIDENED narrower; p_retailprice double double OK -",
    "orders": "o_orderkey* bigint bigint OK -; o_custkey* bigint bigint OK -; o_orderstatus - string OK undeclared; "
    "o_totalprice* double double OK -; o_orderdate* date timestamp_ntz BROKEN type; o_orderpriority - string OK undeclared",
    "lineitem": "l_orderkey* bigint bigint OK -; l_partkey - bigint OK undeclared; l_suppkey - bigint OK undeclared; "
    "l_linenumber* decimal(10,0) int WIDENED narrower; l_quantity* double double OK -; "
    "l_extendedprice - double OK undeclared; l_discount - double OK undeclared; l_tax - double OK undeclared; "
    "l_returnflag - string OK undeclared; l_linestatus - string OK undeclared; "
    "l_shipdate - timestamp_ntz OK undeclared; l_shipmode string - BROKEN missing",
    "events": "event_id* bigint bigint OK -; ts* timestamp_ntz timestamp_ntz OK -; user_id int bigint BROKEN type; "
    "event_type* string string OK -; value* double double OK -; props* string string OK -",
    "documents": "doc_id* bigint bigint OK -; text* string string OK -; lang* string string OK -; "
    "source* string string OK -; n_chars* bigint bigint OK -",
    "embeddings": "vec_id* bigint bigint OK -; embedding* array array OK -; "
    "embedding.element double float WIDENED narrower; label int int OK -",
    "pages": "page_id* bigint bigint OK -; url* string string OK -; html* string string OK -",
    "benchmark": "item_id* bigint bigint OK -; text* string string OK -",
    "labels": "doc_id* bigint bigint OK -; quality* bigint int WIDENED narrower; toxic* int int OK -",
    "conversations": "conv_id* bigint bigint OK -; turn* bigint bigint OK -; role* string string OK -; text* string string OK -",
}


def _contract_check_sql() -> str:
    shown = lambda x: "cast(null as varchar)" if x == "-" else lit(x)
    parts = []
    for table, rows in CONTRACT_VERDICTS.items():
        for row in rows.split("; "):
            name, declared, actual, status, reason = row.split(" ")
            path = name.rstrip("*")
            nulls = f"count(*) - count({path})" if name.endswith("*") else "0::bigint"
            null_decides = f"{nulls} > 0 and '{status}' <> 'BROKEN'"
            parts.append(
                f"select '{table}' as table_name, 2 as contract_version, count(*) as row_count, '{path}' as column_path, "
                f"{shown(declared)} as declared_type, {shown(actual)} as actual_type, "
                f"case when {null_decides} then 'BROKEN' else '{status}' end as status, "
                f"case when {null_decides} then 'nulls' else '{'' if reason == '-' else reason}' end as reason, "
                f"{nulls} as null_values from {table}"
            )
    return "\nunion all\n".join(parts)


oracle("contract_check", _contract_check_sql())

oracle(
    "error_triage",
    """select error_category, is_retryable, count(*) as error_count
from (select *, error_category in ('THROTTLING', 'TIMEOUT') or regexp_matches(message, '50[0234]') as is_retryable
 from (select message, case when regexp_matches(lower(message), '401|unauthorized|authentication') then 'AUTHENTICATION'
   when regexp_matches(lower(message), '403|forbidden|readwrite|permission|not authorized') then 'AUTHORIZATION'
   when regexp_matches(lower(message), '429|throttl|too many requests') then 'THROTTLING'
   when regexp_matches(lower(message), 'timeout|timed out') then 'TIMEOUT'
   when regexp_matches(lower(message), 'not found|doesn''t exist|does not exist') then 'NOT_FOUND'
   else 'ANALYSIS_ERROR' end as error_category
  from (select case event_id % 6 when 0 then 'HTTP 401 Unauthorized' when 1 then '403 Forbidden'
    when 2 then '429 Too Many Requests' when 3 then 'operation timed out' when 4 then 'item does not exist'
    else 'boom 503' end as message from events where event_type = 'error')))
group by error_category, is_retryable""",
)
