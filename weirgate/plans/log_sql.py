"""The threat log over `events` as DuckDB SQL, for the queries' oracles."""

from __future__ import annotations

from weirgate.sources.tables import DEMO_RULES, KINDS


def _case(field: int) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower()
    return "case " + " ".join(f"when kind = '{k[0]}' then {quote(k[field])}" for k in KINDS) + " end"


_KIND = "case when event_type = 'signup' and k < 200 then 'bypass' " + " ".join(f"when k < {k[1]} then '{k[0]}'" for k in KINDS) + " end"
_RULE = "case event_id % 7 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(DEMO_RULES)) + " end"

LOGS = f"""
e as (select *, (event_id * 37) % 1000 k from events),
kinds as (select *, {_KIND} kind from e),
logs as (select 'req-' || event_id request_id, '203.0.113.' || (event_id % 40 + 1) client_ip, event_type application_id, ts created_at, value execution_time_ms,
    coalesce({_case(2)}, 'PASSED') action_taken, coalesce({_case(3)}, 'NONE') triggered_layer, coalesce({_case(4)}, false) is_blocked, coalesce({_case(5)}, false) output_flagged,
    (case when kind = 'bypass' then 0 when kind = 'block_l1' then 1000 when kind = 'block_l2' then 860 + event_id % 139
          when kind like '%\\_l3' escape '\\' then 360 + event_id % 480 else event_id % 301 end)::double / 1000.0 risk_score,
    case when kind = 'block_l1' then {_RULE} end pattern, kind = 'bypass' bypassed, kind in ('pass_l3', 'redact_l3', 'block_l3') judged,
    'demo prompt ' || event_id || ' 100%_of\\' || event_type raw_prompt from kinds)
"""

ROLLUP = """
hourly as (select date_trunc('hour', created_at)::timestamp bucket_start, count(*) total_requests, count(*) filter (is_blocked) blocked_requests,
    count(*) filter (is_blocked and triggered_layer = 'LAYER_1') layer_1_blocks, count(*) filter (is_blocked and triggered_layer = 'LAYER_2') layer_2_blocks,
    count(*) filter (is_blocked and triggered_layer = 'LAYER_3') layer_3_blocks, count(*) filter (is_blocked and triggered_layer = 'OUTPUT_SCANNER') output_blocks,
    round(avg(execution_time_ms), 6) avg_latency_ms, round(quantile_cont(execution_time_ms, 0.95), 6) p95_latency_ms from logs group by 1)
"""


def over_logs(select: str) -> str:
    return f"with {LOGS} {select}"


def over_rollup(select: str) -> str:
    return f"with {LOGS}, {ROLLUP} {select}"
