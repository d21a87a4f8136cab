"""Alerts with cooldown, and streams with state: each stream's result is that of its batch twin."""

from pyspark.sql import functions as F

from ..operators import alerts, align, events as ev
from ..operators.alerts import Rule
from ..streaming import rollups as st, stateful
from .base import OBS, events, obs, q
from .q_windows import states

RULES = [Rule("value", 90.0, 2.0, 70.0, 5.0, 86_400), Rule("k", 95.0, None, 80.0, 10.0, 43_200)]
# The order in which the bounds of a rule are tried.
HIT = """CASE WHEN {v} >= {critical} THEN 'critical' WHEN {v} <= {low} THEN 'critical' WHEN {v} >= {warning} THEN 'warning' WHEN {v} <= {calm} THEN 'warning' END"""
SIDE = """CASE WHEN {v} >= {critical} THEN 'above' WHEN {v} <= {low} THEN 'below' WHEN {v} >= {warning} THEN 'above' WHEN {v} <= {calm} THEN 'below' END"""
BOUND = """CASE WHEN {v} >= {critical} THEN {critical} WHEN {v} <= {low} THEN {low} WHEN {v} >= {warning} THEN {warning} WHEN {v} <= {calm} THEN {calm} END"""
V = {"v": "value", "critical": 90, "low": 2, "warning": 70, "calm": 5}
K = {"v": "k", "critical": 95, "low": -1, "warning": 80, "calm": 10}  # k is never below 0, as its rule has no such bound
READ = f"(SELECT event_id, user_id, ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM {OBS})"
HITS = f"""SELECT event_id, user_id, ts, value, k, {HIT.format(**V)} AS vs, {SIDE.format(**V)} AS vd, {BOUND.format(**V)}::DOUBLE AS vt,
{HIT.format(**K)} AS ks, {SIDE.format(**K)} AS kd, {BOUND.format(**K)}::DOUBLE AS kt FROM {READ}"""


def readings(df):
    k = F.get_json_object("props", "$.k").cast("double")
    return df.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value", k.alias("k"))


TEXT = "{f} || ' ' || {s} || ' is ' || {d} || ' ' || {s} || ' threshold (' || printf('%.2f', {f_v}) || CASE {d} WHEN 'above' THEN ' >= ' ELSE ' <= ' END || printf('%.2f', {t}) || ')'"
VALUE_TEXT = TEXT.format(f="'value'", s="vs", d="vd", f_v="value", t="vt")
K_TEXT = TEXT.format(f="'k'", s="ks", d="kd", f_v="k", t="kt")
q(
    "threshold_alerts",
    lambda s, d: alerts.threshold_alerts(readings(obs(s, d)), RULES).select("event_id", "field", "severity", "value", "threshold", "direction", "message"),
    f"""SELECT event_id, CASE WHEN vs IS NOT NULL THEN 'value' ELSE 'k' END AS field, coalesce(vs, ks) AS severity, CASE WHEN vs IS NOT NULL THEN value ELSE k END AS value,
    coalesce(vt, kt) AS threshold, coalesce(vd, kd) AS direction, CASE WHEN vs IS NOT NULL THEN {VALUE_TEXT} ELSE {K_TEXT} END AS message FROM ({HITS}) WHERE vs IS NOT NULL OR ks IS NOT NULL""",
)

# each source's rows in order; what was last alerted by (field, severity) goes along
FREE_V = "h.vs IS NOT NULL AND epoch(h.ts) - CASE h.vs WHEN 'critical' THEN r.vc ELSE r.vw END >= 86400"
FREE_K = "h.ks IS NOT NULL AND epoch(h.ts) - CASE h.ks WHEN 'critical' THEN r.kc ELSE r.kw END >= 43200"
COOLED = f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ({HITS}) WHERE vs IS NOT NULL OR ks IS NOT NULL),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS field, NULL::VARCHAR AS severity, -1e18::DOUBLE AS vc, -1e18::DOUBLE AS vw, -1e18::DOUBLE AS kc, -1e18::DOUBLE AS kw FROM h
UNION ALL SELECT h.user_id, h.n, h.event_id, CASE WHEN {FREE_V} THEN 'value' WHEN {FREE_K} THEN 'k' END, CASE WHEN {FREE_V} THEN h.vs WHEN {FREE_K} THEN h.ks END,
CASE WHEN {FREE_V} AND h.vs = 'critical' THEN epoch(h.ts) ELSE r.vc END, CASE WHEN {FREE_V} AND h.vs = 'warning' THEN epoch(h.ts) ELSE r.vw END,
CASE WHEN NOT ({FREE_V}) AND {FREE_K} AND h.ks = 'critical' THEN epoch(h.ts) ELSE r.kc END, CASE WHEN NOT ({FREE_V}) AND {FREE_K} AND h.ks = 'warning' THEN epoch(h.ts) ELSE r.kw END
FROM r JOIN h ON h.user_id = r.user_id AND h.n = r.n + 1)
SELECT event_id, field, severity FROM r WHERE field IS NOT NULL"""
q("alert_cooldown", lambda s, d: alerts.alert_cooldown(readings(obs(s, d)), RULES, "user_id", "ts", "event_id").select("event_id", "field", "severity"), COOLED)


# Streams come in four turns that are shuffled over the whole time, so rows have to wait for the watermark.
LATE = "60 days"


def turned(df, time="ts"):
    return st.turns(df, 4, "event_id", time)


q(
    "alert_cooldown_stream",
    lambda s, d: st.drain_turns(turned(readings(obs(s, d))), lambda x: alerts.alert_cooldown_stream(x, RULES, "user_id", "ts", "event_id", late=LATE), "cooldown").select("event_id", "field", "severity"),
    COOLED,
)


def split_sources(stream):
    """Views stand for the secondary source, clicks for the primary one."""
    return stream.where("event_type IN ('view', 'click')").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value", (F.col("event_type") == "click").alias("primary"))


SEEN = """SELECT event_id FROM events s WHERE event_type = 'click' OR event_type = 'view' AND (value > 90 OR NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'click' AND p.user_id = s.user_id
AND p.ts <= s.ts AND epoch(s.ts) - epoch(p.ts) < 3600))"""
q(
    "stream_dedup_sources",
    lambda s, d: st.drain_turns(
        turned(split_sources(events(s, d))), lambda x: stateful.dedup_sources(x, ["user_id"], "ts", "event_id", "primary", 3600, F.col("value") > 90, LATE), "sources"
    ).select("event_id"),
    SEEN,
)
q(
    "stream_dedup_sources_composite",
    lambda s, d: st.drain_turns(
        turned(split_sources(events(s, d)).withColumn("metric", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3))),
        lambda x: stateful.dedup_sources(x, ["user_id", "metric"], "ts", "event_id", "primary", 7200, F.col("value") > 90, LATE),
        "sources",
    ).select("event_id"),
    SEEN.replace("p.user_id = s.user_id", "p.user_id = s.user_id AND p.event_id % 3 = s.event_id % 3").replace("3600", "7200"),
)
TRANSITIONS = """SELECT event_id, from_state, to_state FROM (SELECT event_id, ts, lag(s) OVER w AS from_state, s AS to_state FROM (SELECT *, nullif(event_type, 'signup') AS s FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE from_state IS NOT NULL AND from_state IS DISTINCT FROM to_state"""
q(
    "stream_state_transition",
    lambda s, d: st.drain_turns(
        turned(events(s, d).withColumn("event_type", F.expr("nullif(event_type, 'signup')")).withColumn("ts", F.col("ts").cast("timestamp"))),
        lambda x: stateful.state_transitions(x, ["user_id"], "ts", "event_type", "event_id", LATE),
        "states",
    ).select("event_id", "from_state", "to_state"),
    TRANSITIONS,
)
q(
    "state_transitions_since",
    lambda s, d: ev.transitions_since(states(s, d), "user_id", "ts", "event_type", "event_id", "2024-01-20 00:00:00").select("event_id", "from_state", "to_state"),
    TRANSITIONS.replace("WHERE from_state", "WHERE ts >= '2024-01-20' AND from_state"),
)
q(
    "merge_sources_both",
    lambda s, d: align.merge_sources(events(s, d).where("event_type = 'click'"), events(s, d).where("event_type = 'view'"), ["user_id"], "ts", 3600, F.col("value") > 90).select("event_id"),
    """SELECT event_id FROM events s WHERE event_type = 'click' OR event_type = 'view' AND (value > 90 OR NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'click' AND p.user_id = s.user_id
    AND abs(epoch(p.ts) - epoch(s.ts)) < 3600))""",
)
