"""Registered queries: brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import dimensions as D, rules as R
from palisade.operators import bruteforce as B
from palisade.plans import oracle as O
from palisade.plans.oracle import NOW, ev, matching, q, qlist
from palisade.plans.q_payload import _advice, _cat, _if, _seen
from palisade.plans.registry import big, joined, query, r6, secs
from palisade.session import truncate_lineage
from palisade.sources import fixtures as fx
from palisade.sources.fixtures import AS_OF

J = O.joined
_OK = " OR ".join(f"regexp_matches(raw_message, {q(p)})" for p in R.SUCCESS_PATTERNS)
_OUTCOME = f"CASE WHEN status_code BETWEEN 200 AND 299 THEN true WHEN status_code BETWEEN 400 AND 599 THEN false ELSE ({_OK}) END"
ATT = f"""
att AS MATERIALIZED (SELECT id, ts, source_ip, "user" AS username, user_agent, raw_message, {_OUTCOME} AS success,
   CASE WHEN contains(source, 'apache') THEN 'apache' WHEN contains(source, 'nginx') THEN 'nginx' WHEN contains(source, 'ssh') THEN 'ssh' ELSE 'web' END AS service
   FROM ev WHERE source_ip IS NOT NULL)"""
_UPTO = "(b.ts < a.ts OR (b.ts = a.ts AND b.id <= a.id))"
_RUN = "ORDER BY ts, id ROWS UNBOUNDED PRECEDING"
IP = f"""
ipw AS (SELECT a.id, count(DISTINCT b.username) AS ip_users FROM att a JOIN att b ON a.source_ip = b.source_ip AND b.ts >= a.ts - INTERVAL 900 SECOND AND {_UPTO} GROUP BY a.id),
ipf AS (SELECT *, row_number() OVER (PARTITION BY source_ip, service ORDER BY ts, id) = 1 AS s1,
   user_agent IS NOT NULL AND row_number() OVER (PARTITION BY source_ip, user_agent ORDER BY ts, id) = 1 AS u1 FROM att),
iph AS MATERIALIZED (SELECT f.id, f.ts, f.source_ip, f.service, f.username, ip_users, count(*) OVER w AS ip_total, count_if(NOT success) OVER w AS ip_failed, count_if(success) OVER w AS ip_success,
   min(ts) OVER w AS ip_first, count_if(s1) OVER w AS ip_services, count_if(u1) OVER w AS ip_agents FROM ipf f JOIN ipw USING (id) WINDOW w AS (PARTITION BY source_ip {_RUN})),
ipb0 AS (SELECT *, ip_failed::DOUBLE / ip_total AS failure_rate, greatest(CAST(floor(epoch_us(ts - ip_first) / 60000000) AS BIGINT), 1) AS span_minutes FROM iph),
ipb1 AS (SELECT *, ip_total::DOUBLE / span_minutes AS per_minute, (ip_agents > 3 OR ip_services > 2) AS is_distributed FROM ipb0),
ipb AS MATERIALIZED (SELECT *, greatest(1.0::DOUBLE - CASE WHEN failure_rate > 0.8::DOUBLE THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN per_minute > 5 THEN 0.3::DOUBLE ELSE 0 END
   - CASE WHEN ip_services > 3 THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN is_distributed THEN 0.1::DOUBLE ELSE 0 END, 0.0::DOUBLE) AS reputation FROM ipb1)"""
USER = f"""
uf AS (SELECT *, row_number() OVER (PARTITION BY username, source_ip ORDER BY ts, id) = 1 AS i1, count_if(NOT success) OVER (PARTITION BY username {_RUN}) AS fails FROM att WHERE username IS NOT NULL),
uh AS MATERIALIZED (SELECT id, username, count(*) OVER w AS user_total, fails AS user_failed, count_if(i1) OVER w AS user_ips, count_if(success AND fails > 0) OVER w > 0 AS user_compromised
   FROM uf WINDOW w AS (PARTITION BY username {_RUN})),
ub AS (SELECT *, (CASE WHEN user_compromised THEN 0.9 WHEN user_failed > 5 THEN 0.7 WHEN user_ips > 3 THEN 0.6 ELSE 0.0 END)::DOUBLE AS compromise_confidence FROM uh)"""
SERVICE = f"""
sw AS (SELECT a.id, count(DISTINCT b.source_ip) AS service_ips, count(DISTINCT b.username) AS service_users, count_if(b.ts > a.ts - INTERVAL 60 SECOND) AS minute
   FROM att a JOIN att b ON a.service = b.service AND b.ts >= a.ts - INTERVAL 900 SECOND AND b.ts <= a.ts AND {_UPTO} GROUP BY a.id),
sh AS MATERIALIZED (SELECT a.id, a.service, count(*) OVER w AS service_total, service_ips, service_users, max(minute) OVER w AS service_peak FROM att a JOIN sw USING (id) WINDOW w AS (PARTITION BY service {_RUN})),
sb AS (SELECT *, (service_peak > 10 OR service_ips > 5 OR service_total > 50) AS under_attack FROM sh)"""
_IND = [
    ("failure_rate > 0.8::DOUBLE", "high_failure_rate", "High", "0.9"), ("per_minute > 5", "high_attempt_rate", "Medium", "0.8"),
    ("ip_services > 2", "multiple_services", "High", "0.7"), ("reputation < 0.3::DOUBLE", "low_reputation", "Critical", "0.8"),
    ("user_compromised", "account_compromise", "Critical", "compromise_confidence"), ("user_ips > 3", "multiple_source_ips", "Medium", "0.7"),
    ("under_attack", "service_under_attack", "High", "0.9"), ("service_peak > 20", "ddos_like_pattern", "Critical", "0.8"),
]
_IND_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN {c} THEN {{'t': '{t}', 's': '{s}', 'c': {v}::DOUBLE}} END" for c, t, s, v in _IND) + "], lambda i: i IS NOT NULL)"
_TERMS = """list_filter([failure_rate * 0.3::DOUBLE, least(per_minute / 10, 1.0::DOUBLE) * 0.25::DOUBLE, CASE WHEN ip_services > 1 THEN 0.2::DOUBLE END, (1 - reputation) * 0.15::DOUBLE,
   CASE WHEN user_compromised THEN compromise_confidence * 0.3::DOUBLE END, CASE WHEN under_attack THEN 0.25::DOUBLE END, CASE WHEN crit > 0 THEN least(crit * 0.1::DOUBLE, 0.3::DOUBLE) END], lambda t: t IS NOT NULL)"""
DETECT = f"""{ATT}, {IP}, {USER}, {SERVICE},
pr0 AS MATERIALIZED (SELECT ipb.*, ub.* EXCLUDE (id, username), sb.* EXCLUDE (id, service) FROM ipb JOIN sb ON ipb.id = sb.id LEFT JOIN ub ON ipb.id = ub.id),
pr1 AS (SELECT *, {_IND_SQL} AS ind FROM pr0),
pr2 AS (SELECT *, len(list_filter(ind, lambda i: i.s = 'Critical')) AS crit, len(list_filter(ind, lambda i: i.s = 'High')) AS high FROM pr1),
pr3 AS (SELECT *, least(list_sum({_TERMS}) / len({_TERMS}), 1.0) AS conf FROM pr2),
pr AS MATERIALIZED (SELECT *, CASE WHEN crit > 0 OR conf >= 0.9 THEN 'Critical' WHEN high > 1 OR conf >= 0.7 THEN 'High' WHEN ip_total >= 10 OR per_minute > 10 OR ip_services > 3 THEN 'High'
   WHEN conf >= 0.4 OR failure_rate > 0.7::DOUBLE THEN 'Medium' ELSE 'Low' END AS risk_level FROM pr3)"""


def _tries(spark, sf):
    return truncate_lineage(B.attempts(fx.events(spark, sf)))


def _profile(spark, sf):
    return B.bf_profile(_tries(spark, sf))


@query("attempt_outcome", ev(f"SELECT id, {_OUTCOME} AS success FROM ev"))
def attempt_outcome(spark, sf):
    e = fx.events(spark, sf)
    return e.select("id", B.attempt_outcome(F.col("parsed.status_code"), F.col("raw_message")).alias("success"))


_I = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("ip_total", "ip_failed", "ip_success", "ip_services", "ip_agents", "ip_users"))


@query("ip_history", ev(f"SELECT id, source_ip, {_I}, {O.secs('ip_first')} AS first_s, {O.secs('ts')} AS last_s FROM iph", f"{ATT}, {IP}"))
def ip_history(spark, sf):
    return B.ip_history(_tries(spark, sf)).select(
        "id", "source_ip", *[big(c).alias(c) for c in ("ip_total", "ip_failed", "ip_success", "ip_services", "ip_agents", "ip_users")],
        secs("ip_first").alias("first_s"), secs("ts").alias("last_s"))


@query("user_history", ev("SELECT id, username, CAST(user_total AS BIGINT) AS user_total, CAST(user_failed AS BIGINT) AS user_failed, CAST(user_ips AS BIGINT) AS user_ips, user_compromised FROM uh", f"{ATT}, {USER}"))
def user_history(spark, sf):
    return B.user_history(_tries(spark, sf)).select("id", "username", "user_total", "user_failed", "user_ips", "user_compromised")


@query("service_history", ev("SELECT id, service, CAST(service_total AS BIGINT) AS service_total, service_ips, service_users, CAST(service_peak AS BIGINT) AS service_peak FROM sh", f"{ATT}, {SERVICE}"))
def service_history(spark, sf):
    return B.service_history(_tries(spark, sf)).select("id", "service", "service_total", "service_ips", "service_users", "service_peak")


@query("ip_behavior", ev("SELECT id, source_ip, round(failure_rate, 6) AS failure_rate, span_minutes, round(per_minute, 6) AS per_minute, CAST(ip_users AS BIGINT) AS ip_users, is_distributed, round(reputation, 6) AS reputation FROM ipb", f"{ATT}, {IP}"))
def ip_behavior(spark, sf):
    return B.ip_behavior(B.ip_history(_tries(spark, sf))).select(
        "id", "source_ip", r6("failure_rate").alias("failure_rate"), "span_minutes", r6("per_minute").alias("per_minute"),
        "ip_users", "is_distributed", r6("reputation").alias("reputation"))


@query("user_behavior", ev("SELECT id, username, user_compromised, compromise_confidence FROM ub", f"{ATT}, {USER}"))
def user_behavior(spark, sf):
    return B.user_behavior(B.user_history(_tries(spark, sf))).select("id", "username", "user_compromised", "compromise_confidence")


@query("service_behavior", ev("SELECT id, service, under_attack FROM sb", f"{ATT}, {SERVICE}"))
def service_behavior(spark, sf):
    return B.service_behavior(B.service_history(_tries(spark, sf))).select("id", "service", "under_attack")


_BLOCKS = f"""blk AS (SELECT source_ip, CAST(count_if(NOT success) AS BIGINT) AS failed, max(ts) AS last_ts FROM att GROUP BY 1 HAVING count_if(NOT success) >= 10)"""


@query("ip_block_state", ev(f"SELECT source_ip, failed, {O.secs('last_ts + INTERVAL 30 MINUTE')} AS until_s, last_ts + INTERVAL 30 MINUTE > TIMESTAMP '2024-01-30 20:00:00' AS blocked FROM blk", f"{ATT}, {_BLOCKS}"))
def ip_block_state(spark, sf):
    out = B.ip_block_state(B.attempts(fx.events(spark, sf)), "2024-01-30 20:00:00")
    return out.select("source_ip", "failed", secs("block_until").alias("until_s"), "blocked")


@query("unblock_ip", ev("""SELECT source_ip, failed FROM blk WHERE source_ip NOT IN (SELECT blk.source_ip FROM blk JOIN un ON blk.source_ip = un.source_ip AND un.ts >= blk.last_ts)""",
   f"{ATT}, {_BLOCKS}, un AS (SELECT source_ip, max(ts) AS ts FROM att WHERE service = 'ssh' GROUP BY 1)"))
def unblock_ip(spark, sf):
    tries = B.attempts(fx.events(spark, sf))
    lifted = tries.where("service = 'ssh'").groupBy("source_ip").agg(F.max("ts").alias("ts"))
    return B.unblock_ip(B.ip_block_state(tries, AS_OF), lifted).select("source_ip", "failed")


def _names(i):
    return ", ".join(f"{{'n': {q(r.name)}, 't': {q(r.attack_type)}, 's': {q(r.scope)}}}" for r in [R.BRUTE_FORCE_RULES[i]])


_BF_HITS = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(raw_message, {q(r.regex)}) THEN {_names(i)} END" for i, r in enumerate(R.BRUTE_FORCE_RULES)) + "], lambda m: m IS NOT NULL)"
HITS = f"bh AS MATERIALIZED (SELECT id, {_BF_HITS} AS hits FROM ev), bt AS MATERIALIZED (SELECT id, hits, {_seen('list_transform(hits, lambda h: h.t)')} AS types, {_seen('list_transform(hits, lambda h: h.s)')} AS targets FROM bh)"


@query("bf_patterns", ev(f"SELECT id, {J('list_transform(hits, lambda h: h.n)')} AS patterns, {J('types')} AS attack_types, {J('targets')} AS services_targeted FROM bt", HITS))
def bf_patterns(spark, sf):
    return B.bf_patterns(fx.events(spark, sf)).select("id", *[joined(c).alias(c) for c in ("patterns", "attack_types", "services_targeted")])


@query("bf_indicators", ev(f"SELECT id, {J('''list_transform(ind, lambda i: i.t || ':' || i.s || ':' || CAST(round(i.c, 1) AS VARCHAR))''')} AS indicators FROM pr", DETECT))
def bf_indicators(spark, sf):
    out = B.bf_detect(_profile(spark, sf))
    return out.select("id", joined(F.transform("indicators", lambda i: F.concat_ws(":", i["type"], i["severity"], F.round(i["confidence"], 1).cast("string")))).alias("indicators"))


@query("bf_detect", ev("SELECT id, round(conf, 6) AS confidence, (conf >= 0.3 OR ip_total >= 10) AS detected FROM pr", DETECT))
def bf_detect(spark, sf):
    return B.bf_detect(_profile(spark, sf)).select("id", r6("confidence").alias("confidence"), "detected")


@query("bf_risk", ev("SELECT id, risk_level FROM pr", DETECT))
def bf_risk(spark, sf):
    return B.bf_detect(_profile(spark, sf)).select("id", "risk_level")


@query("bf_sophistication", ev("""SELECT id, round(least(CASE WHEN ip_agents > 3 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN ip_services > 2 THEN 0.3::DOUBLE ELSE 0 END
   + CASE WHEN per_minute < 2 AND ip_total > 20 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN crit > 2 THEN 0.3::DOUBLE ELSE 0 END, 1.0::DOUBLE), 6) AS sophistication FROM pr""", DETECT))
def bf_sophistication(spark, sf):
    return B.bf_detect(_profile(spark, sf)).select("id", r6("sophistication").alias("sophistication"))


_MIT = _cat(
    qlist(D.BRUTE_GENERAL_ADVICE), _advice("types", D.BRUTE_TYPE_ADVICE),
    f"CASE WHEN ip_total >= 10 THEN [replace({q(D.BRUTE_BLOCK_ADVICE)}, '{{}}', source_ip)] ELSE [] END",
    _if("ip_services > 2", D.BRUTE_MULTI_SERVICE_ADVICE), _if("reputation < 0.3::DOUBLE", D.BRUTE_REPUTATION_ADVICE),
    "CASE WHEN under_attack THEN [" + ", ".join(f"replace({q(t)}, '{{}}', service)" for t in D.BRUTE_SERVICE_ADVICE) + "] ELSE [] END",
    _if("service_peak > 20", D.BRUTE_PEAK_ADVICE))


@query("bf_mitigations", ev(f"SELECT pr.id, {J(f'list_sort(list_distinct({_MIT}))')} AS mitigations FROM pr JOIN bt ON pr.id = bt.id", f"{HITS}, {DETECT}"))
def bf_mitigations(spark, sf):
    events = fx.events(spark, sf)
    types = B.bf_patterns(events.select("id", "raw_message")).select("id", "attack_types")
    return _profile(spark, sf).join(types, "id").select("id", joined(B.bf_mitigations(F.col("attack_types"))).alias("mitigations"))


@query("bf_statistics", ev("""SELECT 'monitored_ips' AS measure, '' AS name, CAST(count(DISTINCT source_ip) AS BIGINT) AS n FROM att
   UNION ALL SELECT 'blocked_ips', '', CAST(count(*) AS BIGINT) FROM blk
   UNION ALL SELECT 'high_risk_ips', '', CAST(count(*) AS BIGINT) FROM (SELECT source_ip FROM att GROUP BY 1 HAVING count_if(NOT success) >= 5)
   UNION ALL SELECT 'monitored_users', '', CAST(count(DISTINCT username) AS BIGINT) FROM att
   UNION ALL SELECT 'compromised_users', '', CAST(count(DISTINCT username) AS BIGINT) FROM uh WHERE user_compromised
   UNION ALL SELECT 'monitored_services', '', CAST(count(DISTINCT service) AS BIGINT) FROM att
   UNION ALL SELECT 'services_under_attack', '', CAST(count(*) AS BIGINT) FROM (SELECT service FROM sh GROUP BY 1 HAVING max(service_peak) > 10)
   UNION ALL SELECT 'top_ip', source_ip, n FROM (SELECT source_ip, CAST(count(*) AS BIGINT) AS n FROM att GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""",
   f"{ATT}, {_BLOCKS}, {USER}, {SERVICE}"))
def bf_statistics(spark, sf):
    return B.bf_statistics(_tries(spark, sf))


_COMMON = ", ".join(f"CASE WHEN max(CAST(contains(lower(name), '{w}') AS INTEGER)) = 1 THEN 'common_username_{w}' END" for w in R.COMMON_USERNAMES)


@query("username_patterns", ev(f"""SELECT grp, {J("list_filter(found, lambda f: f IS NOT NULL)")} AS patterns FROM (
   SELECT grp, [{_COMMON}, CASE WHEN max(CAST(hit AS INTEGER)) = 1 THEN 'sequential_numeric_usernames' END] AS found FROM (
     SELECT *, len(name) = len(n1) AND len(n1) = len(n2) AND TRY_CAST(n1 AS INTEGER) = TRY_CAST(n2 AS INTEGER) + 1 AND TRY_CAST(name AS INTEGER) = TRY_CAST(n1 AS INTEGER) + 1 AS hit
     FROM (SELECT *, lag(name, 1) OVER w AS n1, lag(name, 2) OVER w AS n2 FROM names WINDOW w AS (PARTITION BY grp ORDER BY name)))
   GROUP BY 1)""",
   f"""{ATT}, names AS (SELECT DISTINCT source_ip AS grp, username AS name FROM att WHERE username IS NOT NULL
        UNION SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) FROM events)"""))
def username_patterns(spark, sf):
    by_ip = B.username_patterns(_tries(spark, sf)).withColumnRenamed("source_ip", "grp")
    raw = fx.table(spark, sf, "events").select("event_type", F.col("user_id").cast("string").alias("username"))
    by_type = B.username_patterns(raw, key="event_type").withColumnRenamed("event_type", "grp")
    return by_ip.unionByName(by_type).select("grp", joined("patterns").alias("patterns"))


@query("credential_entropy", """SELECT event_type, round(-sum(p * log2(p)), 6) AS entropy FROM (
   SELECT event_type, n::DOUBLE / sum(n) OVER (PARTITION BY event_type) AS p FROM (
     SELECT event_type, ch, count(*) AS n FROM (SELECT event_type, unnest(string_split(props, '')) AS ch FROM events) GROUP BY 1, 2)) GROUP BY 1""")
def credential_entropy(spark, sf):
    return B.credential_entropy(fx.table(spark, sf, "events"), "event_type", "props").withColumn("entropy", r6("entropy"))
