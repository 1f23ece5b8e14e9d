"""Registered queries: anomaly features, models, scores, feedback, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import dimensions as D, rules as R
from palisade.operators import anomaly as M, parse as P
from palisade.operators.engine import combine_risk, detect_all, detect_payloads
from palisade.plans import oracle as O
from palisade.plans.oracle import NOW, q, qlist
from palisade.plans.q_parse import _NO_USER
from palisade.plans.q_alerts import RISK
from palisade.plans.q_bruteforce import DETECT
from palisade.plans.q_payload import SQLI, XSS
from palisade.plans.q_reports import COUNTRY
from palisade.plans.registry import big, joined, query, r6, secs
from palisade.plans.running import shared
from palisade.session import truncate_lineage
from palisade.sources import fixtures as fx
from palisade.sources.fixtures import AS_OF

J = O.joined
_EV = O.events_ctes(line_sql=_NO_USER)


def ev(select, ctes):
    return f"WITH {_EV}, {ctes} {select}"


def _events(spark, sf):
    lines = fx.log_lines(spark, sf).withColumn("line", F.regexp_replace("line", r" - \S+ \[", " - - ["))
    return P.parse_logs(lines)


def _inputs(spark, sf):
    return truncate_lineage(M.ml_inputs(_events(spark, sf)))


def _ent(t):
    share = f"(n::DOUBLE / strlen({t}))"
    return f"CASE WHEN strlen({t}) > 0 THEN list_sum(list_transform(map_values(list_histogram(string_split({t}, ''))), lambda n: -{share} * log2{share})) ELSE 0.0 END"


def _chars(t, cls):
    return f"CAST(length({t}) - length(regexp_replace({t}, {q(cls)}, '', 'g')) AS BIGINT)"


INPUTS = f"""inp AS MATERIALIZED (SELECT id, ts, coalesce(source_ip, '') AS ip, CAST(strlen(raw_message) AS BIGINT) AS request_size, coalesce(TRY_CAST(body_bytes AS BIGINT), 0) AS response_size,
   CAST(floor(TRY_CAST(response_time AS DOUBLE) * 1000) AS BIGINT) AS response_time_ms, status_code, user_agent, method, path, protocol, referer,
   {_ent('raw_message')} AS payload_entropy, {_chars('raw_message', R.SPECIAL_CHARS)} AS special_char_count, CAST(len(iocs) AS BIGINT) AS keyword_matches FROM ev)"""


@query("ml_inputs", ev("""SELECT id, ip AS source_ip, request_size, response_size, response_time_ms, CAST(status_code AS BIGINT) AS status_code, user_agent, method, path, protocol, referer,
   round(payload_entropy, 6) AS payload_entropy, special_char_count, keyword_matches FROM inp""", INPUTS))
def ml_inputs(spark, sf):
    return M.ml_inputs(_events(spark, sf)).drop("ts").withColumns({"status_code": big("status_code"), "payload_entropy": r6("payload_entropy")})


def _rounded(names):
    return [r6(n).alias(n) for n in names]


_BASIC = {
    "log_request_size": "ln(request_size + 1)", "log_response_size": "ln(response_size + 1)", "log_response_time": "ln(coalesce(response_time_ms, 100) + 1)",
    "status_code_normalized": "coalesce(status_code, 200) / 1000.0::DOUBLE", "payload_entropy": "payload_entropy", "log_special_chars": "ln(special_char_count + 1)",
    "keyword_matches": "keyword_matches::DOUBLE",
}


def _select(parts):
    return ", ".join(f"round(({sql})::DOUBLE, 6) AS {n}" for n, sql in parts.items())


@query("basic_features", ev(f"SELECT id, {_select(_BASIC)} FROM inp", INPUTS))
def basic_features(spark, sf):
    feats = M.basic_features()
    return M.ml_inputs(_events(spark, sf)).select("id", *[r6(c).alias(n) for n, c in feats.items()])


def _or0(col, sql):
    return f"CASE WHEN {col} IS NULL THEN 0.0 ELSE {sql} END"


_PAYLOAD = {
    "user_agent_entropy": _or0("user_agent", _ent("user_agent")), "user_agent_length": _or0("user_agent", "strlen(user_agent)"),
    "user_agent_uncommon": f"CASE WHEN {' OR '.join(f'''contains(user_agent, '{w}')''' for w in R.COMMON_AGENT_WORDS)} THEN 0.0 ELSE 1.0 END",
    "path_entropy": _or0("path", _ent("path")), "path_length": _or0("path", "strlen(path)"), "path_depth": _or0("path", _chars("path", "/")),
    "query_strings_count": _or0("path", _chars("path", r"\?")), "parameters_count": _or0("path", _chars("path", "&")),
    "suspicious_chars_count": _or0("path", _chars("path", R.SUSPICIOUS_PATH_CHARS)),
    "referer_entropy": _or0("referer", _ent("referer")), "referer_length": _or0("referer", "strlen(referer)"),
}


@query("payload_features", ev(f"SELECT id, {_select(_PAYLOAD)} FROM inp", INPUTS))
def payload_features(spark, sf):
    return M.ml_inputs(_events(spark, sf)).select("id", *[r6(c).alias(n) for n, c in M.payload_features().items()])


_OCT = "TRY_CAST(split_part(ip, '.', 1) AS INTEGER)"
_NETWORK = {
    "is_private_ip": "CASE WHEN " + " OR ".join(f"starts_with(ip, '{p}')" for p in R.PRIVATE_PREFIXES) + " THEN 1.0 ELSE 0.0 END",
    "ip_class": f"CASE WHEN {_OCT} BETWEEN 1 AND 126 THEN 1 WHEN {_OCT} BETWEEN 128 AND 191 THEN 2 WHEN {_OCT} BETWEEN 192 AND 223 THEN 3 WHEN {_OCT} BETWEEN 224 AND 239 THEN 4 WHEN {_OCT} BETWEEN 240 AND 255 THEN 5 ELSE 0 END",
    "protocol_risk_score": "CASE protocol " + " ".join(f"WHEN '{p}' THEN {s}" for p, s in M.PROTOCOL_SCORES.items()) + " ELSE CASE WHEN starts_with(protocol, 'HTTP') THEN 3.0 ELSE 4.0 END END",
    "method_risk_score": "CASE method " + " ".join(f"WHEN '{p}' THEN {s}" for p, s in M.METHOD_SCORES.items()) + " ELSE 3.0 END",
}


@query("network_features", ev(f"SELECT id, {_select(_NETWORK)} FROM inp", INPUTS))
def network_features(spark, sf):
    return M.ml_inputs(_events(spark, sf)).select("id", *[r6(c).alias(n) for n, c in M.network_features().items()])


_UPTO = "(b.ts < a.ts OR (b.ts = a.ts AND b.id <= a.id))"
TEMPORAL = f"""tw AS (SELECT a.id, any_value(a.ts) AS ts, count(*) AS hour_n, count_if(b.ts > a.ts - INTERVAL 10 MINUTE) AS ten_n, list(epoch_us(b.ts) ORDER BY b.ts, b.id)[-10:] AS times
   FROM inp a JOIN inp b ON a.ip = b.ip AND b.ts >= a.ts - INTERVAL 1 HOUR AND {_UPTO} GROUP BY a.id),
 tg AS (SELECT *, list_transform(range(1, len(times)), lambda i: floor((times[i + 1] - times[i]) / 1000000)::DOUBLE) AS gaps FROM tw)"""
_TEMPORAL = {
    "log_requests_last_hour": "ln(hour_n)", "log_requests_last_10min": "ln(ten_n)", "log_time_since_last": "CASE WHEN len(gaps) > 0 THEN ln(gaps[-1] + 1) ELSE 0.0 END",
    "request_interval_variance": "CASE WHEN len(gaps) >= 2 THEN list_stddev_pop(gaps) ELSE 0.0 END", "hour_of_day": "hour(ts) / 24.0::DOUBLE", "day_of_week": "(isodow(ts) - 1) / 7.0::DOUBLE",
}


@query("temporal_features", ev(f"SELECT id, {_select(_TEMPORAL)} FROM tg", f"{INPUTS}, {TEMPORAL}"))
def temporal_features(spark, sf):
    return M.temporal_features(_inputs(spark, sf)).select("id", *_rounded(_TEMPORAL))


_W = "ORDER BY ts, id ROWS UNBOUNDED PRECEDING"


def _rare(col, missing):
    return f"CASE WHEN {col} IS NULL THEN {missing} ELSE 1 - count(*) OVER (PARTITION BY ip, {col} {_W})::DOUBLE / count({col}) OVER (PARTITION BY ip {_W}) END"


def _ema(col):
    return f"""CASE WHEN {col} IS NULL THEN NULL ELSE list_reduce(list_prepend(0.0::DOUBLE, list_filter(list({col}::DOUBLE) OVER (PARTITION BY ip, {col} IS NULL ORDER BY ts, id ROWS BETWEEN 60 PRECEDING AND CURRENT ROW), lambda v: v IS NOT NULL)), lambda a, x: (a + x) / 2) END"""


BEHAVIOR = f"""bw AS (SELECT id, request_size, response_time_ms, {_rare('user_agent', 1.0)} AS user_agent_deviation, {_rare('path', 0.5)} AS path_deviation, {_rare('method', 0.5)} AS method_deviation,
   {_ema('request_size')} AS size_avg, {_ema('response_time_ms')} AS time_avg FROM inp),
 bv AS (SELECT *, CASE WHEN size_avg > 0 THEN least(abs(request_size - size_avg) / size_avg, 10.0) ELSE 0.0 END AS request_size_deviation,
   CASE WHEN time_avg > 0 THEN least(abs(response_time_ms - time_avg) / time_avg, 10.0) ELSE 0.0 END AS response_time_deviation FROM bw)"""
_BEHAVIOR = ["user_agent_deviation", "path_deviation", "method_deviation", "request_size_deviation", "response_time_deviation"]


@query("behavior_features", ev(f"SELECT id, {_select({n: n for n in _BEHAVIOR})} FROM bv", f"{INPUTS}, {BEHAVIOR}"))
def behavior_features(spark, sf):
    return M.behavior_features(_inputs(spark, sf)).select("id", *_rounded(_BEHAVIOR))


_ALL = {**_BASIC, **_TEMPORAL, **_PAYLOAD, **_NETWORK, **{n: n for n in _BEHAVIOR}}
_VEC = f"""vec AS MATERIALIZED (SELECT inp.id, inp.ts, ip, [{', '.join(f"({s})::DOUBLE" for s in (_ALL[n] for n in M.FEATURES))}] AS f
   FROM inp JOIN (SELECT id, hour_n, ten_n, gaps FROM tg) t ON t.id = inp.id JOIN (SELECT id, {', '.join(_BEHAVIOR)} FROM bv) b ON b.id = inp.id)"""


def _vec_text(col):
    return f"array_to_string(list_transform({col}, lambda x: CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR)), ',')"


@query("register_feature", ev("SELECT id, CAST(33 + 1 AS BIGINT) AS n, coalesce(length(regexp_replace(path, '[^0-9]', '', 'g')), 0)::DOUBLE AS digits FROM inp", INPUTS))
def register_feature(spark, sf):
    M.register_feature("path_digits", F.length(F.regexp_replace("path", "[^0-9]", "")))
    try:
        vectors = M.feature_vector(_inputs(spark, sf))
    finally:
        M.unregister_feature("path_digits")
    return vectors.select("id", big(F.size("features")).alias("n"), F.element_at("features", -1).alias("digits"))


@query("feature_vector", ev(f"SELECT id, {_vec_text('f')} AS features FROM vec", f"{INPUTS}, {TEMPORAL}, {BEHAVIOR}, {_VEC}"))
def feature_vector(spark, sf):
    vectors = M.feature_vector(_inputs(spark, sf))
    return vectors.select("id", F.array_join(F.transform("features", lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("features"))


# --- models over the embedding table ----------------------------------------

_SIZE = 64
_SAMPLES = """smp AS MATERIALIZED (SELECT vec_id AS id, TIMESTAMP '2024-01-01' + to_seconds(vec_id * 977) AS ts, embedding::DOUBLE[] AS f, CASE label % 3 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS label, label AS kind FROM embeddings)"""


def _samples(spark, sf):
    kind = F.col("label") % 3
    return fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 977).alias("ts"),
        F.col("embedding").cast("array<double>").alias("features"), F.when(kind == 0, None).otherwise(kind == 2).alias("label"),
        F.col("label").alias("kind"), F.concat(F.lit("10.0.0."), (F.col("vec_id") % 40).cast("string")).alias("source_ip"),
        F.lit("web_request").alias("event_type"))


def _per_dim(where, exprs, size=64):
    cols = ", ".join(f"{e} AS {n}" for n, e in exprs.items())
    return f"(SELECT CAST(i AS BIGINT) AS feature, {cols} FROM (SELECT unnest(range({size})) AS i, unnest(f) AS x FROM smp WHERE {where}) GROUP BY i)"


@query("feature_stats", f"WITH {_SAMPLES} SELECT feature, round(mean, 6) AS mean, round(std_dev, 6) AS std_dev, round(lo, 6) AS min, round(hi, 6) AS max, round(p95, 6) AS p95 FROM "
       + _per_dim("true", {"mean": "avg(x)", "std_dev": "stddev_pop(x)", "lo": "min(x)", "hi": "max(x)", "p95": "quantile_cont(x, 0.95)"}))
def feature_stats(spark, sf):
    out = M.feature_stats(_samples(spark, sf), _SIZE)
    return out.select(big("feature").alias("feature"), *_rounded(["mean", "std_dev", "min", "max", "p95"]))


_THR = _per_dim("label = false", {"threshold": "CASE WHEN min(x) = max(x) THEN min(x) ELSE avg(x) + 2 * stddev_pop(x) END"})


@query("fit_fp_thresholds", f"WITH {_SAMPLES} SELECT feature, round(threshold, 6) AS threshold FROM {_THR}")
def fit_fp_thresholds(spark, sf):
    return M.fit_fp_thresholds(_samples(spark, sf), _SIZE).select(big("feature").alias("feature"), r6("threshold").alias("threshold"))


_BASE = _per_dim("label IS NULL OR label = false", {"baseline": "avg(x)"})


@query("fit_baseline", f"WITH {_SAMPLES} SELECT feature, round(baseline, 6) AS baseline FROM {_BASE}")
def fit_baseline(spark, sf):
    return M.fit_baseline(_samples(spark, sf), _SIZE).select(big("feature").alias("feature"), r6("baseline").alias("baseline"))


@query("fit_signatures", f"""WITH {O._EV} SELECT source_pattern, payload_fingerprint, CAST(sum(n) AS BIGINT) AS marked, max(last_s) AS last_s FROM (
   SELECT split_part(source_ip, '.', 1) || '.' || split_part(source_ip, '.', 2) || '.' || split_part(source_ip, '.', 3) || '.*' AS source_pattern,
     CASE WHEN contains(raw_message, 'GET') THEN 'GET:' ELSE '' END || CASE WHEN contains(raw_message, 'POST') THEN 'POST:' ELSE '' END || CASE WHEN contains(raw_message, 'clean file') THEN 'CLEAN_FILE:' ELSE '' END
       || CASE WHEN contains(raw_message, 'success') THEN 'SUCCESS:' ELSE '' END || CASE WHEN contains(raw_message, '/api/') THEN 'API:' ELSE '' END AS payload_fingerprint, 1 AS n, {O.secs('ts')} AS last_s FROM ev) GROUP BY 1, 2""")
def fit_signatures(spark, sf):
    samples = fx.events(spark, sf).select(
        "source_ip", "event_type", "ts", F.array(F.col("parsed.status_code").cast("double")).alias("features"),
        F.lit(False).alias("label"), F.col("raw_message").alias("raw_log"))
    out = M.fit_signatures(samples)
    return out.groupBy("source_pattern", "payload_fingerprint").agg(F.sum("marked_fp_count").alias("marked"), F.max(secs("last_seen")).alias("last_s"))


def _retrain(name, now, marked):
    return f"""SELECT '{name}' AS case_name, CAST(count(*) AS BIGINT) AS n, (count(*) > 100 + 250 OR {now} - TIMESTAMP '2024-01-03 19:00:00' >= INTERVAL 6 HOUR) AS retrain,
   (count_if(label = false AND ts > {now} - INTERVAL 1 HOUR) >= 5 OR (count_if({marked}) > 0 AND count_if({marked}) % 10 = 0)) AS retrain_for_feedback, count(*) >= 1000 AS untrained FROM smp"""


_NEWEST = "(SELECT max(ts) FROM smp)"


@query("retrain_needed", f"WITH {_SAMPLES} " + " UNION ALL ".join([
    _retrain("fixed", "TIMESTAMP '2024-01-04'", "false"), _retrain("no_feedback", _NEWEST, "false"),
    _retrain("ten", _NEWEST, "id < 10"), _retrain("seven", _NEWEST, "id < 7")]))
def retrain_needed(spark, sf):
    samples = _samples(spark, sf)
    out = None
    for name, now, marked in (("fixed", "2024-01-04 00:00:00", 0), ("no_feedback", None, 0), ("ten", None, 10), ("seven", None, 7)):
        event = F.when(F.col("id") < marked, F.concat(F.lit("marked_fp_"), F.col("id").cast("string"))).otherwise(F.col("event_type"))
        own = samples.withColumn("event_type", event)
        fresh = M.retrain_needed(own, None, 0, now).select(F.col("retrain").alias("untrained"))
        one = M.retrain_needed(own, "2024-01-03 19:00:00", 100, now).select(F.lit(name).alias("case_name"), "*")
        one = one.withColumn("untrained", fresh.scalar())
        out = one if out is None else out.unionByName(one)
    return out


def _lloyd(size, k=M.CLUSTERS, rounds=M.ROUNDS):
    """Lloyd's rounds over the normal samples, unrolled; ``cen`` has the centres, ``far`` the distance threshold."""
    def nearest(r):
        return f"""(SELECT n.id, any_value(n.f) AS f, list(sqrt(list_sum(list_transform(list_zip(n.f, l.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) ORDER BY l.g) AS ds
   FROM nrm n, l{r} l GROUP BY n.id)"""

    out = ["""nrm AS MATERIALIZED (SELECT id, f, row_number() OVER (ORDER BY ts, id) - 1 AS rn, count(*) OVER () AS n FROM smp WHERE label IS NULL OR NOT label)""",
           f"l0 AS MATERIALIZED (SELECT t.g, nrm.f AS c FROM range({k}) t(g) JOIN nrm ON rn = t.g * n // {k})"]
    for r in range(rounds):
        out.append(f"a{r} AS MATERIALIZED (SELECT f, list_position(ds, list_min(ds)) - 1 AS g FROM {nearest(r)})")
        out.append(f"""l{r + 1} AS MATERIALIZED (SELECT t.g, coalesce(m.c, list_transform(range({size}), lambda i: 0.0::DOUBLE)) AS c FROM range({k}) t(g) LEFT JOIN (
   SELECT g, list(v ORDER BY i) AS c FROM (SELECT g, i, avg(x) AS v FROM (SELECT g, unnest(range({size})) AS i, unnest(f) AS x FROM a{r}) GROUP BY g, i) GROUP BY g) m ON m.g = t.g)""")
    out.append(f"cen AS MATERIALIZED (SELECT list(c ORDER BY g) AS cs FROM l{rounds})")
    out.append(f"far AS MATERIALIZED (SELECT 2 * avg(list_min(ds)) AS dt FROM {nearest(rounds)})")
    return ", ".join(out)


_NAMES = [*M.FEATURES, *[f"f{i}" for i in range(len(M.FEATURES), _SIZE)]]


def _model_sql(size, names):
    """A model fitted on ``smp`` and its scores for all of ``smp``."""
    thr = _per_dim("label = false", {"threshold": "CASE WHEN min(x) = max(x) THEN min(x) ELSE avg(x) + 2 * stddev_pop(x) END"}, size)
    base = _per_dim("label IS NULL OR label = false", {"baseline": "avg(x)"}, size)
    stats = _per_dim("true", {"mean": "avg(x)", "sigma": "stddev_pop(x)"}, size)
    z = "CASE WHEN sd[i + 1] = 0 THEN 0.0 ELSE (f[i + 1] - mu[i + 1]) / sd[i + 1] END"
    return f"""{_lloyd(size)}, thr AS (SELECT list(threshold ORDER BY feature) AS t FROM {thr}), bas AS (SELECT list(baseline ORDER BY feature) AS b FROM {base}),
 st AS (SELECT list(mean ORDER BY feature) AS mu, list(sigma ORDER BY feature) AS sd FROM {stats}),
 sc0 AS (SELECT id, f, (len(list_filter(list_zip(f, t), lambda z: z[1] <= z[2] + 1e-9::DOUBLE * abs(z[2]))) / {size}.0::DOUBLE) * 0.7::DOUBLE + 0.3::DOUBLE * 0.3::DOUBLE AS fp, dt,
   list_min(list_transform(cs, lambda c: sqrt(list_sum(list_transform(list_zip(f, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))))) AS d,
   list_sum(list_transform(list_zip(f, b), lambda z: abs((z[1] - z[2]) / (z[2] + 1)))) / {size} AS away, mu, sd FROM smp, thr, bas, cen, far, st),
 sc1 AS (SELECT *, least(least(d / dt, 2.0) * 0.6::DOUBLE + away * 0.4::DOUBLE, 1.0) AS a FROM sc0),
 sc2 AS MATERIALIZED (SELECT *, CASE WHEN fp > 0.7::DOUBLE THEN greatest(a * (1 - fp), 0.1::DOUBLE) ELSE greatest(least((a * 0.7::DOUBLE - fp * 0.8::DOUBLE) / 0.7::DOUBLE, 1.0), 0.0) END AS voted,
   CASE WHEN fp > 0.7::DOUBLE THEN greatest(a * (1 - fp), 0.1::DOUBLE) ELSE greatest(a * (1 - fp * 0.5::DOUBLE), 0.0) END AS blended FROM sc1),
 imp AS (SELECT id, voted, fp, a, list_reverse(list_sort(list_transform(range({size}), lambda i: {{'imp': abs({z}) / 3, 'name': {qlist(names)}[i + 1], 'con': ({z}) * voted}}))) AS imps FROM sc2),
 rk AS (SELECT *, len(list_filter(imps, lambda p: p.imp > 0.8)) AS strong FROM imp),
 rl AS (SELECT *, CASE WHEN voted >= 0.9 OR strong >= 3 THEN 'Critical' WHEN voted >= 0.7 OR strong >= 2 THEN 'High' WHEN voted >= 0.4 OR strong >= 1 THEN 'Medium' ELSE 'Low' END AS risk_level FROM rk)"""


_MODEL = _model_sql(_SIZE, _NAMES)


def _model(spark, sf):
    """A model fitted on the embedding table."""
    samples = _samples(spark, sf)
    return samples, M.train_model(samples, min_samples=1)


def _scored(spark, sf):
    samples, model = _model(spark, sf)
    return M.detect_anomaly(samples, model, _NAMES)


def mq(select, more=""):
    return f"WITH {_SAMPLES}, {_MODEL}{more} {select}"


@query("fit_clusters", f"""WITH {_SAMPLES}, {_lloyd(_SIZE)},
   p AS (SELECT id, list_transform(cs, lambda c: sqrt(list_sum(list_transform(list_zip(f, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS ds FROM smp, cen)
   SELECT CAST(list_position(ds, list_min(ds)) - 1 AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS samples, round(avg(list_min(ds)), 6) AS mean_distance, round(any_value(dt), 6) AS threshold FROM p, far GROUP BY 1""")
def fit_clusters(spark, sf):
    samples = _samples(spark, sf)
    centers, threshold = M.fit_clusters(samples)
    near = F.array(*[M.distance(c) for c in centers])
    placed = samples.withColumn("d", near).withColumn("cluster", (F.array_position("d", F.array_min("d")) - 1).cast("long"))
    return placed.groupBy("cluster").agg(
        F.count("*").alias("samples"), r6(F.avg(F.array_min("d"))).alias("mean_distance")).withColumn("threshold", r6(F.lit(threshold)))


@query("score_fp", mq("SELECT id, round(fp, 6) AS fp_score FROM sc2"))
def score_fp(spark, sf):
    return _scored(spark, sf).select("id", r6("fp_score").alias("fp_score"))


@query("score_anomaly", mq("SELECT id, round(a, 6) AS distance_score FROM sc2"))
def score_anomaly(spark, sf):
    return _scored(spark, sf).select("id", r6("distance_score").alias("distance_score"))


@query("ensemble_score", mq("SELECT id, round(voted, 6) AS voted, round(blended, 6) AS blended FROM sc2"))
def ensemble_score(spark, sf):
    out = _scored(spark, sf)
    return out.select("id", r6("anomaly_score").alias("voted"), r6(M.ensemble_score(F.col("fp_score"), F.col("distance_score"), False)).alias("blended"))


@query("feature_importance", mq("SELECT id, imps[1].name AS name, round(imps[1].imp, 6) AS importance, round(imps[1].con, 6) AS contribution, CAST(len(list_filter(imps, lambda p: p.imp > 0.5)) AS BIGINT) AS anomalous FROM imp"))
def feature_importance(spark, sf):
    top = F.get("importance", F.lit(0))
    return _scored(spark, sf).select(
        "id", top["name"].alias("name"), r6(top["importance"]).alias("importance"), r6(top["contribution"]).alias("contribution"),
        big(F.size(F.filter("importance", lambda p: p["anomalous"]))).alias("anomalous"))


@query("anomaly_risk", mq("SELECT id, risk_level FROM rl"))
def anomaly_risk(spark, sf):
    return _scored(spark, sf).select("id", "risk_level")


_SIM = """, sim AS (SELECT e.id, list(c ORDER BY c DESC, bid)[1:5] AS s, list(bad ORDER BY c DESC, bid)[1:5] AS bads FROM (SELECT a.id, b.id AS bid, list_cosine_similarity(a.f, b.f) AS c, coalesce(b.label, false) AS bad FROM smp a, smp b WHERE a.id <> b.id) e WHERE c > 0.1 GROUP BY e.id)"""


def _similar_scored(spark, sf):
    from palisade.operators.enrich import similar_events

    samples, model = _model(spark, sf)
    near = similar_events(samples, samples, least=0.1)
    return M.detect_anomaly(samples.join(near, "id"), model, _NAMES)


@query("anomaly_confidence", f"WITH {_SAMPLES}, {_MODEL}{_SIM} SELECT sc2.id, round(least(0.5::DOUBLE + greatest(1 - ((fp - a) * (fp - a)) / 4, 0) * 0.3::DOUBLE + coalesce(list_avg(s) * 0.2::DOUBLE, 0), 1.0), 6) AS confidence FROM sc2 LEFT JOIN sim ON sim.id = sc2.id")
def anomaly_confidence(spark, sf):
    return _similar_scored(spark, sf).select("id", r6("confidence").alias("confidence"))


_HINT = "CASE " + " ".join(f"WHEN contains(p.name, '{m}') THEN {q(t)}" for m, t in D.ANOMALY_FEATURE_ADVICE) + " END"
_HINTS = f"list_filter(list_transform(list_filter(imps[1:3], lambda p: p.imp > 0.5), lambda p: {_HINT}), lambda h: h IS NOT NULL)"
_ABOUT = """CASE WHEN len(list_filter(bads, lambda b: b)) > 0 THEN '|Encontrados ' || CAST(len(bads) AS VARCHAR) || ' eventos similares previos, ' || CAST(len(list_filter(bads, lambda b: b)) AS VARCHAR) || ' fueron anomalías'
   WHEN len(bads) > 0 THEN '|Encontrados ' || CAST(len(bads) AS VARCHAR) || ' eventos similares, ninguno fue anomalía (posible falso positivo)'
   ELSE '|No se encontraron eventos similares en el historial' END"""
_RISK_TEXT = "CASE risk_level " + " ".join(f"WHEN '{r}' THEN {qlist(t)}" for r, t in D.ANOMALY_RISK_ADVICE.items()) + " END"


@query("anomaly_explain", mq(f"""SELECT rl.id, printf('Score de anomalía: %.3f', voted) || CASE WHEN imps[1].imp > 0.5 THEN '|Características anómalas detectadas:' ELSE '' END
   || coalesce('|' || nullif(array_to_string(list_transform(list_filter(imps, lambda p: p.imp > 0.5)[1:3], lambda p: printf('- %s: importancia %.3f, contribución %.3f', p.name, p.imp, p.con)), '|'), ''), '')
   || {_ABOUT} AS explanations, {J(f"list_concat({_RISK_TEXT}, {_HINTS})")} AS recommendations FROM rl LEFT JOIN sim ON sim.id = rl.id""", _SIM))
def anomaly_explain(spark, sf):
    t = F.col("text")
    return _similar_scored(spark, sf).select("id", joined(t["explanations"]).alias("explanations"), joined(t["recommendations"]).alias("recommendations"))


@query("detect_anomaly", mq("SELECT id, voted >= 0.7 AS is_anomaly, round(voted, 6) AS anomaly_score, risk_level FROM rl"))
def detect_anomaly(spark, sf):
    return _scored(spark, sf).select("id", "is_anomaly", r6("anomaly_score").alias("anomaly_score"), "risk_level")


_EVENT_SAMPLES = f"{INPUTS}, {TEMPORAL}, {BEHAVIOR}, {_VEC}, smp AS MATERIALIZED (SELECT id, ts, f, CASE WHEN id % 50 = 0 THEN false END AS label FROM vec)"


@query("train_model", ev("""SELECT risk_level, voted >= 0.7 AS is_anomaly, CAST(count(*) AS BIGINT) AS events, round(avg(voted), 6) AS mean_score,
   round(avg(least(0.5::DOUBLE + greatest(1 - ((fp - a) * (fp - a)) / 4, 0) * 0.3::DOUBLE, 1.0)), 6) AS mean_confidence FROM rl GROUP BY 1, 2""", f"{_EVENT_SAMPLES}, {_model_sql(len(M.FEATURES), M.FEATURES)}"))
def train_model(spark, sf):
    """Fits on the feature vectors of all events, then scores them with it."""
    vectors, model = _event_model(spark, sf)
    scored = M.detect_anomaly(vectors, M.Model.load(model.table(spark)))
    return scored.groupBy("risk_level", "is_anomaly").agg(
        F.count("*").alias("events"), r6(F.avg("anomaly_score")).alias("mean_score"), r6(F.avg("confidence")).alias("mean_confidence"))


def _event_model(spark, sf):
    """Vectors of all events, and the model fitted on them with the feedback as labels."""
    vectors = truncate_lineage(M.feature_vector(_inputs(spark, sf)))
    marked = fx.feedback(spark, sf).select(F.col("event_id").alias("id"), F.lit(False).alias("label"))
    samples = M.collect_training(vectors).drop("label").join(marked, "id", "left")
    return vectors, M.train_model(shared(samples), min_samples=100)


_WITH_ANOMALY = """joint AS (SELECT r.id, r.sqli, r.xss, r.brute, m.voted >= 0.7 AS odd, r.risk AS without,
   (r.sc * 0.3::DOUBLE + r.xc * 0.25::DOUBLE + coalesce(r.bc * 0.25::DOUBLE, 0.0) + m.voted * 0.2::DOUBLE) / (0.75::DOUBLE + CASE WHEN r.bc IS NULL THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END) AS risk
   FROM risk r JOIN rl m ON m.id = r.id)"""


@query("detect_all_anomaly", ev("SELECT id, sqli, xss, brute, odd, sqli OR xss OR brute OR odd AS has_threats, round(risk, 6) AS risk_score, abs(risk - without) > 1e-9 AS moved FROM joint",
                                f"{SQLI}, {XSS}, {DETECT}, {RISK}, {_EVENT_SAMPLES}, {_model_sql(len(M.FEATURES), M.FEATURES)}, {_WITH_ANOMALY}"))
def detect_all_anomaly(spark, sf):
    """All four detectors, the anomaly scores from a model fitted on the same events."""
    vectors, model = _event_model(spark, sf)
    found = detect_all(truncate_lineage(_events(spark, sf)), anomaly=M.detect_anomaly(vectors, model))
    without = combine_risk(sqli=F.col("sqli.confidence"), xss=F.col("xss.confidence"), brute_force=F.col("brute_force.confidence"))
    return found.select(
        "id", F.col("sqli.detected").alias("sqli"), F.col("xss.detected").alias("xss"), F.coalesce("brute_force.detected", F.lit(False)).alias("brute"),
        F.col("anomaly.detected").alias("odd"), "has_threats", r6("risk_score").alias("risk_score"), (F.abs(F.col("risk_score") - without) > 1e-9).alias("moved"))


@query("collect_training", f"WITH {_SAMPLES}, {_MODEL} SELECT id, voted >= 0.7 AS label, {O.secs('ts')} AS ts_s FROM (SELECT sc2.id, voted, ts FROM sc2 JOIN smp ON smp.id = sc2.id )")
def collect_training(spark, sf):
    samples, model = _model(spark, sf)
    out = M.collect_training(samples, M.detect_anomaly(samples, model, _NAMES))
    return out.select("id", "label", secs("ts").alias("ts_s"))


@query("mark_false_positive", f"WITH {_SAMPLES} SELECT id, 'marked_fp_' || CAST(id AS VARCHAR) AS event_type, false AS label, round(f[1], 6) AS first FROM smp WHERE id IN (SELECT event_id FROM events WHERE event_id % 50 = 0)")
def mark_false_positive(spark, sf):
    out = M.mark_false_positive(fx.feedback(spark, sf), _samples(spark, sf))
    return out.select("id", "event_type", "label", r6(F.get("features", F.lit(0))).alias("first"))


@query("fp_patterns", f"WITH {_SAMPLES} SELECT 'threshold' AS kind, CAST(feature AS VARCHAR) AS name, round(threshold, 6) AS value FROM {_THR} UNION ALL SELECT DISTINCT 'internal_ip', '10.0.0.' || CAST(id % 40 AS VARCHAR), 0.9::DOUBLE FROM smp WHERE label = false")
def fp_patterns(spark, sf):
    samples = _samples(spark, sf)
    out = M.fp_patterns(M.fit_fp_thresholds(samples, _SIZE), M.whitelist_patterns(samples.where("label = false")))
    return out.withColumn("value", r6("value"))


# --- quality ----------------------------------------------------------------

_LABELLED = f"""lab AS (SELECT toxic = 1 AS y, (contains(lower(text), 'hate') OR contains(lower(text), 'idiot') OR contains(lower(text), 'stupid') OR length(text) < 200) AS p FROM labels JOIN documents USING (doc_id)),
 cm AS (SELECT count(*) AS n, count_if(y AND p) AS tp, count_if(NOT y AND p) AS fp, count_if(NOT y AND NOT p) AS tn, count_if(y AND NOT p) AS fn FROM lab)"""


@query("ml_metrics", f"""WITH {_LABELLED} SELECT CAST(n AS BIGINT) AS n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
   round((tp + tn) / n::DOUBLE, 6) AS accuracy, coalesce(round(tp / nullif(tp + fp, 0)::DOUBLE, 6), 0.0) AS precision, coalesce(round(tp / nullif(tp + fn, 0)::DOUBLE, 6), 0.0) AS recall,
   coalesce(round(fp / nullif(fp + tn, 0)::DOUBLE, 6), 0.0) AS false_positive_rate, coalesce(round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6), 0.0) AS f1_score FROM cm""")
def ml_metrics(spark, sf):
    low = F.lower("text")
    p = low.contains("hate") | low.contains("idiot") | low.contains("stupid") | (F.length("text") < 200)
    docs = fx.table(spark, sf, "documents").select("doc_id", p.alias("predicted"))
    rows = fx.table(spark, sf, "labels").join(docs, "doc_id").select((F.col("toxic") == 1).alias("label"), "predicted")
    return M.ml_metrics(rows).withColumns({c: r6(c) for c in ("accuracy", "precision", "recall", "false_positive_rate", "f1_score")})


@query("ml_statistics", mq("""SELECT CAST(count(*) AS BIGINT) AS total_predictions, CAST(count_if(voted >= 0.7) AS BIGINT) AS anomalies_detected, CAST(count_if(id % 50 = 0) AS BIGINT) AS false_positives,
   CAST(count_if(voted >= 0.7 AND id % 50 <> 0) AS BIGINT) AS true_positives FROM sc2"""))
def ml_statistics(spark, sf):
    return M.ml_statistics(_scored(spark, sf), fx.feedback(spark, sf))


_FOUND = "fnd AS (SELECT ev.id, ts, event_type FROM ev JOIN sq3 s ON s.id = ev.id JOIN xs5 x ON x.id = ev.id WHERE s.conf >= 0.3 OR x.conf >= 0.25)"


@query("fp_dashboard", f"WITH {O._EV}, {SQLI}, {XSS}, {_FOUND} " + " UNION ALL ".join(
    f"SELECT '{m}' AS measure, {e} AS name, CAST(count_if(id % 50 = 0) AS BIGINT) AS false_positives, CAST(count_if(id % 50 <> 0) AS BIGINT) AS true_positives FROM fnd GROUP BY 2"
    for m, e in (("pattern", "event_type"), ("hour", "CAST(hour(ts) AS VARCHAR)"), ("total", "'all'"))))
def fp_dashboard(spark, sf):
    found = detect_payloads(fx.events(spark, sf)).select("id", "ts", "event_type", (F.col("sqli.detected") | F.col("xss.detected")).alias("has_threats"))
    return M.fp_dashboard(found, fx.feedback(spark, sf))
