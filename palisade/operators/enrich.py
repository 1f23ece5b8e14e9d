"""Joins: related events, indicators, rules, places, context, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.address import address_bits, network_bits
from palisade.operators.reports import country_of
from palisade.operators.similar import SAMPLES_BYTES, TASK_BYTES, VECTORS_BYTES, best_of_blocks, packed, references
from palisade.plans.running import previous_rows, running, shared
from palisade.plans.sizing import pattern_join, substring_join
from palisade.session import truncate_lineage


# --- related events ---------------------------------------------------------

def related_to(events: DataFrame, event_id, limit: int = 10, hours: int = 1) -> DataFrame:
    """Newest events near one event that share its address, source or type."""
    one = events.where(F.col("id") == event_id).limit(1).select(
        F.struct("id", "ts", "source_ip", "source", "event_type").alias("t")).scalar()
    span = F.expr(f"INTERVAL {hours} HOUR")
    near = events.withColumn("t", one)
    shared = (
        F.coalesce(F.col("source_ip") == F.col("t.source_ip"), F.lit(False))
        | (F.col("source") == F.col("t.source")) | (F.col("event_type") == F.col("t.event_type"))
    )
    hit = near.where(
        (F.col("id") != F.col("t.id")) & F.col("ts").between(F.col("t.ts") - span, F.col("t.ts") + span) & shared)
    return hit.drop("t").orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def _newest_near(events: DataFrame, keys: list[str], limit: int, hours: int, at_most: int) -> DataFrame:
    """(id, near) per key: the newest rows of the key up to ``hours`` after each event.

    Each event looks up the last row at or before its time plus the span; that
    row brings itself and the rows before it.  No pairs are formed.  All keys
    go through one pass, told apart by their number.
    """
    own = [F.struct(F.lit(i).alias("kind"), F.col(k).alias("key")) for i, k in enumerate(keys)]
    rows = events.select("id", "ts", F.inline(F.array(*own))).where(F.col("key").isNotNull())
    at_most = at_most * len(keys)
    by = ["kind", "key"]
    rows = shared(previous_rows(rows, by, ["ts", "id"], F.struct("ts", "id"), limit, ts="ts", at_most=at_most))
    span = F.expr(f"INTERVAL {hours} HOUR")
    item = F.struct("ts", "id", F.concat("prev", F.array(F.struct("ts", "id"))).alias("near"))
    none = F.lit(None)
    probe = F.struct(F.col("id"), F.col("ts"))
    item_type = "struct<ts:timestamp,id:bigint,near:array<struct<ts:timestamp,id:bigint>>>"
    steps = rows.select(*by, F.explode(F.array(
        F.struct(F.col("ts").alias("pos"), F.lit(0).alias("phase"), F.col("id").alias("tie"), item.alias("item"),
                 none.cast("struct<id:bigint,ts:timestamp>").alias("probe")),
        F.struct((F.col("ts") + span).alias("pos"), F.lit(1).alias("phase"), F.col("id").alias("tie"),
                 none.cast(item_type).alias("item"), probe.alias("probe")),
    )).alias("s")).select(*by, "s.*")
    seen = running(steps, by, ["pos", "phase", "tie"], ts="pos", maxs={"last": F.col("item")}, at_most=2 * at_most)
    inside = F.filter("last.near", lambda r: (r["id"] != F.col("probe.id")) & (r["ts"] >= F.col("probe.ts") - span))
    return seen.where(F.col("probe").isNotNull()).select(F.col("probe.id").alias("id"), inside.alias("near"))


def related_events(events: DataFrame, limit: int = 10, hours: int = 1) -> DataFrame:
    """(id, related) for every event: ids and times, newest first."""
    narrow = truncate_lineage(events.select("id", "ts", "source_ip", "source", "event_type"))  # parsed once for three keys
    n = narrow.count()
    every = _newest_near(narrow, ["source_ip", "source", "event_type"], limit, hours, n)
    merged = every.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return merged.select("id", F.slice(F.sort_array("near", asc=False), 1, limit).alias("related"))


def event_details(events: DataFrame, detections: DataFrame, limit: int = 10) -> DataFrame:
    """Each event with its related events, its detections and a timeline entry."""
    entry = F.struct(
        F.col("ts").alias("ts"), F.lit("HTTP Request").alias("event_type"),
        F.concat(F.lit("Request from "), F.coalesce("source_ip", F.lit("unknown source"))).alias("description"),
        F.lit("Info").alias("severity"))
    return (
        events.withColumn("timeline", F.array(entry))
        .join(related_events(events, limit), "id", "left").join(detections, "id", "left")
    )


# --- indicators and rules ---------------------------------------------------

def ioc_match(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """(id, indicators): values found in an event, for events with any.

    Addresses meet by equality, names and URLs by substring.
    """
    events = shared(events.select("id", "source_ip", "raw_message"))  # read once per kind of indicator
    ip = indicators.where("ioc_type = 'IpAddress'").select(F.col("value").alias("_value"))
    by_ip = events.select("id", "source_ip").join(ip, F.col("source_ip") == F.col("_value")).select("id", "_value")
    text = indicators.where("ioc_type IN ('Domain', 'Url')").select(F.col("value").alias("_value"))
    by_text = substring_join(events.select("id", "raw_message"), "raw_message", text, "_value").select("id", "_value")
    agent = indicators.where("ioc_type = 'UserAgent'").select(F.col("value").alias("_value"))
    with_agent = events.where(F.col("raw_message").contains("User-Agent")).select("id", "raw_message")
    by_agent = substring_join(with_agent, "raw_message", agent, "_value").select("id", "_value")
    hits = by_ip.unionByName(by_text).unionByName(by_agent)
    return hits.groupBy("id").agg(F.array_sort(F.collect_list("_value")).alias("indicators"))


def rule_match(events: DataFrame, rules: DataFrame, text: str = "raw_message") -> DataFrame:
    """(id, rules, confidence, attack_types) for events any user rule matches.

    ``rules`` has name, pattern, confidence, attack_type.
    """
    named = rules.select(F.col("name").alias("_name"), F.col("pattern").alias("_pattern"), "confidence", "attack_type")
    hits = pattern_join(events.select("id", text), text, named, "_pattern")
    return hits.groupBy("id").agg(
        F.array_sort(F.collect_list("_name")).alias("rules"), F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set("attack_type")).alias("attack_types"))


# --- dimensions -------------------------------------------------------------

def geo_enrich(events: DataFrame, geo: DataFrame) -> DataFrame:
    """The columns of ``geo`` by the longest network that holds the event's address.

    ``prefix`` is ``a.b.`` (whole octets), a network ``a.b.c.d/n`` or ``x::/n``
    of any length, or an address (``range_networks`` makes networks of a
    range); rows whose prefix can't be read hold nothing.  Networks may be
    nested; of rows with the same network one counts, the first as JSON.

    Every distinct address is looked up once: one equi-join with a key per
    length of prefix that occurs, 162 at most, and the longest match wins.
    """
    fields = [c for c in geo.columns if c != "prefix"]
    networks = geo.select(network_bits(F.col("prefix")).alias("_k"), F.struct(*fields).alias("_g")).where("_k IS NOT NULL")
    networks = networks.groupBy("_k").agg(F.min_by("_g", F.to_json("_g")).alias("_g"))
    lengths = sorted(r[0] for r in networks.select(F.length("_k")).distinct().collect())
    addresses = events.select("source_ip").where(F.col("source_ip").isNotNull()).distinct().withColumn("_b", address_bits(F.col("source_ip")))
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("_b"))
    keyed = addresses.select("source_ip", F.explode(F.transform(fitting, lambda n: F.substring(F.col("_b"), F.lit(1), n))).alias("_k"))
    found = keyed.join(networks, "_k").groupBy(F.col("source_ip").alias("_ip")).agg(F.max_by("_g", F.length("_k")).alias("_g"))
    out = events.join(found, F.col("source_ip") == F.col("_ip"), "left").drop("_ip")
    unknown = {"country": "Unknown", "code": "XX", "name": "Unknown"}
    return out.select("*", *[
        F.coalesce(F.col(f"_g.{f}"), F.lit(unknown[f])).alias(f) if f in unknown else F.col(f"_g.{f}").alias(f)
        for f in fields
    ]).drop("_g")


def threat_intel_enrich(events: DataFrame, intel: DataFrame) -> DataFrame:
    """Assessment, usual attacks and known groups of the event's country."""
    country = country_of(F.col("source_ip"))
    known = F.when(country.isin("China", "Russia", "North Korea"), country).otherwise("Unknown/Various")
    return events.withColumn("country", known).join(intel, "country", "left")


def event_context_enrich(events: DataFrame, context: DataFrame) -> DataFrame:
    """What analysts are told about the event's type; '*' serves other types."""
    known = F.when(F.col("event_type").isin("SqlInjection", "XssAttempt", "BruteForce", "Anomaly"), F.col("event_type"))
    keyed = events.withColumn("_context", F.coalesce(known, F.lit("*")))
    side = context.withColumnRenamed("event_type", "_context")
    return keyed.join(side, "_context", "left").drop("_context")


def payload_triage(events: DataFrame) -> DataFrame:
    """Encoding flag, obfuscation techniques and ad-hoc indicators."""
    m = F.col("raw_message")
    return events.withColumns({
        "encoding_detected": m.contains("encode") | m.contains("%"),
        "obfuscation": F.array_compact(F.array(
            F.when(m.contains("%"), "URL Encoding detected"),
            F.when(m.contains("\\x"), "Hexadecimal encoding detected"),
            F.when(m.contains("base64") | m.contains("btoa"), "Base64 encoding detected"),
            F.when(F.octet_length(m) > F.length(m), "Unicode obfuscation possible"))),
        "found_indicators": F.array_compact(F.array(
            F.when(F.col("source_ip").isNotNull(), F.concat(F.lit("IP Address:"), "source_ip")),
            F.when(m.contains("UNION"), "Attack Pattern:SQL UNION"),
            F.when(m.contains("<script>"), "Attack Pattern:<script> tag"))),
    })


def technique_mitigation(findings: DataFrame, advice: DataFrame) -> DataFrame:
    """(id, mitigations): advice for each finding's techniques, in their order.

    ``advice`` has technique and steps.
    """
    parts = findings.select("id", F.posexplode("techniques").alias("_pos", "technique")).join(advice, "technique")
    gathered = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_pos", "steps"))).alias("_s"))
    return gathered.select("id", F.flatten(F.transform("_s", lambda s: s["steps"])).alias("mitigations"))


def whitelist_filter(events: DataFrame, whitelist: DataFrame, flag: bool = False) -> DataFrame:
    """Without (or, with ``flag``, marking) events from whitelisted addresses."""
    known = whitelist.where("pattern_type = 'internal_ip'").select(F.col("pattern_value").alias("_ip")).distinct()
    match = events["source_ip"] == known["_ip"]
    if not flag:
        return events.join(known, match, "left_anti")
    return events.join(known, match, "left").withColumn("whitelisted", F.col("_ip").isNotNull()).drop("_ip")


# --- routing ----------------------------------------------------------------

def alert_route(alerts: DataFrame, routing: DataFrame, enabled: list[str]) -> DataFrame:
    """One row per alert and enabled channel; a severity without an entry goes
    to the console, and to e-mail and webhook too when Critical."""
    routes = routing.groupBy("severity").agg(F.array_sort(F.collect_list(F.struct("position", "channel"))).alias("_r"))
    configured = F.transform("_r", lambda r: r["channel"])
    fallback = F.when(F.col("severity") == "Critical", F.array(F.lit("console"), F.lit("email"), F.lit("webhook"))).otherwise(
        F.array(F.lit("console")))
    wanted = F.coalesce(configured, fallback)
    open_channels = F.filter(wanted, lambda c: c.isin(*enabled))
    routed = alerts.join(routes, "severity", "left").withColumn("channels", open_channels).drop("_r")
    return routed.select("*", F.posexplode("channels").alias("position", "channel")).drop("channels")


def _accepted(severity_filter: Column, alert_types: Column) -> Column:
    """Severities that pass a filter and, where given, a list of severities."""
    by_filter = (
        F.when(severity_filter == "All", F.array(*[F.lit(s) for s in ("Low", "Info", "Medium", "Warning", "High", "Critical")]))
        .when(severity_filter == "Warning", F.array(F.lit("Warning"), F.lit("Critical")))
        .otherwise(F.array(F.lit("Critical")))
    )
    return F.when(F.size(alert_types) > 0, F.array_intersect(by_filter, alert_types)).otherwise(by_filter)


def alert_recipients(alerts: DataFrame, recipients: DataFrame) -> DataFrame:
    """Alert x recipient: severity filter, alert types and active hours.

    ``recipients``: address, severity_filter, alert_types, start_hour,
    end_hour, weekdays_only (hours NULL: always).
    """
    from palisade.operators.query import active_hours_gate

    wanted = recipients.withColumn("severity", F.explode(_accepted(F.col("severity_filter"), F.col("alert_types"))))
    joined = alerts.join(wanted, "severity")
    awake = F.col("start_hour").isNull() | active_hours_gate(F.col("ts"), F.col("start_hour"), F.col("end_hour"), F.col("weekdays_only"))
    return joined.where(awake)


def alert_endpoints(alerts: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Alert x webhook endpoint: enabled, severity filter, alert types."""
    wanted = endpoints.where("enabled").withColumn(
        "severity", F.explode(_accepted(F.col("severity_filter"), F.col("alert_types"))))
    return alerts.join(wanted, "severity")


# --- similarity -------------------------------------------------------------

_SIMILAR = "id long, similar array<struct<similarity:double,id:bigint,ts:timestamp,source_ip:string,event_type:string,was_anomaly:boolean>>"


def similar_events(vectors: DataFrame, samples: DataFrame, *, newest: int | None = None, least: float = 0.8, top: int = 5) -> DataFrame:
    """(id, similar): the ``top`` cosine neighbours above ``least`` of every vector, best first.

    Both tables have id and features; samples may have ts, source_ip,
    event_type and label (true: it was an anomaly), which come back with each
    neighbour.  All samples are compared unless ``newest`` asks for a few.  They
    and the vectors are packed into blocks, and a task reads its block of
    vectors and the blocks of samples one after the other, a product of two
    matrices each: no row is copied for the rows that it meets, and only the
    best of a task's samples leave it.  Vectors that are NULL, empty or hold NULL or
    non-finite numbers, and those of another length, are similar to nothing.
    ``similar_indexed`` finds nearly all of them without comparing everything.
    """
    def able(df: DataFrame) -> DataFrame:
        bad = F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
        return df.where(F.col("id").isNotNull() & (F.size("features") > 0) & ~bad)

    refs = truncate_lineage(able(references(samples, newest).withColumn("id", F.col("id").cast("long"))).withColumn("features", F.col("features").cast("array<double>")))
    mine = truncate_lineage(vectors.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features")))
    member = F.struct("id", "ts", "source_ip", "event_type", "was_anomaly")
    left = packed(able(mine), F.struct("id"), VECTORS_BYTES, VECTORS_BYTES)
    right = packed(refs, member, SAMPLES_BYTES, TASK_BYTES).select(
        F.col("dim").alias("samples_dim"), F.col("vec").alias("samples_vec"), F.col("members").alias("samples"))
    parts = left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(best_of_blocks(least, top), _SIMILAR)
    order = F.transform(F.flatten(F.collect_list("similar")), lambda s: F.struct((-s["similarity"]).alias("k"), s["id"].alias("i"), s.alias("s")))
    best = parts.groupBy("id").agg(F.transform(F.slice(F.sort_array(order), 1, top), lambda o: o["s"]).alias("similar"))
    empty = F.array().cast(_SIMILAR.split("similar ", 1)[1])
    return mine.select("id").join(best, "id", "left").select("id", F.coalesce("similar", empty).alias("similar"))
