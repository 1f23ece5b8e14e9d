"""Login attempts: histories per address, user and service, and their scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions import dimensions as D, rules as R
from palisade.functions.text import names_matching
from palisade.operators.parse import event_fields
from palisade.operators.payload import _advice, _distinct, _texts, rule_hits
from palisade.operators.query import ago, at
from palisade.plans.running import Sliding, previous_rows, running, shared, sliding

MAX_PER_IP, MAX_PER_USER, WINDOW_SECONDS, LOCKOUT_MINUTES = 10, 5, 900, 30


def attempt_outcome(status: Column, message: Column) -> Column:
    """True for a success: by status code, else by wording, else a failure."""
    wording = reduce(lambda a, b: a | b, [message.rlike(p) for p in R.SUCCESS_PATTERNS])
    return (
        F.when(status.between(200, 299), True).when(status.between(400, 599), False)
        .when(wording, True).otherwise(False)
    )


def attempts(events: DataFrame, auth_only: bool = False) -> DataFrame:
    """One attempt per event with an address; only login events on request."""
    known = event_fields(events).where(F.col("source_ip").isNotNull())
    if auth_only:
        known = known.where(F.col("username").isNotNull() | (F.size(bf_pattern_hits(F.col("raw_message"))) > 0))
    return known.select(
        "id", "ts", "source_ip", "username", "service", "user_agent",
        attempt_outcome(F.col("status"), F.col("raw_message")).alias("success"))


def _last_same(df: DataFrame, key: str, value: str, out: str, at_most: int) -> DataFrame:
    """Time of the key's previous row with the same value; NULL values have none."""
    own = F.coalesce(F.col(value), F.concat(F.lit("\u0000"), F.col("id").cast("string")))
    df = previous_rows(df.withColumn("_same", own), [key, "_same"], ["ts", "id"], F.col("ts"), 1, ts="ts", out="_before", at_most=at_most)
    return shared(df.withColumn(out, F.get("_before", F.lit(0))).drop("_same", "_before"))


def _one() -> Column:
    return F.lit(1)


def _ok() -> Column:
    return F.col("success").cast("int")


def _failed() -> Column:
    return (~F.col("success")).cast("int")


def ip_history(tries: DataFrame) -> DataFrame:
    """Per address, up to each attempt: totals, services, agents; users of 15 min."""
    n = tries.count()
    seen = _last_same(tries, "source_ip", "username", "_user_ts", n)
    out = sliding(
        seen, ["source_ip"], at_most=n,
        windows=[Sliding("ip_users", WINDOW_SECONDS, True, F.col("username").isNotNull(), F.col("_user_ts"))],
        sums={"ip_total": _one(), "ip_failed": _failed(), "ip_success": _ok()}, mins={"ip_first": F.col("ts")},
        distinct={"ip_services": F.col("service"), "ip_agents": F.col("user_agent")})
    return out.drop("_user_ts")


def user_history(tries: DataFrame) -> DataFrame:
    """Per user, up to each attempt: totals, addresses, success after a failure."""
    named = tries.where(F.col("username").isNotNull())
    place = F.struct("ts", "id")
    out = sliding(
        named, ["username"], windows=[], at_most=named.count(), sums={"user_total": _one(), "user_failed": _failed()},
        mins={"_fail": F.when(~F.col("success"), place)}, maxs={"_ok": F.when(F.col("success"), place)},
        distinct={"user_ips": F.col("source_ip")})
    return out.withColumn("user_compromised", F.coalesce(F.col("_fail") < F.col("_ok"), F.lit(False))).drop("_fail", "_ok")


def service_history(tries: DataFrame) -> DataFrame:
    """Per service, up to each attempt: total, addresses and users of 15 min,
    and the highest count of any 60 s so far."""
    n = tries.count()
    seen = _last_same(tries, "service", "source_ip", "_ip_ts", n)
    seen = _last_same(seen, "service", "username", "_user_ts", n)
    out = sliding(
        seen, ["service"], at_most=n, sums={"service_total": _one()}, windows=[
            Sliding("service_ips", WINDOW_SECONDS, True, F.col("source_ip").isNotNull(), F.col("_ip_ts")),
            Sliding("service_users", WINDOW_SECONDS, True, F.col("username").isNotNull(), F.col("_user_ts")),
            Sliding("_minute", 60, False, F.lit(True)),
        ])
    out = running(shared(out), ["service"], ["ts", "id"], ts="ts", maxs={"service_peak": F.col("_minute")}, at_most=n)
    return out.drop("_ip_ts", "_user_ts", "_minute")


def ip_behavior(history: DataFrame) -> DataFrame:
    """Rates and reputation from ``ip_history``."""
    rate = F.col("ip_failed") / F.col("ip_total")
    minutes = F.greatest(F.floor((F.unix_micros("ts") - F.unix_micros("ip_first")) / 60_000_000), F.lit(1))
    df = history.withColumns({"failure_rate": rate, "span_minutes": minutes.cast("long")})
    df = df.withColumn("per_minute", F.col("ip_total") / F.col("span_minutes"))
    spread = (F.col("ip_agents") > 3) | (F.col("ip_services") > 2)

    def minus(condition: Column, points: float) -> Column:
        return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))

    reputation = (
        F.lit(1.0) - minus(F.col("failure_rate") > 0.8, 0.4) - minus(F.col("per_minute") > 5.0, 0.3)
        - minus(F.col("ip_services") > 3, 0.2) - minus(spread, 0.1)
    )
    return df.withColumns({"is_distributed": spread, "reputation": F.greatest(reputation, F.lit(0.0))})


def compromise_confidence(compromised: Column, failed: Column, ips: Column) -> Column:
    return (
        F.when(compromised, 0.9).when(failed > MAX_PER_USER, 0.7).when(ips > 3, 0.6).otherwise(F.lit(0.0))
    )


def user_behavior(history: DataFrame) -> DataFrame:
    return history.withColumn("compromise_confidence", compromise_confidence(
        F.col("user_compromised"), F.col("user_failed"), F.col("user_ips")))


def service_behavior(history: DataFrame) -> DataFrame:
    return history.withColumn(
        "under_attack",
        (F.col("service_peak") > 10) | (F.col("service_ips") > 5) | (F.col("service_total") > 50))


def bf_pattern_hits(message: Column) -> Column:
    return rule_hits(message, R.BRUTE_FORCE_RULES)


def bf_patterns(events: DataFrame) -> DataFrame:
    """Matched rule names, attack types and services of each message."""
    df = events.withColumn("_hits", bf_pattern_hits(F.col("raw_message")))
    return df.withColumns({
        "patterns": F.transform("_hits", lambda h: h["name"]), "attack_types": _distinct(F.col("_hits"), "attack_type"),
        "services_targeted": _distinct(F.col("_hits"), "scope"),
    }).drop("_hits")


#: What is counted along each kind of key: the key's column, and (column, seconds) of up to three measures, the distinct
#: values of the last ``seconds`` or, without, of all time.
_KINDS = {
    "ip": ("source_ip", [("username", WINDOW_SECONDS), ("service", None), ("user_agent", None)]),
    "user": ("username", [("source_ip", None)]),
    "service": ("service", [("source_ip", WINDOW_SECONDS), ("username", WINDOW_SECONDS)]),
}
_MINUTE = 2  # the measure of a service that counts the rows of the last minute
_STEP = "struct<pos:bigint,tie:bigint,slot:int,delta:int>"


def _distinct_steps(tries: DataFrame, at_most: int) -> DataFrame:
    """(kind, key, pos, tie, slot, delta): where the distinct counts of a key change.

    A value counts from its row on; it leaves ``seconds`` after it was last
    seen, so a value seen again in time cancels its earlier leaving.
    """
    values = [
        F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.lit(slot).alias("slot"), F.col(value).alias("value"),
                 F.lit(seconds).cast("long").alias("seconds"))
        for kind, (key, measures) in _KINDS.items() for slot, (value, seconds) in enumerate(measures)]
    rows = tries.select("id", "ts", F.inline(F.array(*values))).where(F.col("key").isNotNull() & F.col("value").isNotNull())
    rows = previous_rows(rows, ["kind", "key", "slot", "value"], ["ts", "id"], F.unix_micros("ts"), 1, ts="ts", at_most=len(values) * at_most)
    t, before, span = F.unix_micros("ts"), F.get("prev", F.lit(0)), F.col("seconds") * 1_000_000
    last = F.lit((1 << 63) - 1).cast("long")
    kept = F.coalesce(F.col("seconds").isNull() & before.isNotNull() | (t - before <= span), F.lit(False))

    def step(when: Column, pos: Column, tie: Column, delta: int) -> Column:
        return F.when(when, F.struct(pos.alias("pos"), tie.alias("tie"), F.col("slot"), F.lit(delta).alias("delta")).cast(_STEP))

    leaves = F.col("seconds").isNotNull()
    steps = F.array_compact(F.array(
        step(~kept, t, F.col("id").cast("long"), 1), step(leaves & kept, before + span, last, 1), step(leaves, t + span, last, -1)))
    return rows.select("kind", "key", F.inline(steps))


def bf_profile(tries: DataFrame) -> DataFrame:
    """Every attempt with the behaviour of its address, user and service.

    Equal to ``ip_history``, ``user_history`` and ``service_history`` joined by
    id, but all three kinds of key go through one pass: one look for each
    value's previous row, one running sum over rows and changes.
    """
    n = tries.count()
    steps = shared(_distinct_steps(tries, n)).select(
        "*", F.lit(0).alias("phase"), *[F.lit(None).cast(tries.schema[c].dataType).alias(c) for c in ("id", "ts", "success")])
    own = [F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key")) for kind, (key, _) in _KINDS.items()]
    rows = tries.select("id", "ts", "success", F.inline(F.array(*own))).where(F.col("key").isNotNull())
    t, is_service = F.unix_micros("ts"), F.col("kind") == "service"
    place = [t.alias("pos"), F.col("id").cast("long").alias("tie"), F.lit(_MINUTE).alias("slot"), is_service.cast("int").alias("delta")]
    past = rows.where(is_service).select(
        "kind", "key", (t + 60_000_000).alias("pos"), F.lit(-(1 << 63)).cast("long").alias("tie"), F.lit(_MINUTE).alias("slot"),
        F.lit(-1).alias("delta"), F.lit(0).alias("phase"), *[F.lit(None).cast(tries.schema[c].dataType).alias(c) for c in ("id", "ts", "success")])
    steps = steps.unionByName(past).unionByName(rows.select("kind", "key", *place, F.lit(1).alias("phase"), "id", "ts", "success"))

    is_row, spot = F.col("phase") == 1, F.struct("ts", "id")
    of_user = is_row & (F.col("kind") == "user")
    total = running(
        steps.withColumn("at", F.timestamp_micros("pos")), ["kind", "key"], ["at", "tie", "phase"], ts="at", at_most=13 * n,
        sums={f"m{i}": F.when(F.col("slot") == i, F.col("delta")).otherwise(0) for i in range(3)}
        | {"total": is_row.cast("int"), "failed": (is_row & ~F.col("success")).cast("int"), "good": (is_row & F.col("success")).cast("int")},
        mins={"first": F.col("ts"), "fail": F.when(of_user & ~F.col("success"), spot)}, maxs={"ok": F.when(of_user & F.col("success"), spot)})
    total = shared(total.where(is_row).select("kind", "key", "id", "ts", "m0", "m1", "m2", "total", "failed", "good", "first", "fail", "ok"))

    def named(kind: str, **columns: str) -> DataFrame:
        return total.where(F.col("kind") == kind).select("id", *[F.col(c).alias(n) for n, c in columns.items()])

    ips = named("ip", ip_users="m0", ip_services="m1", ip_agents="m2", ip_total="total", ip_failed="failed", ip_success="good", ip_first="first")
    users = named("user", user_ips="m0", user_total="total", user_failed="failed", fail="fail", ok="ok").withColumn(
        "user_compromised", F.coalesce(F.col("fail") < F.col("ok"), F.lit(False))).drop("fail", "ok")
    services = named("service", key="key", ts="ts", service_ips="m0", service_users="m1", minute="m2", service_total="total")
    services = running(services, ["key"], ["ts", "id"], ts="ts", maxs={"service_peak": F.col("minute")}, at_most=n).drop("key", "ts", "minute")
    return (
        ip_behavior(tries.join(ips, "id")).join(service_behavior(services), "id").join(user_behavior(users), "id", "left")
    )


def bf_indicators() -> Column:
    """``array<struct<type, severity, confidence>>`` over ``bf_profile`` columns."""
    c = F.col
    compromised = F.coalesce(c("user_compromised"), F.lit(False))
    table = [
        (c("failure_rate") > 0.8, "high_failure_rate", "High", F.lit(0.9)),
        (c("per_minute") > 5.0, "high_attempt_rate", "Medium", F.lit(0.8)),
        (c("ip_services") > 2, "multiple_services", "High", F.lit(0.7)),
        (c("reputation") < 0.3, "low_reputation", "Critical", F.lit(0.8)),
        (compromised, "account_compromise", "Critical", c("compromise_confidence")),
        (c("user_ips") > 3, "multiple_source_ips", "Medium", F.lit(0.7)),
        (c("under_attack"), "service_under_attack", "High", F.lit(0.9)),
        (c("service_peak") > 20, "ddos_like_pattern", "Critical", F.lit(0.8)),
    ]
    return F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), conf.alias("confidence")))
        for cond, t, s, conf in table
    ]))


def _with_severity(indicators: Column, severity: str) -> Column:
    return F.size(F.filter(indicators, lambda i: i["severity"] == severity))


def bf_detect(profile: DataFrame) -> DataFrame:
    """Score, verdict and risk of each attempt of ``bf_profile``."""
    df = profile.withColumn("indicators", bf_indicators())
    df = df.withColumns({
        "_critical": _with_severity(F.col("indicators"), "Critical"), "_high": _with_severity(F.col("indicators"), "High"),
    })
    c = F.col
    compromised = F.coalesce(c("user_compromised"), F.lit(False))
    terms = [
        c("failure_rate") * 0.3,
        F.least(c("per_minute") / 10.0, F.lit(1.0)) * 0.25,
        F.when(c("ip_services") > 1, F.lit(0.2)),
        (1.0 - c("reputation")) * 0.15,
        F.when(compromised, c("compromise_confidence") * 0.3),
        F.when(c("under_attack"), F.lit(0.25)),
        F.when(c("_critical") > 0, F.least(c("_critical") * 0.1, F.lit(0.3))),
    ]
    present = F.array_compact(F.array(*terms))
    df = df.withColumn("_terms", present)
    total = F.aggregate("_terms", F.lit(0.0), lambda a, t: a + t)
    df = df.withColumn("confidence", F.least(total / F.size("_terms"), F.lit(1.0)))
    return df.withColumns({
        "detected": (c("confidence") >= 0.3) | (c("ip_total") >= MAX_PER_IP),
        "risk_level": bf_risk(c("confidence"), c("_critical"), c("_high")),
        "sophistication": bf_sophistication(c("_critical")),
    }).drop("_terms", "_critical", "_high")


def bf_risk(confidence: Column, critical: Column, high: Column) -> Column:
    c = F.col
    return (
        F.when((critical > 0) | (confidence >= 0.9), "Critical")
        .when((high > 1) | (confidence >= 0.7), "High")
        .when((c("ip_total") >= MAX_PER_IP) | (c("per_minute") > 10.0) | (c("ip_services") > 3), "High")
        .when((confidence >= 0.4) | (c("failure_rate") > 0.7), "Medium")
        .otherwise("Low")
    )


def bf_sophistication(critical: Column) -> Column:
    c = F.col

    def plus(condition: Column, points: float) -> Column:
        return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))

    return F.least(
        plus(c("ip_agents") > 3, 0.2) + plus(c("ip_services") > 2, 0.3)
        + plus((c("per_minute") < 2.0) & (c("ip_total") > 20), 0.2) + plus(critical > 2, 0.3), F.lit(1.0))


def bf_mitigations(attack_types: Column) -> Column:
    """Sorted advice for an attempt of ``bf_profile`` with these attack types."""
    c = F.col

    def filled(texts: list[str], value: Column, when: Column) -> Column:
        return F.when(when, F.array(*[F.replace(F.lit(t), F.lit("{}"), value) for t in texts])).otherwise(
            F.array().cast("array<string>"))

    return F.array_sort(F.array_distinct(F.concat(
        _texts(D.BRUTE_GENERAL_ADVICE), _advice(attack_types, D.BRUTE_TYPE_ADVICE),
        filled([D.BRUTE_BLOCK_ADVICE], c("source_ip"), c("ip_total") >= MAX_PER_IP),
        _texts(D.BRUTE_MULTI_SERVICE_ADVICE, c("ip_services") > 2),
        _texts(D.BRUTE_REPUTATION_ADVICE, c("reputation") < 0.3),
        filled(D.BRUTE_SERVICE_ADVICE, c("service"), c("under_attack")),
        _texts(D.BRUTE_PEAK_ADVICE, c("service_peak") > 20))))


# --- state per key ----------------------------------------------------------

def ip_block_state(tries: DataFrame, as_of=None) -> DataFrame:
    """Addresses with ten lifetime failures; each later attempt renews the block."""
    now = at(as_of, tries)
    per_ip = tries.groupBy("source_ip").agg(
        F.count_if(~F.col("success")).alias("failed"), F.max("ts").alias("last_ts"))
    hit = per_ip.where(F.col("failed") >= MAX_PER_IP)
    until = F.col("last_ts") + F.expr(f"INTERVAL {LOCKOUT_MINUTES} MINUTE")
    return hit.withColumn("block_until", until).withColumn("blocked", F.col("block_until") > now)


def unblock_ip(blocks: DataFrame, unblocks: DataFrame) -> DataFrame:
    """Blocks without those lifted by hand after the address's last attempt."""
    lifted = unblocks.groupBy("source_ip").agg(F.max("ts").alias("unblock_ts"))
    cond = (blocks["source_ip"] == lifted["source_ip"]) & (lifted["unblock_ts"] >= blocks["last_ts"])
    return blocks.join(lifted, cond, "left_anti")


def bf_statistics(tries: DataFrame, top: int = 10) -> DataFrame:
    """Long table (measure, name, n) of the monitored keys."""
    ips = tries.groupBy("source_ip").agg(F.count("*").alias("total"), F.count_if(~F.col("success")).alias("failed"))
    place = F.struct("ts", "id")
    users = tries.where(F.col("username").isNotNull()).groupBy("username").agg(
        F.min(F.when(~F.col("success"), place)).alias("fail"), F.max(F.when(F.col("success"), place)).alias("ok"))
    services = sliding(
        tries.select("id", "ts", "service"), ["service"], windows=[Sliding("minute", 60, False, F.lit(True))],
    ).groupBy("service").agg(F.max("minute").alias("peak"))

    def measures(df: DataFrame, **named: Column) -> DataFrame:
        sums = df.agg(*[c.alias(n) for n, c in named.items()])
        return sums.select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("measure"), F.lit("").alias("name"), F.col(n).cast("long").alias("n")) for n in named
        ])).alias("m")).select("m.*")

    out = measures(
        ips, monitored_ips=F.count("*"), blocked_ips=F.count_if(F.col("failed") >= MAX_PER_IP),
        high_risk_ips=F.count_if(F.col("failed") >= MAX_PER_IP // 2))
    out = out.unionByName(measures(users, monitored_users=F.count("*"), compromised_users=F.count_if(F.col("fail") < F.col("ok"))))
    out = out.unionByName(measures(services, monitored_services=F.count("*"), services_under_attack=F.count_if(F.col("peak") > 10)))
    leaders = ips.orderBy(F.desc("total"), "source_ip").limit(top)
    return out.unionByName(leaders.select(
        F.lit("top_ip").alias("measure"), F.col("source_ip").alias("name"), F.col("total").alias("n")))


# --- names and secrets ------------------------------------------------------

def username_patterns(tries: DataFrame, key: str = "source_ip", name: str = "username") -> DataFrame:
    """Per key: common account names tried, and three consecutive numbers."""
    names = tries.select(key, F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct()
    low = F.lower("name")
    common = names.groupBy(key).agg(*[F.max(low.contains(w)).alias(w) for w in R.COMMON_USERNAMES])
    number = F.when(F.col("name").rlike(r"^[+-]?[0-9]+$"), F.col("name").try_cast("int"))
    row = F.struct(F.octet_length("name").alias("size"), number.alias("number"))
    near = previous_rows(
        names.withColumn("row", row), [key], ["name"], F.col("row"), 2, bucket=F.substring("name", 1, 6))
    a, b, c = F.get("prev", F.lit(0)), F.get("prev", F.lit(1)), F.col("row")
    in_row = (
        (F.size("prev") == 2) & (a["size"] == b["size"]) & (b["size"] == c["size"])
        & (b["number"] == a["number"] + 1) & (c["number"] == b["number"] + 1)
    )
    sequence = near.groupBy(key).agg(F.coalesce(F.max(in_row), F.lit(False)).alias("sequential"))
    found = F.array_compact(F.array(
        *[F.when(F.col(w), F.lit("common_username_" + w)) for w in R.COMMON_USERNAMES],
        F.when(F.col("sequential"), F.lit("sequential_numeric_usernames"))))
    return common.join(sequence, key).select(key, found.alias("patterns"))


def credential_entropy(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Shannon entropy over all characters of a key's strings."""
    chars = rows.select(key, F.explode(F.split(text, "")).alias("ch")).where("ch <> ''")
    counts = chars.groupBy(key, "ch").agg(F.count("*").alias("n"))
    # sum(p*log2(p)) = sum(n*log2(n))/N - log2(N): one pass, no total per key first
    total = F.sum("n")
    return counts.groupBy(key).agg(
        (F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"))
