"""Statistical anomaly detection: features, fitted models, scores, feedback."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.functions import dimensions as D, rules as R
from palisade.functions.text import contains_any, count_chars, is_private_ip, text_entropy
from palisade.operators.parse import user_agent
from palisade.operators.query import ago, at
from palisade.plans.running import Sliding, halving_mean, previous_rows, running, shared, sliding

# Feature names in vector order.
FEATURES = [
    "log_request_size", "log_response_size", "log_response_time", "status_code_normalized", "payload_entropy",
    "log_special_chars", "keyword_matches",
    "log_requests_last_hour", "log_requests_last_10min", "log_time_since_last", "request_interval_variance",
    "hour_of_day", "day_of_week",
    "user_agent_entropy", "user_agent_length", "user_agent_uncommon", "path_entropy", "path_length", "path_depth",
    "query_strings_count", "parameters_count", "suspicious_chars_count", "referer_entropy", "referer_length",
    "is_private_ip", "ip_class", "protocol_risk_score", "method_risk_score",
    "user_agent_deviation", "path_deviation", "method_deviation", "request_size_deviation", "response_time_deviation",
]
# Risk points of protocols and methods.
PROTOCOL_SCORES = {"HTTP/1.1": 1.0, "HTTP/1.0": 2.0, "HTTP/2.0": 0.5}
METHOD_SCORES = {
    "GET": 1.0, "POST": 1.5, "PUT": 2.0, "DELETE": 2.5, "OPTIONS": 3.0, "HEAD": 1.2, "TRACE": 4.0, "CONNECT": 4.0}
# Model settings.
THRESHOLD, MIN_SAMPLES, RETRAIN_HOURS, CLUSTERS, ROUNDS = 0.7, 1000, 6, 3, 10

_SPECIAL = R.SPECIAL_CHARS[1:-1].replace("\\[", "[").replace("\\]", "]").replace("\\\\", "\\")
_SUSPICIOUS = R.SUSPICIOUS_PATH_CHARS[1:-1]


# --- features ---------------------------------------------------------------

def ml_inputs(events: DataFrame) -> DataFrame:
    """The fourteen inputs of the feature extractors."""
    p = F.col("parsed")
    return events.select(
        "id", "ts", F.coalesce("source_ip", F.lit("")).alias("source_ip"),
        F.octet_length("raw_message").cast("long").alias("request_size"),
        F.coalesce(p["body_bytes"].try_cast("long"), F.lit(0)).alias("response_size"),
        F.floor(p["response_time"].try_cast("double") * 1000).cast("long").alias("response_time_ms"),
        p["status_code"].alias("status_code"), user_agent(events).alias("user_agent"),
        p["method"].alias("method"), p["path"].alias("path"), p["protocol"].alias("protocol"), p["referer"].alias("referer"),
        text_entropy(F.col("raw_message")).alias("payload_entropy"),
        count_chars(F.col("raw_message"), _SPECIAL).cast("long").alias("special_char_count"),
        F.size("iocs").cast("long").alias("keyword_matches"))


def basic_features() -> dict[str, Column]:
    c = F.col
    return {
        "log_request_size": F.log(c("request_size") + 1.0), "log_response_size": F.log(c("response_size") + 1.0),
        "log_response_time": F.log(F.coalesce(c("response_time_ms"), F.lit(100)) + 1.0),
        "status_code_normalized": F.coalesce(c("status_code"), F.lit(200)) / 1000.0,
        "payload_entropy": c("payload_entropy"), "log_special_chars": F.log(c("special_char_count") + 1.0),
        "keyword_matches": c("keyword_matches").cast("double"),
    }


def payload_features() -> dict[str, Column]:
    ua, path, ref = F.col("user_agent"), F.col("path"), F.col("referer")

    def of(value: Column, number: Column) -> Column:
        return F.when(value.isNotNull(), number.cast("double")).otherwise(F.lit(0.0))

    return {
        "user_agent_entropy": of(ua, text_entropy(ua)), "user_agent_length": of(ua, F.octet_length(ua)),
        "user_agent_uncommon": F.when(contains_any(ua, R.COMMON_AGENT_WORDS), 0.0).otherwise(F.lit(1.0)),
        "path_entropy": of(path, text_entropy(path)), "path_length": of(path, F.octet_length(path)),
        "path_depth": of(path, count_chars(path, "/")), "query_strings_count": of(path, count_chars(path, "?")),
        "parameters_count": of(path, count_chars(path, "&")),
        "suspicious_chars_count": of(path, count_chars(path, _SUSPICIOUS)),
        "referer_entropy": of(ref, text_entropy(ref)), "referer_length": of(ref, F.octet_length(ref)),
    }


def network_features() -> dict[str, Column]:
    ip, protocol, method = F.col("source_ip"), F.col("protocol"), F.col("method")
    octet = F.substring_index(ip, ".", 1).try_cast("int")
    ip_class = (
        F.when(octet.between(1, 126), 1.0).when(octet.between(128, 191), 2.0).when(octet.between(192, 223), 3.0)
        .when(octet.between(224, 239), 4.0).when(octet.between(240, 255), 5.0).otherwise(F.lit(0.0))
    )
    protocols, methods = F, F
    for name, score in PROTOCOL_SCORES.items():
        protocols = protocols.when(protocol == name, score)
    for name, score in METHOD_SCORES.items():
        methods = methods.when(method == name, score)
    return {
        "is_private_ip": is_private_ip(ip).cast("double"), "ip_class": ip_class,
        "protocol_risk_score": protocols.when(protocol.startswith("HTTP"), 3.0).otherwise(F.lit(4.0)),
        "method_risk_score": methods.otherwise(F.lit(3.0)),
    }


def temporal_features(inputs: DataFrame) -> DataFrame:
    """(id, six features) of each address's request rhythm."""
    rows = inputs.select("id", "ts", "source_ip")
    n = rows.count()
    counted = sliding(rows, ["source_ip"], at_most=n, windows=[
        Sliding("hour_n", 3600, True, F.lit(True)), Sliding("ten_n", 600, False, F.lit(True))]).select("id", "hour_n", "ten_n")
    near = previous_rows(rows, ["source_ip"], ["ts", "id"], F.col("ts"), 9, ts="ts", at_most=n)
    times = F.concat(F.filter("prev", lambda t: t >= F.col("ts") - F.expr("INTERVAL 1 HOUR")), F.array("ts"))
    near = near.withColumn("times", times)
    last = F.size("times") - 1
    gaps = F.transform(
        F.sequence(F.lit(1), last),
        lambda i: F.floor((F.unix_micros(F.get("times", i)) - F.unix_micros(F.get("times", i - 1))) / 1_000_000).cast("double"))
    near = near.withColumn("gaps", F.when(last >= 1, gaps).otherwise(F.array().cast("array<double>")))
    n = F.size("gaps")
    some = F.greatest(n, F.lit(1))
    near = near.withColumn("mean", F.aggregate("gaps", F.lit(0.0), lambda a, g: a + g) / some)
    spread = F.sqrt(F.aggregate("gaps", F.lit(0.0), lambda a, g: a + (g - F.col("mean")) * (g - F.col("mean"))) / some)
    return near.join(counted, "id").select(
        "id", F.log(F.col("hour_n").cast("double")).alias("log_requests_last_hour"),
        F.log(F.col("ten_n").cast("double")).alias("log_requests_last_10min"),
        F.when(n >= 1, F.log(F.get("gaps", n - 1) + 1.0)).otherwise(F.lit(0.0)).alias("log_time_since_last"),
        F.when(n >= 2, spread).otherwise(F.lit(0.0)).alias("request_interval_variance"),
        (F.hour("ts") / 24.0).alias("hour_of_day"), (F.weekday("ts") / 7.0).alias("day_of_week"))


_RARE = (("user_agent", "user_agent_deviation", 1.0), ("path", "path_deviation", 0.5), ("method", "method_deviation", 0.5))
_AWAY = (("request_size", "request_size_deviation"), ("response_time_ms", "response_time_deviation"))


def _exponential_deviations(inputs: DataFrame, at_most: int) -> DataFrame:
    """(id, name, x): distance from avg = (avg + x) / 2, started at 0, own value included, of every value there is."""
    values = [F.struct(F.lit(name).alias("name"), F.col(v).cast("double").alias("x")) for v, name in _AWAY]
    rows = inputs.select("id", "ts", "source_ip", F.inline(F.array(*values))).where(F.col("x").isNotNull())
    near = halving_mean(rows, ["name", "source_ip"], ["ts", "id"], F.col("x"), ts="ts", out="avg", at_most=len(_AWAY) * at_most)
    away = F.when(F.col("avg") > 0, F.least(F.abs(F.col("x") - F.col("avg")) / F.col("avg"), F.lit(10.0)))
    return near.select("id", "name", F.coalesce(away, F.lit(0.0)).alias("x"))


def _rarities(inputs: DataFrame, at_most: int) -> DataFrame:
    """(id, name, x): 1 - share of a value among the address's values of its kind so far; a missing value has none.

    The three kinds go through one pass per count, as narrow rows.  A missing
    value has a name no value has.  Of rows of one id that come twice, the second
    pass counts the later of the first pass first, whatever joins are chosen.
    """
    kinds = [F.struct(F.lit(name).alias("name"), F.lit(missing).alias("missing"), F.col(v).isNotNull().cast("int").alias("has"),
                      F.coalesce(F.col(v), F.lit("\u0000")).alias("value")) for v, name, missing in _RARE]
    rows = inputs.select("id", "ts", "source_ip", F.inline(F.array(*kinds)))
    at_most = len(_RARE) * at_most
    rows = running(rows, ["name", "source_ip", "value"], ["ts", "id"], ts="ts", sums={"same": F.lit(1)}, at_most=at_most).drop("value")
    rows = running(shared(rows), ["name", "source_ip"], ["ts", "id", F.desc("same")], ts="ts", sums={"all": F.col("has")}, at_most=at_most)
    return rows.select("id", "name", F.when(F.col("has") == 1, 1.0 - F.col("same") / F.col("all")).otherwise(F.col("missing")).alias("x"))


def behavior_features(inputs: DataFrame) -> DataFrame:
    """(id, five features) of how unusual an event is for its address."""
    inputs = inputs.where(F.col("source_ip").isNotNull())
    n = inputs.select("id").count()
    every = _rarities(inputs, n).unionByName(_exponential_deviations(inputs, n))
    names = [name for _, name, _ in _RARE] + [name for _, name in _AWAY]
    return every.groupBy("id").agg(*[F.coalesce(F.max(F.when(F.col("name") == name, F.col("x"))), F.lit(0.0)).alias(name) for name in names])


_OWN_FEATURES: dict[str, Column] = {}


def register_feature(name: str, value: Column) -> None:
    """Append a feature, a number from the columns of ``ml_inputs``, to every vector; a missing value counts as zero."""
    if name in FEATURES:
        raise ValueError(f"{name} is a feature already")
    _OWN_FEATURES[name] = value


def unregister_feature(name: str) -> None:
    _OWN_FEATURES.pop(name, None)


def feature_names() -> list[str]:
    """All features in vector order, registered ones last."""
    return [*FEATURES, *_OWN_FEATURES]


def feature_table(inputs: DataFrame) -> DataFrame:
    """id, ts, source_ip and all features as columns."""
    registered = {n: F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in _OWN_FEATURES.items()}
    own = inputs.select("id", "ts", "source_ip", *[
        c.alias(n) for part in (basic_features(), payload_features(), network_features(), registered) for n, c in part.items()])
    return own.join(temporal_features(inputs), "id").join(behavior_features(inputs), "id")


def feature_vector(inputs: DataFrame) -> DataFrame:
    """id, ts, source_ip, features: all features in order as one array."""
    return feature_table(inputs).select("id", "ts", "source_ip", F.array(*feature_names()).alias("features"))


# --- training samples -------------------------------------------------------

def collect_training(vectors: DataFrame, scored: DataFrame | None = None, keep: int | None = None) -> DataFrame:
    """Samples (id, ts, source_ip, features, event_type, label); on request the newest ``keep`` only."""
    out = vectors.select("id", "ts", "source_ip", "features", F.lit("web_request").alias("event_type"))
    if scored is None:
        out = out.withColumn("label", F.lit(None).cast("boolean"))
    else:
        out = out.join(scored.select("id", F.col("is_anomaly").alias("label")), "id", "left")
    return out.orderBy(F.desc("ts"), F.desc("id")).limit(keep) if keep else out


def mark_false_positive(feedback: DataFrame, vectors: DataFrame) -> DataFrame:
    """Feedback on events as negative samples with the events' own features."""
    marked = feedback.select(F.col("event_id").alias("id")).distinct()
    return vectors.join(marked, "id").select(
        "id", "ts", "source_ip", "features", F.concat(F.lit("marked_fp_"), F.col("id").cast("string")).alias("event_type"),
        F.lit(False).alias("label"))


def whitelist_patterns(negatives: DataFrame) -> DataFrame:
    """Internal addresses and clean-file types among negative samples."""
    ip = negatives.where(F.col("source_ip").rlike(r"^(192\.168\.|10\.)")).groupBy("source_ip").agg(F.count("*").alias("times_matched"))
    out = ip.select(F.lit("internal_ip").alias("pattern_type"), F.col("source_ip").alias("pattern_value"), F.lit(0.9).alias("confidence"), "times_matched")
    clean = negatives.where(F.col("event_type").contains("clean file")).groupBy("event_type").agg(F.count("*").alias("times_matched"))
    return out.unionByName(clean.select(
        F.lit("clean_file_upload").alias("pattern_type"), F.col("event_type").alias("pattern_value"), F.lit(0.95).alias("confidence"), "times_matched"))


def _per_feature(samples: DataFrame, size: int, **fns) -> DataFrame:
    """(feature, one column per aggregate) from one pass without exploding."""
    row = samples.agg(*[f(F.get("features", F.lit(i))).alias(f"{n}_{i}") for n, f in fns.items() for i in range(size)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("feature"), *[F.col(f"{n}_{i}").alias(n) for n in fns]) for i in range(size)])))


def feature_stats(samples: DataFrame, size: int = len(FEATURES)) -> DataFrame:
    """Mean, deviation, range and 95th percentile of every feature."""
    stats = _per_feature(samples, size, n=F.count, mean=F.avg, std_dev=F.stddev_pop, min=F.min, max=F.max).collect()
    high = exact_quantile(samples, 0.95, [(r["n"], r["min"], r["max"]) for r in stats])
    rows = [(i, r["mean"], r["std_dev"], r["min"], r["max"], high[i]) for i, r in enumerate(stats)]
    return samples.sparkSession.createDataFrame(
        rows, "feature int, mean double, std_dev double, min double, max double, p95 double")


def _columns(features: pd.Series, wanted) -> dict[int, np.ndarray]:
    """The values of some features; a missing one is NaN, which lies between no bounds."""
    rows = [f for f in features if f is not None]
    if len({len(f) for f in rows}) == 1:
        whole = np.stack(rows).astype(np.float64)
        return {i: whole[:, i] if i < whole.shape[1] else np.zeros(0) for i in wanted}
    return {i: np.array([f[i] for f in rows if i < len(f)], np.float64) for i in wanted}


def _bin_counts(bounds: dict[int, tuple[float, float]], bins: int):
    """(i, b, n, lo, hi): a task's rows per bin of a feature, with their least and greatest value."""
    def run(batches):
        n = {i: np.zeros(bins, np.int64) for i in bounds}
        low, high = ({i: np.full(bins, v) for i in bounds} for v in (np.inf, -np.inf))
        for pdf in batches:
            for i, x in _columns(pdf["features"], bounds).items():
                lo, hi = bounds[i]
                x = x[(x >= lo) & (x <= hi)]
                b = np.minimum(((x - lo) / (hi - lo) * bins).astype(np.int64), bins - 1)
                n[i] += np.bincount(b, minlength=bins)
                np.minimum.at(low[i], b, x)
                np.maximum.at(high[i], b, x)
        for i in bounds:
            b = np.flatnonzero(n[i])
            yield pd.DataFrame({"i": np.int32(i), "b": b.astype(np.int32), "n": n[i][b], "lo": low[i][b], "hi": high[i][b]})
    return run


def _values_within(bounds: dict[int, tuple[float, float]]):
    """(i, x, n): the values of a feature within its bounds, and how often they come."""
    def run(batches):
        for pdf in batches:
            for i, x in _columns(pdf["features"], bounds).items():
                x, n = np.unique(x[(x >= bounds[i][0]) & (x <= bounds[i][1])], return_counts=True)
                yield pd.DataFrame({"i": np.int32(i), "x": x, "n": n.astype(np.int64)})
    return run


def exact_quantile(
    samples: DataFrame, share: float, ranges: list[tuple[int, float, float]], bins: int = 1024, few: int = 4096,
) -> list[float | None]:
    """The interpolated quantile of every feature, whatever the number of rows.

    The wanted place is searched by counting rows per bin between bounds that
    shrink each round; the last ``few`` values around it are then looked at.
    Only bin counts and those values leave the tasks.
    """
    found: dict[int, tuple[float, float]] = {}
    bounds, below, inside = {}, {}, {}
    for i, (n, lo, hi) in enumerate(ranges):
        if n:
            bounds[i], below[i], inside[i] = (lo, hi), 0, n
    place = {i: share * (ranges[i][0] - 1) for i in bounds}
    while True:
        wide = [i for i in bounds if i not in found and inside[i] > few and bounds[i][1] > bounds[i][0]]
        if not wide:
            break
        counts = samples.select("features").mapInPandas(
            _bin_counts({i: bounds[i] for i in wide}, bins), "i int, b int, n long, lo double, hi double").groupBy("i", "b").agg(
            F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
        for i in wide:
            mine = sorted((r for r in counts if r["i"] == i), key=lambda r: r["b"])
            seen, rank = below[i], int(place[i])
            for r, following in zip(mine, [*mine[1:], None]):
                if seen + r["n"] > rank:
                    if seen + r["n"] == rank + 1:  # the place ends its bin
                        found[i] = (r["hi"], following["lo"] if following else r["hi"])
                    else:
                        below[i], bounds[i], inside[i] = seen, (r["lo"], r["hi"]), r["n"]
                    break
                seen += r["n"]
    rest = [i for i in bounds if i not in found]
    if rest:
        values = samples.select("features").mapInPandas(
            _values_within({i: bounds[i] for i in rest}), "i int, x double, n long").groupBy("i", "x").agg(F.sum("n").alias("n")).collect()
        for i in rest:
            ordered = sorted((r["x"], r["n"]) for r in values if r["i"] == i)
            ends = np.cumsum([n for _, n in ordered]) + below[i]

            def value_at(rank: int) -> float:
                return ordered[min(int(np.searchsorted(ends, rank, side="right")), len(ordered) - 1)][0]

            found[i] = (value_at(int(place[i])), value_at(int(place[i]) + 1))
    return [
        found[i][0] + (found[i][1] - found[i][0]) * (place[i] - int(place[i])) if i in found else None
        for i in range(len(ranges))]


def fit_fp_thresholds(samples: DataFrame, size: int = len(FEATURES)) -> DataFrame:
    """Mean + 2 sigma of every feature over samples known to be harmless; a feature that never changes there has its value."""
    parts = _per_feature(samples.where("label = false"), size, mean=F.avg, sigma=F.stddev_pop, lo=F.min, hi=F.max)
    return parts.select("feature", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("mean") + 2 * F.col("sigma")).alias("threshold"))


def fit_baseline(samples: DataFrame, size: int = len(FEATURES)) -> DataFrame:
    return _per_feature(_normal(samples), size, baseline=F.avg)


def _normal(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("label").isNull() | ~F.col("label"))


def _term(i: int) -> str:
    return f"get(features, {i})"


def _sum_of(terms: list[str]) -> Column:
    return F.expr(" + ".join(terms))


def distance(center: list[float]) -> Column:
    """Euclidean distance of the ``features`` column from a centre."""
    return F.sqrt(_sum_of([f"power({_term(i)} - ({float(c)!r}D), 2)" for i, c in enumerate(center)]))


def _nth_samples(samples: DataFrame, ranks: list[int]) -> list[list[float]]:
    """Features of the rows at given places in (ts, id) order.

    Counts per bin narrow the times, then the ids of one time, until ``few``
    rows or one value are left; only those rows are sorted, and one of them
    comes back.
    """
    out = []
    for rank in ranks:
        rows, left = samples, rank
        for place in (F.unix_micros("ts"), F.col("id").cast("long")):
            rows, left = _narrow(rows, left, place)
        found = rows.orderBy("ts", "id").limit(left + 1).orderBy(F.desc("ts"), F.desc("id")).limit(1)
        out.append([float(x) for x in found.first()["features"]])
    return out


def _narrow(rows: DataFrame, left: int, place: Column, bins: int = 1024, few: int = 1000) -> tuple[DataFrame, int]:
    """The rows whose ``place`` lies around the wanted one, and its rank among them."""
    found = rows.agg(F.count("*").alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi")).first()
    lo, hi, n = found["lo"], found["hi"], found["n"]
    while n > few and lo < hi:
        width = (hi - lo) // bins + 1
        bin_ = F.floor((place - F.lit(lo)) / F.lit(width)).cast("long")
        counts = rows.where(place.between(lo, hi)).groupBy(bin_.alias("b")).agg(
            F.count("*").alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi")).orderBy("b").collect()
        for row in counts:
            if left < row["n"]:
                lo, hi, n = row["lo"], row["hi"], row["n"]
                break
            left -= row["n"]
    return rows.where(place.between(lo, hi)), left


def fit_clusters(samples: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[list[list[float]], float]:
    """Centres and distance threshold (twice the mean nearest distance).

    Lloyd's rounds from the samples at i*n/k; each round is one aggregation,
    and only the centres come back.  A centre nobody is near becomes zero.
    """
    normal = _normal(samples).select("id", "ts", "features").persist()
    try:
        n = normal.count()
        if n == 0:
            raise ValueError("no normal samples to fit on")
        centers = np.array(_nth_samples(normal, [i * n // k for i in range(k)]))
        for _ in range(rounds):
            found = {r["c"]: r for r in _cluster_sums(normal, centers).collect()}
            centers = np.array([
                np.array(found[i]["total"]) / found[i]["n"] if i in found else np.zeros(centers.shape[1]) for i in range(k)])
        closing = _cluster_sums(normal, centers).agg(F.sum("far").alias("far")).first()
    finally:
        normal.unpersist()
    return centers.tolist(), 2.0 * closing["far"] / n


def _cluster_sums(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """(c, n, far, total): per nearest centre the rows, summed distance and vector sum."""

    def partial(batches):
        for pdf in batches:
            x = np.stack(pdf["features"].to_numpy())
            d = np.sqrt(((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2))
            near = d.argmin(axis=1)
            for c in np.unique(near):
                mine = near == c
                yield pd.DataFrame({
                    "c": [int(c)], "n": [int(mine.sum())], "far": [float(d[mine, c].sum())], "total": [x[mine].sum(axis=0)]})

    parts = rows.select("features").mapInPandas(partial, "c int, n long, far double, total array<double>")
    sums = parts.select("c", "n", "far", F.posexplode("total").alias("i", "x")).groupBy("c", "i").agg(
        F.sum("n").alias("n"), F.sum("far").alias("far"), F.sum("x").alias("x"))
    return sums.groupBy("c").agg(
        F.max("n").alias("n"), F.max("far").alias("far"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("total"))


def fit_signatures(samples: DataFrame) -> DataFrame:
    """Signatures of harmless samples with how often and when last seen.

    ``raw_log`` says what was requested.
    """
    log = F.col("raw_log")
    marks = [("GET", "GET:"), ("POST", "POST:"), ("clean file", "CLEAN_FILE:"), ("success", "SUCCESS:"), ("/api/", "API:")]
    print_ = F.concat(*[F.when(log.contains(w), m).otherwise("") for w, m in marks])
    octets = F.split("source_ip", r"\.")
    network = F.when(F.size(octets) >= 3, F.concat(F.array_join(F.slice(octets, 1, 3), "."), F.lit(".*"))).otherwise(F.col("source_ip"))
    rounded = F.transform("features", lambda x: (x * 1000.0).cast("long"))
    return samples.where("label = false").groupBy(
        F.xxhash64(rounded).alias("features_hash"), network.alias("source_pattern"), "event_type", print_.alias("payload_fingerprint"),
    ).agg(F.count("*").alias("marked_fp_count"), F.max("ts").alias("last_seen"))


# --- model ------------------------------------------------------------------

@dataclass
class Model:
    """A fitted model: a few numbers per feature, whatever the data size."""

    thresholds: list[float]
    baseline: list[float]
    centers: list[list[float]]
    distance_threshold: float
    means: list[float]
    deviations: list[float]
    has_whitelist: bool
    samples: int

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([asdict(self)], (
            "thresholds array<double>, baseline array<double>, centers array<array<double>>, distance_threshold double, "
            "means array<double>, deviations array<double>, has_whitelist boolean, samples long"))

    @classmethod
    def load(cls, table: DataFrame) -> "Model":
        return cls(**table.first().asDict())


def train_model(samples: DataFrame, min_samples: int = MIN_SAMPLES) -> Model:
    """Fit every part of the model; an error when samples are too few."""
    count = samples.count()
    if count < min_samples:
        raise ValueError(f"insufficient training samples: {count} < {min_samples}")
    size = len(samples.select("features").first()[0])

    def column(table: DataFrame, name: str) -> list[float]:
        return [r[name] for r in table.orderBy("feature").collect()]

    centers, threshold = fit_clusters(samples)
    stats = feature_stats(samples, size).orderBy("feature").collect()
    thresholds = column(fit_fp_thresholds(samples, size), "threshold")
    return Model(
        thresholds=thresholds, baseline=column(fit_baseline(samples, size), "baseline"),
        centers=centers, distance_threshold=threshold, means=[r["mean"] for r in stats],
        deviations=[r["std_dev"] for r in stats],
        has_whitelist=not whitelist_patterns(samples.where("label = false")).isEmpty(), samples=count)


MARGIN = 1e-9


def score_fp(thresholds: list[float | None], has_whitelist: bool) -> Column:
    """How harmless ``features`` look: the share within their thresholds.

    A threshold is a sum of floats, whose last digits depend on the order of
    rows; values beyond it by less than ``MARGIN`` of it count as within.
    """
    known = [f"cast({_term(i)} <= ({float(t) + MARGIN * abs(float(t))!r}D) as int)" for i, t in enumerate(thresholds) if t is not None]
    share = _sum_of(known) / float(len(known)) if known else F.lit(0.5)
    return F.least(share * 0.7 + (0.3 if has_whitelist else 0.0) * 0.3, F.lit(1.0))


def score_anomaly(centers: list[list[float]], distance_threshold: float, baseline: list[float]) -> Column:
    """Distance of ``features`` from the clusters and from the baseline."""
    nearest = F.least(*[distance(c) for c in centers]) if len(centers) > 1 else distance(centers[0])
    away = _sum_of([f"abs(try_divide({_term(i)} - ({float(b)!r}D), {float(b)!r}D + 1.0D))" for i, b in enumerate(baseline)])
    return F.least(F.least(nearest / distance_threshold, F.lit(2.0)) * 0.6 + away / float(len(baseline)) * 0.4, F.lit(1.0))


def score_untrained(features: Column) -> Column:
    mean = F.aggregate(features, F.lit(0.0), lambda a, x: a + x) / F.size(features)
    return F.greatest(F.least(mean / 10.0, F.lit(1.0)), F.lit(0.0))


def ensemble_score(fp: Column, anomaly: Column, voting: bool = True) -> Column:
    if voting:
        other = F.greatest(F.least((anomaly * 0.7 - fp * 0.8) / 0.7, F.lit(1.0)), F.lit(0.0))
    else:
        other = F.greatest(anomaly * (1.0 - fp * 0.5), F.lit(0.0))
    return F.when(fp > 0.7, F.greatest(anomaly * (1.0 - fp), F.lit(0.1))).otherwise(other)


def _z_scores(means: list[float], deviations: list[float]) -> list[str]:
    return [f"(({_term(i)} - ({float(mean)!r}D)) / {float(dev)!r}D)" if dev else "0.0D" for i, (mean, dev) in enumerate(zip(means, deviations))]


def feature_importance(score: str, means: list[float], deviations: list[float], names: list[str]) -> Column:
    """``array<struct<importance, name, contribution, anomalous>>`` of the
    ``features`` column, strongest first."""
    parts = [
        f"named_struct('importance', abs({z}) / 3.0D, 'name', '{name}', 'contribution', {z} * {score}, "
        f"'anomalous', abs({z}) / 3.0D > 0.5D)" for z, name in zip(_z_scores(means, deviations), names)]
    return F.sort_array(F.expr(f"array({', '.join(parts)})"), asc=False)


def strong_features(means: list[float], deviations: list[float]) -> Column:
    """How many entries of ``feature_importance`` are above 0.8, without making them."""
    return _sum_of([f"coalesce(cast(abs({z}) / 3.0D > 0.8D as int), 0)" for z in _z_scores(means, deviations)])


def anomaly_risk(score: Column, importance: Column) -> Column:
    return _risk_level(score, F.size(F.filter(importance, lambda f: f["anomalous"] & (f["importance"] > 0.8))))


def _risk_level(score: Column, strong: Column) -> Column:
    return (
        F.when((score >= 0.9) | (strong >= 3), "Critical").when((score >= 0.7) | (strong >= 2), "High")
        .when((score >= 0.4) | (strong >= 1), "Medium").otherwise("Low")
    )


def anomaly_confidence(fp: Column, anomaly: Column, similar: Column) -> Column:
    """0.5, more when the two scores agree, more with similar events."""
    mean = (fp + anomaly) / 2.0
    variance = ((fp - mean) * (fp - mean) + (anomaly - mean) * (anomaly - mean)) / 2.0
    total = F.aggregate(similar, F.lit(0.0), lambda a, s: a + s)
    near = F.when(F.size(similar) > 0, total / F.size(similar) * 0.2).otherwise(F.lit(0.0))
    return F.least(0.5 + F.greatest(1.0 - variance, F.lit(0.0)) * 0.3 + near, F.lit(1.0))


def anomaly_explain(score: Column, importance: Column, similar: Column, risk: Column) -> Column:
    """``struct<explanations, recommendations>``."""
    none = F.array().cast("array<string>")
    odd = F.slice(F.filter(importance, lambda f: f["anomalous"]), 1, 3)
    lines = F.transform(odd, lambda f: F.format_string(
        "- %s: importancia %.3f, contribución %.3f", f["name"], f["importance"], f["contribution"]))
    n, bad = F.size(similar).cast("string"), F.size(F.filter(similar, lambda s: s["was_anomaly"]))
    about = F.when(bad > 0, F.concat(F.lit("Encontrados "), n, F.lit(" eventos similares previos, "), bad.cast("string"), F.lit(" fueron anomalías")))
    about = about.when(F.size(similar) > 0, F.concat(
        F.lit("Encontrados "), n, F.lit(" eventos similares, ninguno fue anomalía (posible falso positivo)"))).otherwise(
        "No se encontraron eventos similares en el historial")
    explanations = F.concat(
        F.array(F.format_string("Score de anomalía: %.3f", score)),
        F.when(F.size(odd) > 0, F.array(F.lit("Características anómalas detectadas:"))).otherwise(none), lines, F.array(about))
    by_risk = none
    for level, texts in D.ANOMALY_RISK_ADVICE.items():
        by_risk = F.when(risk == level, F.array(*[F.lit(t) for t in texts])).otherwise(by_risk)

    def hint(f):
        chain = F
        for mark, text in D.ANOMALY_FEATURE_ADVICE:
            chain = chain.when(f["name"].contains(mark), text)
        return chain

    hints = F.array_compact(F.transform(F.filter(F.slice(importance, 1, 3), lambda f: f["anomalous"]), hint))
    return F.struct(explanations.alias("explanations"), F.concat(by_risk, hints).alias("recommendations"))


def detect_anomaly(vectors: DataFrame, model: Model | None, names: list[str] | None = None, voting: bool = True) -> DataFrame:
    """Scores and verdict per vector; an untrained detector finds nothing.

    A ``similar`` column (see ``similar_events``) enters confidence and text.
    """
    names = feature_names() if names is None else names
    if model is None:
        return vectors.select(
            "id", F.lit(False).alias("is_anomaly"), F.lit(0.0).alias("anomaly_score"), F.lit(0.0).alias("confidence"),
            F.lit("Low").alias("risk_level"))
    df = vectors.withColumns({
        "fp_score": score_fp(model.thresholds, model.has_whitelist),
        "distance_score": score_anomaly(model.centers, model.distance_threshold, model.baseline),
    })
    df = df.withColumn("anomaly_score", ensemble_score(F.col("fp_score"), F.col("distance_score"), voting))
    df = df.withColumn("importance", feature_importance("anomaly_score", model.means, model.deviations, names))
    none = F.array().cast("array<struct<similarity:double,was_anomaly:boolean>>")
    neighbours = F.col("similar") if "similar" in vectors.columns else none
    similar = F.transform(neighbours, lambda s: s["similarity"])
    # whoever asks for the risk only need not wait for sorted features
    df = df.withColumn("_strong", strong_features(model.means[:len(names)], model.deviations[:len(names)]))
    risk = _risk_level(F.col("anomaly_score"), F.col("_strong"))
    df = df.withColumns({
        "is_anomaly": F.col("anomaly_score") >= THRESHOLD, "risk_level": risk,
        "confidence": anomaly_confidence(F.col("fp_score"), F.col("distance_score"), similar),
    }).drop("_strong")
    return df.withColumn("text", anomaly_explain(F.col("anomaly_score"), F.col("importance"), neighbours, F.col("risk_level")))


def retrain_needed(samples: DataFrame, trained_at: str | None, trained_samples: int, as_of=None) -> DataFrame:
    """One row: retrain (size, age) and retrain_for_feedback (recent negatives)."""
    now = at(as_of, samples)
    sums = samples.agg(
        F.count("*").alias("n"),
        F.count_if((F.col("label") == F.lit(False)) & (F.col("ts") > ago(now, hours=1))).alias("recent_negatives"),
        F.count_if(F.col("event_type").startswith("marked_fp_")).alias("marked"))
    if trained_at is None:
        need = F.col("n") >= MIN_SAMPLES
    else:
        age = F.unix_micros(now) - F.unix_micros(F.lit(trained_at).cast("timestamp"))
        need = (age >= RETRAIN_HOURS * 3_600_000_000) | (F.col("n") > trained_samples + MIN_SAMPLES // 4)
    return sums.select(
        "n", need.alias("retrain"),
        ((F.col("recent_negatives") >= 5) | ((F.col("marked") > 0) & (F.col("marked") % 10 == 0))).alias("retrain_for_feedback"))


def fp_patterns(thresholds: DataFrame, whitelist: DataFrame) -> DataFrame:
    """What the false-positive model knows, as (kind, name, value)."""
    known = thresholds.select(F.lit("threshold").alias("kind"), F.col("feature").cast("string").alias("name"), F.col("threshold").alias("value"))
    return known.unionByName(whitelist.select(F.col("pattern_type").alias("kind"), F.col("pattern_value").alias("name"), F.col("confidence").alias("value")))


# --- quality ----------------------------------------------------------------

def ml_metrics(labelled: DataFrame) -> DataFrame:
    """Quality over rows with label and predicted; zero where undefined."""
    y, p = F.col("label"), F.col("predicted")
    m = labelled.agg(
        F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    c = F.col
    m = m.withColumns({
        "accuracy": share(c("tp") + c("tn"), c("n")), "precision": share(c("tp"), c("tp") + c("fp")),
        "recall": share(c("tp"), c("tp") + c("fn")), "false_positive_rate": share(c("fp"), c("fp") + c("tn")),
    })
    both = c("precision") + c("recall")
    return m.withColumn("f1_score", F.when(both > 0, 2 * c("precision") * c("recall") / both).otherwise(F.lit(0.0)))


def ml_statistics(scored: DataFrame, feedback: DataFrame) -> DataFrame:
    """Predictions, anomalies, and how feedback judged them."""
    marked = feedback.select(F.col("event_id").alias("id"), F.lit(True).alias("_fp")).distinct()
    seen = scored.join(marked, "id", "left")
    is_fp = F.col("_fp").isNotNull()
    return seen.agg(
        F.count("*").alias("total_predictions"), F.count_if("is_anomaly").alias("anomalies_detected"),
        F.count_if(is_fp).alias("false_positives"), F.count_if(F.col("is_anomaly") & ~is_fp).alias("true_positives"))


def fp_dashboard(detections: DataFrame, feedback: DataFrame) -> DataFrame:
    """Long table (measure, name, false_positives, true_positives) by event
    type, by hour of day, and in total.  ``detections``: id, ts, event_type,
    has_threats."""
    marked = feedback.select(F.col("event_id").alias("id"), F.lit(True).alias("_fp")).distinct()
    found = detections.where("has_threats").join(marked, "id", "left")
    fp = F.col("_fp").isNotNull()
    cells = found.groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count_if(fp).alias("fp"), F.count_if(~fp).alias("tp"))

    def cut(measure: str, name: Column) -> DataFrame:
        return cells.groupBy(F.lit(measure).alias("measure"), name.cast("string").alias("name")).agg(
            F.sum("fp").alias("false_positives"), F.sum("tp").alias("true_positives"))

    return cut("pattern", F.col("event_type")).unionByName(cut("hour", F.col("hour"))).unionByName(cut("total", F.lit("all")))
