"""URL filters over sorted arrays of 64-bit digests.

A list of rules (host and path) and of whole addresses is kept as sorted xxhash
digests beside their strings, cut into segments by the digests' upper bits.  A
task memory-maps the digests of its segment, probes them by vectorised binary
search and compares the stored strings, so that colliding digests decide
nothing.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm.common import cut

#: Entries of a segment, and probes that meet a segment in one group.
SEGMENT_ENTRIES = 65_536
GROUP_PROBES = 100_000
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def build_list(spark, rules: Iterable[tuple[str, str, str]], listed: DataFrame | None = None) -> DataFrame:
    """Entries ``key, digest, verdict``: rules as given and addresses (column ``url``) to block; nulls are no entries."""
    own = spark.createDataFrame([(f"r:{host}{path}", verdict) for verdict, host, path in rules], "key string, verdict string")
    if listed is not None:
        own = own.unionByName(listed.where("url IS NOT NULL").select(F.concat(F.lit("u:"), "url").alias("key"), F.lit("block").alias("verdict")))
    return own.groupBy("key").agg(F.max("verdict").alias("verdict")).withColumn("digest", F.xxhash64("key"))


def find_in_segment(entries: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
    """Probes whose key is an entry, with its verdict."""
    entries = entries.sort_values("digest", kind="stable", ignore_index=True)
    with tempfile.TemporaryFile() as scratch:  # has no name, so nothing is left of it
        entries["digest"].to_numpy(np.int64).tofile(scratch)
        scratch.flush()
        digests = np.memmap(scratch, np.int64, "r") if len(entries) else np.zeros(0, np.int64)
        wanted = probes["digest"].to_numpy()
        at, end = np.searchsorted(digests, wanted, "left"), np.searchsorted(digests, wanted, "right")
        keys, verdicts, own = entries["key"].to_numpy(), entries["verdict"].to_numpy(), probes["key"].to_numpy()
        verdict = np.full(len(probes), None, object)
        open_rows = np.flatnonzero(at < end)
        while len(open_rows):  # one turn, unless digests collide
            same = keys[at[open_rows]] == own[open_rows]
            verdict[open_rows[same]] = verdicts[at[open_rows[same]]]
            open_rows = open_rows[~same]
            at[open_rows] += 1
            open_rows = open_rows[at[open_rows] < end[open_rows]]
        del digests
    out = probes.assign(verdict=verdict)
    return out[out.verdict.notna()]


def _fitting(rules: list[tuple[str, str, str]]) -> Column:
    """Keys of all rules that may fit ``host`` and ``path``."""
    labels = max((host.count(".") + 1 for _, host, _ in rules), default=1)
    lengths = sorted({len(path) for _, _, path in rules})
    suffixes = F.array(*[F.substring_index("host", ".", -n) for n in range(1, labels + 1)])
    starts = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.left("path", F.lit(n)).alias("start")) for n in lengths]), lambda s: F.length(s["start"]) == s["n"])
    return F.flatten(F.transform(F.array_distinct(suffixes), lambda h: F.transform(starts, lambda s: F.concat(F.lit("r:"), h, s["start"]))))


def probes_of(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``key, digest`` to look up for ``url, host, path``, each once: one key may stand for a third of all addresses."""
    own = F.array(F.concat(F.lit("u:"), F.col("url")))
    keys = F.concat(own, _fitting(rules)) if rules else own
    return urls.select(F.explode(keys).alias("key")).distinct().withColumn("digest", F.xxhash64("key"))


def judge_urls(pages: DataFrame, entries: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """Columns of ``pages`` with ``host``, ``path``, ``rule`` (host and path of the rule that decides, or null) and ``verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest one wins.  Without a rule, a listed address is blocked, any
    other allowed; so is a null.  Equal keys are probed once, so digests spread
    evenly over the segments and their groups.  Rules that were found are no
    more than ``rules`` holds, and are broadcast.  Columns of the added names
    are replaced.
    """
    rules = list(rules)
    host, path = url_parts(F.col("url"))
    distinct = pages.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct().withColumns({"host": host, "path": path})
    probes = probes_of(distinct, rules)

    entries = cut(entries.select("key", "digest", "verdict"))
    bits = max(0, math.ceil(math.log2(max(entries.count(), 1) / SEGMENT_ENTRIES)))
    groups = max(1, math.ceil(probes.count() / GROUP_PROBES / 2**bits))
    segment = F.shiftrightunsigned("digest", 64 - bits) if bits else F.lit(0).cast("long")
    dealt = probes.withColumns({"segment": segment, "part": F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(groups)).cast("int")})
    copies = entries.withColumns({"segment": segment, "part": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    hits = cut(copies.groupBy("segment", "part").cogroup(dealt.groupBy("segment", "part")).applyInPandas(
        lambda held, wanted: find_in_segment(held, wanted)[["key", "verdict"]], "key string, verdict string"))
    found = hits.where(F.col("key").startswith("u:")).select(F.substr("key", F.lit(3)).alias("url"), "key", "verdict")
    if rules:
        own = F.broadcast(hits.where(F.col("key").startswith("r:")))
        found = found.unionByName(distinct.select("url", F.explode(_fitting(rules)).alias("key")).join(own, "key").select("url", "key", "verdict"))
    is_rule = F.col("key").startswith("r:")
    best = found.groupBy("url").agg(
        F.max(F.when(is_rule, F.struct(F.length("key").alias("n"), F.substr("key", F.lit(3)).alias("rule"), "verdict"))).alias("__best"),
        F.max(F.when(~is_rule, F.col("verdict"))).alias("__listed")).withColumnRenamed("url", "__url")
    host, path = url_parts(F.col(url))
    kept = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")], F.col(url).alias("__own"))
    return kept.join(best, F.col("__own") == F.col("__url"), "left").withColumns({
        "host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit("")), "rule": F.col("__best.rule"),
        "verdict": F.coalesce("__best.verdict", "__listed", F.lit("allow"))}).drop("__best", "__listed", "__own", "__url")


def toxic_addresses(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url`` of pages whose path ends in the number of a document labelled toxic."""
    _, path = url_parts(F.col("url"))
    numbered = pages.select("url", F.regexp_extract(path, r"/([0-9]{1,18})(?:\.html|/)?$", 1).alias("n")).where("n <> ''")
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return numbered.join(toxic, F.col("n").cast("long") == F.col("doc_id"), "left_semi").select("url").distinct()


def oracle_sql(rules: Iterable[tuple[str, str, str]] = RULES) -> str:
    """DuckDB SQL for the verdicts of ``pages``."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*', 0) AS h FROM parts),
split AS (
  SELECT page_id, url, translate(h, '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*', 0) AS path FROM cut),
rules(verdict, host, path) AS (VALUES {values}),
best AS (
  SELECT s.url, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT url, host, path FROM split) s JOIN rules r
    ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY s.url),
listed AS (
  SELECT DISTINCT s.url FROM split s
  JOIN labels l ON TRY_CAST(regexp_extract(s.path, '/([0-9]{{1,18}})(\\.html|/)?$', 1) AS BIGINT) = l.doc_id WHERE l.toxic = 1)
SELECT s.page_id, s.host, s.path, b.rule,
  coalesce(b.verdict, CASE WHEN l.url IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM split s LEFT JOIN best b ON s.url = b.url LEFT JOIN listed l ON s.url = l.url"""
