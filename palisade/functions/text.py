"""Column helpers over text: matching, counting, entropy, addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import rules as R

SEP = "\u0001"


def captures(text: Column, pattern: str, groups: int) -> Column:
    """All capture groups of an anchored pattern from one regex pass.

    ``array<string>`` of ``groups`` entries plus an end mark, with '' for a
    group that took no part; an array of another size when there is no match.
    """
    template = SEP.join(f"${i}" for i in range(1, groups + 1)) + SEP + "end"
    return F.split(F.regexp_replace(F.translate(text, SEP, ""), pattern, template), SEP)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often it is used.

    Spark repeats an expression that only conditional branches share; a bound
    lambda variable is the declarative way to name it inside one projection.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settle(value: Column) -> Column:
    """``value``, computed once where it is projected.

    Spark pushes a filter below a deterministic projection by repeating the
    projected expression inside the filter.  Through the layers of a parser
    that doubles the work per layer; a projection that mentions the partition
    id is left where it is.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def _words(words: list[str]) -> Column:
    """A constant array of words."""
    return F.split(F.lit(SEP.join(words)), SEP)


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(_words(words), lambda w: F.contains(text, w))


def words_found(text: Column, words: list[str], prefix: str = "") -> Column:
    """The words that occur in ``text``, in list order."""
    found = let(text, lambda t: F.filter(_words(words), lambda w: F.contains(t, w)))
    return F.transform(found, lambda w: F.concat(F.lit(prefix), w)) if prefix else found


def found(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` occurs; tried only where a text that it needs does."""
    needed = R.PATTERN_LITERALS.get(pattern)
    return text.rlike(pattern) if needed is None else text.contains(needed) & text.rlike(pattern)


def names_matching(text: Column, named_patterns: list[tuple[str, str]]) -> Column:
    """Names of the patterns found in ``text``, in list order, with repeats."""
    return F.array_compact(
        F.array(*[F.when(found(text, p), F.lit(n)) for n, p in named_patterns])
    )


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def extract_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def distinct_lower(text: Column, pattern: str, group: int = 1, prefix: str = "") -> Column:
    """Distinct lower-cased captures, first-seen order."""
    found = extract_all(text, pattern, group)
    return F.array_distinct(
        F.transform(found, lambda x: F.concat(F.lit(prefix), F.lower(x)) if prefix else F.lower(x))
    )


def text_entropy(text: Column) -> Column:
    """Shannon entropy of the characters, each weighted by the byte length.

    The characters are sorted and taken in runs of equal ones, so the work follows
    the length of the text and not that times its distinct characters.
    """
    size = F.octet_length(text).cast("double")
    runs = extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), r"(?s)(.)\1*", 0)
    shares = F.transform(runs, lambda run: F.length(run) / size)
    return F.when(size > 0, F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(F.lit(0.0))


def extract_ip(text: Column) -> Column:
    """First IPv4 address with valid octets, else first full IPv6, else NULL."""
    return F.coalesce(
        F.nullif(F.regexp_extract(text, R.IPV4, 0), F.lit("")),
        F.nullif(F.regexp_extract(text, R.IPV6, 0), F.lit("")),
    )


def is_private_ip(ip: Column) -> Column:
    pattern = "^(" + "|".join(p.replace(".", r"\.") for p in R.PRIVATE_PREFIXES) + ")"
    return ip.rlike(pattern)


def grams(text: Column, size: Column) -> Column:
    """All pieces of ``size`` characters, with repeats; none of a shorter or missing text.

    Cutting at a place walks there from the start, so long texts are cut into
    short ones first, which overlap by what a piece needs.
    """
    step = 64

    def pieces(part: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(part) - size + 1), lambda i: F.substring(part, i, size))

    def parts(whole: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.length(whole) - size) / step).cast("int"))
        return F.flatten(F.transform(starts, lambda k: let(F.substring(whole, k * step + 1, size + (step - 1)), pieces)))

    short = F.length(text) < step
    return F.when(F.length(text) >= size, F.when(short, pieces(text)).otherwise(parts(text))).otherwise(F.array().cast("array<string>"))


def payload_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def sql_keywords(text: Column) -> Column:
    """Basic SQL words, every occurrence, lower case."""
    return F.transform(extract_all(text, R.SQL_BASIC_WORDS), F.lower)


def has_sql_keywords(text: Column) -> Column:
    return text.rlike(R.SQL_BASIC_WORDS)


def html_tags(text: Column) -> Column:
    return F.transform(extract_all(text, R.HTML_TAG), F.lower)


def html_event_handlers(text: Column) -> Column:
    return F.transform(
        extract_all(text, R.JS_EVENT), lambda x: F.concat(F.lit("on"), F.lower(x))
    )
