"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Base rules find e-mail and IP addresses, card and phone numbers.  High-recall
generators propose further, overlapping spans: long mixed tokens (``secret``)
and runs of digits with separators (``number``).  Boosted trees judge those by
their form and surroundings.  Nobody labels the candidates, so labels come from
the words before them, which are no features: a token after an assignment cue,
a number after a word such as ``tel`` or ``account``, against those without a
cue.  A number with a cue counts inside base spans too; tokens there, and
numbers there without a cue, are never judged and don't count.  What lacks a
cue counts against the precision, so it is a lower bound.  All documents count.
Thresholds are calibrated on documents that the trees did not see, per kind, or
on all where those lack a label.  Redaction takes base spans and selected ones.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret", "number")

#: The base rules.  Groups are possessive and starts guarded, which changes no match: a long run of one kind of character
#: then costs linear time and no stack.
_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: High-recall generators.
_SECRET = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9][A-Za-z0-9_+/-]{14,}+"
_NUMBER = r"(?<![0-9A-Za-z])[+(]?[0-9][0-9().\x20/-]{5,}[0-9](?![0-9A-Za-z])"
_CUE = r"(?i)(?:passw(?:or)?d|pwd|token|secret|api[_-]?key|key)[\x20\"':=]{1,6}$"
_NUMBER_CUE = (
    r"(?i)(?<![a-z])(?:phone|telephone|tel|mobile|cell|fax|call|card|account|acct|iban|ssn|passport|licen[cs]e)"
    r"(?:\x20?(?:number|no|nr))?[\x20.\"':=#(]{1,4}$")

#: Candidate patterns that one partition of the fit takes.
PATTERNS_TOGETHER = 200_000
TREES, DEPTH = 12, 3
#: Share of positive labels among what a threshold selects, on the calibration documents.
PRECISION = 0.95

FEATURES = ("length", "digits", "upper", "lower", "other", "changes", "before", "after", "spaced", "groups")
SPAN = "struct<kind:string,start:bigint,end:bigint,found:string,before:string,after:string>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit is right for the others."""
    backward = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(backward, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _ip_parts_fit(found: Column) -> Column:
    def fits(part: Column) -> Column:
        short = F.ltrim(part, F.lit("0"))
        return (F.length(short) <= 3) & (F.coalesce(F.substring(short, 1, 3).try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(found, r"\."), fits)


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return _ip_parts_fit(found)
    if kind == "card":
        return F.length(_digits(found)).between(16, 19) & F.when(F.length(_digits(found)).between(16, 19), luhn(_digits(found))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    return F.lit(True)


def _checks(kind: str):
    return lambda s: _valid(kind, s["found"])


def _with_spans(df: DataFrame, out: str, kind: str, pattern: str, possible: Column) -> DataFrame:
    """Add the matches of a pattern with code point positions and the characters around them.

    The pieces between the matches give the positions; both come from the same
    left-to-right search.
    """
    text = F.col("__t")
    empty = F.array().cast("array<string>")
    df = df.withColumn("__m", F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty))
    df = df.withColumn("__g", F.when(F.size("__m") > 0, F.split(text, pattern, -1)).otherwise(empty))

    def step(acc: Column, i: Column) -> Column:
        gap, found = F.get("__g", i), F.get("__m", i)
        start = acc["at"] + F.length(gap)
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(found)).alias("end"), found.alias("found"),
            F.right(gap, F.lit(24)).alias("before"), F.left(F.get("__g", i + 1), F.lit(2)).alias("after"))
        return F.struct((start + F.length(found)).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    every = F.sequence(F.lit(0), F.size("__m") - 1)
    walked = F.when(F.size("__m") > 0, F.aggregate(every, first, step)["spans"]).otherwise(F.array().cast(f"array<{SPAN}>"))
    return df.withColumn(out, walked).drop("__m", "__g")


def _outside(span: Column, base: Column) -> Column:
    return ~F.exists(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))


def _features(c: Column) -> Column:
    """A few small numbers for the form and the surroundings of a candidate; the cue before it is not among them."""
    found, size = c["found"], F.length(c["found"])

    def tenths(pattern: str) -> Column:
        return F.floor(10 * (size - F.length(F.regexp_replace(found, pattern, ""))) / size).cast("double")

    changes = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(found, "[0-9]+", "0"), "[A-Za-z]+", "a"), "[^0a]+", "-"))
    last, first = F.right(c["before"], F.lit(1)), F.left(c["after"], F.lit(1))

    def around(x: Column) -> Column:
        return F.when(x == "", 0).when(x.rlike(r"^\s"), 1).when(x.rlike("^[\"'=:]"), 2).when(x.rlike("^[,.;]"), 3).otherwise(4).cast("double")

    values = {
        "length": F.least(F.floor(size / 4), F.lit(16)).cast("double"), "digits": tenths("[0-9]"), "upper": tenths("[A-Z]"),
        "lower": tenths("[a-z]"), "other": tenths("[^A-Za-z0-9]"), "changes": F.least(changes, F.lit(12)).cast("double"),
        "before": around(last), "after": around(first), "spaced": found.rlike(r"[\x20(]").cast("double"),
        "groups": F.least(F.size(F.split(found, "[^0-9]+")), F.lit(6)).cast("double"),
    }
    return F.struct(*[values[f].alias(f) for f in FEATURES])


def _weak_label(c: Column, base: Column) -> Column:
    """1 after a cue, 0 without one, null for what a base rule has found already (but numbers after a cue)."""
    cued = F.when(c["kind"] == "secret", c["before"].rlike(_CUE)).otherwise(c["before"].rlike(_NUMBER_CUE))
    return F.when(_outside(c, base), cued.cast("int")).when((c["kind"] == "number") & cued, 1)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns of ``docs`` with ``base`` (valid base spans) and ``proposed`` (spans of the generators, overlapping ones too)."""
    df = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("__digit", F.col("__t").rlike("[0-9]"))
    has_digit = F.col("__digit")
    df = _with_spans(df, "__email", "email", _EMAIL, F.col("__t").contains("@"))
    df = _with_spans(df, "__ip", "ip", _IP, has_digit & F.col("__t").rlike(r"[0-9]\.[0-9]"))
    df = _with_spans(df, "__card", "card", _CARD, has_digit)
    df = _with_spans(df, "__phone", "phone", _PHONE, has_digit & F.col("__t").contains("+"))
    for kind in KINDS:
        df = df.withColumn(f"__{kind}", F.filter(f"__{kind}", _checks(kind)))
    df = _with_spans(df, "__secret", "secret", _SECRET, F.lit(True))
    df = _with_spans(df, "__number", "number", _NUMBER, has_digit)
    df = df.withColumn("base", F.concat(*[F.col(f"__{k}") for k in KINDS]))
    # a number of a base kind is proposed as well: after a cue the trees learn from it
    df = df.withColumn("__proposed", F.concat("__secret", "__number"))
    return df.drop("__t", "__digit", *[f"__{k}" for k in (*KINDS, *ADDED)])


def _tree_expression(node, columns: dict[str, Column]) -> Column:
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(columns[FEATURES[split.featureIndex()]] <= F.lit(float(split.threshold())),
                  _tree_expression(node.leftChild(), columns)).otherwise(_tree_expression(node.rightChild(), columns))


class Judge:
    """Trees of one kind as a column expression, and the threshold from which a candidate is selected.

    ``precision`` and ``recall`` are those of the threshold among the calibration labels.
    """

    def __init__(self, model, threshold: float = 2.0, precision: float = 0.0, recall: float = 0.0):
        self.model, self.threshold, self.precision, self.recall = model, threshold, precision, recall

    def score(self, features: Column) -> Column:
        columns = {f: features[f] for f in FEATURES}
        sums = [F.lit(w) * _tree_expression(t._java_obj.rootNode(), columns) for t, w in zip(self.model.trees, self.model.treeWeights, strict=True)]
        return 1 / (1 + F.exp(-2 * reduce(lambda a, b: a + b, sums)))


def fit_judges(marked: DataFrame, doc_id: str = "doc_id", precision: float = PRECISION) -> dict[str, Judge]:
    """Fit and calibrate the trees of each kind on the labelled candidates of ``marked`` (from ``candidates``).

    Candidates with equal features and label are counted, not kept: the fit
    reads one row per pattern, from all documents, in as many partitions as
    there are ``PATTERNS_TOGETHER``.  A fifth of them, by hashed
    id, serves the calibration; a kind that has a label in one of the two parts
    only is fitted and calibrated on both together.  A kind with one label
    only, or none that reaches the wanted precision, has no judge and adds
    nothing, which a warning tells.
    """
    told = F.filter(F.transform("__proposed", lambda c: F.struct(c.alias("c"), _weak_label(c, F.col("base")).alias("label"))), lambda x: x["label"].isNotNull())
    rows = marked.select(F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held"), F.inline(told))
    rows = rows.select("held", "c.kind", F.col("label").cast("double").alias("label"), _features(F.col("c")).alias("f"))
    patterns = cut(rows.groupBy("held", "kind", "label", "f").agg(F.count("*").cast("double").alias("n")).select(
        "held", "kind", "label", "n", "f.*"))
    parts_of_fit = 1 + patterns.count() // PATTERNS_TOGETHER
    judges = {}
    for kind in ADDED:
        own = patterns.where(F.col("kind") == kind)
        parts = {(r["held"], r["label"]) for r in own.select("held", "label").distinct().collect()}
        if len({label for _, label in parts}) < 2:
            warnings.warn(f"no judge for {kind}: one label at most", stacklevel=2)
            continue
        split = len(parts) == 4
        learn = own.where("NOT held") if split else own
        learn = learn.orderBy("label", *FEATURES).coalesce(parts_of_fit)
        fitted = GBTClassifier(featuresCol="x", weightCol="n", maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=7).fit(
            VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(learn))
        judge = Judge(fitted)
        scored = (own.where("held") if split else own).withColumn("score", judge.score(F.struct(*FEATURES)))
        along = Window.partitionBy("kind").orderBy(F.desc("score"))
        steps = scored.groupBy("kind", "score").agg(F.sum(F.col("n") * F.col("label")).alias("hits"), F.sum("n").alias("all")).select(
            "score", F.sum("hits").over(along).alias("hits"), (F.sum("hits").over(along) / F.sum("all").over(along)).alias("share"))
        lowest = steps.agg(
            F.min(F.when((F.col("share") >= precision) & (F.col("score") >= 0.5), F.struct("score", "share", "hits"))).alias("at"), F.max("hits").alias("labels")).first()
        if lowest["at"] is not None:
            judges[kind] = Judge(fitted, lowest["at"]["score"], lowest["at"]["share"], lowest["at"]["hits"] / lowest["labels"])
        else:
            warnings.warn(f"no judge for {kind}: no threshold reaches a precision of {precision}", stacklevel=2)
    return judges


def select_spans(marked: DataFrame, judges: dict[str, Judge]) -> DataFrame:
    """Replace ``proposed`` by ``added``: proposals outside base spans whose score reaches their kind's threshold."""
    def keep(x: Column) -> Column:
        out = F.lit(False)
        for kind, judge in judges.items():
            out = F.when(x["c"]["kind"] == kind, judge.score(x["f"]) >= judge.threshold).otherwise(out)
        return out

    able = F.filter("__proposed", lambda c: _outside(c, F.col("base")))
    seen = F.transform(able, lambda c: F.struct(c.alias("c"), _features(c).alias("f")))
    added = F.transform(F.filter(seen, keep), lambda x: x["c"]) if judges else F.array().cast(f"array<{SPAN}>")
    return marked.withColumn("added", added).drop("__proposed")


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Columns of ``docs`` with ``base`` and ``added``: arrays of (kind, start, end, found, before, after).

    Positions count code points from 0, the end exclusive.  Base spans come by
    kind, then start; a null or empty text has none.  Columns of these names
    are replaced.  All rows are judged, one by one, so repeated rows and ties
    don't matter; the trees are fitted on the patterns of all of them with an id.
    """
    judges = fit_judges(candidates(docs.select(doc_id, text).where(F.col(doc_id).isNotNull()), text), doc_id)
    return select_spans(candidates(docs, text), judges)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    order = F.sort_array(F.transform(spans, lambda s: F.struct(
        F.array_position(F.array(*[F.lit(k) for k in (*KINDS, *ADDED)]), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace spans of ``base`` and ``added`` in the text by ``[KIND]`` and drop both columns.

    Spans that overlap become one, named after the one that starts first.  A
    null text stays null.
    """
    spans = F.sort_array(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    one = "struct<start:bigint,end:bigint,kind:string>"

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] < last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))).otherwise(
            F.concat(acc, F.array(s)))

    df = found.withColumn("__s", F.when(F.size("base") + F.size("added") > 0, F.aggregate(spans, F.array().cast(f"array<{one}>"), merge)))
    source = F.col(text)

    def piece(s: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("__s", i - 1)["end"])
        return F.concat(F.substr(source, (start + 1).cast("int"), (s["start"] - start).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))

    rest = F.substr(source, (F.element_at("__s", -1)["end"] + 1).cast("int"), F.length(source))
    clean = F.concat(F.array_join(F.transform("__s", piece), ""), rest)
    return df.withColumn(text, F.when(F.size("__s") > 0, clean).otherwise(source)).drop("__s", "base", "added")
