"""Operator 9: personal data by weak supervision, in DataFrame functions only.

Exact patterns give the base spans. Wider patterns give further candidates, on
which four labelers vote; expectation-maximisation over the counted vote
patterns estimates how reliable each labeler is, and a span classifier trained
on the resulting labels decides which candidates join the base spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodmill.llm.common import stored
from moodmill.llm.spans import any_word, spans_if
from moodmill.session import local_table

KINDS = ("email", "ip", "card", "phone")

# A match starts where a run of its first class starts or where the match before it ended; with
# possessive repeats no character is tried twice, so long runs cost no more than others.
BASE = {
    "email": "(?:(?<![A-Za-z0-9._%+\\-])|\\G)[A-Za-z0-9._%+\\-]++@[A-Za-z0-9\\-]++(?:\\.[A-Za-z0-9\\-]+)++",
    "ip": "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[ \\-]?[0-9])++",
    "phone": "\\+[0-9][ ().0-9\\-]+[0-9]",
}
_AT = "(?: ?[\\[({<](?:at|@)[\\])}>] ?| @ )"
_DOT = "(?:\\.| ?[\\[({<](?:dot|\\.)[\\])}>] ?| dot )"
_LOCAL = "(?<![A-Za-z0-9._%+\\-])[A-Za-z0-9._%+\\-]{1,64}+"
_LABEL = "[A-Za-z0-9\\-]{1,63}+"
_V4_DOT = "(?: ?[\\[({]\\.[\\])}] ?| \\. |[\\[({]dot[\\])}])"
_HEX = "[0-9A-Fa-f]{1,4}"
# What the base forms leave out: written-out and spaced addresses; four-part numbers with
# guarded dots and eight-part addresses; cards of 13 to 15 digits and other separators; national
# numbers and those that begin with 00. Failed matches of base forms come in too, as evidence.
WIDE = {
    "email": f"(?i){_LOCAL}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})+| at {_LABEL}(?: dot {_LABEL})+)",
    "ip": (
        f"(?<![0-9])[0-9]{{1,3}}(?:{_V4_DOT}[0-9]{{1,3}}){{3}}(?![0-9])"
        f"|(?<![A-Za-z0-9:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![A-Za-z0-9:])"
        f"|{BASE['ip']}"
    ),
    "card": "(?<![0-9])[0-9](?:[ .\\-/]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": (
        "(?<![0-9A-Za-z+.\\-/_])(?:"
        "00[1-9](?:[ .\\-/]?[0-9]){7,13}"
        "|0[1-9](?:[ .\\-]?[0-9]{2}){4}"
        "|\\(?0[0-9]{1,4}\\)?[ /\\-][0-9]{2,4}(?:[ \\-]?[0-9]{2,4}){1,3}"
        "|(?:1[ .\\-])?(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .\\-])[0-9]{3}[ .\\-][0-9]{4}"
        ")(?![0-9])"
    ),
}
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike("[0-9]\\.[0-9]"),
    "card": lambda t: t.rlike("[0-9](?:[ \\-]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
WIDE_HINTS = {
    "email": lambda t: t.rlike("(?i)[\\[({<](?:at|@)[\\])}>]| dot [a-z]| @ "),
    "ip": lambda t: t.rlike("[0-9](?:\\.| ?[\\[({]|\\s\\.)|[0-9A-Fa-f]::?[0-9A-Fa-f]"),
    "card": lambda t: t.rlike("[0-9](?:[ .\\-/]{0,2}[0-9]){12}"),
    "phone": lambda t: t.rlike("[0-9](?:[ .\\-/()]{0,2}[0-9]){7}"),
}

# Gazetteers and context words, fixed values.
GENERIC_DOMAINS = (
    "com org net edu gov mil int info biz name pro mobi app dev io ai co me tv cc xyz online site shop store blog cloud tech "
    "agency club email live news space today website world example test"
).split()
COUNTRY_DOMAINS = (
    "ac ae ar at au az ba bd be bg bh bo br by ca ch ci cl cm cn cr cy cz de dk do dz ec ee eg es eu fi fr ge gh gr gt hk hn hr "
    "hu id ie il in iq ir is it jm jo jp ke kh kr kw kz lb li lk lt lu lv ly ma md mk mm mn mt mx my mz na ng ni nl no np nz om "
    "pa pe ph pk pl pt py qa ro rs ru rw sa se sg si sk sn sv th tn tr tt tw tz ua ug uk us uy uz ve vn za zm zw"
).split()
DOMAINS = GENERIC_DOMAINS + COUNTRY_DOMAINS
# Beginnings and lengths that card issuers use.
ISSUERS = (
    "^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}"
    "|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11}|(?:6011|65[0-9]{2}|64[4-9][0-9]|35[2-8][0-9]|62[0-9]{2})[0-9]{12,15}"
    "|(?:50|5[6-9]|6[0-9])[0-9]{11,17})$"
)
# Country codes of one, two and three digits behind 00 or +.
CALLING = (
    "(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
    "|2(?:1[1-9]|2[0-9]|3[0-9]|4[0-9]|5[0-8]|6[0-9]|9[0-9])|3(?:5[0-9]|7[0-9]|8[0-9])|42[013]|50[0-9]|59[0-9]|6(?:7[0-9]|8[0-9]|9[0-2])"
    "|8(?:0[08]|5[0-9]|8[0-8])|9(?:6[0-8]|7[0-79]|9[2-8]))"
)
SPEAKS_FOR = {
    "email": ("mail", "contact", "kontakt", "courriel", "correo", "posta", "write to", "reach", "address", "ask ", "support"),
    "ip": ("ip", "server", "host", "address", "login", "client", "connect", "ping", "gateway", "router", "node", "dns", "logged", "from "),
    "card": ("card", "karte", "carte", "tarjeta", "carta", "visa", "amex", "express", "diners", "maestro", "credit", "debit", "payment", "paid", "account"),
    "phone": ("call", "phone", "tel", "mobile", "cell", "fax", "ring", "dial", "text me", "whatsapp", "sms", "reach", "anruf", "appel", "llama", "chiama", "number is", "contact"),
}
SPEAKS_AGAINST = (
    "version", "release", "build", "isbn", "issn", "serial", "order", "invoice", "article", "id ", "id:", "no.", "number of",
    "section", "chapter", "page", "score", "ratio", "tracking", "sku", "part ", "ticket", "timestamp", "epoch", "doi",
)
DATE = "^(?:[0-3]?[0-9][./\\- ][01]?[0-9][./\\- ](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[./\\- ][01][0-9][./\\- ][0-3][0-9])"
CONTEXT = 40
LABELERS = ("pattern", "gazetteer", "context", "shape")
# A failed check digit or octet is arithmetic, the others are habits of writing.
LEAST_RIGHT = (0.9, 0.55, 0.55, 0.55)
DIGIT_BUCKET = 4


@dataclass(frozen=True)
class Reliability:
    """Share of a labeler's votes that are right, and the share of candidates that are personal data."""

    right: tuple[float, ...]
    prior: float


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check digit rule."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _octets(match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    return match.rlike(f"^{part}(?:\\.{part}){{3}}$")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return _octets(match)
    if kind == "card":
        n = F.length(_digits(match))
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        n = F.length(_digits(match))
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Exact spans of a kind; matches that fail the kind's test are dropped."""
    return F.filter(spans_if(HINTS[kind](text), text, BASE[kind]), lambda s: _valid(kind, s["match"]))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("tinyint")


def _gazetteer(kind: str, match: Column) -> Column:
    if kind == "email":
        known = F.lower(F.regexp_extract(match, "([A-Za-z0-9\\-]+)$", 1)).isin(*DOMAINS)
        return _vote(known, ~known)
    if kind == "ip":
        first = F.regexp_extract(match, "^0*([0-9]+)", 1)
        wide = F.contains(match, F.lit(":"))
        odd = F.when(wide, ~match.rlike("(?i)^(?:[23][0-9a-f]{3}|f[cdef][0-9a-f]{2}):")).otherwise(
            first.isin("", "255") | (F.length(first) > 3)
        )
        return _vote(~odd, odd)
    digits = _digits(match)
    if kind == "card":
        issuer = digits.rlike(ISSUERS)
        return _vote(issuer, ~issuer)
    # Country codes, areas and exchanges of the American plan, and trunk prefixes of other plans.
    known = (
        match.rlike("^\\+") & digits.rlike(f"^{CALLING}") | digits.rlike(f"^00{CALLING}")
        | digits.rlike("^1?[2-9][0-8][0-9][2-9][0-9]{6}$") | digits.rlike("^0[1-9][0-9]{7,10}$")
    )
    return _vote(known, ~known | digits.rlike("^1?(?:000|555|999)"))


def _shape(kind: str, match: Column, joined: Column) -> Column:
    """How regularly a match is written; letters that touch it speak against it."""
    if kind == "email":
        regular, odd = match.rlike("[\\[({<].*[\\])}>]") | match.rlike("^[^ ]+$"), match.rlike("^[._%+\\-]|[0-9]$")
    elif kind == "ip":
        marks = F.array_distinct(F.filter(F.split(match, "[0-9A-Fa-f]+"), lambda x: x != ""))
        regular, odd = F.size(marks) <= 1, match.rlike("^0[0-9]|[^:]0[0-9]{2}[^0-9A-Fa-f:]")
    elif kind == "card":
        regular = match.rlike("^(?:[0-9]{4}([ .\\-/]?)[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,7}|[0-9]{4}([ \\-]?)[0-9]{6}\\2[0-9]{4,5}|[0-9]+)$")
        odd = match.rlike("[ .\\-/]{2}") | match.rlike("^([0-9])\\1+$")
    else:
        marks = F.array_distinct(F.filter(F.split(match, "[0-9]+"), lambda x: x != ""))
        regular = match.rlike("^[+(]") | (F.size(marks) == 1)
        odd = match.rlike(DATE) | match.rlike("([0-9])\\1{6}")
    return _vote(regular & ~odd & ~joined, odd | joined)


def _passes(kind: str, match: Column) -> Column:
    """The tests of wider forms: the base tests, for cards from 13 digits on, and no dates as numbers."""
    n = F.length(_digits(match))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "ip":
        plain = F.regexp_replace(F.regexp_replace(match, "(?i)dot", "."), "[^0-9.]", "")
        return F.contains(match, F.lit(":")) | _octets(plain)
    if kind == "phone":
        return (n >= 8) & (n <= 15) & ~match.rlike(DATE)
    return F.lit(True)


def _candidates(text: Column, kind: str, base: Column) -> Column:
    """Wider matches that no base span of the kind meets, with the votes on them."""
    wide = spans_if(WIDE_HINTS[kind](text), text, WIDE[kind])
    alone = F.filter(wide, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return _voted(text, kind, alone, F.lit(False))


def _voted(text: Column, kind: str, spans: Column, exact: Column) -> Column:
    def votes(s: Column) -> Column:
        match = s["match"]
        before = F.lower(F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(CONTEXT)).cast("int")))
        after = F.substring(text, (s["end"] + 1).cast("int"), F.lit(2))
        joined = after.rlike("^[A-Za-z0-9_]") | before.rlike("[a-z0-9_]$")
        ok = exact | _passes(kind, match)
        checked = F.lit(kind in ("ip", "card"))
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), exact.alias("exact"),
            _vote(exact | (ok & checked), ~ok).alias("pattern"),
            _gazetteer(kind, match).alias("gazetteer"),
            _vote(any_word(before, SPEAKS_FOR[kind]), any_word(before, SPEAKS_AGAINST)).alias("context"),
            _shape(kind, match, joined).alias("shape"),
            F.least(F.length(_digits(match)), F.lit(40)).cast("int").alias("digits"),
            # What no labeler sees: separators, and what stands directly before and behind.
            F.least(F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")), F.lit(4)).cast("int").alias("marks"),
            before.rlike("(?:[:=(\\[<\"']|\\b(?:is|at|on|to|am|um|au|al|by|with)) ?$").cast("int").alias("led"),
            after.rlike("^(?:$|[\\s,;)\\]>\"'!?]|\\.(?:$|\\s))").cast("int").alias("closed"),
        )

    return F.transform(spans, votes)


def _posterior(votes: tuple[int, ...], model: Reliability) -> float:
    odds = math.log(model.prior / (1 - model.prior))
    for vote, right in zip(votes, model.right, strict=True):
        odds += vote * math.log(right / (1 - right))
    return 1 / (1 + math.exp(-odds))


def estimate_reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 30) -> Reliability:
    """Expectation-maximisation over how often each pattern of votes (-1, 0, 1) occurs.

    Labelers are taken to be right more often than ``LEAST_RIGHT``, and at most
    half of all candidates as personal data; both settle which of the two hidden
    classes is which. No votes at all leave the starting values.
    """
    model = Reliability(tuple((1 + x) / 2 for x in LEAST_RIGHT), 0.5)
    total = sum(counts.values())
    if not total:
        return model
    for _ in range(rounds):
        agree, voted, positive = [0.8] * len(LABELERS), [1.0] * len(LABELERS), 0.0
        for votes, n in counts.items():
            p = _posterior(votes, model)
            positive += n * p
            for j, vote in enumerate(votes):
                if vote:
                    voted[j] += n
                    agree[j] += n * (p if vote > 0 else 1 - p)
        right = tuple(
            min(max(a / v, least), 0.98) for a, v, least in zip(agree, voted, LEAST_RIGHT, strict=True)
        )
        model = Reliability(right, min(max(positive / total, 0.02), 0.5))
    return model


TRAITS = ("marks", "led", "closed")


def _features(kind: str, votes: tuple[int, ...], traits: tuple[int, ...], bucket: int) -> list[float]:
    marks, led, closed = traits
    return [*(float(kind == k) for k in KINDS), *map(float, votes), marks / 4, float(led), float(closed), bucket / 4]


def train_span_classifier(found: DataFrame, *, iterations: int = 40) -> tuple[list[float], float]:
    """Weights and intercept of the span classifier, from all spans' votes.

    The spans are counted by kind, votes, number of digits and traits; there are
    few such patterns however many spans there are (4 * 81 * 11 * 20 at the very
    most), so no sample is taken. Each pattern trains as both classes, weighted
    by its posterior.
    """
    spark = found.sparkSession
    bucket = F.floor(F.col("digits") / DIGIT_BUCKET).cast("int").alias("bucket")
    rows = found.groupBy("kind", *LABELERS, *TRAITS, bucket).count().collect()
    counts: dict[tuple[int, ...], int] = {}
    for r in rows:
        votes = tuple(int(r[name]) for name in LABELERS)
        counts[votes] = counts.get(votes, 0) + r["count"]
    model = estimate_reliabilities(counts)
    data = []
    for r in rows:
        votes = tuple(int(r[name]) for name in LABELERS)
        p, x = _posterior(votes, model), _features(r["kind"], votes, tuple(r[t] for t in TRAITS), r["bucket"])
        data += [(x, 1.0, r["count"] * p), (x, 0.0, r["count"] * (1 - p))]
    if not data:
        return [0.0] * (len(KINDS) + len(LABELERS) + len(TRAITS) + 1), -math.inf
    table = _training_table(spark, data)
    fitted = LogisticRegression(weightCol="weight", maxIter=iterations, regParam=1e-3, standardization=False).fit(table)
    return [float(v) for v in fitted.coefficients], float(fitted.intercept)


def _training_table(spark: SparkSession, data: list[tuple[list[float], float, float]]) -> DataFrame:
    flat = local_table(spark, data, "x array<double>, label double, weight double")
    return flat.select(array_to_vector("x").alias("features"), "label", "weight")


def _probability(c: Column, weights: list[float], intercept: float) -> Column:
    score = F.lit(intercept)
    for kind, w in zip(KINDS, weights, strict=False):
        score = score + F.when(c["kind"] == kind, w).otherwise(0.0)
    scaled = [c[name] for name in LABELERS] + [c["marks"] / 4, c["led"], c["closed"]]
    for value, w in zip(scaled, weights[len(KINDS) :], strict=False):
        score = score + value * F.lit(w)
    score = score + F.floor(c["digits"] / DIGIT_BUCKET) / 4 * F.lit(weights[-1])
    return 1 / (1 + F.exp(-score))


def find_pii(
    docs: DataFrame, *, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Counts of base spans per kind, their checksum, and all spans of each text.

    Columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, n_added, spans,
    and found, the spans as structs. ``spans`` holds kind:start:end by kind as in
    ``KINDS`` and then by start, in code points with an exclusive end. A candidate
    joins them if it fails no test of its kind, no word before it speaks against
    it, and the classifier gives it at least ``threshold``. Null and empty
    texts have no spans; repeated rows are read each for itself; an empty table
    gives no rows. One scan of the texts and no shuffle of them: candidates and
    spans are kept in each row and stored without the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    for kind in KINDS:
        rows = rows.withColumn(f"b_{kind}", base_spans(F.col("text"), kind))
    for kind in KINDS:
        rows = rows.withColumn(f"w_{kind}", _candidates(F.col("text"), kind, F.col(f"b_{kind}"))).withColumn(
            f"b_{kind}", _voted(F.col("text"), kind, F.col(f"b_{kind}"), F.lit(True))
        )
    seen = stored(
        rows.select(
            "doc_id",
            F.concat(*(f"b_{k}" for k in KINDS)).alias("base"),
            F.concat(*(f"w_{k}" for k in KINDS)).alias("wide"),
        )
    )
    exploded = seen.select(F.explode(F.concat("base", "wide")).alias("c")).select("c.*")
    weights, intercept = train_span_classifier(exploded)
    # A failed check digit or octet outweighs any context, and words before outweigh how a match looks.
    added = F.filter("wide", lambda c: (c["pattern"] >= 0) & (c["context"] >= 0) & (_probability(c, weights, intercept) >= threshold))
    order = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))

    def ordered(spans: Column) -> Column:
        keyed = F.transform(spans, lambda c: F.struct(order[c["kind"]].alias("k"), c["start"].alias("s"), c["end"].alias("e"), c["kind"].alias("n")))
        return F.array_join(
            F.transform(F.array_sort(keyed), lambda c: F.concat_ws(":", c["n"], c["s"].cast("string"), c["e"].cast("string"))), ","
        )

    def of_kind(kind: str) -> Column:
        return F.filter("base", lambda c: c["kind"] == kind)

    return seen.withColumn("added", added).select(
        "doc_id",
        *(F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(ordered(F.col("base")), 256).alias("base_sha256"),
        F.size("added").cast("long").alias("n_added"),
        ordered(F.concat("base", "added")).alias("spans"),
        F.transform(F.concat("base", "added"), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).alias("found"),
    )
