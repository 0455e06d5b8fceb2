"""Personal data by weak supervision, in DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.session import stage

# The patterns of the base kinds, written so that a long run of
# characters is read once. A match can begin in a run only where the run begins
# or the match before it ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Looser forms that only the votes can confirm.
SPELLED_EMAIL = r"(?i)\b[a-z0-9._%+-]{1,64}\s?[\[(]\s?at\s?[\])]\s?[a-z0-9-]{1,63}(?:\s?(?:[\[(]\s?dot\s?[\])]|\.)\s?[a-z0-9-]{2,63}){1,4}"
LOCAL_PHONE = r"(?<![0-9+().-]|[0-9+] )(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b"

BASE = ("email", "ip", "card", "phone")
#: kind: (pattern, what a text must show to be searched at all)
KINDS = {
    "email": (EMAIL, r"@[A-Za-z0-9-]++\."),
    "ip": (IP, r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (CARD, r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": (PHONE, r"\+[0-9][\x20().0-9-]"),
    "email_spelled": (SPELLED_EMAIL, r"(?i)[\[(]\s?at\s?[\])]"),
    "phone_local": (LOCAL_PHONE, r"[0-9]{3}[-.][0-9]{4}"),
    "social": (SOCIAL, r"[0-9]-[0-9]{2}-[0-9]"),
    "iban": (IBAN, r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
}
ORDER = {kind: i for i, kind in enumerate(KINDS)}

#: Gazetteers: top-level domains, country calling codes, card issuers' first digits.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us|ca|ch|at|nl|be|pl|ru|jp|cn|in|br|au"
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|3[57]\\d|4[2]\\d|2[1-6]\\d|8[057]\\d|9[679]\\d"
ISSUERS = "3[04-9]|4|5|6|2[2-7]"
NEAR = 40
HINTS = {
    "email": r"(?i)e-?mail|contact|write|reach|correo|courriel|adresse|kontakt|@",
    "ip": r"(?i)\bip\b|address|server|host|client|from|login|adresse|direcci",
    "card": r"(?i)card|credit|debit|visa|master|amex|pay|karte|carte|tarjeta",
    "phone": r"(?i)tel|phone|call|mobile|fax|cell|appel|anruf|llam|contact",
    "social": r"(?i)ssn|social|security|tax|id\b",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
}
AGAINST = r"(?i)(?:version|release|build|isbn|issn|doi|order|invoice|part|item|serial|no\.|nr\.|#)\s*[:#]?\s*\z"
LABELERS = ("format", "check", "gazetteer", "context", "border")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a number pass the Luhn check."""
    digits = F.reverse(_digits(value))
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(places, F.lit(0), lambda acc, i: acc + F.coalesce(worth(i), F.lit(0)))
    return (total % 10 == 0) & (F.length(digits) > 0)


def _octets(value: Column) -> Column:
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return value.rlike(rf"\A{part}(?:\.{part}){{3}}\z")


def _holds(kind: str, value: Column) -> Column:
    """The condition that a match of the pattern must meet."""
    size = F.length(_digits(value))
    if kind == "ip":
        return _octets(value)
    if kind == "card":
        return size.between(14, 19) & luhn(value)
    if kind == "phone":
        return size.between(10, 15)
    return F.lit(True)


def _matches(text: Column, kind: str) -> Column:
    """All matches in order, with code-point positions (end exclusive).

    The pieces between matches give the positions: no match is looked for twice.
    """
    pattern, shows = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def add(acc: Column, pair: Column) -> Column:
        begin = acc.at + F.length(pair["piece"])
        end = begin + F.length(pair["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc.out, F.array(span)).alias("out"))

    pairs = F.zip_with(
        F.slice(between, 1, F.size(found)), found, lambda p, v: F.struct(p.alias("piece"), v.alias("value"))
    )
    spans = F.aggregate(pairs, start, add, lambda acc: acc.out)
    spans = F.filter(spans, lambda s: _holds(kind, s.value))
    return F.when(text.rlike(shows), spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, span: Column, text: Column) -> Column:
    """What each labeler says of a candidate: 1, -1 or 0 (nothing)."""
    value, never = span.value, F.lit(False)
    family = kind.split("_")[0]
    before = F.substring(text, F.greatest(span.start - NEAR, F.lit(0)) + 1, F.least(span.start, F.lit(NEAR)))
    after = F.substring(text, span.end + 1, F.lit(1))
    digits = _digits(value)
    form = F.lit(1 if kind in BASE else 0)
    if family == "email":
        known = value.rlike(rf"(?i)(?:{DOMAINS})\z")
        check = _vote(value.rlike(r"[A-Za-z]{2,}\z"), value.rlike(r"\.[0-9-]+\z"))
    elif family == "ip":
        known = ~value.rlike(r"\A0*(?:0|127|255|22[4-9]|2[34][0-9])\.")
        check = _vote(~value.rlike(r"(?:\A|\.)0[0-9]"), value.rlike(r"(?:\A|\.)0[0-9]"))
    elif family == "card":
        known, check = digits.rlike(rf"\A(?:{ISSUERS})"), _vote(luhn(value), never)
    elif family == "phone":
        known = value.rlike(rf"\A\+(?:{CALLING})") if kind == "phone" else digits.rlike(r"\A[2-9][0-9]{2}[2-9]")
        check = _vote(F.length(digits).between(10, 15), ~F.length(digits).between(10, 15))
    elif family == "social":
        known = never
        check = _vote(~digits.rlike(r"\A(?:000|666|9)|\A.{3}00|0000\z"), digits.rlike(r"\A(?:000|666|9)|\A.{3}00|0000\z"))
    else:
        known, check = never, _vote(F.length(F.regexp_replace(value, " ", "")).between(15, 34), never)
    context = _vote(before.rlike(HINTS[family]), before.rlike(AGAINST))
    loose = before.rlike(r"[\p{L}\p{N}_/=.-]\z") | after.rlike(r"[\p{L}\p{N}_/=]")
    border = _vote(~loose, loose)
    votes = (form, check, _vote(known, never), context, border)
    return F.struct(*[v.cast("int").alias(name) for name, v in zip(LABELERS, votes, strict=True)])


def candidates(text: Column) -> Column:
    """Everything that may be personal data, with votes, by start and kind.

    Looser candidates that overlap a base span say nothing new and are left out.
    """
    text = F.coalesce(text, F.lit(""))

    def of(kind: str) -> Column:
        return F.transform(
            _matches(text, kind),
            lambda s: F.struct(
                s.start.alias("start"),
                F.lit(ORDER[kind]).alias("place"),
                s.end.alias("end"),
                F.lit(kind).alias("kind"),
                F.lit(kind in BASE).alias("base"),
                _votes(kind, s, text).alias("votes"),
            ),
        )

    every = F.array_sort(F.concat(*[of(kind) for kind in KINDS]))
    return F.filter(
        every,
        lambda s: s.base | ~F.exists(every, lambda o: o.base & (o.start < s.end) & (s.start < o.end)),
    )


@dataclass
class Reliability:
    """Naive-Bayes tables of the labelers and the weights of the final classifier."""

    prior: float = 0.5
    tables: dict[tuple[str, int], tuple[float, float]] = field(default_factory=dict)
    bias: float = 0.0
    weights: dict[tuple[str, int], float] = field(default_factory=dict)

    def chance(self, span: Column) -> Column:
        """The final classifier's probability that a candidate is personal data."""
        total = F.lit(self.bias)
        for name in LABELERS:
            for vote in (-1, 0, 1):
                weight = self.weights.get((name, vote), 0.0)
                total = total + F.when(span.votes[name] == vote, F.lit(weight)).otherwise(0.0)
        for kind in KINDS:
            total = total + F.when(span.kind == kind, F.lit(self.weights.get(("kind", ORDER[kind]), 0.0))).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> Reliability:
    """EM over vote patterns (kind, votes, count), then a classifier on its answer.

    Labelers err independently given the truth. The start trusts each vote a
    little, so the two classes cannot change places. The classifier, a logistic
    regression on votes and kind, learns the soft labels of EM: it weighs what
    labelers share and knows kinds that EM does not look at.
    """
    model = Reliability()
    if not patterns:
        return model
    belief = []
    for _, votes, _ in patterns:
        belief.append(1 / (1 + math.exp(-sum(votes) + 0.5)))
    total = sum(n for *_, n in patterns)
    for _ in range(rounds):
        mass = sum(b * n for b, (*_, n) in zip(belief, patterns, strict=True))
        model.prior = (mass + 1) / (total + 2)
        for i, name in enumerate(LABELERS):
            for vote in (-1, 0, 1):
                hit = [(b * n, (1 - b) * n) for b, (_, v, n) in zip(belief, patterns, strict=True) if v[i] == vote]
                lean = 1.0 + 0.5 * vote
                model.tables[name, vote] = (
                    (sum(p for p, _ in hit) + lean) / (mass + 3),
                    (sum(q for _, q in hit) + 2 - lean) / (total - mass + 3),
                )
        belief = []
        for _, votes, _ in patterns:
            odds = math.log(model.prior / (1 - model.prior))
            for name, vote in zip(LABELERS, votes, strict=True):
                yes, no = model.tables[name, vote]
                odds += math.log(yes / no)
            belief.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    names = [(name, vote) for name in LABELERS for vote in (-1, 0, 1)] + [("kind", i) for i in ORDER.values()]
    weights, bias = dict.fromkeys(names, 0.0), 0.0
    for _ in range(300):
        slope, drift = dict.fromkeys(names, 0.0), 0.0
        for b, (kind, votes, n) in zip(belief, patterns, strict=True):
            keys = [*zip(LABELERS, votes, strict=True), ("kind", ORDER[kind])]
            odds = bias + sum(weights[k] for k in keys)
            gap = (b - 1 / (1 + math.exp(-odds))) * n / total
            drift += gap
            for k in keys:
                slope[k] += gap
        bias += 2 * drift
        for k in names:
            weights[k] += 2 * (slope[k] - 1e-4 * weights[k])
    model.bias, model.weights = bias, weights
    return model


def fit(spans: DataFrame) -> Reliability:
    """Learn from ``spans``, an array of candidates per row, of all documents.

    Only counts of vote patterns reach the driver: at most kinds times votes, a
    number fixed by the labelers.
    """
    one = spans.select(F.explode("spans").alias("s")).select("s.kind", *[F.col(f"s.votes.{n}").alias(n) for n in LABELERS])
    rows = one.groupBy("kind", *LABELERS).count().orderBy("kind", *LABELERS).collect()
    return estimate([(r.kind, tuple(r[n] for n in LABELERS), r["count"]) for r in rows])


def found(spans: Column, model: Reliability, least: float = 0.5) -> Column:
    """Base spans, and those that the classifier confirms."""
    return F.filter(spans, lambda s: s.base | (model.chance(s) >= least))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` of every row: start, end, kind, base and the votes.

    Null texts count as empty and have no spans; repeated rows get equal spans; an
    empty table gives no rows; other columns are not carried. Each text is read
    once: candidates are written with their votes and judged afterwards.
    """
    spans = stage(docs.select(F.col(doc_id).alias("doc_id"), candidates(F.col(text)).alias("spans")), "pii")
    return spans.select("doc_id", found(F.col("spans"), fit(spans)).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind; overlapping spans become one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        piece = F.substring(text, acc.at + 1, s.start - acc.at)
        shown = F.concat(acc.out, F.array(piece, F.concat(F.lit("<"), F.upper(s.kind), F.lit(">"))))
        return F.struct(
            F.greatest(acc.at, s.end).alias("at"), F.when(s.start >= acc.at, shown).otherwise(acc.out).alias("out")
        )

    def close(acc: Column) -> Column:
        return F.concat(F.array_join(acc.out, ""), F.substring(text, acc.at + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, close)).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal data masked; all other columns as they are."""
    spans = stage(docs.select(candidates(F.col(text)).alias("spans")).filter(F.size("spans") > 0), "pii")
    model = fit(spans)
    return docs.withColumn(text, masked(F.col(text), found(candidates(F.col(text)), model)))
