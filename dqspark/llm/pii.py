"""Personal data by patterns, checksums and context, with SQL functions only.

A pattern proposes spans, a validator confirms them (value ranges, digit counts,
Luhn for cards, mod 97 for IBANs), and words near a span raise its score.  A
pattern splits the text, so a span starts where the gaps and matches before it
end; nothing is searched twice.

Patterns are written so that a scan stays linear on any text: they begin at the
start of a run, and quantifiers that need no second try are possessive.

Results in special cases: null or empty text: no spans; repeated rows: one row
each; spans of different kinds may overlap; a match that fails its check is
dropped and not tried again at another length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.text import fresh

#: Matches whose lengths are summed together; keeps running sums cheap on texts with very many matches.
STRIDE = 64
NEAR = 40  # code points before a span that may hold a context word


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i))
    return total % 10 == 0


def _card(v: Column) -> Column:
    d = _digits(v)
    return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)


def _mod97(v: Column) -> Column:
    compact = F.replace(v, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, F.lit(1), F.lit(4)))

    def step(a: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, a * 10 + code - 48).otherwise(a * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(compact)), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    name: str
    hint: str  # a text without it has no match
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str  # a word near the span that makes it likelier

    @property
    def tag(self) -> str:
        return f"[{self.name.upper()}]"


_PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
EMAIL = Kind(
    "email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    lambda v: F.lit(True), 0.9, "mail|contact|address|kontakt|adresse|correo|courriel")
IP = Kind(
    "ip", ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    lambda v: v.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"), 0.6, r"\bip\b|host|server|login|client|addr")
CARD = Kind("card", "", r"[0-9](?:[ -]?[0-9])++", _card, 0.8, "card|visa|credit|pay|karte|carte|tarjeta")
PHONE = Kind(
    "phone", "+", r"\+[0-9][ ().0-9-]+[0-9]", lambda v: F.length(_digits(v)).between(9, 15), 0.7,
    "phone|call|tel|mobile|fax|anruf|appel|llam")
# Characters of an IBAN by country.
IBAN_LENGTH = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC",
}
#: A country's IBAN has its length, so what follows it is no part of it.
IBAN_PATTERN = "|".join(
    f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, countries in IBAN_LENGTH.items())
#: The look ahead spares trying every country at every place.
IBAN = Kind("iban", "", f"(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN_PATTERN})", _mod97, 0.9, "iban|bank|account|konto|compte|cuenta")
BASE = (EMAIL, IP, CARD, PHONE)
KINDS = (*BASE, IBAN)
#: What must not be left in part: wider kinds go first.
REDACTION = (IBAN, EMAIL, PHONE, CARD, IP)


def _matches(text: Column, kind: Kind) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if not kind.hint:
        return found
    return F.when(F.contains(text, F.lit(kind.hint)), found).otherwise(F.array().cast("array<string>"))


def _gaps(text: Column, kind: Kind, matches: Column) -> Column:
    """The text between matches: one more than there are matches."""
    return F.when(F.size(matches) > 0, F.split(text, kind.pattern, -1)).otherwise(F.array(text))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _running(values: Column) -> Column:
    """Sums of the values before each, in strides, so that the work stays small for very many."""
    strides = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STRIDE).cast("int")),
        lambda k: F.slice(values, k * STRIDE + 1, F.lit(STRIDE)))
    totals = F.transform(strides, _sum)

    def within(stride: Column, k: Column) -> Column:
        base = _sum(F.slice(totals, F.lit(1), k))
        return F.transform(stride, lambda _, i: base + _sum(F.slice(stride, F.lit(1), i)))

    return F.when(F.size(values) > 0, F.flatten(F.transform(strides, within))).otherwise(
        F.array().cast("array<int>"))


def _spans(kind: Kind, matches: Column, gaps: Column, starts: Column) -> Column:
    def span(i: Column) -> Column:
        v, gap = F.get(matches, i), F.get(gaps, i)
        start = F.get(starts, i) + F.length(gap)
        near = F.lower(F.right(gap, F.lit(NEAR))).rlike(kind.context)
        score = F.lit(kind.score) + F.when(near, 0.1).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(v)).alias("end"),
                        F.round(score, 2).alias("score"), kind.valid(v).alias("valid"))

    every = F.transform(F.sequence(F.lit(0), F.size(matches) - 1), span)
    found = F.filter(every, lambda s: s["valid"])
    kept = F.transform(found, lambda s: F.struct(s["kind"], s["start"], s["end"], s["score"]))
    return F.when(F.size(matches) > 0, kept).otherwise(F.array().cast(
        "array<struct<kind:string,start:int,end:int,score:double>>"))


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id and, for each kind, an array of (kind, start, end, score) in code points, end exclusive."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = out.select("*", *[_matches(F.col("text"), k).alias(f"m_{k.name}") for k in kinds])
    out = out.select("*", *[_gaps(F.col("text"), k, F.col(f"m_{k.name}")).alias(f"g_{k.name}") for k in kinds])
    out = out.select("*", *[F.zip_with(
        F.slice(f"g_{k.name}", F.lit(1), F.size(f"m_{k.name}")), f"m_{k.name}", lambda g, v: F.length(g) + F.length(v),
    ).alias(f"l_{k.name}") for k in kinds])
    out = out.select("*", *[F.when(F.size(f"m_{k.name}") > 0, _running(F.col(f"l_{k.name}"))).alias(f"s_{k.name}")
                            for k in kinds])
    return out.select("doc_id", *[_spans(k, *(F.col(f"{c}_{k.name}") for c in "mgs")).alias(k.name) for k in kinds])


def written(*spans: Column) -> Column:
    """kind:start:end, comma-joined, kind by kind."""
    shown = [F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])) for s in spans]
    return F.array_join(F.concat(*shown), ",")


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = REDACTION) -> DataFrame:
    """``docs`` with every confirmed span of ``text`` replaced by the tag of its kind; n_chars follows if present.

    Kinds are taken one after the other, so a span that an earlier tag has
    replaced is not looked at again.  A null text stays null.
    """
    names = docs.columns  # "text" may be spelled in any case
    texts, found, gaps = fresh(names, 3)
    out = docs
    for k in kinds:
        source = F.col("text") if texts not in out.columns else F.col(texts)
        out = out.withColumn(texts, source)
        out = out.withColumn(found, _matches(F.coalesce(texts, F.lit("")), k))
        out = out.withColumn(gaps, _gaps(F.coalesce(texts, F.lit("")), k, F.col(found)))
        shown = _tagged(F.col(found), k)
        parts = F.zip_with(F.col(gaps), shown, lambda g, v: F.concat(g, F.coalesce(v, F.lit(""))))
        out = out.withColumn(texts, F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(F.col(texts)))
    keep = [F.col(texts).alias(c) if c.lower() == "text"
            else F.length(texts).cast(docs.schema[c].dataType).alias(c) if c.lower() == "n_chars" else F.col(c) for c in names]
    return out.select(*keep)


def _tagged(matches: Column, kind: Kind) -> Column:
    return F.transform(matches, lambda v: F.when(kind.valid(v), kind.tag).otherwise(v))

