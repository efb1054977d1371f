"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Positions come without Python: splitting a text by a pattern gives the stretches between matches, extracting it
gives the matches, and the running sum of their lengths (code points) gives every start. Patterns are written
with possessive repeats and start guards, which match what the plain forms match but never go back over a run,
so one very long run of digits or letters costs its length and not its square.

Running sums go by chunks, so a text with very many matches costs its length too.

Base kinds: email, ip, card, phone; they stay whatever their score. The method adds iban (its country's length, mod-97) and national
numbers of the form 123-45-6789 (score above the threshold, which needs a context word before them).

score = the kind's own weight, plus CONTEXT if one of its context words stands within ``NEAR`` characters before
the span; at most 1.

Defined cases: a null or empty text has no spans; ties do not occur inside a kind (matches do not overlap) and
spans of different kinds may overlap; repeated rows give equal results; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import let, whole

NEAR = 40
CHUNK = 128
CONTEXT = 0.35
THRESHOLD = 0.6


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a cheap test that any text with a match passes
    weight: float
    context: str
    base: bool


# The kinds, their patterns and the words that speak for them.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"e-?mail|contact|write|mailto", True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"\bip\b|address|host|server|login", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", 0.8, r"card|credit|visa|payment|debit", True),
    Kind("phone", r"\+[0-9](?:[\x20().-]*+[0-9])++", r"\+[0-9]", 0.6, r"phone|tel|call|mobile|fax", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.8, r"iban|account|bank|konto", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-", 0.3, r"ssn|social|security|identity", False),
]


# The number of characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE BI", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BY DJ FR GR IT MC MR SM", 28: "AL AZ CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def claimed(kind: Kind, match: Column) -> Column:
    """What of a match can be the number: an IBAN ends with its country's length, null where it does not end at a blank."""
    if kind.name != "iban":
        return match
    sizes = F.create_map(*[F.lit(x) for n, countries in IBAN_LENGTHS.items() for c in countries.split() for x in (c, n)])
    size = F.element_at(sizes, F.substring(match, 1, 2))
    solid = F.filter(F.sequence(F.lit(1), F.length(match)), lambda i: F.substr(match, i, F.lit(1)) != " ")
    end = F.get(solid, size - 1)
    return F.when(F.substr(match, end + 1, F.lit(1)).isin("", " "), F.substr(match, F.lit(1), end))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right Luhn check digit."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's remainder is 1 once its first four characters stand last and letters count from 10."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    value = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).when(c.rlike("[A-Z]"), F.ascii(c) - 55))
    return F.aggregate(F.filter(value, lambda v: v.isNotNull()), F.lit(0),
                       lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def valid(kind: Kind, match: Column) -> Column:
    number = digits(match)
    length = F.length(number)
    if kind.name == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255))
    if kind.name == "card":
        return F.when(length.between(16, 19), luhn(number)).otherwise(False)
    if kind.name == "phone":
        return length.between(8, 15)
    if kind.name == "iban":
        return F.coalesce(mod97(F.replace(match, F.lit(" "), F.lit(""))), F.lit(False))
    if kind.name == "ssn":
        return ~match.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def running_sums(lengths: Column) -> Column:
    """Sums of an array of integers up to each element: by chunks of CHUNK, so that neither level copies an array per element of the whole."""
    add = lambda a, x: a + x
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")), lambda k: F.slice(lengths, k * CHUNK + 1, CHUNK))
    no_numbers = F.array().cast("array<int>")

    def place(a: Column, chunk: Column) -> Column:
        return F.struct((a["at"] + F.aggregate(chunk, F.lit(0), add)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    def numbered(chunks: Column) -> Column:
        before = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), no_numbers.alias("out")), place, lambda a: a["out"])
        return F.flatten(F.zip_with(chunks, before, lambda c, start: F.transform(c, lambda _, i: F.aggregate(F.slice(c, 1, i + 1), start, add))))

    return F.when(F.size(lengths) == 0, no_numbers).otherwise(let(cut, numbered))


def context_before(pairs: Column, i: Column) -> Column:
    """The NEAR characters before match i. A match and the gap before it have two characters or more but for a first gap, so NEAR / 2 of them reach."""
    far = F.greatest(F.lit(0), i - NEAR // 2)
    earlier = F.transform(F.slice(pairs, far + 1, i - far), lambda p: F.concat(F.right(p["gap"], F.lit(NEAR)), F.right(p["text"], F.lit(NEAR))))
    return F.right(F.concat(F.array_join(earlier, ""), F.right(F.get(pairs, i)["gap"], F.lit(NEAR))), F.lit(NEAR))


def located(kind: Kind, text: Column) -> Column:
    """Array of (start, end, text, before): every match with its place and the NEAR characters before it."""
    gaps, matches = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def placed(pairs: Column) -> Column:
        ends = running_sums(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["text"])))
        spans = F.zip_with(pairs, ends, lambda p, end: F.struct((end - F.length(p["text"])).alias("start"), p["text"].alias("text")))
        return F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), (s["start"] + F.length(claimed(kind, s["text"]))).alias("end"),
                                                        claimed(kind, s["text"]).alias("text"), context_before(pairs, i).alias("before")))

    pairs = F.when(F.size(matches) > 0, F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("text"))))
    none = F.array().cast("array<struct<start:int,end:int,text:string,before:string>>")
    return F.coalesce(let(pairs, placed), none)


def spans_of(kind: Kind, text: Column) -> Column:
    """Array of (start, end, score) of one kind, in order."""
    good = F.filter(located(kind, text), lambda s: s["text"].isNotNull() & valid(kind, s["text"]))
    score = F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.least(
        F.lit(1.0), F.lit(kind.weight) + F.when(F.lower(s["before"]).rlike(kind.context), F.lit(CONTEXT)).otherwise(F.lit(0.0))).alias("score")))
    kept = score if kind.base else F.filter(score, lambda s: s["score"] >= THRESHOLD)
    return F.when(text.rlike(kind.hint), kept).otherwise(F.array().cast("array<struct<start:int,end:int,score:double>>"))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and one array column of (start, end, score) per kind."""
    rows = docs.select("doc_id", whole(docs["text"]).alias("text"))
    return rows.select("doc_id", *[spans_of(k, F.col("text")).alias(k.name) for k in KINDS])


def join_spans(kinds: list[Kind]) -> Column:
    def named(name: str) -> Column:
        return F.transform(name, lambda s: F.concat_ws(":", F.lit(name), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[named(k.name) for k in kinds]), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    base = [k for k in KINDS if k.base]
    scores = F.concat(*[F.transform(k.name, lambda s: F.format_number(s["score"], 2)) for k in KINDS])
    return find_spans(docs).select(
        "doc_id", *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in KINDS],
        F.sha2(join_spans(base), 256).alias("base_sha256"), join_spans(KINDS).alias("spans"), F.array_join(scores, ",").alias("scores"))
