"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions only. Base kinds are e-mail, IP address, payment card (Luhn) and phone number;
their confirmed spans always stay. Further kinds are international bank accounts (mod 97), and two
that count only where a word before them supports it: social security and plain account numbers.

Offsets are code points, ends exclusive. Spans of one kind never overlap; spans of different kinds
may. Defined results: null text counts as empty; empty text has no spans; a table without rows gives
no rows; columns other than doc_id and text are not read; repeated rows are searched one by one.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import table

CONTEXT_CHARS = 48
BLOCK = 64                      # matches whose sizes are added up at once
KEEP_AT = 0.5


class Kind(NamedTuple):
    name: str
    pattern: str            # no match may be cut short by another start inside the same run
    hint: str               # a text without this character has no match; "" if there is none
    valid: object           # Column -> Column
    score: float
    context: str            # words that raise the score by 0.4 when they stand shortly before
    base: bool = True


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def weighted(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), weighted), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """ISO 7064: letters are two-digit numbers, the first four characters go last, the rest is 1."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(r, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (r * 100 + c - 55) % 97).otherwise((r * 10 + c - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


_OCTET = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?)"  # of digits; nothing is left of zeros

# Patterns of the base kinds, with possessive loops that accept the same matches in
# linear time, and the words that support a kind.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda m: F.lit(True), 0.9, "mail|contact|contacto|kontakt"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".",
         lambda m: m.rlike(rf"\A{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"), 0.6, "ip|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "",
         lambda m: F.length(_digits(m)).between(13, 19) & luhn(_digits(m)), 0.9, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+",
         lambda m: F.length(_digits(m)).between(9, 15), 0.7, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "",
         lambda m: mod97(F.translate(m, " ", "")), 0.9, "iban|account|konto|compte|cuenta", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-",
         lambda m: ~m.rlike(r"\A(?:000|666|9..)|-00-|-0000\z"), 0.3, "ssn|social security", False),
    Kind("account", r"(?<![0-9])[0-9]{7,12}(?![0-9])", "",
         lambda m: F.lit(True), 0.2, "account|passport|konto|compte|cuenta|customer number", False),
)


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _total(a: Column, first: Column, n: Column) -> Column:
    return F.aggregate(F.slice(a, first + 1, n), F.lit(0), lambda s, x: s + x)


def _sums(a: Column) -> Column:
    """The sums of each BLOCK numbers of an array."""
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: _total(a, i, F.lit(BLOCK)))


def _placed(text: Column, pattern: str, found: Column) -> Column:
    """(start, end, text, before) of the matches `found` of a pattern. What lies between them gives the offsets, as
    sums over whole blocks and blocks of blocks: a match adds up some BLOCK numbers, however many there are.
    `before`: the CONTEXT_CHARS characters before a match, from the pieces before it."""
    def all_(s):
        found, gaps = s["found"], s["gaps"]

        def placed(t, whole):
            def one(m, i):
                big, block = F.floor(i / BLOCK ** 2).cast("int"), F.floor(i / BLOCK).cast("int")
                start = (_total(whole, F.lit(0), big) + _total(t["sums"], big * BLOCK, block - big * BLOCK)
                         + _total(t["sizes"], block * BLOCK, i - block * BLOCK) + F.length(F.get(gaps, i)))
                first = F.greatest(i - (CONTEXT_CHARS // 2 + 1), F.lit(0))     # a match has two characters at least
                pieces = F.transform(F.sequence(first, i), lambda j: F.concat(
                    F.when(j > first, F.get(found, j - 1)).otherwise(F.lit("")), F.get(gaps, j)))
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"),
                                F.substring(F.array_join(pieces, ""), -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"))
            return F.transform(found, one)
        sizes = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
        return _let(sizes, lambda z: _let(F.struct(z.alias("sizes"), _sums(z).alias("sums")), lambda t: _let(_sums(t["sums"]), lambda whole: placed(t, whole))))
    empty = F.array().cast("array<struct<start:int,end:int,text:string,before:string>>")
    return F.when(F.size(found) > 0, _let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps")), all_)).otherwise(empty)


def find(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id and, per kind, array<struct<start, end, text, score>>, sorted by start."""
    none = F.array().cast("array<string>")
    t = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    proposed = [F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)) for k in KINDS]
    t = t.select("doc_id", "text", *[
        (F.when(F.instr("text", k.hint) > 0, p).otherwise(none) if k.hint else p).alias(k.name) for k, p in zip(KINDS, proposed)])
    t = t.select("doc_id", *[_placed(F.col("text"), k.pattern, F.col(k.name)).alias(k.name) for k in KINDS])

    def scored(k: Kind) -> Column:
        def score(x):
            near = F.lower(x["before"]).rlike(rf"\b(?:{k.context})\b")
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"),
                            F.when(near, F.lit(min(1.0, k.score + 0.4))).otherwise(F.lit(k.score)).alias("score"))
        kept = F.transform(F.filter(k.name, lambda x: k.valid(x["text"])), score)
        return kept if k.base else F.filter(kept, lambda x: x["score"] >= keep_at)
    return t.select("doc_id", *[scored(k).alias(k.name) for k in KINDS])


def _listed(kinds: list[Kind]) -> Column:
    def of(name):
        return F.transform(name, lambda x: F.concat_ws(":", F.lit(name), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(F.concat(*[of(k.name) for k in kinds]), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: counts and spans of every document."""
    base = [k for k in KINDS if k.base]
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in base],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(list(KINDS)).alias("spans"))
