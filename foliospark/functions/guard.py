"""Checks of an answer against its document, with penalties on its confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .dictionaries import COUNTRY_INDICATORS, EVIDENCE_PREFIXES, lookup
from .validators import validate_iban, validate_vat

MIN_SIMILARITY = 0.5
#: The rules in their order, with the penalty of each and whether it is an error.
RULES = {
    "year_absent": (0.3, True),
    "year_short": (0.05, False),
    "company_unlikely": (0.1, False),
    "company_doubtful": (0.05, False),
    "vat_invalid": (0.2, True),
    "vat_country": (0.1, False),
    "iban_invalid": (0.15, True),
    "country_bare": (0.05, False),
}


def _names(company: Column, text: Column) -> list[Column]:
    c = F.lower(company)
    words = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\b(\w{3,})\b"), F.lit(1)))
    first = F.array_join(F.slice(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""), 1, 2), " ")
    return [c.alias("c"), F.lower(text).alias("t"), words.alias("words"), first.alias("first")]


def _similarity(x: Column) -> Column:
    share = F.size(F.filter(x["words"], lambda w: F.contains(x["t"], w))) / F.size(x["words"])
    start = (F.length(x["first"]) >= 4) & F.contains(x["t"], x["first"])
    return F.when(F.contains(x["t"], x["c"]), 1.0).when(F.size(x["words"]) == 0, 0.0).when(start, F.greatest(share, F.lit(0.8))).otherwise(share)


def company_similarity(company: Column, text: Column) -> Column:
    """1 for a substring, else the share of distinct words of three letters or more; at least 0.8 if the first two words occur."""
    return let(F.struct(*_names(company, text)), _similarity)


def country_evidence(country: Column, text: Column) -> Column:
    """Whether an indicator or a VAT prefix of the country occurs; false for countries without indicators."""
    c, t = F.lower(country), F.lower(text)
    known = F.lit(False)
    for name, indicators in COUNTRY_INDICATORS.items():
        there = F.lit(False)
        for i in indicators:
            there = there | F.contains(t, F.lit(i))
        known = F.when(c == name, there).otherwise(known)
    prefix = F.regexp_extract(text, r"(?U)\b([A-Z]{2})\d{8,12}", 1)
    return F.coalesce(known | (c.isin(list(COUNTRY_INDICATORS)) & (lookup(EVIDENCE_PREFIXES, prefix) == c)), F.lit(False))


#: Which checks run; each may be turned off.
CHECKS = ("vat", "iban", "year", "company", "country")


def check(
    country: Column, company: Column, year: Column, text: Column, vat: Column | None = None, iban: Column | None = None, min_similarity: float = MIN_SIMILARITY, checks=CHECKS
) -> Column:
    """struct<is_valid, penalty, errors, warnings>, in the order year, company, vat, iban, country; ``checks`` names those that run."""
    t = F.coalesce(text, F.lit(""))
    vat, iban = (vat if "vat" in checks else None), (iban if "iban" in checks else None)
    values = F.struct(*_values(company_similarity(company, t), country_evidence(country, t), vat, iban))
    return let(let(values, lambda x: _messages(x, country, company, year, t, vat, iban, min_similarity, checks)), _judged)


def _values(similarity: Column, evidence: Column, vat: Column | None, iban: Column | None) -> list[Column]:
    values = [similarity.alias("similarity"), evidence.alias("evidence")]
    if vat is not None:
        values.append(validate_vat(vat).alias("vat"))
    if iban is not None:
        values.append(validate_iban(iban)["is_valid"].alias("iban"))
    return values


def _messages(x: Column, country: Column, company: Column, year: Column, t: Column, vat: Column | None, iban: Column | None, min_similarity: float, checks) -> Column:
    """One message or null for each rule."""
    y = year.cast("string")
    short = F.substring(y, -2, 2)
    absent = year.isNotNull() & ~F.contains(t, y) & F.lit("year" in checks)
    s = x["similarity"]
    percent = F.concat(F.format_string("%.0f", F.bround(s * 100, 0)), F.lit("%)"))
    has = (F.coalesce(company, F.lit("")) != "") & F.lit("company" in checks)
    none = F.lit(None).cast("string")
    bad_vat = other = bad_iban = none
    if vat is not None:
        v = x["vat"]
        bad_vat = F.when(vat.isNotNull() & ~v["is_valid"], F.concat(F.lit("Invalid VAT checksum: "), vat))
        differs = vat.isNotNull() & v["is_valid"] & (F.lower(country) != F.lower(v["country"]))
        other = F.when(differs, F.concat(F.lit("VAT "), vat, F.lit(" ("), v["country"], F.lit(") doesn't match country "), country))
    if iban is not None:
        bad_iban = F.when(iban.isNotNull() & ~x["iban"], F.concat(F.lit("Invalid IBAN: "), iban))
    bare = (F.coalesce(country, F.lit("")) != "") & ~x["evidence"] & F.lit("country" in checks)
    said = {
        "year_absent": F.when(absent & ~F.contains(t, short), F.concat(F.lit("Year "), y, F.lit(" not found in text (possible hallucination)"))),
        "year_short": F.when(absent & F.contains(t, short), F.concat(F.lit("Year "), y, F.lit(" found only as '"), short, F.lit("'"))),
        "company_unlikely": F.when(has & (s < min_similarity), F.concat(F.lit("Company '"), company, F.lit("' may be hallucinated (similarity: "), percent)),
        "company_doubtful": F.when(has & (s >= min_similarity) & (s < 0.7), F.concat(F.lit("Company '"), company, F.lit("' has low confidence (similarity: "), percent)),
        "vat_invalid": bad_vat,
        "vat_country": other,
        "iban_invalid": bad_iban,
        "country_bare": F.when(bare, F.concat(F.lit("No strong evidence for country '"), country, F.lit("' in text"))),
    }
    return F.struct(*(said[rule].alias(rule) for rule in RULES))


def _judged(m: Column) -> Column:
    penalty = F.lit(0.0)
    for rule, (amount, _) in RULES.items():
        penalty = penalty + F.when(m[rule].isNotNull(), amount).otherwise(0.0)
    errors, warnings = (F.filter(F.array(*(m[rule] for rule, (_, error) in RULES.items() if error is wanted)), lambda e: e.isNotNull()) for wanted in (True, False))
    return F.struct((F.size(errors) == 0).alias("is_valid"), penalty.alias("penalty"), errors.alias("errors"), warnings.alias("warnings"))
