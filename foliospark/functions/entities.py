"""Entities of invoice-like texts and the fusion of country evidence, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import let
from .dictionaries import BIC_BLACKLIST, BIC_COUNTRIES, CURRENCIES, IBAN_COUNTRIES, VAT_PREFIXES, lookup, strings
from .text import trim

# Extraction patterns.
VAT_LABELLED = (
    r"(?iuU)\b(?:VAT|BTW|USt-ID|USt\.?-?IdNr|NIF|TVA|P\.?IVA|IVA|ИНН|КПП|ЄДРПОУ|ABN|GST|EIN|Tax ID|Steuernummer|Numéro de TVA|Partita IVA|NIP|DIČ|UID)"
    r"[:\s.-]*([A-Z]{2}[\dA-Z]{6,14}|\d{8,14})"
)
VAT_STANDALONE = r"(?U)\b([A-Z]{2}\d{8,12}[A-Z]?\d{0,2})\b"
IBAN = r"(?U)\b([A-Z]{2}\d{2}[A-Z0-9]{4}[A-Z0-9]{4,26})\b"
BIC = r"(?U)\b([A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"
PHONE = r"(?U)\+(\d{1,3})[\s.\-()]*\d"
EMAIL = r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
CURRENCY = r"(?U)\b(EUR|USD|GBP|PLN|CHF|SEK|NOK|DKK|CZK|HUF|RON|BGN|HRK|RSD|UAH|RUB|TRY|JPY|CNY|KRW|INR|BRL|MXN|ZAR|AED|SAR|ILS|NZD|CAD|AUD|ISK)\b(?!\s*:)"
DATE = r"(?U)\b(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})\b"
INVOICE_NUMBER = r"(?iuU)(?:Invoice|Rechnung|Facture|Faktura|Fattura|Račun|Счёт|Счет)\s*(?:No\.?|Nr\.?|#|№|Number|Nummer)?[:\s]*([A-Z0-9][\w\-/]{2,20})"
AMOUNT = r"(?iuU)(?:Total|Gesamt|Summe|Montant|Totale|Razem|Итого|Всього)[:\s]*([\d\s.,]+)\s*(?:EUR|USD|GBP|PLN)?"
VAT_CONFIDENCE, IBAN_CONFIDENCE, BIC_CONFIDENCE = 0.95, 0.90, 0.85


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _head(x: Column, start: int = 1) -> Column:
    return F.substring(x, start, 2)


def _if(possible: Column, found: Column) -> Column:
    """What is found where a cheap test allows it, else an empty array."""
    return F.when(possible, found).when(possible.isNotNull(), F.array().cast("array<string>"))


def _first(a: Column) -> Column:
    return F.try_element_at(a, F.lit(1))


def vat_numbers(text: Column) -> Column:
    known = lambda x: _head(x).isin(list(VAT_PREFIXES)) & (F.length(x) >= 8)
    labelled = F.transform(_all(text, VAT_LABELLED), lambda x: F.regexp_replace(F.upper(x), "[ .]", ""))
    alone = F.filter(_all(text, VAT_STANDALONE), lambda x: x.rlike("[0-9]"))
    return F.array_distinct(F.filter(F.concat(labelled, alone), known))


def ibans(text: Column) -> Column:
    return F.array_distinct(F.filter(_all(text, IBAN), lambda x: (F.length(x) >= 15) & _head(x).isin(list(IBAN_COUNTRIES))))


def bics(text: Column) -> Column:
    ok = lambda x: _head(x, 5).isin(list(BIC_COUNTRIES)) & ~x.isin(BIC_BLACKLIST)
    return F.array_distinct(F.filter(_all(text, BIC), ok))


def phones(text: Column) -> Column:
    return _if(F.contains(text, F.lit("+")), F.array_distinct(_all(text, PHONE)))


def emails(text: Column) -> Column:
    return _if(F.contains(text, F.lit("@")), F.array_distinct(F.transform(_all(text, EMAIL), lambda x: F.lower(x))))


def domains(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda x: F.substring_index(x, "@", -1)))


def currencies(text: Column) -> Column:
    return F.array_distinct(_all(text, CURRENCY))


def dates(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, DATE, 0), lambda x: F.translate(x, "/-", "..")))


def years(text: Column) -> Column:
    """Years of all dates, repeats kept: two digits turn at 50, and 2000 to 2030 count."""
    last = F.transform(_all(text, DATE, 3), lambda y: y.cast("int"))
    full = F.transform(last, lambda y: F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y))
    return F.filter(full, lambda y: y.between(2000, 2030))


def most_common(values: Column) -> Column:
    """The most frequent element, on a tie the one seen first; null for an empty array."""
    start = F.struct(F.lit(None).cast("int").alias("v"), F.lit(0).alias("n"))

    def best(found: Column) -> Column:
        counted = F.transform(F.array_distinct(found), lambda v: F.struct(v.alias("v"), F.size(F.filter(found, lambda x: x == v)).alias("n")))
        return F.aggregate(counted, start, lambda a, c: F.when(c["n"] > a["n"], c).otherwise(a))["v"]

    return let(values, best)


def invoice_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, INVOICE_NUMBER, 1), F.lit(""))


def amounts(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(_all(text, AMOUNT), trim), lambda x: x != ""))


def fuse(evidence: Column) -> Column:
    """struct<country, confidence, source>: 1-(1-a)(1-b) within a country, the best country, on ties the first seen; nulls without evidence."""
    start = F.struct(F.lit(None).cast("string").alias("country"), F.lit(0.0).alias("confidence"))

    def combined(own: Column) -> Column:
        first = F.element_at(own, 1)["confidence"]
        return F.aggregate(F.slice(own, 2, F.size(own) - 1), first, lambda a, e: 1 - (1 - a) * (1 - e["confidence"]))

    def best(found: Column) -> Column:
        countries = F.array_distinct(F.transform(found, lambda e: e["country"]))
        scored = F.transform(countries, lambda c: F.struct(c.alias("country"), let(F.filter(found, lambda e: e["country"] == c), combined).alias("confidence")))
        winner = F.aggregate(scored, start, lambda a, s: F.when(s["confidence"] > a["confidence"], s).otherwise(a))
        source = lambda w: F.try_element_at(F.filter(found, lambda e: e["country"] == w["country"]), F.lit(1))["source"]
        return let(winner, lambda w: F.struct(w["country"].alias("country"), w["confidence"].alias("confidence"), source(w).alias("source")))

    return let(evidence, best)


def with_entities(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All entities, the country of each kind of evidence, and the fused country."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumns({
        "vat_numbers": vat_numbers(t), "ibans": ibans(t), "bics": bics(t), "phone_codes": phones(t), "emails": emails(t),
        "currencies": currencies(t), "dates": dates(t), "year": most_common(years(t)), "invoice_number": invoice_number(t), "amounts": amounts(t),
    })
    priced = {k: v for k, v in CURRENCIES.items() if v[0] and v[1] > 0.7}
    out = out.withColumns({
        "email_domains": domains(F.col("emails")),
        "vat_country": lookup(VAT_PREFIXES, _head(_first(F.col("vat_numbers")))),
        "iban_country": lookup(IBAN_COUNTRIES, _head(_first(F.col("ibans")))),
        "bic_country": lookup(BIC_COUNTRIES, _head(_first(F.col("bics")), 5)),
        "currency_country": lookup({k: v[0] for k, v in priced.items()}, _first(F.filter("currencies", lambda c: c.isin(list(priced))))),
    })
    piece = lambda c, p, s: F.struct(c.alias("country"), p.cast("double").alias("confidence"), F.lit(s).alias("source"))
    fixed = F.array(piece(F.col("vat_country"), F.lit(VAT_CONFIDENCE), "vat"), piece(F.col("iban_country"), F.lit(IBAN_CONFIDENCE), "iban"), piece(F.col("bic_country"), F.lit(BIC_CONFIDENCE), "bic"))
    money = F.transform("currencies", lambda c: piece(lookup({k: v[0] for k, v in CURRENCIES.items()}, c), lookup({k: v[1] for k, v in CURRENCIES.items()}, c), "currency"))
    evidence = F.concat(fixed, F.when(F.col("currency_country").isNotNull(), money).otherwise(F.slice(money, 1, 0)))
    fused = fuse(F.filter(evidence, lambda e: e["country"].isNotNull()))
    return out.withColumn("_fused", fused).select(
        "*", F.col("_fused.country").alias("country"), F.col("_fused.confidence").alias("country_confidence"), F.col("_fused.source").alias("country_source")
    ).drop("_fused")
