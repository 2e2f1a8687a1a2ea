"""Normalisation of semi-structured model answers: JSON recovery, dictionaries, range checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .dictionaries import COUNTRIES, COUNTRY_ALIASES, DOC_TYPE_ALIASES, DOC_TYPE_CATEGORY, lookup, strings
from .text import trim

ANSWER = "country string, doc_type string, company string, year string"
VALID, MAPPED, UNKNOWN = 0.85, 0.75, 0.5
#: A deterministic order for partial country names: the longest first, then by name.
PARTIAL = sorted(COUNTRIES, key=lambda c: (-len(c), c))


def _object(text: Column) -> Column:
    """The text if it is one JSON object, else null."""
    return let(trim(text), lambda t: F.when(t.rlike(r"(?s)^\{.*\}$") & F.try_parse_json(t).isNotNull() & F.json_object_keys(t).isNotNull(), t))


def recover_json(raw: Column, attempts: int = 4) -> Column:
    """The JSON object of an answer: the whole, a fenced block, the first flat object, or the widest braces."""
    fence = F.regexp_extract(raw, r"(?Us)```(?:json)?\s*(\{.*?\})\s*```", 1)
    flat = F.regexp_extract(raw, r"\{[^{}]*\}", 0)
    wide = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.coalesce(*[_object(x) for x in (raw, fence, flat, wide)][:attempts])


def normalize_country(name: Column) -> Column:
    """Exact name, alias, or the first name that contains or is contained; null otherwise."""
    def known(n: Column) -> Column:
        partial = F.try_element_at(F.filter(strings(PARTIAL), lambda c: F.contains(n, c) | F.contains(c, n)), F.lit(1))
        return F.coalesce(F.when(n.isin(COUNTRIES), n), lookup(COUNTRY_ALIASES, n), partial)

    return F.when(F.coalesce(name, F.lit("")) != "", let(trim(F.lower(name)), known))


def normalize_doc_type(name: Column) -> Column:
    """struct<doc_type, confidence, category>; null for an empty name."""
    def known(n: Column) -> Column:
        valid, mapped = n.isin(list(DOC_TYPE_CATEGORY)), lookup(DOC_TYPE_ALIASES, n)
        kind = F.when(valid, n).otherwise(F.coalesce(mapped, F.lit("unknown")))
        confidence = F.when(valid, VALID).when(mapped.isNotNull(), MAPPED).otherwise(UNKNOWN)
        category = F.coalesce(lookup(DOC_TYPE_CATEGORY, kind), F.lit("other"))
        return F.struct(kind.alias("doc_type"), confidence.alias("confidence"), category.alias("category"))

    return F.when(F.coalesce(name, F.lit("")) != "", let(F.regexp_replace(trim(F.lower(name)), " ", "_"), known))


def parse_response(raw: Column, text: Column) -> Column:
    """struct of country, doc_type, doc_category, company, year, both confidences, is_valid and errors.

    A year counts only if the document holds it and it lies within 1990 to 2030. Numbers in text
    fields are read as their JSON text.
    """
    def fields(found: Column) -> Column:
        a = F.from_json(found, ANSWER)
        return let(F.struct(found.alias("found"), a.alias("a")), normalised)

    def normalised(x: Column) -> Column:
        a = x["a"]
        company = F.when(F.length(a["company"]) > 1, trim(a["company"]))
        number = a["year"].try_cast("int")
        values = (
            x["found"].alias("found"), a.alias("a"), normalize_country(a["country"]).alias("country"), normalize_doc_type(a["doc_type"]).alias("kind"),
            company.alias("company"), number.alias("number"), F.contains(F.coalesce(text, F.lit("")), number.cast("string")).alias("there"),
        )
        return let(F.struct(*values), _checked)

    return let(recover_json(F.coalesce(raw, F.lit(""))), fields)


def _checked(x: Column) -> Column:
    """The answer and its errors from the normalised fields."""
    a, country, kind, company, number, there = (x[f] for f in ("a", "country", "kind", "company", "number", "there"))
    given = (F.coalesce(a["year"], F.lit("")) != "") & ~a["year"].isin("0", "false")
    errors = F.filter(
        F.array(
            F.when(x["found"].isNull(), "Failed to parse JSON from response"),
            F.when((a["country"] != "") & country.isNull(), F.concat(F.lit("Unknown country: "), a["country"])),
            F.when(kind["confidence"] == UNKNOWN, F.concat(F.lit("Unknown doc_type '"), a["doc_type"], F.lit("', mapped to 'unknown'"))),
            F.when(given & number.isNull(), F.concat(F.lit("Invalid year format: "), a["year"])),
            F.when(given & ~there, F.concat(F.lit("Year "), number.cast("string"), F.lit(" not found in text (hallucination?)"))),
            F.when(given & there & ~number.between(1990, 2030), F.concat(F.lit("Year "), number.cast("string"), F.lit(" out of valid range"))),
        ),
        lambda e: e.isNotNull(),
    )
    return F.struct(
        country.alias("country"), F.when(country.isNotNull(), VALID).otherwise(0.0).alias("country_confidence"),
        kind["doc_type"].alias("doc_type"), F.coalesce(kind["confidence"], F.lit(0.0)).alias("doc_type_confidence"), kind["category"].alias("doc_category"),
        company.alias("company"), F.when(given & there & number.between(1990, 2030), number).alias("year"),
        (country.isNotNull() | kind.isNotNull() | company.isNotNull()).alias("is_valid"), errors.alias("errors"),
    )
