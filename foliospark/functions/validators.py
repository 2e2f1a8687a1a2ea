"""VAT and IBAN validation as column functions that return struct<is_valid, country, errors>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import IBAN_COUNTRIES, IBAN_LENGTHS, VAT_FORMATS, VAT_PREFIXES, lookup


def _digits(s: Column) -> Column:
    """Digits of a string as ints; null elements for anything else."""
    return F.transform(F.split(s, ""), lambda c: c.try_cast("int"))


def _digit(s: Column, at) -> Column:
    return F.substring(s, at, 1).try_cast("int")


def _weighted(s: Column, weights: list[int]) -> Column:
    return sum((_digit(s, i + 1) * w for i, w in enumerate(weights)), F.lit(0))


def _luhn_sum(s: Column, n: int, doubled: int) -> Column:
    """Digit sum with every index of parity ``doubled`` doubled and 9 taken off above 9."""
    total = F.lit(0)
    for i in range(n):
        v = _digit(s, i + 1) * (2 if i % 2 == doubled else 1)
        total = total + F.when(v > 9, v - 9).otherwise(v)
    return total


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def vat_checksum(vat: Column) -> Column:
    """The check of ten countries; other prefixes pass. What cannot be computed fails."""
    prefix, body = F.substring(vat, 1, 2), F.substring(vat, 3, 40)
    number = lambda at, n: F.substring(body, at, n).try_cast("bigint")

    def german(a, d):
        s = (a + d) % 10
        return F.when(s == 0, 10).otherwise(s) * 2 % 11

    de = (11 - F.aggregate(_digits(F.substring(body, 1, 8)), F.lit(10), german)) % 10 == _digit(body, 9)
    pl_sum = _weighted(body, [6, 5, 7, 2, 3, 4, 5, 6, 7]) % 11
    gb9 = (_weighted(body, [8, 7, 6, 5, 4, 3, 2]) + number(8, 2)) % 97
    at_sum = _luhn_sum(F.substring(body, 2, 7), 7, 0)
    rules = {
        "DE": (F.length(body) == 9) & de,
        "FR": (F.length(body) == 11) & ((12 + 3 * (number(3, 9) % 97)) % 97 == number(1, 2)),
        "IT": (F.length(body) == 11) & ((10 - _luhn_sum(body, 10, 1) % 10) % 10 == _digit(body, 11)),
        "PL": (F.length(body) == 10) & (pl_sum != 10) & (pl_sum == _digit(body, 10)),
        "NL": (F.length(vat) == 14) & (F.substring(vat, -3, 1) == "B") & (_weighted(body, [9, 8, 7, 6, 5, 4, 3, 2, 1]) % 11 == 0),
        "BE": (F.length(body) == 10) & (97 - number(1, 8) % 97 == number(9, 2)),
        "ES": F.length(body) == 9,
        "PT": (F.length(body) == 9) & (_weighted(body, [9, 8, 7, 6, 5, 4, 3, 2, 1]) % 11 == 0),
        "AT": (F.length(body) == 9) & body.startswith("U") & ((10 - (at_sum + 4) % 10) % 10 == _digit(body, 9)),
        "GB": body.rlike("^[0-9]{9,}$") & ((F.length(body) > 9) | (gb9 == 0) | ((gb9 + 55) % 97 == 0)),
    }
    out = F.lit(True)
    for code, rule in rules.items():
        out = F.when(prefix == code, _sure(rule)).otherwise(out)
    return out


def _errors(*rules: tuple[Column, Column | str]) -> Column:
    return F.filter(F.array(*(F.when(c, e) for c, e in rules)), lambda e: e.isNotNull())


def validate_vat(vat: Column) -> Column:
    """EL numbers take the pattern of GR and so never fit it; both messages may occur; a known prefix names its country even then."""
    clean = F.regexp_replace(F.upper(F.coalesce(vat, F.lit(""))), "[ .-]", "")
    prefix = F.substring(clean, 1, 2)
    key = F.when(prefix == "EL", "GR").otherwise(prefix)
    empty, known = F.coalesce(vat, F.lit("")) == "", key.isin(list(VAT_FORMATS))
    shaped = _sure(F.rlike(clean, F.coalesce(lookup(VAT_FORMATS, key), F.lit("^$"))))
    country = F.when(known & ~empty, lookup(VAT_PREFIXES, key))
    errors = _errors(
        (empty, "Empty VAT number"),
        (~empty & ~known, F.concat(F.lit("Unknown VAT prefix: "), key)),
        (~empty & known & ~shaped, F.concat(F.lit("Invalid VAT format for "), country)),
        (~empty & known & ~vat_checksum(clean), "Invalid VAT checksum"),
    )
    return F.struct((F.size(errors) == 0).alias("is_valid"), country.alias("country"), errors.alias("errors"))


def mod97(iban: Column) -> Column:
    """The ISO check remainder: digits and letters (A = 10) folded after moving the first four characters to the end."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))

    def step(a, c):
        d = c.try_cast("int")
        return F.when(d.isNotNull(), (a * 10 + d) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)


def validate_iban(iban: Column) -> Column:
    clean = F.regexp_replace(F.upper(F.coalesce(iban, F.lit(""))), "[ -]", "")
    code = F.substring(clean, 1, 2)
    size = lookup(IBAN_LENGTHS, code)
    empty, shaped = F.coalesce(iban, F.lit("")) == "", clean.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$")
    known = ~empty & shaped & size.isNotNull()
    errors = _errors(
        (empty, "Empty IBAN"),
        (~empty & ~shaped, "Invalid IBAN format"),
        (~empty & shaped & size.isNull(), F.concat(F.lit("Unknown IBAN country code: "), code)),
        (known & (F.length(clean) != size), F.format_string("Invalid IBAN length: expected %d, got %d", size, F.length(clean))),
        (known & (mod97(clean) != 1), "Invalid IBAN checksum"),
    )
    return F.struct((F.size(errors) == 0).alias("is_valid"), F.when(known, lookup(IBAN_COUNTRIES, code)).alias("country"), errors.alias("errors"))


def format_iban(iban: Column) -> Column:
    return F.regexp_replace(F.upper(F.regexp_replace(iban, r"(?U)\s", "")), "(.{4})(?=.)", "$1 ")


def bban(iban: Column) -> Column:
    return F.substring(F.upper(F.regexp_replace(iban, r"(?U)\s", "")), 5, 40)

