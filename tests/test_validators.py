"""Tax numbers of every country against plain Python."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from foliospark.functions import guard, validators
from foliospark.functions.dictionaries import VAT_FORMATS, VAT_PREFIXES


def checked(vat):
    """The checksum of ten countries, as their rules are written down; other prefixes pass."""
    prefix, body = vat[:2], vat[2:]
    try:
        d = [int(c) if c.isdigit() else None for c in body]
        if prefix == "DE":
            if len(body) != 9:
                return False
            p = 10
            for x in d[:8]:
                s = (x + p) % 10 or 10
                p = s * 2 % 11
            return (11 - p) % 10 == d[8]
        if prefix == "FR":
            return len(body) == 11 and int(body[:2]) == (12 + 3 * (int(body[2:]) % 97)) % 97
        if prefix == "IT":
            total = 0
            for i, x in enumerate(d[:10]):
                x *= 2 if i % 2 else 1
                total += x - 9 if x > 9 else x
            return len(body) == 11 and (10 - total % 10) % 10 == d[10]
        if prefix == "PL":
            s = sum(a * b for a, b in zip(d, [6, 5, 7, 2, 3, 4, 5, 6, 7])) % 11
            return len(body) == 10 and s != 10 and s == d[9]
        if prefix == "NL":
            return len(vat) == 14 and vat[-3] == "B" and sum(a * b for a, b in zip(d[:9], range(9, 0, -1))) % 11 == 0
        if prefix == "BE":
            return len(body) == 10 and 97 - int(body[:8]) % 97 == int(body[8:])
        if prefix == "ES":
            return len(body) == 9
        if prefix == "PT":
            return len(body) == 9 and sum(a * b for a, b in zip(d, range(9, 0, -1))) % 11 == 0
        if prefix == "AT":
            total = 0
            for i, x in enumerate(int(c) for c in body[1:8]):
                x *= 2 if i % 2 == 0 else 1
                total += x - 9 if x > 9 else x
            return len(body) == 9 and body[0] == "U" and (10 - (total + 4) % 10) % 10 == d[8]
        if prefix == "GB":
            if not re.fullmatch(r"[0-9]{9,}", body):
                return False
            if len(body) > 9:
                return True
            s = sum(a * b for a, b in zip(d, [8, 7, 6, 5, 4, 3, 2])) + int(body[7:])
            return s % 97 == 0 or (s + 55) % 97 == 0
        return True
    except (TypeError, ValueError, IndexError):
        return False


def judged(vat):
    if not vat:
        return False, None, ["Empty VAT number"]
    clean = re.sub("[ .-]", "", vat.upper())
    key = "GR" if clean[:2] == "EL" else clean[:2]
    if key not in VAT_FORMATS:
        return False, None, [f"Unknown VAT prefix: {key}"]
    country, errors = VAT_PREFIXES.get(key), []
    if not re.match(VAT_FORMATS[key], clean):
        errors.append(f"Invalid VAT format for {country}")
    if not checked(clean):
        errors.append("Invalid VAT checksum")
    return not errors, country, errors


def made(seed, n):
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    shapes = {"AT": "U########", "NL": "#########B##", "ES": "X#######X", "FR": "###########", "GB": "#########", "IT": "###########", "PL": "##########", "BE": "0#########", "PT": "#########", "DE": "#########", "CH": "E#########MWST", "NO": "#########MVA", "CY": "########X", "IE": "#X#####X"}
    out = [None, "", "XX1", "de 136.695-976", "DE136695976", "GBGD123", "GBHA123", "EL123456789", "GR123456789"]
    for _ in range(n):
        code = r.choice(sorted(VAT_FORMATS))
        shape = shapes.get(code, "#" * r.randrange(7, 13))
        body = "".join(digits(1) if c == "#" else r.choice("AKX") if c == "X" else c for c in shape)
        if code in ("DE", "PL", "PT", "IT", "AT", "BE", "FR", "GB", "NL") and r.random() < 0.6:  # a check digit that fits
            for _ in range(400):
                if checked(code + body):
                    break
                at = max(i for i, c in enumerate(body) if c.isdigit() and (code != "NL" or i < 9)) if code not in ("BE", "FR", "GB") else r.randrange(len(body))
                body = body[:at] + digits(1) + body[at + 1 :]
        if r.random() < 0.1:
            body = body[: r.randrange(len(body))] + r.choice(["", "Z", "9"]) + body[r.randrange(len(body)) :]
        out.append(code + body)
    return out


def test_tax_numbers_against_python(spark):
    numbers = made(1, 10_000)
    rows = spark.createDataFrame(list(enumerate(numbers)), "i int, vat string").select("i", validators.validate_vat(F.col("vat")).alias("v")).collect()
    right, countries = 0, set()
    for r in rows:
        assert (r["v"]["is_valid"], r["v"]["country"], r["v"]["errors"]) == judged(numbers[r["i"]]), numbers[r["i"]]
        if r["v"]["is_valid"]:
            right += 1
            countries.add(numbers[r["i"]][:2].upper())
    assert right > 2000 and {"DE", "FR", "IT", "PL", "NL", "BE", "ES", "PT", "AT", "GB"} <= countries


def test_checks_that_are_turned_off(spark):
    df = spark.createDataFrame([("germany", "Acme Tools", 2020, "nothing of it", "DE136695977", "DE1")], "country string, company string, year int, text string, vat string, iban string")
    every = df.select(guard.check(*(F.col(c) for c in df.columns)).alias("g")).first()["g"]
    assert len(every["errors"]) == 3 and len(every["warnings"]) == 2
    for left_out, errors, warnings in (("year", 2, 2), ("vat", 2, 2), ("iban", 2, 2), ("company", 3, 1), ("country", 3, 1)):
        g = df.select(guard.check(*(F.col(c) for c in df.columns), checks=[c for c in guard.CHECKS if c != left_out]).alias("g")).first()["g"]
        assert (len(g["errors"]), len(g["warnings"])) == (errors, warnings), left_out
