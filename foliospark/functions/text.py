"""Text normalisation, structure fingerprints and company hints as native expressions.

Patterns carry (?U) where white space, digits or word characters are meant in the Unicode sense.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import let
from .dictionaries import TRUNCATION_KEYWORDS, strings

# Patterns whose matches define the fingerprints.
STRUCTURE = {
    "amount": r"\d+[.,]\d{2}\s*(EUR|USD|GBP|PLN|CHF)",
    "date": r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "iban": r"[A-Z]{2}\d{2}[A-Z0-9]{10,30}",
    "vat": r"[A-Z]{2}\d{8,12}",
}
_NAME = r"([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3})\s+"
CACHE_SUFFIXES = ["GMBH|AG|SA|SAS|SRL|LTD|PLC|INC|BV|NV", "ENERGIE|ENERGY|TELECOM|MOBILE"]


#: Unicode white space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def normalize(text: Column) -> Column:
    return trim(F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"(?U)\d+", "#")))


def normal_head(text: Column, size: int = 500) -> Column:
    """The first characters of the normalised text, from its beginning alone where that has enough of them.

    A sigma's small letter depends on what follows, so texts that begin with one are taken whole.
    """
    start = F.substring(text, 1, 4 * size)
    whole = F.substring(normalize(text), 1, size)
    return F.when(F.contains(start, F.lit("Σ")), whole).otherwise(let(normalize(start), lambda n: F.when((F.length(n) > size) | (F.length(text) <= 4 * size), F.substring(n, 1, size)).otherwise(whole)))


def first_offset(text: Column, pattern: str) -> Column:
    """Code-point offset of the first match, null if there is none.

    ``regexp_instr`` counts UTF-16 units, which are code points unless the text has some beyond the first plane;
    only then the text before the match is cut out and measured.
    """
    wide = F.length(F.regexp_extract(text, f"(?Us)^(.*?)(?:{pattern})", 1))
    found = lambda units: F.when(units > 0, F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), wide).otherwise(units - 1))
    return let(F.regexp_instr(text, F.lit(f"(?U){pattern}")), found)


def structure(text: Column, kinds=("amount", "date", "iban", "vat")) -> Column:
    """Kinds with the hundreds of their offsets; texts without the sign or any digit that a kind holds are passed over."""
    digits, at = text.rlike(r"(?U)\d"), F.contains(text, F.lit("@"))
    # where a run of an address's letters leads to no address, its later letters lead to none either
    address = "(?<![a-zA-Z0-9._%+-])" + STRUCTURE["email"].replace("+@", "++@")
    offset = lambda k: F.when(at, first_offset(text, address)) if k == "email" else F.when(digits, first_offset(text, STRUCTURE[k]))
    parts = [F.concat(F.lit(f"{k}:"), F.floor(offset(k) / 100).cast("string")) for k in kinds]
    return F.concat_ws("|", *parts)


def header_hash(text: Column) -> Column:
    return F.substring(F.md5(F.encode(normalize(F.substring(text, 1, 500)), "UTF-8")), 1, 16)


def fingerprint(text: Column) -> Column:
    content = F.concat(normalize(F.substring(text, 1, 500)), F.lit("|"), structure(text))
    return F.substring(F.sha2(F.encode(content, "UTF-8"), 256), 1, 32)


def company_hint(text: Column, suffixes=CACHE_SUFFIXES) -> Column:
    header = F.upper(F.substring(text, 1, 500))

    def hint(s: str) -> Column:
        # the suffix behind a letter and white space is found in one pass; only then names before it are tried
        name = F.when(header.rlike(f"(?U)[A-Za-z]\\s+(?:{s})"), trim(F.regexp_extract(header, f"(?U){_NAME}(?:{s})", 1)))
        return F.when(F.length(name).between(3, 50), F.lower(name))

    return F.coalesce(*(hint(s) for s in suffixes))


def with_fingerprint(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds fingerprint, header_hash, structure and company_hint of the template table."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns({"fingerprint": fingerprint(t), "header_hash": header_hash(t), "structure": structure(t), "company_hint": company_hint(t)})


def generator_fingerprint(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The library variant: cut after normalising, e-mail in the structure, more company suffixes, 'empty' without text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    header = F.substring(F.md5(F.encode(normal_head(t), "UTF-8")), 1, 16)
    shape = F.substring(F.md5(F.encode(structure(t, ("amount", "date", "email", "iban", "vat")), "UTF-8")), 1, 16)
    hint = company_hint(t, ["GMBH|AG|SA|SAS|SRL|LTD|PLC|INC|BV|NV|SP Z O O", "ENERGIE|ENERGY|TELECOM|MOBILE|BANK"])
    empty = t == ""
    full = F.substring(F.sha2(F.concat_ws("|", header, shape, F.coalesce(hint, F.lit(""))), 256), 1, 32)
    pick = lambda c: F.when(empty, F.lit("empty")).otherwise(c)
    return df.withColumns({"g_header": pick(header), "g_structure": pick(shape), "g_hint": F.when(~empty, hint), "g_full": pick(full)})


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def prepare_text(text: Column) -> Column:
    """Runs of spaces to one, lines trimmed, blank lines dropped."""
    lines = F.split(F.regexp_replace(strip_controls(text), " {2,}", " "), "\n", -1)
    return F.array_join(F.filter(F.transform(lines, trim), lambda x: x != ""), "\n")


#: Keywords without those that hold another one.
_KEYWORDS = [k for k in TRUNCATION_KEYWORDS if not any(o != k and o in k for o in TRUNCATION_KEYWORDS)]
#: Later lines that are tried first: mostly they fill what a truncated text may hold.
FIRST_LINES = 300


def smart_truncate(text: Column, limit: int = 3000, header_lines: int = 30) -> Column:
    """Header lines, then later lines with a keyword and the line after the first equal line; cut if still too long."""

    def important(lines: Column, hit: Column) -> Column:
        after = lambda x: F.coalesce(F.try_element_at(lines, (F.array_position(lines, x) + 1).cast("int")), F.lit(""))
        pairs = F.flatten(F.transform(F.array_distinct(hit), lambda x: F.array(trim(x), trim(after(x)))))
        return F.array_distinct(F.filter(pairs, lambda x: x != ""))

    def hits(lines: Column, n: Column) -> Column:
        named = lambda x: let(F.lower(x), lambda y: reduce(or_, (F.contains(y, F.lit(k)) for k in _KEYWORDS)))
        return F.filter(F.slice(lines, F.lit(header_lines + 1), F.greatest(n - header_lines, F.lit(0))), named)

    def joined(lines: Column, found: Column) -> Column:
        head = F.filter(F.transform(F.slice(lines, 1, header_lines), trim), lambda x: x != "")
        return F.array_join(F.when(F.size(found) > 0, F.concat(head, strings(["", "---", ""]), found)).otherwise(head), "\n")

    def cut(whole: Column) -> Column:
        return F.when(F.length(whole) > limit, F.concat(F.substring(whole, 1, limit - 20), F.lit("\n...[trimmed]"))).otherwise(whole)

    def shortened(lines: Column) -> Column:
        early = F.least(F.size(lines), F.lit(header_lines + FIRST_LINES))
        # what later lines add lies beyond the limit if the first ones reach it
        some = let(important(lines, hits(lines, early)), lambda found: joined(lines, found))
        every = lambda: let(let(important(lines, hits(lines, F.size(lines))), lambda found: joined(lines, found)), cut)
        return let(some, lambda x: F.when((F.length(x) > limit) | (F.size(lines) <= early), cut(x)).otherwise(every()))

    return let(text, lambda t: F.when(F.length(t) > limit, let(F.split(t, "\n", -1), shortened)).otherwise(t))


def similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Likeness of two generator fingerprints given as columns full, header, structure, hint."""
    near = F.when(a["hint"] == b["hint"], 0.1).when(F.contains(a["hint"], b["hint"]) | F.contains(b["hint"], a["hint"]), 0.05).otherwise(0.0)
    score = F.when(a["header"] == b["header"], 0.6).otherwise(0.0) + F.when(a["structure"] == b["structure"], 0.3).otherwise(0.0) + F.coalesce(near, F.lit(0.0))
    return F.when(a["full"] == b["full"], 1.0).otherwise(F.least(score, F.lit(1.0)))
