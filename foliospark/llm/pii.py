"""Personal data: certain spans by pattern, further ones by boosted trees over proposed candidates.

E-mail addresses, IP addresses, card numbers (Luhn) and international phone numbers are certain.
High-recall generators also propose ``contact`` (spelled-out or spaced addresses) and ``number``
(nine digits or more with separators) candidates, which overlap the certain spans and each other;
those that overlap a certain one are dropped. What the patterns do not decide is taught by their own
spans: positive examples are certain spans of the corpus disguised as people write them (separators
spelled out, plus signs dropped, other grouping), in the context where they stand or behind a word
that announces them; negative ones are look-alikes of the same shapes (dates, amounts, order numbers,
prices, plain runs of digits) in such contexts. Candidates of the corpus itself have no labels and teach
nothing. Gradient boosted trees learn from format (lengths, digit groups, separators, Luhn) and context
(words before, neighbouring characters). Some disguises are held out of the fit and used for
calibration only: a generator's threshold is the lowest score whose precision on the held-out part,
unseen disguises included, is at least ``precision``. All certain spans teach: examples of equal features are
one row with their number as its weight, so the rows to fit grow with the distinct shapes and contexts. All
candidates are scored. Without certain spans nothing is learned or added, and
a generator adds nothing unless at least 20 held-out examples reach its threshold, as fewer show no precision.
Only DataFrame, SQL and pyspark.ml functions are used.

Defined results: a null text counts as empty and has no spans. Rows that repeat are judged alike and
all returned; a null id is kept. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_spans import match_spans, render
from .store import materialize

# Fixed values of the contract; possessive and anchored forms that match the same spans in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

# "at" and "dot" may stand for their signs in brackets of any kind, or between underscores.
_AT = r"[(\[{<]\x20?(?i:at|arobase)\x20?[)\]}>]"
_DOT = r"[(\[{<]\x20?(?i:dot|point|punkt|punto)\x20?[)\]}>]"
CONTACT = (
    rf"(?<![A-Za-z0-9._%+-])(?:[A-Za-z0-9._%+-]++\x20?(?:@|{_AT})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|{_DOT})\x20?[A-Za-z0-9-]++)++"
    r"|[A-Za-z0-9.%+-]++_(?i:at)_[A-Za-z0-9-]++(?:(?:_(?i:dot)_|\.)[A-Za-z0-9-]++)++)"
)
SPELLED = r"(?i)[(\[{<_]\x20?(?:at|arobase|dot|point|punkt|punto)\x20?[)\]}>_]"
NUMBER = r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){8,}+"
ANNOUNCED = r"(?i)(?:tel|phone|call|fax|mobile|cell|card|visa|account|mail|contact|reach|write|ssn)[^A-Za-z]{0,8}(?:(?:me|us|to|at|no|number|is)[^A-Za-z]{1,4}){0,2}$"
OTHERWISE = r"(?i)(?:order|ref|reference|invoice|isbn|id|page|version|date|total|no|nr|build|serial|part)[^A-Za-z]{0,8}$"

PRECISION = 0.95
CONTEXT = 30
ROUNDS = 20
FEATURES = [
    "f_len", "f_digits", "f_plus", "f_at", "f_spelled", "f_dots", "f_dashes", "f_parens", "f_spaces", "f_groups", "f_first", "f_longest", "f_last",
    "f_luhn", "f_label", "f_sentence", "f_word", "f_other", "f_before", "f_after", "f_contact",
]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    d = F.reverse(F.transform(F.split(_digits(m), ""), lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))))
    return F.aggregate(F.transform(d, lambda v, i: F.when(i % 2 == 0, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0))), F.lit(0), lambda a, v: a + v) % 10 == 0


def base_spans(t: Column, context: int = 0) -> Column:
    size = lambda m: F.length(_digits(m))
    return F.concat(
        match_spans(t, EMAIL, "email", 0, None, t.contains("@"), context),
        match_spans(t, IP, "ip", 1, lambda m: m.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"), None, context),
        match_spans(t, CARD, "card", 2, lambda m: size(m).between(16, 19) & luhn(m), None, context),
        match_spans(t, PHONE, "phone", 3, lambda m: size(m).between(8, 15), t.contains("+"), context),
    )


def _featured(rows: DataFrame) -> DataFrame:
    """Format and context of candidates (m, before, after, kind)."""
    m, before, after = F.col("m"), F.col("before"), F.col("after")
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    flag = lambda c: c.cast("double")
    count = lambda c: F.length(F.regexp_replace(m, f"[^{c}]", "")).cast("double")
    group = lambda i: F.coalesce(F.length(F.try_element_at(groups, F.lit(i))), F.lit(0)).cast("double")
    return rows.select(
        "*",
        F.length(m).cast("double").alias("f_len"),
        F.length(_digits(m)).cast("double").alias("f_digits"),
        flag(m.startswith("+")).alias("f_plus"),
        flag(m.contains("@")).alias("f_at"),
        flag(m.rlike(SPELLED)).alias("f_spelled"),
        count(".").alias("f_dots"),
        count("-").alias("f_dashes"),
        count("()").alias("f_parens"),
        count(" ").alias("f_spaces"),
        F.size(groups).cast("double").alias("f_groups"),
        group(1).alias("f_first"),
        F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)).cast("double").alias("f_longest"),
        group(-1).alias("f_last"),
        flag(F.length(_digits(m)).between(16, 19) & luhn(m)).alias("f_luhn"),
        F.length(F.regexp_extract(m, r"[.)\]}>_]\x20?([a-z]{2,})$", 1)).cast("double").alias("f_label"),
        flag(m.rlike(r"\.\x20?[A-Z]")).alias("f_sentence"),
        flag(before.rlike(ANNOUNCED)).alias("f_word"),
        flag(before.rlike(OTHERWISE)).alias("f_other"),
        flag(before.rlike(r"(?:^|[\s(<])$")).alias("f_before"),
        flag(after.rlike(r"^(?:$|[\s,.;)>])")).alias("f_after"),
        flag(F.col("kind") == "contact").alias("f_contact"),
    )


#: Disguises of an address (between name and host, between labels of the host); the last ones are held out of the fit.
_AT_DOT = [("(at)", "(dot)"), (" (at) ", " (dot) "), (" @ ", "."), (" (at) ", "."), (" @ ", " . "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", ".")]
_HELD_CONTACTS = {6, 7}
_HELD_NUMBERS = {3, 4}
_ANNOUNCE = ["tel: ", "phone ", "call me at ", "mobile: ", "", "", "", ""]
_OTHER_WORDS = ["order ", "ref. ", "invoice no ", "id: ", "", "", "", ""]


def _pick(choices: list, n: Column) -> Column:
    return F.element_at(F.array(*(c if isinstance(c, Column) else F.lit(c) for c in choices)), (F.pmod(n, F.lit(len(choices))) + 1).cast("int"))


def _examples(certain: DataFrame) -> DataFrame:
    """(kind, m, before, after, label, held): disguised certain spans, and look-alikes in their places."""
    m, h = F.col("m"), F.col("h")
    n = lambda i: F.shiftrightunsigned(h, 5 * i)  # noqa: E731  another part of the hash for each choice
    d = _digits(m)
    tail = F.right(d, F.lit(10))
    cut = lambda x, *at: [F.substring(x, a, k) for a, k in at]
    a, b, c = cut(tail, (1, 3), (4, 3), (7, 4))
    long = F.length(d) >= 10
    phones = [
        F.when(long, F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c)).otherwise(d), F.when(long, F.concat_ws("-", a, b, c)).otherwise(d),
        F.when(long, F.concat_ws(" ", a, b, c)).otherwise(d), F.when(long, F.concat_ws(".", a, b, c)).otherwise(d), F.regexp_replace(m, r"^\+", ""),
    ]
    quads = cut(d, (1, 4), (5, 4), (9, 4), (13, 7))
    cards = [F.concat_ws(".", *quads), F.concat_ws("  ", *quads), F.concat_ws(". ", *quads), F.concat_ws("--", *quads), F.concat_ws(" .", *quads)]
    # addresses with and without digits and further labels
    bare = F.regexp_replace(F.substring_index(m, "@", 1), "[^A-Za-z]+", "")
    name = F.when((F.pmod(n(5), F.lit(2)) == 0) & (bare != ""), bare).otherwise(F.substring_index(m, "@", 1))
    host = F.substring_index(m, "@", -1)
    host = F.when(F.pmod(n(6), F.lit(2)) == 0, F.concat(F.regexp_replace(F.element_at(F.split(host, r"\."), -2), "[0-9]+", "x"), F.lit("."), _pick(["com", "org", "net", "de"], n(7)))).otherwise(host)
    contacts = [F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))) for at, dot in _AT_DOT]

    shape_c, shape_n = F.pmod(n(1), F.lit(len(contacts))), F.pmod(n(1), F.lit(len(phones)))
    mail = F.col("kind") == "email"
    disguised = F.when(mail, _pick(contacts, n(1))).when(F.col("kind") == "phone", _pick(phones, n(1))).otherwise(_pick(cards, n(1)))
    held = F.when(mail, shape_c.isin(_HELD_CONTACTS)).otherwise(shape_n.isin(_HELD_NUMBERS))
    kind = F.when(mail, "contact").otherwise("number").alias("kind")
    positive = certain.filter("kind <> 'ip'").select(
        kind, disguised.alias("m"), F.concat("before", _pick(_ANNOUNCE, n(2))).alias("before"), "after", F.lit(1.0).alias("label"), held.alias("held"), "part"
    )

    random = F.translate(F.sha2(F.concat(h.cast("string"), m), 256), "abcdef", "271828")
    g = lambda *lengths: [F.substring(random, 1 + sum(lengths[:i]), k) for i, k in enumerate(lengths)]
    numbers = [
        F.substring(random, F.lit(1), (F.lit(9) + F.pmod(n(3), F.lit(12))).cast("int")), F.concat(F.lit("20"), *cut(random, (1, 2)), F.lit("-0"), *cut(random, (3, 1)), F.lit("-1"), *cut(random, (4, 1)), F.lit(" "), *cut(random, (5, 4))),
        F.concat_ws(".", *g(3, 3, 3, 2)), F.concat_ws(" ", *g(1, 3, 3, 3)), F.concat_ws(".", *g(2, 2, 3, 2)), F.concat_ws("-", *g(4, 6, 3)), F.concat_ws("-", F.lit("978"), *g(1, 4, 4, 1)),
        F.concat_ws(".", *g(4, 4, 4, 4)), F.concat_ws(" ", *g(2, 2, 2, 2, 2)), F.concat_ws(" - ", *g(5, 5)), F.concat_ws("-", *g(2, 7, 2)), F.concat(*g(5), F.lit("("), *g(5, 4), F.lit(")")),
    ]
    # any groups of digits: from two to seven, of one to seven digits each
    sizes = F.transform(F.sequence(F.lit(0), (F.pmod(n(8), F.lit(6)) + 1).cast("int")), lambda i: (F.pmod(F.ascii(F.substring(random, i + 40, F.lit(1))), F.lit(7)) + 1).cast("int"))
    groups = F.transform(sizes, lambda k, i: F.substring(random, i * 7 + 1, k))
    any_number = F.array_join(groups, "-")
    any_number = F.when(F.pmod(n(9), F.lit(3)) == 0, F.array_join(groups, ".")).when(F.pmod(n(9), F.lit(3)) == 1, F.array_join(groups, " ")).otherwise(any_number)
    w1, w2 = F.regexp_extract("before", r"([A-Za-z]+)[^A-Za-z]*$", 1), F.regexp_extract("after", "([A-Za-z]+)", 1)
    word = lambda w, other: F.when(w == "", other).otherwise(w)
    w1, w2 = word(w1, "stay"), word(w2, "home")
    prices = [
        F.concat(*g(1), F.lit(" @ "), *cut(random, (2, 1)), F.lit("."), *cut(random, (3, 2))), F.concat(w1, F.lit(" @ "), w2, F.lit(". "), F.initcap(w1)),
        F.concat(w1, F.lit("@"), w2, F.lit(". "), F.initcap(w1)), F.concat(*cut(random, (1, 2)), w1, F.lit(" @ "), *cut(random, (2, 2)), F.lit("."), *cut(random, (4, 1)), w2),
    ]
    other = F.concat("before", _pick(_OTHER_WORDS, n(2)))
    alike = certain.select(F.lit("number").alias("kind"), F.when(F.pmod(n(10), F.lit(2)) == 0, any_number).otherwise(_pick(numbers, n(4))).alias("m"), other.alias("before"), "after", F.lit(0.0).alias("label"), F.lit(False).alias("held"), "part")
    priced = certain.filter(mail).select(F.lit("contact").alias("kind"), _pick(prices, n(4)).alias("m"), other.alias("before"), "after", F.lit(0.0).alias("label"), F.lit(False).alias("held"), "part")
    return positive.unionByName(alike).unionByName(priced)


def _weighted(examples: DataFrame) -> DataFrame:
    """Examples of equal kind, label and features as one row, with their number as ``weight``; ``fit`` parts those of the fit from the held-out ones."""
    used = examples.withColumn("fit", F.col("part") < 7).filter("not (fit and held)")
    return _featured(used).groupBy("label", "fit", "kind", *FEATURES).agg(F.count("*").cast("double").alias("weight"))


def _thresholds(scored: DataFrame, precision: float, least: int = 20) -> dict[str, float]:
    """For each generator the lowest score from which on the precision holds, halfway to the scores below; bins of a hundredth."""
    bins = scored.groupBy("kind", F.floor(F.col("p") * 100).alias("bin")).agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n"))
    by_kind: dict[str, list] = {}
    for r in bins.orderBy(F.desc("bin")).collect():  # a hundred rows for each generator at most
        by_kind.setdefault(r["kind"], []).append(r)
    out: dict[str, float] = {}
    for kind, rows in by_kind.items():
        good, total = 0.0, 0
        for i, r in enumerate(rows):
            good, total = good + r["good"], total + r["n"]
            if total >= least and good >= precision * total:
                below = (rows[i + 1]["bin"] + 1) / 100 if i + 1 < len(rows) else r["bin"] / 100
                out[kind] = (r["bin"] / 100 + below) / 2
    return out


def find_personal_data(
    docs: DataFrame, precision: float = PRECISION, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, _h (hash of the text), base and added spans as arrays of (start, ord, end, kind)."""
    t = F.col("_t")
    digit = t.rlike("[0-9]")
    plain = lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"])
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).select(
        "_id", F.xxhash64("_t").alias("_h"), base_spans(t, CONTEXT).alias("certain"),
        F.concat(
            match_spans(t, CONTACT, "contact", 4, None, t.contains("@") | t.rlike(rf"{_AT}|_(?i:at)_"), CONTEXT),
            match_spans(t, NUMBER, "number", 5, None, digit, CONTEXT),
        ).alias("proposed"),
    )
    found = materialize(found, "personal_spans").withColumn("base", F.transform("certain", plain))
    none = F.array().cast("array<struct<start:bigint,ord:int,end:bigint,kind:string>>")
    nothing = found.select(F.col("_id").alias(id_col), "_h", "base", none.alias("added"))

    rows = found.filter(F.size("proposed") > 0).select("_id", "_h", "base", F.explode("proposed").alias("c"))
    clear = ~F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start")))
    candidates = materialize(_featured(rows.filter(clear).select("_id", "_h", "c.*").distinct()).drop("m", "before", "after"), "candidates")
    if candidates.isEmpty():
        return nothing

    certain = found.select("_id", "_h", F.explode("certain").alias("c")).select("_h", "c.kind", "c.m", "c.before", "c.after", F.xxhash64("_id", "_h", "c.start", "c.end").alias("h"))
    certain = certain.withColumn("part", F.pmod(F.xxhash64("_h"), F.lit(10)))  # a text is fit on or held out as a whole
    examples = materialize(_weighted(_examples(certain)), "examples")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    sample = assembler.transform(examples)
    fit_part = sample.filter("fit")
    if fit_part.agg(F.count_distinct("label")).first()[0] < 2:
        return nothing
    model = GBTClassifier(maxIter=rounds, maxDepth=4, stepSize=0.3, seed=7, weightCol="weight").fit(fit_part)
    probability = vector_to_array("probability")[1].alias("p")
    limits = _thresholds(model.transform(sample.filter("not fit")).select("kind", "label", "weight", probability), precision)

    limit = F.lit(2.0)
    for kind, value in limits.items():
        limit = F.when(F.col("kind") == kind, value).otherwise(limit)
    chosen = model.transform(assembler.transform(candidates)).select("_id", "_h", "start", "ord", "end", "kind", probability).filter(F.col("p") >= limit)
    spans = chosen.groupBy(F.col("_id").alias("a_id"), F.col("_h").alias("a_h")).agg(F.sort_array(F.collect_list(F.struct("start", "ord", "end", "kind"))).alias("all"))
    contacts = F.filter("all", lambda s: s["kind"] == "contact")
    # a number inside a chosen contact is part of it
    apart = F.filter("all", lambda s: (s["kind"] == "contact") | ~F.exists(contacts, lambda c: (c["start"] < s["end"]) & (c["end"] > s["start"])))
    spans = spans.select("a_id", "a_h", apart.alias("added"))
    return found.join(spans, F.col("_id").eqNullSafe(F.col("a_id")) & (F.col("_h") == F.col("a_h")), "left").select(
        F.col("_id").alias(id_col), "_h", "base", F.coalesce("added", none).alias("added")
    )


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the certain spans, and all spans as text."""

    def count(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    return spans.select(
        F.col(id_col), count("email"), count("ip"), count("card"), count("phone"),
        F.sha2(render(F.col("base"), True), 256).alias("base_sha256"),
        render(F.concat("base", "added"), True).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input with every span of ``text_col`` replaced by its kind in brackets; a null text stays null."""
    found = find_personal_data(docs, id_col=id_col, text_col=text_col, **options)
    marked = found.select(F.col(id_col).alias("_r"), "_h", F.array_sort(F.concat("base", "added")).alias("_spans")).filter(F.size("_spans") > 0)
    marked = materialize(marked.dropDuplicates(["_r", "_h"]), "redactions")
    text = F.col(text_col)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a, s):
        gap = F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(a["parts"], F.array(F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("parts"))
        return F.when(s["start"] >= a["at"], fresh).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["parts"].alias("parts")))

    whole = F.aggregate("_spans", start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"].cast("int") + 1, F.length(text))))
    joined = docs.join(
        marked.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_r")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_h")), "left"
    )
    return joined.select(*(F.when(F.col("_spans").isNotNull(), whole).otherwise(text).alias(c) if c == text_col else docs[c] for c in docs.columns))
