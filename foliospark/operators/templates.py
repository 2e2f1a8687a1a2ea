"""The learned template table: three-tier lookup, learning, hits, ageing, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dictionaries import DOC_TYPE_CATEGORY, lookup
from ..store import materialize

HIT_THRESHOLD, LEARN_THRESHOLD = 0.95, 0.85
HEADER_FACTOR, FUZZY_FACTOR, FUZZY_FLOOR = 0.98, 0.90, 0.90
BOOST, CAP = 0.02, 0.99
MIN_TEXT = 50
TEMPLATE = "id bigint, fingerprint string, header_hash string, company_hint string, country string, doc_type string, doc_category string, company string, confidence double, hit_count bigint, created_at timestamp, last_hit_at timestamp"
GRAM_BLOCK = 2000
_ANSWER = ["id", "fingerprint", "country", "doc_type", "doc_category", "company", "confidence"]


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def _answer(t: DataFrame, name: str, *keys: str) -> DataFrame:
    return t.select(*keys, F.struct(*_ANSWER).alias(name))


def _containing(needles: DataFrame, outer: DataFrame, block: int = GRAM_BLOCK) -> DataFrame:
    """(_hint, _fuzzy): for each needle the best answer among the hints that contain it.

    ``outer`` has one row for each hint, with its best answer. A needle meets hints on its rarest trigram
    among theirs, if they have all of its trigrams; hints of a frequent trigram are dealt out in blocks.
    """
    def grams(c: str) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(F.col(c), i, F.lit(3))))

    index = outer.filter("length(_outer) >= 3").select("*", F.explode(grams("_outer")).alias("_gram"))
    often = index.groupBy("_gram").agg(F.count("*").alias("_k"))
    wanted = needles.filter("length(_hint) >= 3").select("_hint", F.size(grams("_hint")).alias("_all"), F.explode(grams("_hint")).alias("_gram"))
    found = wanted.join(often, "_gram").groupBy("_hint", "_all").agg(F.count("*").alias("_n"), F.min(F.struct("_k", "_gram")).alias("_rare")).filter("_n = _all")
    blocks = F.ceil(F.col("_rare._k") / block).cast("int")
    found = found.select("_hint", F.col("_rare._gram").alias("_gram"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"))
    dealt = index.join(often, "_gram").withColumn("_block", F.pmod(F.xxhash64("_outer"), F.ceil(F.col("_k") / block)).cast("int"))
    pairs = found.join(dealt.select("_gram", "_block", "_outer", "_best", "_rank"), ["_gram", "_block"]).filter(F.contains("_outer", F.col("_hint")))
    return pairs.groupBy("_hint").agg(F.min_by("_best", "_rank").alias("_fuzzy"))


def match_templates(docs: DataFrame, templates: DataFrame, hit_threshold: float = HIT_THRESHOLD, length: str | None = None) -> DataFrame:
    """docs(doc_id, text, fingerprint, header_hash, company_hint) with ``tier`` (exact, header, fuzzy or null) and ``hit``.

    A column ``length`` with the lengths of the texts may stand in their place.

    Exact: equal fingerprint. Header: the most used template of the header, then the threshold.
    Fuzzy: the most used template whose hint contains the document's (ASCII capitals of the template's count
    as small letters), at least 0.90 confident. Distinct combinations of the three keys are looked up, and
    documents take their answer by one join, the only one that texts may go through.
    """
    keys = ["fingerprint", "header_hash", "company_hint"]
    enough = (F.length("text") if length is None else F.col(length)) >= MIN_TEXT
    best = lambda *order: F.min_by(F.struct(*_ANSWER), F.struct(*order))
    kinds = materialize(docs.filter(enough).select(*keys).distinct(), "kinds")  # read twice, and dear to compute
    exact = _answer(templates, "_exact", "fingerprint")
    header = templates.filter("header_hash <> ''").groupBy("header_hash").agg(best(-F.col("hit_count"), "id").alias("_header"))
    # of all kinds: which of them the earlier tiers serve would take those joins a second time
    needles = kinds.filter("length(company_hint) >= 3").select(F.col("company_hint").alias("_hint")).distinct()
    rank = (-F.col("hit_count"), -F.col("confidence"), "id")
    lowered = F.translate("company_hint", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    outer = templates.filter("length(company_hint) >= 3").groupBy(lowered.alias("_outer")).agg(best(*rank).alias("_best"), F.min(F.struct(*rank)).alias("_rank"))
    fuzzy = _containing(needles, outer)
    tiers = kinds.join(exact, "fingerprint", "left").join(header, "header_hash", "left").join(fuzzy, F.col("company_hint") == F.col("_hint"), "left")
    sure = lambda f, least: F.coalesce(F.col(f"{f}.confidence") >= least, F.lit(False))
    tier = F.when(sure("_exact", hit_threshold), "exact").when(sure("_header", hit_threshold), "header").when(sure("_fuzzy", FUZZY_FLOOR), "fuzzy")

    def pick(f: str) -> Column:
        return F.when(F.col("tier") == "exact", F.col(f"_exact.{f}")).when(F.col("tier") == "header", F.col(f"_header.{f}")).otherwise(F.col(f"_fuzzy.{f}"))

    factor = F.when(F.col("tier") == "header", HEADER_FACTOR).when(F.col("tier") == "fuzzy", FUZZY_FACTOR).otherwise(1.0)
    hit = F.struct(*(pick(f).alias(f) for f in _ANSWER if f != "confidence"), (pick("confidence") * factor).alias("confidence"))
    served = tiers.withColumn("tier", tier).filter("tier is not null").select(*(F.col(k).alias(f"_{k}") for k in keys), "tier", hit.alias("hit"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys[1:]]
    met = docs.join(served, (F.col("fingerprint") == F.col("_fingerprint")) & same[0] & same[1] & enough, "left")
    return met.select(*docs.columns, "tier", "hit")


def learn(templates: DataFrame, answers: DataFrame, now: Column, threshold: float = LEARN_THRESHOLD) -> DataFrame:
    """The template table after confident answers, taken in order of doc_id.

    answers: doc_id, fingerprint, header_hash, company_hint, country, doc_type, doc_category, company,
    confidence. A new fingerprint starts with the first answer's fields and confidence; each later one
    raises the confidence by 0.02 up to 0.99. As that cap is reached within fifty answers, a group
    keeps no more of them; counts and the latest category cover all.
    """
    good = answers.filter(F.col("confidence") >= threshold)
    steps = int(CAP / BOOST) + 2
    fields = ["header_hash", "company_hint", "country", "doc_type", "company"]
    early = (
        good.withColumn("_n", F.row_number().over(Window.partitionBy("fingerprint").orderBy("doc_id")))
        .filter(F.col("_n") <= steps)
        .groupBy("fingerprint")
        .agg(F.sort_array(F.collect_list(F.struct("_n", "confidence"))).alias("_early"))
    )
    totals = good.groupBy("fingerprint").agg(
        F.count("*").alias("_k"),
        *(F.min_by(F.struct(F.col(f)), "doc_id")[f].alias(f"_{f}") for f in fields),
        F.max_by("doc_category", F.when(F.col("doc_category").isNotNull(), F.col("doc_id"))).alias("_category"),
    )
    new = totals.join(early, "fingerprint")
    old = templates.select("*", F.lit(True).alias("_old"))
    merged = old.join(new, "fingerprint", "full_outer")
    values = F.coalesce(F.transform("_early", lambda s: s["confidence"]), F.array().cast("array<double>"))
    fresh = F.col("_old").isNull()
    start = F.when(fresh, F.try_element_at(values, F.lit(1))).otherwise(F.col("confidence"))
    later = F.when(fresh, F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))).otherwise(values)
    confidence = F.aggregate(later, start, lambda a, c: F.least(F.greatest(a, c) + BOOST, F.lit(CAP)))
    # ids of new templates come from the fingerprint, so that no task has to number all of them
    made_id = F.pmod(F.xxhash64("fingerprint"), F.lit(2**62)) + 2**32
    confirmed = F.coalesce("_k", F.lit(0)) - F.when(fresh, 1).otherwise(0)
    return merged.select(
        F.when(fresh, made_id).otherwise(F.col("id")).cast("bigint").alias("id"),
        "fingerprint",
        *(F.when(fresh, F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in ["header_hash", "company_hint", "country", "doc_type"]),
        F.coalesce("_category", "doc_category").alias("doc_category"),
        F.when(fresh, F.col("_company")).otherwise(F.col("company")).alias("company"),
        confidence.alias("confidence"),
        (F.coalesce("hit_count", F.lit(0)) + confirmed).cast("bigint").alias("hit_count"),
        F.when(fresh, now).otherwise(F.col("created_at")).alias("created_at"),
        F.when(confirmed > 0, now).otherwise(F.col("last_hit_at")).alias("last_hit_at"),
    )


def record_hits(templates: DataFrame, matched: DataFrame, now: Column) -> DataFrame:
    """Adds the number of documents that each template served to its hit_count."""
    hits = matched.filter("tier is not null").groupBy(F.col("hit.id").alias("id")).agg(F.count("*").alias("_hits"))
    out = templates.join(hits, "id", "left")
    return out.select(
        *(
            (F.col("hit_count") + F.coalesce("_hits", F.lit(0))).alias(c) if c == "hit_count" else F.when(F.col("_hits") > 0, now).otherwise(F.col(c)).alias(c) if c == "last_hit_at" else F.col(c)
            for c in templates.columns
        )
    )


def age_out(templates: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return templates.filter(F.col("created_at") >= now - F.make_interval(days=F.lit(days)))


def template_stats(templates: DataFrame) -> DataFrame:
    return templates.agg(
        F.count("*").alias("total_templates"), F.count_distinct("country").alias("countries"), F.count_distinct("company").alias("companies"),
        F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"),
    )


def hit_rate(matched: DataFrame) -> DataFrame:
    """Queries (texts long enough to be looked up), hits, and hits over queries, 0 without queries."""
    queries = F.count_if(F.length("text") >= MIN_TEXT)
    hits = F.count_if(F.col("tier").isNotNull())
    return matched.agg(queries.alias("total_queries"), hits.alias("total_hits"), F.when(queries > 0, hits / queries).otherwise(0.0).alias("hit_rate"))


def top_templates(templates: DataFrame, n: int = 100) -> DataFrame:
    return templates.orderBy(F.desc("hit_count"), F.asc("id")).limit(n)


def add_category(templates: DataFrame) -> DataFrame:
    """Adds doc_category to a table that lacks it, from doc_type; unknown types are 'other'."""
    if "doc_category" in templates.columns:
        return templates
    return templates.withColumn("doc_category", F.coalesce(lookup(DOC_TYPE_CATEGORY, F.col("doc_type")), F.lit("other")))


def import_templates(templates: DataFrame, given: DataFrame) -> DataFrame:
    """Appends rows whose fingerprint is new; of several such rows one is taken."""
    fresh = _first(given, ["fingerprint"], [F.asc("id")]).join(templates.select("fingerprint"), "fingerprint", "left_anti")
    return templates.unionByName(fresh, allowMissingColumns=True)
