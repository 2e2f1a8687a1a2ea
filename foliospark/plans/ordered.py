"""The cascade with learning between the documents of a batch, in order of their ids.

Documents of one fingerprint depend on one another: each asks the model until the answers before it have
made its template sure enough, and all that follow are served by it. So the documents that the table does
not serve at the start are ranked within their fingerprint, and windows of ranks that double in length are
asked until each fingerprint is decided; an answer asked too early is dropped. As a template is sure within
some fifty good answers, the fold over them is short, however many documents share a fingerprint. Lookups
by header and by hint see the table as it was before the batch, and texts too short for a lookup are asked
at once and teach at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import running_sum
from ..operators.templates import BOOST, CAP, HIT_THRESHOLD, LEARN_THRESHOLD, TEMPLATE, record_hits
from ..store import materialize
from .classify import RESULT, Responder, classify, learn_from

STEPS = int(CAP / BOOST) + 2


def _decided(good: DataFrame, templates: DataFrame, hit_threshold: float) -> DataFrame:
    """(fingerprint, sure_at, confidence): the rank of the answer after which a template serves, and what it is worth then."""
    first = running_sum(good, ["fingerprint"], ["rank"], "_n").filter(F.col("_n") <= STEPS)
    listed = first.groupBy("fingerprint").agg(F.sort_array(F.collect_list(F.struct("rank", "country_confidence"))).alias("_answers"))
    held = listed.join(templates.select("fingerprint", F.col("confidence").alias("_held")), "fingerprint", "left")

    def step(a: Column, x: Column) -> Column:
        raised = F.least(F.greatest(a["c"], x["country_confidence"]) + BOOST, F.lit(CAP))
        c = F.when(a["at"].isNotNull(), a["c"]).when(a["c"].isNull(), x["country_confidence"]).otherwise(raised)
        return F.struct(c.alias("c"), F.coalesce(a["at"], F.when(c >= hit_threshold, x["rank"])).alias("at"))

    start = F.struct(F.col("_held").alias("c"), F.lit(None).cast("bigint").alias("at"))
    folded = held.withColumn("_s", F.aggregate("_answers", start, step))
    return folded.filter("_s.at is not null").select("fingerprint", F.col("_s.at").alias("sure_at"), F.col("_s.c").alias("_confidence"))


def classify_in_order(
    docs: DataFrame, templates: DataFrame, responder: Responder, now: Column, hit_threshold: float = HIT_THRESHOLD, guard: bool = True, gate: bool = True, window: int = 1,
    learn_threshold: float = LEARN_THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """(results, templates afterwards) of docs(doc_id, text) taken one after another; results have the columns RESULT and the fingerprint.

    ``window`` is the number of documents of each fingerprint that are asked first. A responder answers a
    document by its row alone, and may be asked for up to twice as many as count.
    """
    spark = docs.sparkSession
    nothing = spark.createDataFrame([], TEMPLATE)
    start = materialize(classify(docs, templates, None, hit_threshold, guard, gate), "start")
    served = start.filter("not needs_llm")
    missed = materialize(running_sum(start.filter("needs_llm and queried").select("doc_id", "fingerprint"), ["fingerprint"], ["doc_id"], "rank"), "missed")
    deepest = missed.agg(F.max("rank")).first()[0] or 0
    brief = docs.join(start.filter("needs_llm and not queried").select("doc_id"), "doc_id").select("doc_id", "text")
    asked = materialize(classify(brief, nothing, responder, hit_threshold, guard, False).withColumn("rank", F.lit(None).cast("bigint")), "brief")
    sure, low, high = None, 0, window
    while low < deepest:
        due = missed.filter((F.col("rank") > low) & (F.col("rank") <= high))
        if sure is not None:
            due = due.join(sure.select("fingerprint"), "fingerprint", "left_anti")
        if due.isEmpty():  # ranks have no gaps, so nothing is left open
            break
        texts = docs.join(due.select("doc_id", "rank"), "doc_id")
        answers = classify(texts.select("doc_id", "text"), nothing, responder, hit_threshold, guard, False)
        answers = materialize(answers.join(due.select("doc_id", "rank"), "doc_id"), "answers")
        asked = asked.unionByName(answers)
        good = asked.filter("is_valid and rank is not null").filter((F.col("confidence") >= learn_threshold) & (F.col("country_confidence") >= learn_threshold))
        sure = materialize(_decided(good.select("fingerprint", "rank", "country_confidence"), templates, hit_threshold), "sure")
        low, high = high, high * 2 + 1
    if sure is None:
        after = materialize(learn_from(templates, asked, now, learn_threshold), "templates")
        return served.select(*RESULT, "fingerprint").unionByName(asked.select(*RESULT, "fingerprint")), record_hits(after, _hits(served.filter("tier is not null"), after), now)
    kept = asked.join(sure, "fingerprint", "left").filter("sure_at is null or rank is null or rank <= sure_at")
    after = materialize(learn_from(templates, kept, now, learn_threshold), "templates")
    later = missed.join(sure, "fingerprint").filter("rank > sure_at").join(after.select("fingerprint", "country", "doc_type", "doc_category", "company"), "fingerprint")
    none, empty = F.lit(None), F.array().cast("array<string>")
    worth = lambda f: F.when(F.col(f).isNotNull(), F.col("_confidence")).otherwise(0.0)
    filled = later.withColumns({
        "country_confidence": worth("country"), "doc_type_confidence": worth("doc_type"), "year": none.cast("int"), "source": F.lit("template_cache"), "needs_llm": F.lit(False),
        "is_valid": F.lit(True), "validation_errors": empty, "validation_warnings": empty, "raw_llm_response": none.cast("string"), "confidence": F.col("_confidence"),
    })
    results = served.select(*RESULT, "fingerprint").unionByName(kept.select(*RESULT, "fingerprint")).unionByName(filled.select(*RESULT, "fingerprint"))
    hits = _hits(start.filter("tier is not null and not needs_llm"), after).unionByName(_hits(later.withColumn("template", F.col("fingerprint")), after))
    return results, record_hits(after, hits, now)


def _hits(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Hits as ``record_hits`` counts them: a tier and the struct of a template's id."""
    ids = templates.select(F.col("fingerprint").alias("template"), "id")
    return rows.select("template").join(ids, "template").select(F.lit("exact").alias("tier"), F.struct("id").alias("hit"))
