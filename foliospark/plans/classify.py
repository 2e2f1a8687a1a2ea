"""The cascade: template table, responder, normalisation, guard, learning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guard as checks
from ..functions.binding import bind
from ..functions.responses import parse_response
from ..functions.text import trim, with_fingerprint
from ..operators.progress import error_message
from ..operators.templates import HIT_THRESHOLD, LEARN_THRESHOLD, MIN_TEXT, learn, match_templates
from ..store import materialize

MIN_STRIPPED = 20
PARTIAL_FACTOR = 0.9
RESULT = [
    "doc_id", "country", "country_confidence", "doc_type", "doc_type_confidence", "doc_category", "company", "year", "source", "needs_llm", "is_valid",
    "validation_errors", "validation_warnings", "raw_llm_response", "confidence",
]

KEYS = ["fingerprint", "header_hash", "company_hint"]
#: What a lookup did to the counters of the template table: the tier that passed, its template, and whether it was a query at all.
USE = ["tier", "template", "queried"]
#: What learning reads of results.
LEARNED = ["doc_id", *KEYS, "country", "country_confidence", "doc_type", "doc_category", "company", "source", "is_valid", "confidence"]


def row_confidence(a: Column, b: Column) -> Column:
    """The smaller of the positive confidences, 0 without any."""
    return F.coalesce(F.least(F.when(a > 0, a), F.when(b > 0, b)), F.lit(0.0))


def can_use_llm(hour: Column, minute: Column, start: int = 23 * 60, end: int = 6 * 60, force: bool | Column = False) -> Column:
    """Whether models may be asked: if forced, or at a time in the half-open night window, which may span midnight."""
    at = hour * 60 + minute
    night = (at >= start) & (at < end) if start <= end else (at >= start) | (at < end)
    return F.coalesce(force if isinstance(force, Column) else F.lit(force), F.lit(False)) | night


#: Adds a column raw_response to its rows, all of which it returns: an answer where ``ask_text`` is not null. It
#: may add response_error: why there is none, "All LLM servers are DEAD" if nobody was left to ask.
Responder = Callable[[DataFrame], DataFrame]


def keyed(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs with the keys of the template table and what a lookup must know of their texts.

    Without the texts the rows are small and written, as a lookup reads them twice and joins them.
    """
    stripped = F.length(trim(F.coalesce("text", F.lit("")))) < MIN_STRIPPED
    out = with_fingerprint(docs).drop("structure").withColumns({"_stripped": stripped, "_length": F.length("text")})
    return out if keep_text else materialize(out.drop("text"), "keys")


def classify(docs: DataFrame, templates: DataFrame, responder: Responder | None, hit_threshold: float = HIT_THRESHOLD, guard: bool = True, gate: bool = True) -> DataFrame:
    """docs(doc_id, text), or with the columns of ``keyed``, to results; every lookup sees the template table as it was before.

    Each document is one row from the lookup on: template answers, answers of the responder and texts
    set aside differ by column values, so texts are read and joined once. Without a responder misses keep
    a partial answer of the template table at 0.9 of its confidence, or are marked needs_llm. ``gate``
    sets texts of fewer than 20 characters aside. A lookup that a tier answers is a hit of its template,
    also if the threshold of the cascade then turns the answer down.
    """
    asks = responder is not None
    prints = docs if "_length" in docs.columns else keyed(docs.select("doc_id", "text"), asks)
    matched = match_templates(prints, templates, min(hit_threshold, HIT_THRESHOLD), "_length")
    matched = matched.withColumn("_short", F.col("_stripped") if gate else F.lit(False))
    matched = matched.withColumns({"tier": F.when(~F.col("_short"), F.col("tier")), "_served": F.when(~F.col("_short"), F.col("hit.fingerprint"))})
    accepted = ~F.col("_short") & (F.coalesce("hit.confidence", F.lit(0.0)) >= hit_threshold)
    ask = ~F.col("_short") & ~F.col("_hit")
    rows = matched.withColumn("_hit", accepted).withColumn("ask_text", F.when(ask, F.col("text")) if asks else F.lit(None).cast("string"))
    text_array = F.array().cast("array<string>")
    if responder is None:
        partial = ask & F.col("hit").isNotNull()
        found = {"hit": F.when(F.col("_hit") | partial, F.col("hit"))}
        factor = F.when(F.col("_hit"), 1.0).otherwise(PARTIAL_FACTOR)
        source = F.when(F.col("_hit"), "template_cache").when(partial, "template_cache_partial").otherwise("no_match")
        rows = rows.withColumns({"source": source, "raw_response": F.lit(None).cast("string"), **found})
    else:
        factor = F.lit(1.0)
        source = F.when(F.col("_hit"), "template_cache").when(F.col("_short"), "no_match").otherwise("llm")
        rows = responder(rows.withColumns({"source": source, "hit": F.when(F.col("_hit"), F.col("hit"))}))
    if "response_error" not in rows.columns:
        rows = rows.withColumn("response_error", F.lit(None).cast("string"))
    rows = bind(rows, a=parse_response(F.col("raw_response"), F.col("ask_text")))
    rows = bind(rows, g=checks.check(F.col("a.country"), F.col("a.company"), F.col("a.year"), F.col("ask_text")))
    llm = F.col("source") == "llm"
    conf = F.coalesce(F.col("hit.confidence") * factor, F.lit(0.0))
    penalty = F.col("g.penalty") if guard else F.lit(0.0)

    def either(f: str) -> Column:
        return F.when(llm, F.col(f"a.{f}")).otherwise(F.col(f"hit.{f}"))

    def sure(f: str) -> Column:
        return F.when(llm, F.greatest(F.lit(0.0), F.col(f"a.{f}_confidence") - penalty)).when(F.col(f"hit.{f}").isNotNull(), conf).otherwise(0.0)

    said = F.concat("a.errors", "g.errors") if guard else F.col("a.errors")
    answered = F.col("response_error").isNull() & F.col("a.is_valid") & (F.col("g.is_valid") if guard else F.lit(True))
    out = rows.select(
        "doc_id", either("country").alias("country"), sure("country").alias("country_confidence"), either("doc_type").alias("doc_type"),
        sure("doc_type").alias("doc_type_confidence"), either("doc_category").alias("doc_category"), either("company").alias("company"),
        F.when(llm, F.col("a.year")).alias("year"), "source", (~F.col("_hit") & ~F.col("_short") & F.lit(responder is None)).alias("needs_llm"),
        F.when(llm, answered).otherwise(F.col("hit").isNotNull()).alias("is_valid"),
        F.when(llm & F.col("response_error").isNotNull(), F.array("response_error")).when(llm, said).when(F.col("_short"), F.array(F.lit("Text too short"))).otherwise(text_array).alias("validation_errors"),
        F.when(llm & F.lit(guard), F.col("g.warnings")).otherwise(text_array).alias("validation_warnings"),
        F.when(llm, F.col("raw_response")).alias("raw_llm_response"), *KEYS, "tier", F.col("_served").alias("template"), (~F.col("_short") & (F.col("_length") >= MIN_TEXT)).alias("queried"),
    )
    out = out.withColumn("confidence", row_confidence(F.col("country_confidence"), F.col("doc_type_confidence")))
    return out.select(*RESULT, *KEYS, *USE)


ROUTE_CONFIDENCE = 0.7
ALL_DEAD = "All LLM servers are DEAD"


def route(results: DataFrame, cache_only: bool = False, min_confidence: float = ROUTE_CONFIDENCE) -> DataFrame:
    """Results of ``classify`` with the status of a batch run and its message.

    Too short a text is an error. In a run on the cache alone, what it does not answer waits as
    ``pending_llm``, and so does what found no living server. Valid results of enough confidence are ok,
    others errors with reasons and confidence.
    """
    short = (F.col("source") == "no_match") & F.array_contains("validation_errors", "Text too short")
    waits = F.lit(cache_only) & (F.col("source") == "no_match") & ~short
    sure = F.coalesce("is_valid", F.lit(False)) & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    dead = F.coalesce(F.contains(F.try_element_at("validation_errors", F.lit(1)), F.lit(ALL_DEAD)), F.lit(False)) & ~F.coalesce("is_valid", F.lit(False))
    status = F.when(short, "error").when(waits | dead, "pending_llm").when(sure, "ok").otherwise("error")
    reason = error_message(F.coalesce("validation_errors", F.array().cast("array<string>")), F.coalesce("confidence", F.lit(0.0)))
    message = F.when(short, "Empty or too short text").when(waits, "No cache match (cache-only mode)").when(dead, "All servers dead").when(~sure, reason)
    return results.withColumns({"status": status, "error_msg": message})


def learn_from(templates: DataFrame, results: DataFrame, now: Column, threshold: float = LEARN_THRESHOLD) -> DataFrame:
    """The template table after the valid, confident answers of a batch."""
    good = results.filter((F.col("source") == "llm") & F.col("is_valid") & (F.col("confidence") >= threshold))
    fields = ["doc_id", "fingerprint", "header_hash", "company_hint", "country", "doc_type", "doc_category", "company"]
    return learn(templates, good.select(*fields, F.col("country_confidence").alias("confidence")), now, threshold)


class ModeError(RuntimeError):
    """A batch that needs a model at a time when none may be asked."""


def classify_batch(
    docs: DataFrame, templates: DataFrame, responder: Responder, now: Column, may_ask: bool = True, hit_threshold: float = HIT_THRESHOLD, guard: bool = True, threshold: float = LEARN_THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """(results in order of doc_id, templates afterwards): lookups against the table as it was, answers for the misses, then learning.

    Raises ModeError if models may not be asked now (see ``can_use_llm``). Short texts are not set aside here.
    """
    if not may_ask:
        raise ModeError("models may be asked at night or when forced")
    results = materialize(classify(docs, templates, responder, hit_threshold, guard, gate=False), "results")
    return results.orderBy("doc_id"), learn_from(templates, results, now, threshold)
