"""Learning between documents against a loop over them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions.text import with_fingerprint
from foliospark.operators import templates as T
from foliospark.plans.classify import ModeError, classify, classify_batch
from foliospark.plans.ordered import classify_in_order


def letter(kind, i):
    """Texts of one kind share a fingerprint; some of them get no answer, or one without a country."""
    name = "".join(chr(97 + (kind // 26**k) % 26) for k in range(2))
    return f"The {name} letter of number {i % 9} says germany gmbh and goes on a little\n{'good' if i % 5 else 'poor'}"


def responder(rows):
    poor = F.when(F.pmod(F.length("ask_text") + F.ascii(F.reverse("ask_text")), F.lit(7)) == 0, "no answer")
    answer = F.coalesce(poor, F.concat(F.lit('{"country": "germany", "doc_type": "invoice", "company": "'), F.substring("ask_text", 1, 6), F.lit('"}')))
    return rows.withColumn("raw_response", F.when(F.col("ask_text").isNotNull(), answer))


def loop(spark, docs, threshold, known):
    """One document after another: exact lookup, else ask and learn."""
    answers = {r["doc_id"]: r for r in classify(docs, spark.createDataFrame([], T.TEMPLATE), responder, gate=False).collect()}
    table = {t["fingerprint"]: [t["confidence"], t["hit_count"], t["country"], t["company"]] for t in known}
    out = {}
    for r in with_fingerprint(docs).orderBy("doc_id").collect():
        i, f = r["doc_id"], r["fingerprint"]
        if len((r["text"] or "").strip()) < 20:
            out[i] = ("no_match", None, 0.0)
            continue
        t = table.get(f)
        if t and len(r["text"]) >= T.MIN_TEXT and t[0] >= threshold:
            t[1] += 1
            out[i] = ("template_cache", t[2], round(t[0], 9))
            continue
        a = answers[i]
        out[i] = ("llm", a["country"], round(a["confidence"], 9))
        if a["is_valid"] and a["confidence"] >= 0.8 and a["country_confidence"] >= 0.8:
            if t:
                t[0], t[1] = min(max(t[0], a["country_confidence"]) + 0.02, 0.99), t[1] + 1
            else:
                table[f] = [a["country_confidence"], 0, a["country"], a["company"]]
    return out, {f: (round(t[0], 9), t[1]) for f, t in table.items()}


@pytest.mark.parametrize("threshold, window", [(0.84, 1), (0.93, 1), (0.93, 8), (0.985, 3)])
def test_later_documents_hit(spark, threshold, window):
    r = random.Random(threshold)
    rows = [(i, letter(r.choice([0, 0, 0, 1, 2, 3 + i % 40]), i)) for i in range(300)] + [(1000, "short"), (1001, None), (1002, "brief germany gmbh of one"), (1003, "brief germany gmbh of one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = with_fingerprint(docs.filter("doc_id in (1, 7)")).select("fingerprint", "header_hash").distinct()
    known = seen.selectExpr("1L as id", "fingerprint", "'' as header_hash", "cast(null as string) as company_hint", "'france' as country", "'invoice' as doc_type", "'financial' as doc_category",
                            "'x' as company", "0.80D as confidence", "3L as hit_count", "timestamp '2024-01-01' as created_at", "cast(null as timestamp) as last_hit_at").limit(1)
    known = spark.createDataFrame(known.collect(), T.TEMPLATE)
    want, table = loop(spark, docs, threshold, [t.asDict() for t in known.collect()])
    results, after = classify_in_order(docs, known, responder, F.lit("2024-06-01").cast("timestamp"), threshold, window=window, learn_threshold=0.8)
    got = {x["doc_id"]: (x["source"], x["country"], round(x["confidence"], 9)) for x in results.collect()}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {} and set(got) == set(want)
    assert {x["fingerprint"]: (round(x["confidence"], 9), x["hit_count"]) for x in after.collect()} == table
    assert {s for s, *_ in got.values()} >= {"llm", "no_match"} and (threshold > 0.98 or sum(s == "template_cache" for s, *_ in got.values()) > 50)


def test_a_batch_in_its_order(spark):
    docs = spark.createDataFrame([(i, letter(i % 3, 1)) for i in (9, 2, 7, 4, 0)] + [(5, "short")], "doc_id long, text string").repartition(4)
    nothing, now = spark.createDataFrame([], T.TEMPLATE), F.lit("2024-06-01").cast("timestamp")
    results, after = classify_batch(docs, nothing, responder, now, threshold=0.8)
    assert [r["doc_id"] for r in results.collect()] == [0, 2, 4, 5, 7, 9] and {r["source"] for r in results.collect()} == {"llm"}
    # every lookup saw the table as it was, so all were asked, and equal fingerprints confirmed one another
    assert after.count() < 5 and after.agg(F.sum("hit_count")).first()[0] > 0
    with pytest.raises(ModeError):
        classify_batch(docs, nothing, responder, now, may_ask=False)


def test_without_misses(spark):
    docs = spark.createDataFrame([(1, "short")], "doc_id long, text string")
    results, after = classify_in_order(docs, spark.createDataFrame([], T.TEMPLATE), responder, F.current_timestamp())
    assert results.count() == 1 and after.count() == 0
