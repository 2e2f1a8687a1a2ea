"""Reports: counts, shares, endpoint comparison, golden scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dictionaries import SUSPICIOUS_PATTERNS
from .ranking import running_sum


def count_by(df: DataFrame, key: str, missing: str | None = None, limit: int | None = None, share: bool = False, bar: bool = False, cut: int | None = None) -> DataFrame:
    """Counts by a column, largest first, then by key. Nulls are left out, or counted as ``missing``.

    ``share`` adds each count's part of all counted rows, also of those beyond ``limit``, ``bar`` a mark for every two percent,
    and ``cut`` the name as shown, cut after so many characters.
    """
    rows = df.withColumn(key, F.coalesce(F.col(key), F.lit(missing))) if missing else df.filter(F.col(key).isNotNull())
    out = rows.groupBy(key).agg(F.count("*").alias("n"))
    if share or bar:
        out = out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    if bar:
        out = out.withColumn("bar", F.repeat(F.lit("#"), F.floor(F.col("share") * 100 / 2).cast("int")))
    if cut:
        out = out.withColumn("shown", shortened(F.col(key), cut))
    out = out.orderBy(F.desc("n"), F.asc(key))
    return out.limit(limit) if limit else out


def organize_summary(results: DataFrame) -> DataFrame:
    """One row: how many files ended in each status."""
    one = lambda s: F.count_if(F.col("status") == s)
    return results.agg(F.count("*").alias("total_files"), one("success").alias("successful"), one("trash").alias("moved_to_trash"), one("skipped").alias("skipped"), one("error").alias("errors"))


def endpoint_stats(responses: DataFrame) -> DataFrame:
    """responses(endpoint, elapsed, tokens, error): counts, times, tokens a second, success rate."""
    ok = F.col("error").isNull()
    good = F.when(ok, F.col("elapsed"))
    n = F.count("*")
    return responses.groupBy("endpoint").agg(
        n.alias("requests"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(good), F.lit(0.0)).alias("total_time"),
        F.min(good).alias("min_time"), F.max(good).alias("max_time"), F.avg(good).alias("avg_time"),
        F.when(F.sum(good) > 0, F.sum(F.when(ok, F.col("tokens"))) / F.sum(good)).otherwise(0.0).alias("tokens_per_sec"),
        (F.count_if(ok) / n).alias("success_rate"), F.coalesce(F.sum(F.when(ok, F.col("tokens"))), F.lit(0)).alias("total_tokens"),
    )


def host_ranking(stats: DataFrame, host: Column) -> DataFrame:
    """Endpoint statistics by host with its endpoints (in order), the fastest first."""
    time = F.sum("total_time")
    return (
        stats.groupBy(host.alias("host"))
        .agg(
            F.sum("requests").alias("requests"), F.sum("successful").alias("successful"), F.count("*").alias("endpoints"),
            F.when(time > 0, F.sum("total_tokens") / time).otherwise(0.0).alias("tokens_per_sec"), F.array_sort(F.collect_list("endpoint")).alias("ports"),
        )
        .orderBy(F.desc("tokens_per_sec"), "host")
    )


def host_speed(responses: DataFrame, host: Column) -> DataFrame:
    """Average time and tokens a second of each host's responses without an error."""
    total = F.sum("elapsed")
    rate = F.when(total > 0, F.sum("tokens") / total).otherwise(0.0)
    return responses.filter("error is null").groupBy(host.alias("host")).agg(F.avg("elapsed").alias("avg_time"), rate.alias("tokens_per_sec")).orderBy("host")


def requests_for(files: DataFrame, hosts: list[str], ports: list[int]) -> DataFrame:
    """One request for each file and endpoint; endpoints are all hosts with all ports, a list of the caller's."""
    endpoints = F.array(*(F.lit(f"http://{h}:{p}") for h in hosts for p in ports))
    return files.withColumn("endpoint", F.explode(endpoints))


def token_count(tokens: Column, text: Column) -> Column:
    """The reported number of tokens, or the number of words where none is reported."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.coalesce(F.when(tokens > 0, tokens), words.cast("long"))


def endpoint_status(alive: Column, dead: Column) -> Column:
    """DEAD for an endpoint given up, else OK or DOWN by its last probe."""
    return F.when(F.coalesce(dead, F.lit(False)), "DEAD").when(F.coalesce(alive, F.lit(False)), "OK").otherwise("DOWN")


def session_counters(results: DataFrame, elapsed: float, total: int) -> DataFrame:
    """One row: processed, cache hits, model calls, errors, files a second, seconds left.

    Here every success that the cache did not serve whole counts as a model call, partial answers too; the statistics of runs count neither.
    """
    ok = F.col("status") == "ok"
    hit = ok & (F.col("source") == "template_cache")
    done = results.filter("status <> 'pending_llm'").agg(
        F.count("*").alias("processed"), F.count_if(hit).alias("cache_hits"), F.count_if(ok & (F.col("source") != "template_cache")).alias("llm_calls"), F.count_if(F.col("status") == "error").alias("errors")
    )
    rate = F.col("processed") / F.lit(float(elapsed))
    return done.withColumns({"files_per_sec": rate, "seconds_left": F.when(rate > 0, F.floor((F.lit(total) - F.col("processed")) / rate))})


def vision_name(name: Column, is_country: bool = False) -> Column:
    """A part of a path: trimmed, a country with capitals, blanks as underscores, forbidden characters left out."""
    n = F.trim(name)
    n = F.initcap(n) if is_country else n
    return F.coalesce(F.nullif(F.regexp_replace(F.replace(n, F.lit(" "), F.lit("_")), r'[<>:"/\\|?*]', ""), F.lit("")), F.lit("unknown"))


def vision_folder(results: DataFrame) -> DataFrame:
    """results(error, warning, country, document_type) with ``folder``: _errors, _unknown, or country/type."""
    path = F.concat_ws("/", vision_name(F.coalesce("country", F.lit("unknown")), True), vision_name(F.coalesce("document_type", F.lit("unknown"))))
    doubtful = (F.coalesce("document_type", F.lit("")) == "not_a_document") | (F.coalesce("warning", F.lit("")) != "")
    return results.withColumn("folder", F.when(F.col("error").isNotNull(), "_errors").when(doubtful, "_unknown").otherwise(path))


def vision_counts(results: DataFrame) -> DataFrame:
    """Counts by country/type of results without an error, sorted."""
    key = F.concat_ws("/", F.coalesce("country", F.lit("?")), F.coalesce("document_type", F.lit("?")))
    return results.filter("error is null").groupBy(key.alias("key")).agg(F.count("*").alias("n")).orderBy("key")


def notebook_counts(results: DataFrame, key: str, missing: str) -> DataFrame:
    """Counts by a field of JSON results: ``missing`` where the key is absent, null where it is there and null."""
    v = F.try_parse_json("result")
    present = F.array_contains(F.coalesce(F.json_object_keys("result"), F.array().cast("array<string>")), key)
    value = F.when(present, F.try_variant_get(v, f"$.{key}", "string")).otherwise(F.lit(missing))
    return results.groupBy(value.alias(key)).agg(F.count("*").alias("n"))


def consistency(responses: DataFrame) -> DataFrame:
    """Per file, whether the endpoints that answered agree on each field; of two company names one may contain the other."""
    norm = lambda c: F.trim(F.lower(F.coalesce(F.col(c), F.lit(""))))
    seen = lambda c: F.sort_array(F.collect_set(c))
    out = responses.filter("error is null").groupBy("pdf_file").agg(
        F.count("*").alias("answers"), seen(norm("country")).alias("countries"), seen(norm("doc_type")).alias("doc_types"),
        seen(norm("company")).alias("companies"), F.count_distinct(F.coalesce(F.col("year").cast("string"), F.lit(""))).alias("years"),
    )
    c = F.col("companies")
    near = (F.size(c) == 2) & (F.contains(F.get(c, F.lit(0)), F.get(c, F.lit(1))) | F.contains(F.get(c, F.lit(1)), F.get(c, F.lit(0))))
    agree = {"same_country": F.size("countries") == 1, "same_doc_type": F.size("doc_types") == 1, "same_company": (F.size(c) == 1) | F.coalesce(near, F.lit(False)), "same_year": F.col("years") == 1}
    out = out.withColumns(agree)
    return out.select("pdf_file", "answers", *agree, (F.col("same_country") & F.col("same_doc_type") & F.col("same_company") & F.col("same_year")).alias("consistent"))


def golden_score(df: DataFrame, fields: list[str]) -> DataFrame:
    """Fields that equal their expected_<field>, case aside; a company passes if either contains the other."""
    low = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    hit = [F.contains(low(f), low(f"expected_{f}")) if f == "company" else low(f) == low(f"expected_{f}") for f in fields]
    return df.withColumns({"passed": sum((h.cast("int") for h in hit), F.lit(0)), "total": F.lit(len(fields))})


def spread(df: DataFrame, key: str, endpoints: list[str]) -> DataFrame:
    """A deterministic spread of rows over endpoints by hash of the key."""
    return df.withColumn("endpoint", _one_of(endpoints, F.xxhash64(key)))


def round_robin(df: DataFrame, key: str, endpoints: list[str]) -> DataFrame:
    """Endpoints in turn, in order of a key (null first); rows of equal key take turns by their content."""
    nth = running_sum(df, [], [F.asc_nulls_first(key), F.xxhash64(*df.columns)], "_nth")
    return nth.withColumn("endpoint", _one_of(endpoints, F.col("_nth") - 1)).drop("_nth")


def _one_of(endpoints: list[str], turn: Column) -> Column:
    return F.element_at(F.array(*(F.lit(e) for e in endpoints)), F.pmod(turn, F.lit(len(endpoints))).cast("int") + 1)


def suspicious(value: Column, patterns: list[str] = SUSPICIOUS_PATTERNS) -> Column:
    """Whether a value holds one of the patterns, case aside."""
    found, low = F.lit(False), F.lower(F.coalesce(value, F.lit("")))
    for p in patterns:
        found = found | F.contains(low, F.lit(p))
    return found


def mark_suspicious(results: DataFrame, fields: list[str]) -> DataFrame:
    """results(error, ...) with ``warning``: suspicious_data where one of the fields looks invented, kept otherwise."""
    found = F.lit(False)
    for f in fields:
        found = found | suspicious(F.col(f))
    kept = F.col("warning") if "warning" in results.columns else F.lit(None).cast("string")
    return results.withColumn("warning", F.when(F.col("error").isNull() & found, "suspicious_data").otherwise(kept))


def shortened(name: Column, length: int) -> Column:
    """A name cut after some characters, with dots where it went on."""
    return F.when(F.length(name) > length, F.concat(F.substring(name, 1, length), F.lit("..."))).otherwise(name)


def probed(endpoints: DataFrame, probes: DataFrame) -> DataFrame:
    """endpoints(endpoint) with the status of its latest probe in probes(endpoint, at, ok): available or not, null if never asked."""
    last = probes.groupBy("endpoint").agg(F.max_by("ok", "at").alias("available"), F.max("at").alias("probed_at"), F.count("*").alias("probes"))
    return endpoints.join(last, "endpoint", "left")
