"""Inputs that the tables lack, built alike here and in the SQL of the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import with_fingerprint


PER_TASK = 32 << 20


def spread(df: DataFrame, key: str, per_task: int = PER_TASK) -> DataFrame:
    """Rows of a table dealt out to all cores by its key, for work that costs more than moving them.

    A file of one row group is read by one task however large it is, and what follows would stay there. Tables of
    two files for each core have tasks enough and are left as they are; others get a task for ``per_task`` bytes,
    by their files, and one for each core at least.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= 2 * cores:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(cores, -(-size // per_task)), key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(read, "doc_id") if name == "documents" else read


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, filename, text of one invoice for each order."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    o = spread(o, "o_orderkey")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    text = F.concat(
        F.col("n_name"), F.lit(" "), F.col("c_mktsegment"), F.lit(" GMBH\nInvoice No: INV-"), F.col("o_orderkey").cast("string"),
        F.lit("\nDate: "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit("\nVAT: DE"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"),
        F.lit("\nIBAN DE"), F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"), F.lpad(F.col("o_custkey").cast("string"), 18, "0"),
        F.lit("\nTotal: "), F.floor("o_totalprice").cast("string"), F.lit(".50 "), F.when(F.col("o_orderkey") % 3 == 0, "PLN").otherwise("EUR"), F.lit("\n"),
    )
    return rows.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("inv"), F.col("o_orderkey") % 50, F.lit(".pdf")).alias("filename"), text.alias("text"), "n_name", "c_mktsegment", "o_custkey", "o_totalprice", "o_orderdate")


INVOICES = """invoices AS (
  SELECT o_orderkey AS doc_id, concat('inv', o_orderkey % 50, '.pdf') AS filename,
         concat(n_name, ' ', c_mktsegment, ' GMBH', chr(10), 'Invoice No: INV-', o_orderkey, chr(10), 'Date: ', strftime(o_orderdate, '%d.%m.%Y'), chr(10),
                'VAT: DE', lpad(o_custkey::VARCHAR, 9, '0'), chr(10), 'IBAN DE', lpad((o_orderkey % 97)::VARCHAR, 2, '0'), lpad(o_custkey::VARCHAR, 18, '0'), chr(10),
                'Total: ', floor(o_totalprice)::BIGINT, '.50 ', CASE WHEN o_orderkey % 3 = 0 THEN 'PLN' ELSE 'EUR' END, chr(10)) AS text,
         n_name, c_mktsegment, o_custkey, o_totalprice, o_orderdate
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def dated_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with further dates: twenty years on, once or twice, in two digits, and a year later."""
    k, year = F.col("doc_id"), F.year("o_orderdate") + 20
    more = F.concat(
        F.lit("Due: 01.02."), year, F.when(k % 3 == 0, F.concat(F.lit("\nPaid: 3/4/"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))).otherwise(""),
        F.when(k % 4 == 0, F.concat(F.lit("\nAgain: 5-6-"), year + 1)).otherwise(""), F.lit("\n"),
    )
    return invoices(spark, sf_dir).withColumn("text", F.concat("text", F.when(k % 7 == 0, "").otherwise(more)))


DATED = f"""{INVOICES}, dated AS (
  SELECT doc_id, concat(text, CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('Due: 01.02.', year(o_orderdate) + 20, chr(10)) END) AS text,
         CASE WHEN doc_id % 7 = 0 THEN [year(o_orderdate)] ELSE list_concat([year(o_orderdate), year(o_orderdate) + 20],
           CASE WHEN doc_id % 3 = 0 THEN [year(o_orderdate) + 21] ELSE [] END, CASE WHEN doc_id % 4 = 0 THEN [year(o_orderdate) + 21] ELSE [] END) END AS found
  FROM invoices)"""


def evidence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with a VAT number, IBAN, BIC and currency that agree, disagree or are missing."""
    k = F.col("o_orderkey")
    one = lambda n, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (k % n + 1).cast("int"))
    parts = [
        one(5, "VAT: DE123456789\n", "VAT: FR12345678901\n", "VAT: PL1234567890\n", "", ""), one(4, "IBAN DE89370400440532013000\n", "IBAN FR7630006000011234567890189\n", "IBAN NL91ABNA0417164300\n", ""),
        one(3, "BIC COBADEFF\n", "BIC BNPAFRPP\n", ""), one(7, "Total: 12.50 EUR\n", "Total: 12.50 PLN\n", "Total: 12.50 GBP\n", "Total: 12.50 USD\n", "", "Total: 12.50 CHF\n", ""),
    ]
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select(k.alias("doc_id"), F.concat(F.lit("letter "), *parts).alias("text"))


EVIDENCE = """evidence AS (
  SELECT o_orderkey AS doc_id, ['germany', 'france', 'poland', NULL, NULL][o_orderkey % 5 + 1] AS vat_country, ['germany', 'france', 'netherlands', NULL][o_orderkey % 4 + 1] AS iban_country,
         ['germany', 'france', NULL][o_orderkey % 3 + 1] AS bic_country, [NULL, 'poland', 'uk', NULL, NULL, 'switzerland', NULL][o_orderkey % 7 + 1] AS money_country,
         [NULL, 0.95, 0.90, NULL, NULL, 0.85, NULL][o_orderkey % 7 + 1]::DOUBLE AS money
  FROM orders)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with a model answer, spoiled in different ways by the order's key."""
    k = F.col("doc_id") % 6
    country = F.when(F.col("doc_id") % 4 == 0, "Deutschland").when(F.col("doc_id") % 4 == 1, "Poland").when(F.col("doc_id") % 4 == 2, "atlantis").otherwise("the netherlands")
    kind = F.when(F.col("doc_id") % 5 == 0, "Invoice").when(F.col("doc_id") % 5 == 1, "bill").when(F.col("doc_id") % 5 == 2, "credit note").otherwise("novel")
    year = F.when(F.col("doc_id") % 7 == 0, "1875").otherwise(F.date_format("o_orderdate", "yyyy"))
    body = F.concat(F.lit('{"country":"'), country, F.lit('","doc_type":"'), kind, F.lit('","company":"'), F.col("n_name"), F.lit('","year":'), year, F.lit("}"))
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Sure: "), body, F.lit(" done"))).when(k == 2, F.lit("no json here")).otherwise(body)
    return invoices(spark, sf_dir).withColumn("raw_response", raw)


def template_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates from documents with an even id; of equal fingerprints the smallest id."""
    docs = with_fingerprint(table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", "text"))
    first = docs.groupBy("fingerprint").agg(F.min_by(F.struct("doc_id", "header_hash", "company_hint"), "doc_id").alias("d"))
    return first.select(
        F.col("d.doc_id").alias("id"), "fingerprint", F.col("d.header_hash").alias("header_hash"), F.col("d.company_hint").alias("company_hint"),
        F.when(F.col("d.doc_id") % 3 == 0, "germany").otherwise("france").alias("country"), F.lit("invoice").alias("doc_type"), F.lit("financial").alias("doc_category"),
        F.concat(F.lit("Company "), F.col("d.doc_id") % 10).alias("company"), (F.lit(0.90) + (F.col("d.doc_id") % 10) / 100.0).cast("double").alias("confidence"),
        (F.col("d.doc_id") % 13).alias("hit_count"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("d.doc_id") * 86_400).alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_hit_at"),
    )


def progress_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "pending").otherwise("error")
    source = F.when(F.col("o_orderkey") % 3 == 0, "llm").when(F.col("o_orderkey") % 3 == 1, "template_cache")
    return o.select(
        F.col("o_orderkey").alias("id"), F.lit(1).cast("bigint").alias("batch_run_id"), F.concat(F.lit("/in/"), F.col("o_orderkey")).alias("file_path"),
        F.col("o_orderpriority").alias("folder"), F.when((F.col("o_orderkey") % 11 == 0), "pending_llm").otherwise(status).alias("status"), source.alias("source"),
        F.when(status == "error", "failed").alias("error_msg"), (F.col("o_orderkey") % 500).alias("processing_time_ms"),
    )


PROGRESS = """progress AS (
  SELECT o_orderkey AS id, 1::BIGINT AS batch_run_id, concat('/in/', o_orderkey) AS file_path, o_orderpriority AS folder,
         CASE WHEN o_orderkey % 11 = 0 THEN 'pending_llm' WHEN o_orderstatus = 'F' THEN 'ok' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'error' END AS status,
         CASE o_orderkey % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'template_cache' END AS source,
         CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'failed' END AS error_msg, o_orderkey % 500 AS processing_time_ms
  FROM orders)"""


def endpoint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    endpoint = F.concat(F.lit("host"), (F.col("user_id") % 3).cast("string"), F.lit(":"), (8000 + F.col("user_id") % 9).cast("string"))
    return e.select(
        endpoint.alias("endpoint"), F.concat(F.lit("f"), F.col("event_id") % 200).alias("pdf_file"), F.floor(F.abs("value") * 100).cast("bigint").cast("double").alias("elapsed"),
        (F.col("event_id") % 50).alias("tokens"), F.when(F.col("event_type") == "error", "timeout").alias("error"),
        F.when(F.col("event_id") % 400 < 200, "Germany").otherwise(" germany").alias("country"), F.when(F.col("event_id") % 3000 == 7, "bill").otherwise("invoice").alias("doc_type"),
        F.when(F.col("event_id") % 700 == 3, "Other Ltd").when(F.col("event_id") % 2 == 0, "Acme").otherwise("Acme GmbH").alias("company"), (2020 + F.col("event_id") % 200 % 5).cast("int").alias("year"),
    )


ENDPOINTS = """log AS (
  SELECT concat('host', user_id % 3, ':', 8000 + user_id % 9) AS endpoint, concat('f', event_id % 200) AS pdf_file, floor(abs(value) * 100)::BIGINT::DOUBLE AS elapsed,
         event_id % 50 AS tokens, CASE WHEN event_type = 'error' THEN 'timeout' END AS error,
         CASE WHEN event_id % 400 < 200 THEN 'Germany' ELSE ' germany' END AS country, CASE WHEN event_id % 3000 = 7 THEN 'bill' ELSE 'invoice' END AS doc_type,
         CASE WHEN event_id % 700 = 3 THEN 'Other Ltd' WHEN event_id % 2 = 0 THEN 'Acme' ELSE 'Acme GmbH' END AS company, (2020 + event_id % 200 % 5)::INT AS year
  FROM events)"""
