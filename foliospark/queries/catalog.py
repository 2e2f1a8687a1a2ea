"""Queries and oracles by name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities, guard, paths, responses, text, validators
from ..functions.binding import bind
from ..functions.dictionaries import DOC_TYPE_CATEGORY, SUSPICIOUS_PATTERNS, VAT_FORMATS
from ..operators import chat, likeness, progress, reports, templates
from ..plans.classify import LEARNED, can_use_llm, classify, learn_from, route
from ..plans.ordered import classify_in_order
from ..plans.organize import organize_plan
from ..plans.sessions import Sessions
from ..store import materialize, new_path
from .inputs import DATED, ENDPOINTS, EVIDENCE, INVOICES, PROGRESS, answers, dated_invoices, endpoint_log, evidence_texts, invoices, progress_seed, table, template_seed
from .stub import stub_responder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _normal(x: str) -> str:
    return f"trim(lower(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '\\d+', '#', 'g')))"


def _offset(kind: str) -> str:
    p = text.STRUCTURE[kind]
    return f"CASE WHEN regexp_matches(text, '{p}') THEN '{kind}:' || (length(regexp_extract(text, '(?s)^(.*?)(?:{p})', 1)) // 100) END"


# letters whose capital form is two letters, which this SQL's upper() leaves as they are
WIDE = {"ß": "SS", "ﬀ": "FF", "ﬁ": "FI", "ﬂ": "FL", "ﬃ": "FFI", "ﬄ": "FFL", "ﬅ": "ST", "ﬆ": "ST", "ŉ": "ʼN", "ǰ": "J̌"}


def _upper(x: str) -> str:
    for letter, capitals in WIDE.items():
        x = f"replace({x}, '{letter}', '{capitals}')"
    return f"upper({x})"


HEAD = _upper("substring(text, 1, 500)")
HINT = f"nullif(lower(trim(regexp_extract({HEAD}, '([A-Z][A-Za-z]+(?:\\s+[A-Z][A-Za-z]+){{0,3}})\\s+(?:GMBH|AG|SA|SAS|SRL|LTD|PLC|INC|BV|NV)', 1))), '')"
PRINTS = f"""prints AS (
  SELECT doc_id, text, {HINT} AS company_hint, {_normal("substring(text, 1, 500)")} AS header,
         concat_ws('|', {", ".join(_offset(k) for k in ("amount", "date", "iban", "vat"))}) AS structure
  FROM documents), marked AS (
  SELECT doc_id, text, company_hint, structure, substring(md5(header), 1, 16) AS header_hash, substring(sha256(header || '|' || structure), 1, 32) AS fingerprint FROM prints)"""


@query(f"WITH {PRINTS} SELECT doc_id, header_hash, structure, fingerprint FROM marked")
def doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.with_fingerprint(table(spark, sf_dir, "documents")).select("doc_id", "header_hash", "structure", "fingerprint")


@query(f"WITH {PRINTS} SELECT header_hash, count(*) AS n_documents, min(doc_id) AS first_id FROM marked GROUP BY 1 HAVING count(*) > 1")
def duplicate_headers(spark, sf_dir):
    docs = doc_fingerprint(spark, sf_dir)
    return docs.groupBy("header_hash").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_id")).filter("n_documents > 1")


@query(
    f"""WITH g AS (SELECT doc_id, {_normal("text")} AS n, concat_ws('|', {", ".join(_offset(k) for k in ("amount", "date", "email", "iban", "vat"))}) AS s FROM documents)
    SELECT doc_id, CASE WHEN n = '' THEN 'empty' ELSE substring(md5(substring(n, 1, 500)), 1, 16) END AS g_header,
           CASE WHEN n = '' THEN 'empty' ELSE substring(md5(s), 1, 16) END AS g_structure FROM g"""
)
def fingerprint_generator(spark, sf_dir):
    return text.generator_fingerprint(table(spark, sf_dir, "documents")).select("doc_id", "g_header", "g_structure")


@query(
    f"""WITH {INVOICES} SELECT doc_id, lower(trim(regexp_extract({HEAD},
    '([A-Z][A-Za-z]+(?:\\s+[A-Z][A-Za-z]+){{0,3}})\\s+(?:GMBH|AG|SA|SAS|SRL|LTD|PLC|INC|BV|NV)', 1))) AS company_hint FROM invoices"""
)
def company_hint(spark, sf_dir):
    return invoices(spark, sf_dir).select("doc_id", text.company_hint(F.col("text")).alias("company_hint"))


def _sorted(name: str):
    return F.array_join(F.array_sort(name), ",").alias(name)


def _all(pattern: str, change: str = "x", keep: str = "true") -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '{pattern}', 1), lambda x: {change}), lambda x: {keep}))), ',')"


@query(
    f"""SELECT doc_id, {_all(entities.EMAIL, "lower(x)")} AS emails, {_all(r"\+(\d{1,3})[\s.\-()]*\d")} AS phone_codes,
    {_all(r"\b(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})\b", "replace(replace(x, '/', '.'), '-', '.')")} AS dates FROM documents"""
)
def extract_contacts(spark, sf_dir):
    return entities.with_entities(table(spark, sf_dir, "documents")).select("doc_id", _sorted("emails"), _sorted("phone_codes"), _sorted("dates"))


@query(
    f"""WITH {DATED}, ys AS (SELECT *, list_filter(found, lambda y: y BETWEEN 2000 AND 2030) AS years FROM dated),
    counted AS (SELECT *, list_transform(range(1, len(years) + 1), lambda i: struct_pack(n := -len(list_filter(years, lambda y: y = years[i])), i := i)) AS k FROM ys)
    SELECT doc_id, {_all(r"VAT: (DE[0-9]{9})")} AS vat_numbers, {_all(r"\b([A-Z]{2}[0-9]{2}[A-Z0-9]{8,30})\b", "x", "length(x) >= 15")} AS ibans,
    regexp_extract(text, 'Invoice No: (INV-[0-9]+)', 1) AS invoice_number, regexp_extract(text, 'Total: ([0-9.]+)', 1) AS amounts,
    regexp_extract(text, ' (EUR|PLN)', 1) AS currencies, years[list_sort(k)[1].i]::INT AS found_year FROM counted"""
)
def extract_invoice_entities(spark, sf_dir):
    """Invoices with up to four dates: years before 2000, years in two digits, repeats and ties."""
    found = entities.with_entities(dated_invoices(spark, sf_dir))
    return found.select("doc_id", _sorted("vat_numbers"), _sorted("ibans"), "invoice_number", _sorted("amounts"), _sorted("currencies"), F.col("year").alias("found_year"))


@query(
    f"""WITH {EVIDENCE}, e AS (
      SELECT doc_id, 1 AS rank, vat_country AS country, 0.95::DOUBLE AS c, 'vat' AS source FROM evidence UNION ALL SELECT doc_id, 2, iban_country, 0.90::DOUBLE, 'iban' FROM evidence
      UNION ALL SELECT doc_id, 3, bic_country, 0.85::DOUBLE, 'bic' FROM evidence UNION ALL SELECT doc_id, 4, money_country, money, 'currency' FROM evidence),
    g AS (SELECT doc_id, country, list(c ORDER BY rank) AS cs, min(rank) AS first, arg_min(source, rank) AS source FROM e WHERE country IS NOT NULL GROUP BY 1, 2),
    f AS (SELECT *, list_reduce(cs[2:], lambda a, c: 1 - (1 - a) * (1 - c), cs[1]) AS confidence FROM g),
    w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, first) AS n FROM f)
    SELECT evidence.doc_id, w.country, round(coalesce(w.confidence, 0.0), 9) AS country_confidence, w.source AS country_source FROM evidence LEFT JOIN w ON evidence.doc_id = w.doc_id AND n = 1"""
)
def country_evidence(spark, sf_dir):
    """Texts whose VAT number, IBAN, BIC and currency agree, disagree or are missing."""
    found = entities.with_entities(evidence_texts(spark, sf_dir))
    return found.select("doc_id", "country", F.round("country_confidence", 9).alias("country_confidence"), "country_source")


def _sum(digits: str, n: int) -> str:
    return f"list_reduce(list_transform(range(1, {n} + 1), lambda i: substring({digits}, i, 1)::INT), lambda a, d: (2 * CASE WHEN (a + d) % 10 = 0 THEN 10 ELSE (a + d) % 10 END) % 11, 10)"


@query(
    f"""WITH v AS (SELECT c_custkey, 'DE' || lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS vat, lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS d FROM customer),
    w AS (SELECT *, (11 - {_sum("d", 8)}) % 10 = substring(d, 9, 1)::INT AS ok FROM v)
    SELECT c_custkey, vat, ok AS is_valid, 'germany' AS country, CASE WHEN ok THEN '' ELSE 'Invalid VAT checksum' END AS errors FROM w"""
)
def validate_vat(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("DE"), F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0")).alias("vat"))
    v = validators.validate_vat(F.col("vat"))
    return c.withColumn("v", v).select("c_custkey", "vat", "v.is_valid", "v.country", F.array_join("v.errors", "; ").alias("errors"))


def validate_vat_formats(spark, sf_dir):
    """Every country's format on the same digits, lengths and endings varying."""
    c = table(spark, sf_dir, "customer")
    codes = sorted(VAT_FORMATS)
    vat = F.concat(F.element_at(F.array(*map(F.lit, codes)), (F.col("c_custkey") % len(codes)).cast("int") + 1), F.lpad((F.col("c_custkey") * 104729 % 1000000000).cast("string"), 9, "0"))
    return c.select("c_custkey", vat.alias("vat")).withColumn("v", validators.validate_vat(F.col("vat"))).select("c_custkey", "vat", "v.is_valid", "v.country", F.array_join("v.errors", "; ").alias("errors"))


QUERIES["validate_vat_formats"] = validate_vat_formats


@query(
    """WITH i AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'GB' ELSE 'ZZ' END || lpad((c_custkey % 98)::VARCHAR, 2, '0')
      || CASE WHEN c_custkey % 3 = 1 THEN 'WEST' ELSE '' END || lpad((c_custkey * 31)::VARCHAR, CASE c_custkey % 5 WHEN 4 THEN 17 ELSE CASE WHEN c_custkey % 3 = 1 THEN 14 ELSE 18 END END, '0') AS iban FROM customer),
    m AS (SELECT c_custkey, iban, list_reduce(list_transform(string_split(substring(iban, 5) || substring(iban, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END),
      lambda a, d: CASE WHEN d > 9 THEN (a * 100 + d) % 97 ELSE (a * 10 + d) % 97 END, 0) AS r FROM i)
    SELECT c_custkey, iban, CASE WHEN iban LIKE 'ZZ%' THEN false ELSE length(iban) = 22 AND r = 1 END AS is_valid,
      CASE WHEN iban LIKE 'DE%' THEN 'germany' WHEN iban LIKE 'GB%' THEN 'uk' END AS country,
      CASE WHEN iban LIKE 'ZZ%' THEN 'Unknown IBAN country code: ZZ' ELSE concat_ws('; ', CASE WHEN length(iban) <> 22 THEN 'Invalid IBAN length: expected 22, got ' || length(iban) END,
        CASE WHEN r <> 1 THEN 'Invalid IBAN checksum' END) END AS errors FROM m"""
)
def validate_iban(spark, sf_dir):
    k = F.col("c_custkey")
    code = F.when(k % 3 == 0, "DE").when(k % 3 == 1, "GB").otherwise("ZZ")
    digits = lambda n: F.lpad((k * 31).cast("string"), n, "0")
    body = F.when(k % 5 == 4, digits(17)).when(k % 3 == 1, digits(14)).otherwise(digits(18))
    iban = F.concat(code, F.lpad((k % 98).cast("string"), 2, "0"), F.when(k % 3 == 1, "WEST").otherwise(""), body)
    c = table(spark, sf_dir, "customer").select("c_custkey", iban.alias("iban")).withColumn("v", validators.validate_iban(F.col("iban")))
    return c.select("c_custkey", "iban", "v.is_valid", "v.country", F.array_join("v.errors", "; ").alias("errors"))


@query(
    """WITH i AS (SELECT c_custkey, 'gb' || lpad((c_custkey % 98)::VARCHAR, 2, '0') || ' we st' || repeat('7', (c_custkey % 9)::INT) || c_custkey AS iban FROM customer),
    u AS (SELECT *, upper(replace(iban, ' ', '')) AS plain FROM i)
    SELECT c_custkey, trim(regexp_replace(plain, '(.{4})', '\\1 ', 'g')) AS shown, substring(plain, 5) AS bban FROM u"""
)
def iban_parts(spark, sf_dir):
    """IBANs as written in groups, and the account part."""
    k = F.col("c_custkey")
    iban = F.concat(F.lit("gb"), F.lpad((k % 98).cast("string"), 2, "0"), F.lit(" we st"), F.repeat(F.lit("7"), (k % 9).cast("int")), k.cast("string"))
    return table(spark, sf_dir, "customer").select(k, validators.format_iban(iban).alias("shown"), validators.bban(iban).alias("bban"))


@query(
    """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, ' +', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents)
    SELECT doc_id, md5(coalesce(array_to_string(lines, chr(10)), '')) AS digest FROM l"""
)
def prepare_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.prepare_text(F.col("text"))).alias("digest"))


@query()
def smart_truncate(spark, sf_dir):
    cut = bind(table(spark, sf_dir, "documents").select("doc_id", "text"), cut=text.smart_truncate(text.prepare_text(F.col("text"))))
    return cut.select("doc_id", F.length("cut").alias("n_chars"), F.md5("cut").alias("digest"))


@query(
    f"""WITH {INVOICES} SELECT doc_id,
    CASE WHEN doc_id % 6 = 2 THEN NULL ELSE CASE doc_id % 4 WHEN 0 THEN 'germany' WHEN 1 THEN 'poland' WHEN 3 THEN 'netherlands' END END AS country,
    CASE WHEN doc_id % 6 = 2 THEN NULL ELSE CASE doc_id % 5 WHEN 0 THEN 'invoice' WHEN 1 THEN 'invoice' WHEN 2 THEN 'credit_note' ELSE 'unknown' END END AS doc_type,
    CASE WHEN doc_id % 6 = 2 THEN 0.0::DOUBLE ELSE CASE doc_id % 5 WHEN 0 THEN 0.85::DOUBLE WHEN 1 THEN 0.75::DOUBLE WHEN 2 THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END END AS doc_type_confidence,
    CASE WHEN doc_id % 6 = 2 THEN NULL WHEN doc_id % 7 <> 0 THEN year(o_orderdate)::INT WHEN false THEN 0 END AS year,
    doc_id % 6 <> 2 AS is_valid,
    CASE WHEN doc_id % 6 = 2 THEN 'Failed to parse JSON from response' ELSE concat_ws('; ', CASE WHEN doc_id % 4 = 2 THEN 'Unknown country: atlantis' END,
      CASE WHEN doc_id % 5 > 2 THEN 'Unknown doc_type ''novel'', mapped to ''unknown''' END,
      CASE WHEN doc_id % 7 = 0 AND NOT contains(text, '1875') THEN 'Year 1875 not found in text (hallucination?)' WHEN doc_id % 7 = 0 THEN 'Year 1875 out of valid range' END) END AS errors
    FROM invoices"""
)
def parse_response(spark, sf_dir):
    a = bind(answers(spark, sf_dir), a=responses.parse_response(F.col("raw_response"), F.col("text")))
    return a.select("doc_id", "a.country", "a.doc_type", "a.doc_type_confidence", "a.year", "a.is_valid", F.array_join("a.errors", "; ").alias("errors"))


@query()
def guard_validate(spark, sf_dir):
    a = bind(answers(spark, sf_dir), a=responses.parse_response(F.col("raw_response"), F.col("text")))
    g = guard.check(F.col("a.country"), F.col("a.company"), F.col("a.year"), F.col("text"))
    return bind(a, g=g).select("doc_id", "g.is_valid", "g.penalty", F.array_join("g.errors", "; ").alias("errors"), F.array_join("g.warnings", "; ").alias("warnings"))


@query(
    f"""WITH {INVOICES} SELECT doc_id, 'Acme ' || c_mktsegment AS company,
    (len(list_filter(['acme', lower(c_mktsegment)], lambda w: contains(lower(text), w)))::DOUBLE / 2) AS similarity FROM invoices"""
)
def company_similarity(spark, sf_dir):
    company = F.concat(F.lit("Acme "), F.col("c_mktsegment"))
    return invoices(spark, sf_dir).select("doc_id", company.alias("company"), guard.company_similarity(company, F.col("text")).alias("similarity"))


SEED = f"""{PRINTS}, seed AS (
  SELECT min(doc_id) AS id, fingerprint, arg_min(struct_pack(h := header_hash, c := company_hint), doc_id) AS d FROM marked WHERE doc_id % 2 = 0 GROUP BY fingerprint), templates AS (
  SELECT id, fingerprint, d.h AS header_hash, d.c AS company_hint, CASE WHEN id % 3 = 0 THEN 'germany' ELSE 'france' END AS country, 'Company ' || id % 10 AS company,
         0.90::DOUBLE + (id % 10) / 100.0::DOUBLE AS confidence, id % 13 AS hit_count, to_timestamp(1700000000 + id * 86400)::TIMESTAMP AS created_at FROM seed)"""
MATCHED = f"""{SEED}, best AS (SELECT header_hash, arg_min(struct_pack(id := id, confidence := confidence, country := country), (-hit_count, id)) AS h FROM templates GROUP BY 1),
    hints AS (SELECT DISTINCT company_hint AS hint FROM marked WHERE length(company_hint) >= 3),
    near AS (SELECT hint, arg_min(struct_pack(id := t.id, confidence := t.confidence, country := t.country), (-t.hit_count, -t.confidence, t.id)) AS f
      FROM hints JOIN templates t ON contains(t.company_hint, hint) GROUP BY 1),
    j AS (SELECT m.doc_id, m.text, t.id AS e_id, t.confidence AS e_conf, t.country AS e_country, b.h, near.f,
      CASE WHEN coalesce(length(m.text), 0) < 50 THEN NULL WHEN t.confidence >= 0.92 THEN 'exact' WHEN b.h.confidence >= 0.92 THEN 'header' WHEN near.f.confidence >= 0.90 THEN 'fuzzy' END AS tier
      FROM marked m LEFT JOIN templates t USING (fingerprint) LEFT JOIN best b ON m.header_hash = b.header_hash LEFT JOIN near ON m.company_hint = near.hint),
    matched AS (SELECT doc_id, text, tier, CASE tier WHEN 'exact' THEN e_id WHEN 'header' THEN h.id WHEN 'fuzzy' THEN f.id END AS template_id,
      CASE tier WHEN 'exact' THEN e_country WHEN 'header' THEN h.country WHEN 'fuzzy' THEN f.country END AS country,
      CASE tier WHEN 'exact' THEN e_conf WHEN 'header' THEN h.confidence * 0.98::DOUBLE WHEN 'fuzzy' THEN f.confidence * 0.90::DOUBLE END AS confidence FROM j)"""


def _stored(spark, sf_dir):
    """The templates as a table on disk, as a lookup finds them."""
    return materialize(template_seed(spark, sf_dir), "templates")


def _matched(spark, sf_dir):
    docs = text.with_fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return templates.match_templates(docs, _stored(spark, sf_dir), 0.92)


@query(f"WITH {MATCHED} SELECT doc_id, tier, template_id, country, confidence FROM matched")
def template_match(spark, sf_dir):
    """The tier that served each document, exact before header before containment of the hint."""
    hit = (F.col(f"hit.{f}").alias(a) for f, a in (("id", "template_id"), ("country", "country"), ("confidence", "confidence")))
    return _matched(spark, sf_dir).select("doc_id", "tier", *hit)


@query(f"WITH {MATCHED} SELECT doc_id, tier, template_id, country, confidence FROM matched")
def template_match_tiers(spark, sf_dir):
    """All three tiers, a row for each document."""
    return template_match(spark, sf_dir)


@query(
    f"""WITH {SEED} SELECT count(*) AS total_templates, count(DISTINCT country) AS countries, count(DISTINCT company) AS companies, min(created_at) AS oldest, max(created_at) AS newest FROM templates"""
)
def template_stats(spark, sf_dir):
    return templates.template_stats(template_seed(spark, sf_dir))


@query(f"WITH {SEED} SELECT id, fingerprint, hit_count, confidence FROM templates ORDER BY hit_count DESC, id LIMIT 100")
def top_templates(spark, sf_dir):
    return templates.top_templates(template_seed(spark, sf_dir)).select("id", "fingerprint", "hit_count", "confidence")


@query(f"WITH {SEED} SELECT id, fingerprint FROM templates WHERE created_at >= TIMESTAMP '2024-06-01' - INTERVAL 90 DAY")
def age_out(spark, sf_dir):
    return templates.age_out(template_seed(spark, sf_dir), F.lit("2024-06-01").cast("timestamp"), 90).select("id", "fingerprint")


@query(
    f"""WITH {MATCHED} SELECT count(*) FILTER (length(text) >= 50) AS total_queries, count(tier) AS total_hits, count(tier)::DOUBLE / count(*) FILTER (length(text) >= 50) AS hit_rate FROM matched"""
)
def cache_hit_rate(spark, sf_dir):
    return templates.hit_rate(_matched(spark, sf_dir))


@query(
    f"""WITH {MATCHED}, h AS (SELECT template_id AS id, count(*) AS hits FROM matched WHERE tier IS NOT NULL GROUP BY 1)
    SELECT t.id, t.hit_count + coalesce(hits, 0) AS hit_count, CASE WHEN hits > 0 THEN TIMESTAMP '2024-06-01' END AS last_hit_at FROM templates t LEFT JOIN h ON t.id = h.id"""
)
def record_hits(spark, sf_dir):
    seed = _stored(spark, sf_dir)
    return templates.record_hits(seed, _matched(spark, sf_dir), F.lit("2024-06-01").cast("timestamp")).select("id", "hit_count", "last_hit_at")


_ANSWERED = """a AS (SELECT 'c' || o_custkey AS fingerprint, o_orderkey, 0.80::DOUBLE + (o_orderkey % 20) / 100.0::DOUBLE AS confidence,
      CASE WHEN o_orderkey % 3 > 0 THEN 'cat' || o_orderkey % 5 END AS category, 'land' || o_orderkey % 4 AS country FROM orders), g AS (SELECT * FROM a WHERE confidence >= 0.85),
    l AS (SELECT fingerprint, list(confidence ORDER BY o_orderkey) AS c, count(*) AS k, arg_min(country, o_orderkey) AS country,
      arg_max(category, o_orderkey) FILTER (category IS NOT NULL) AS category FROM g GROUP BY 1)"""


def _answered(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("doc_id"), F.concat(F.lit("c"), "o_custkey").alias("fingerprint"), F.lit("").alias("header_hash"), F.lit(None).cast("string").alias("company_hint"),
        F.concat(F.lit("land"), k % 4).alias("country"), F.lit("invoice").alias("doc_type"), F.when(k % 3 > 0, F.concat(F.lit("cat"), k % 5)).alias("doc_category"), F.lit("x").alias("company"),
        (F.lit(0.80) + (k % 20) / 100.0).cast("double").alias("confidence"),
    )


@query(
    f"""WITH {_ANSWERED} SELECT fingerprint, country, category AS doc_category, list_reduce(c[2:], lambda x, y: least(greatest(x, y) + 0.02::DOUBLE, 0.99::DOUBLE), c[1]) AS confidence, (k - 1)::BIGINT AS hit_count FROM l"""
)
def template_learn(spark, sf_dir):
    """Answers learned into an empty table."""
    empty = spark.createDataFrame([], templates.TEMPLATE)
    return templates.learn(empty, _answered(spark, sf_dir), F.lit("2024-06-01").cast("timestamp")).select("fingerprint", "country", "doc_category", "confidence", "hit_count")


@query(
    f"""WITH {_ANSWERED}, t AS (SELECT c_custkey AS id, 'c' || c_custkey AS fingerprint, 0.50::DOUBLE + (c_custkey % 50) / 100.0::DOUBLE AS confidence, c_custkey % 9 AS hit_count,
      CASE WHEN c_custkey % 4 > 0 THEN 'old' END AS category FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(t.fingerprint, l.fingerprint) AS fingerprint, t.id, CASE WHEN t.id IS NULL THEN l.country ELSE 'oldland' END AS country, coalesce(l.category, t.category) AS doc_category,
      CASE WHEN t.id IS NULL THEN list_reduce(c[2:], lambda x, y: least(greatest(x, y) + 0.02::DOUBLE, 0.99::DOUBLE), c[1])
           WHEN k IS NULL THEN t.confidence ELSE list_reduce(c, lambda x, y: least(greatest(x, y) + 0.02::DOUBLE, 0.99::DOUBLE), t.confidence) END AS confidence,
      (coalesce(t.hit_count, 0) + coalesce(k, 0) - CASE WHEN t.id IS NULL THEN 1 ELSE 0 END)::BIGINT AS hit_count,
      CASE WHEN t.id IS NULL THEN TIMESTAMP '2024-06-01' ELSE TIMESTAMP '2024-01-01' END AS created_at,
      CASE WHEN k - CASE WHEN t.id IS NULL THEN 1 ELSE 0 END > 0 THEN TIMESTAMP '2024-06-01' END AS last_hit_at
    FROM t FULL JOIN l ON t.fingerprint = l.fingerprint"""
)
def template_learn_merge(spark, sf_dir):
    """Answers learned into a table that holds half of their fingerprints: first values stay, the category follows, hits add up."""
    k = F.col("c_custkey")
    held = table(spark, sf_dir, "customer").filter(k % 2 == 0).select(
        k.cast("long").alias("id"), F.concat(F.lit("c"), k).alias("fingerprint"), F.lit("").alias("header_hash"), F.lit(None).cast("string").alias("company_hint"), F.lit("oldland").alias("country"),
        F.lit("invoice").alias("doc_type"), F.when(k % 4 > 0, "old").alias("doc_category"), F.lit("y").alias("company"), (F.lit(0.50) + (k % 50) / 100.0).cast("double").alias("confidence"),
        (k % 9).cast("long").alias("hit_count"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("last_hit_at"),
    )
    out = templates.learn(held, _answered(spark, sf_dir), F.lit("2024-06-01").cast("timestamp"))
    return out.select("fingerprint", F.when(F.col("country") == "oldland", F.col("id")).alias("id"), "country", "doc_category", "confidence", "hit_count", "created_at", "last_hit_at")


@query()
def classify_cascade(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, _stored(spark, sf_dir), stub_responder, hit_threshold=0.92)
    return out.select("doc_id", "country", "doc_type", "doc_category", "company", "year", "source", "needs_llm", "is_valid", "confidence")


_DAY = f"""{MATCHED}, day AS (SELECT doc_id, length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31))) < 20 AS short,
      tier IS NOT NULL AS known, confidence AS c FROM matched),
    judged AS (SELECT doc_id, CASE WHEN NOT short AND known AND c >= 0.97 THEN 'template_cache' WHEN NOT short AND known THEN 'template_cache_partial' ELSE 'no_match' END AS source,
      NOT short AND NOT (known AND c >= 0.97) AS needs_llm, NOT short AND known AS is_valid, short,
      CASE WHEN short OR NOT known THEN 0.0::DOUBLE WHEN c >= 0.97 THEN c ELSE c * 0.9::DOUBLE END AS confidence FROM day)"""


def _day_mode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, _stored(spark, sf_dir), None, hit_threshold=0.97)


@query(f"WITH {_DAY.replace('>= 0.92', '>= 0.95')} SELECT doc_id, source, needs_llm, is_valid, round(confidence, 9) AS confidence FROM judged")
def classify_day_mode(spark, sf_dir):
    """The cascade without a model: templates alone, partial answers at nine tenths."""
    return _day_mode(spark, sf_dir).select("doc_id", "source", "needs_llm", "is_valid", F.round("confidence", 9).alias("confidence"))


@query(
    f"""WITH {_DAY.replace('>= 0.92', '>= 0.95')} SELECT doc_id, CASE WHEN short THEN 'error' WHEN source = 'no_match' THEN 'pending_llm' WHEN is_valid AND confidence >= 0.9 THEN 'ok' ELSE 'error' END AS status,
      CASE WHEN short THEN 'Empty or too short text' WHEN source = 'no_match' THEN 'No cache match (cache-only mode)' WHEN NOT (is_valid AND confidence >= 0.9) THEN printf('Low confidence (conf=%.2f)', confidence) END AS error_msg FROM judged"""
)
def route_cache_only(spark, sf_dir):
    """Statuses of a run on the cache alone."""
    return route(_day_mode(spark, sf_dir), cache_only=True, min_confidence=0.9).select("doc_id", "status", "error_msg")


def _second(sql: str) -> str:
    """The lookup's common table expressions once more, over the second session's files and templates."""
    for name in ("templates", "best", "hints", "near", "matched", "day", "judged", "j"):
        sql = re.sub(rf"\b{name}\b(?! :=)", f"{name}2", sql)
    return sql


_LOOKUP = MATCHED.removeprefix(f"{SEED}, ").replace(">= 0.92", ">= 0.95") + _DAY.removeprefix(MATCHED)
_STATUS = """CASE WHEN short THEN 'error' WHEN source = 'no_match' THEN 'pending_llm' WHEN is_valid AND confidence >= 0.9 THEN 'ok' ELSE 'error' END"""
_FIRST = _LOOKUP.replace("FROM marked m", "FROM (SELECT * FROM marked WHERE doc_id % 3 > 0) m").replace("FROM marked WHERE length", "FROM marked WHERE doc_id % 3 > 0 AND length")
_LATER = _second(_LOOKUP).replace("FROM marked m", "FROM (SELECT * FROM marked JOIN again USING (doc_id)) m").replace("FROM marked WHERE length", "FROM marked JOIN again USING (doc_id) WHERE length")
_SESSIONS = f"""{SEED}, {_FIRST}, one AS (SELECT doc_id, {_STATUS} AS status, source, confidence, short FROM judged),
    used AS (SELECT template_id AS id, count(*) AS n FROM matched JOIN one USING (doc_id) WHERE tier IS NOT NULL AND NOT short GROUP BY 1),
    templates2 AS (SELECT t.* REPLACE (t.hit_count + coalesce(n, 0) AS hit_count) FROM templates t LEFT JOIN used USING (id)),
    again AS (SELECT doc_id FROM marked LEFT JOIN one USING (doc_id) WHERE status IS NULL OR status <> 'ok'),
    {_LATER}, two AS (SELECT doc_id, {_STATUS} AS status, source, confidence, short FROM judged2),
    final AS (SELECT * FROM two UNION ALL SELECT * FROM one WHERE status = 'ok'),
    used2 AS (SELECT template_id AS id, count(*) AS n FROM matched2 JOIN two USING (doc_id) WHERE tier IS NOT NULL AND NOT short GROUP BY 1)"""


def _sessions(spark, sf_dir) -> Sessions:
    """Two sessions on the cache alone: two thirds of the documents, a retry of what failed, then all."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".pdf")).alias("file_path"), F.col("source").alias("folder"), F.lit(1).alias("file_size"), "text", "doc_id")
    book = Sessions(spark, new_path(spark, "sessions"))
    book.templates.import_new(template_seed(spark, sf_dir))
    now = F.lit("2024-06-01").cast("timestamp")
    options = {"cache_only": True, "hit_threshold": 0.97, "min_confidence": 0.9, "now": now}
    book.run(files.filter("doc_id % 3 > 0").drop("doc_id"), "/in", None, **options)
    book.retry()
    book.run(files.drop("doc_id"), "/in", None, **options)
    return book


@query(
    f"""WITH {_SESSIONS} SELECT '/in/' || d.source || '/' || d.doc_id || '.pdf' AS file_path, d.source AS folder, f.status, CASE WHEN f.status = 'ok' THEN f.source END AS source,
      CASE WHEN short THEN 'Empty or too short text' WHEN f.source = 'no_match' THEN 'No cache match (cache-only mode)' WHEN f.status <> 'ok' THEN printf('Low confidence (conf=%.2f)', confidence) END AS error_msg,
      CASE WHEN d.doc_id % 3 > 0 THEN 1 ELSE 2 END::BIGINT AS batch_run_id FROM final f JOIN documents d USING (doc_id)"""
)
def run_sessions(spark, sf_dir):
    """What two sessions and a retry leave of each file; the second one ranks templates by the hits of the first."""
    return _sessions(spark, sf_dir).files.read().select("file_path", "folder", "status", "source", "error_msg", "batch_run_id")


@query(
    f"""WITH {_SESSIONS}, r AS (SELECT CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 2 END::BIGINT AS id, f.* FROM final f), later AS (SELECT * FROM r WHERE id = 2), first AS (SELECT 1::BIGINT AS id, one.* FROM one)
    SELECT id, '/in' AS source_root, 'finished' AS status, count(*) AS total_files, count(*) FILTER (status = 'ok') AS processed_files, count(*) FILTER (status = 'ok' AND source = 'template_cache') AS cache_hits,
      0::BIGINT AS llm_calls, count(*) FILTER (status = 'error') AS errors FROM (SELECT id, status, source FROM first UNION ALL SELECT id, status, source FROM later) GROUP BY 1"""
)
def run_records(spark, sf_dir):
    """The records of both runs, as each ended."""
    return _sessions(spark, sf_dir).runs.read().drop("started_at", "finished_at")


@query(
    f"""WITH {_SESSIONS} SELECT t.id, t.hit_count + coalesce(u.n, 0) AS hit_count, CASE WHEN u.n > 0 OR t.hit_count > s.hit_count THEN TIMESTAMP '2024-06-01' END AS last_hit_at
    FROM templates2 t JOIN templates s USING (id) LEFT JOIN used2 u USING (id)"""
)
def template_hits_in_runs(spark, sf_dir):
    """Hits of every template after both sessions."""
    return _sessions(spark, sf_dir).templates.read().select("id", "hit_count", "last_hit_at")


@query(
    f"""WITH {INVOICES}, {PRINTS.replace("FROM documents", "FROM invoices")}
    SELECT fingerprint, 'germany' AS country, arg_min(company_hint, doc_id) AS company, count(*) - 1 AS hit_count,
      list_reduce(list_transform(range(1, least(count(*), 20)), lambda i: 0.85::DOUBLE), lambda x, y: least(greatest(x, y) + 0.02::DOUBLE, 0.99::DOUBLE), 0.85::DOUBLE) AS confidence
    FROM marked GROUP BY fingerprint"""
)
def classify_and_learn(spark, sf_dir):
    docs = invoices(spark, sf_dir).select("doc_id", "text")
    empty = spark.createDataFrame([], templates.TEMPLATE)
    results = materialize(classify(docs, empty, stub_responder).select(*LEARNED), "results")  # learning reads them twice
    return learn_from(empty, results, F.lit("2024-06-01").cast("timestamp")).select("fingerprint", "country", "company", "confidence", "hit_count")


@query(
    f"""WITH {INVOICES}, {PRINTS.replace("FROM documents", "FROM invoices")}, r AS (SELECT doc_id, row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id) AS n FROM marked)
    SELECT doc_id, CASE WHEN n <= 5 THEN 'llm' ELSE 'template_cache' END AS source, 'germany' AS country, CASE WHEN n <= 5 THEN 0.85::DOUBLE ELSE 0.93::DOUBLE END AS confidence FROM r"""
)
def learning_in_order(spark, sf_dir):
    """The first five documents of a fingerprint are asked, and make its template sure enough for all that follow."""
    docs = invoices(spark, sf_dir).select("doc_id", "text")
    results, _ = classify_in_order(docs, spark.createDataFrame([], templates.TEMPLATE), stub_responder, F.lit("2024-06-01").cast("timestamp"), 0.925)
    return results.select("doc_id", "source", "country", F.round("confidence", 9).alias("confidence"))


_KINDS = ["invoice", "credit_note", "receipt", "contract", "novel"]


@query(
    f"""WITH t AS (SELECT o_orderkey AS id, {_KINDS}[o_orderkey % {len(_KINDS)} + 1] AS doc_type FROM orders)
    SELECT id, doc_type, CASE doc_type {" ".join(f"WHEN '{k}' THEN '{DOC_TYPE_CATEGORY.get(k, 'other')}'" for k in _KINDS)} END AS doc_category FROM t"""
)
def category_backfill(spark, sf_dir):
    """Templates of before the category existed get it from their type."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % len(_KINDS) + 1).cast("int"))
    return templates.add_category(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("doc_type")))


_MEASURES = """count(*) AS total, sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END)::BIGINT AS ok, sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors,
  sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END)::BIGINT AS pending, sum(CASE WHEN status = 'pending_llm' THEN 1 ELSE 0 END)::BIGINT AS pending_llm,
  sum(CASE WHEN source = 'template_cache' THEN 1 ELSE 0 END)::BIGINT AS cache_hits, sum(CASE WHEN source = 'llm' THEN 1 ELSE 0 END)::BIGINT AS llm_calls,
  avg(CASE WHEN processing_time_ms > 0 THEN processing_time_ms END) AS avg_ms"""
_SHARES = "ok::DOUBLE / total AS ok_share, cache_hits::DOUBLE / (cache_hits + llm_calls) AS cache_share"


@query(f"WITH {PROGRESS}, s AS (SELECT {_MEASURES} FROM progress) SELECT *, {_SHARES} FROM s")
def progress_stats(spark, sf_dir):
    return progress.run_stats(progress_seed(spark, sf_dir))


@query(f"WITH {PROGRESS}, s AS (SELECT folder, {_MEASURES} FROM progress GROUP BY folder) SELECT *, {_SHARES} FROM s ORDER BY folder")
def folder_stats(spark, sf_dir):
    return progress.folder_stats(progress_seed(spark, sf_dir))


@query(
    f"""WITH {PROGRESS} SELECT id, CASE WHEN status IN ('error', 'pending_llm') AND folder = '1-URGENT' THEN 'pending' ELSE status END AS status,
    CASE WHEN status IN ('error', 'pending_llm') AND folder = '1-URGENT' THEN NULL ELSE error_msg END AS error_msg FROM progress"""
)
def retry_reset(spark, sf_dir):
    return progress.reset_errors(progress_seed(spark, sf_dir), "1-URGENT").select("id", "status", "error_msg")


@query("SELECT sha256(lower('/In/' || o_orderkey)) AS file_path_hash, '/In/' || o_orderkey AS file_path, 'pending' AS status FROM orders WHERE o_orderkey % 2 = 1")
def register_new_files(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    known = o.filter("o_orderkey % 2 = 0").select(paths.path_hash(F.concat(F.lit("\\in\\"), F.col("o_orderkey"))).alias("file_path_hash"))
    files = o.select(F.concat(F.lit("/In/"), F.col("o_orderkey")).alias("file_path"), F.lit("In").alias("folder"), F.lit(1).alias("file_size"))
    return progress.register_files(known, files).select("file_path_hash", "file_path", "status")


@query(f"WITH {PROGRESS} SELECT id, status, folder FROM progress WHERE status IN ('pending', 'pending_llm') AND folder = '2-HIGH' ORDER BY id")
def pending_files(spark, sf_dir):
    return progress.pending(progress_seed(spark, sf_dir), "2-HIGH").select("id", "status", "folder")


def _results(spark, sf_dir):
    i = invoices(spark, sf_dir)
    k = F.col("doc_id")
    return i.select(
        "doc_id", "filename", F.lower("n_name").alias("country"), F.when(k % 2 == 0, "invoice").alias("doc_type"), F.lit("financial").alias("doc_category"),
        F.concat(F.col("n_name"), F.lit(" / Sons: "), F.col("c_mktsegment")).alias("company"), F.year("o_orderdate").alias("year"), ((k % 10) / 10.0).cast("double").alias("confidence"),
        (k % 17 != 0).alias("is_valid"), F.when(k % 19 == 0, "unreadable").alias("error"),
    )


RESULTS = f"""{INVOICES}, results AS (
  SELECT doc_id, filename, lower(n_name) AS country, CASE WHEN doc_id % 2 = 0 THEN 'invoice' END AS doc_type, n_name || ' / Sons: ' || c_mktsegment AS company, year(o_orderdate) AS year,
         (doc_id % 10) / 10.0::DOUBLE AS confidence, doc_id % 17 <> 0 AS is_valid, CASE WHEN doc_id % 19 = 0 THEN 'unreadable' END AS error FROM invoices), routed AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN NOT is_valid OR confidence < 0.7 THEN 'skipped' ELSE 'success' END AS status FROM results)"""


@query(
    rf"""WITH {RESULTS}, d AS (SELECT *, CASE WHEN status = 'success' THEN concat_ws('/', '/out', replace(country, ' ', '_'), coalesce(doc_type, 'unknown'),
      regexp_replace(substring(replace(replace(replace(company, '/', '_'), ':', '_'), ' ', '_'), 1, 50), '_+$', ''), year, filename) END AS base FROM routed),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY filename, doc_id) - 1 AS n FROM d)
    SELECT status, CASE WHEN base IS NULL THEN NULL WHEN n = 0 THEN base ELSE regexp_replace(base, '\.pdf$', '') || '_' || n || '.pdf' END AS dest_path, count(*) AS n_files FROM n GROUP BY 1, 2"""
)
def organize_paths(spark, sf_dir):
    plan = organize_plan(_results(spark, sf_dir), "/out", use_trash=False)
    return plan.groupBy("status", "dest_path").agg(F.count("*").alias("n_files"))


def _existing(spark, sf_dir):
    """Files that lie at some destinations already: the plain name of every fifth, and the first number of every seventh."""
    plan = organize_plan(_results(spark, sf_dir), "/out", use_trash=False).filter("status = 'success'")
    base = F.regexp_replace("dest_path", r"(_\d+)?\.pdf$", "")
    pick = lambda n: F.pmod(F.length(base) + F.ascii(F.reverse(base)), F.lit(n)) == 0
    names = F.concat(F.when(pick(5), F.array(F.concat(base, F.lit(".pdf")))).otherwise(F.array()), F.when(pick(7), F.array(F.concat(base, F.lit("_1.pdf")), F.concat(base, F.lit("_3.pdf")))).otherwise(F.array()))
    return plan.select(F.explode(names).alias("path")).distinct()


@query(
    rf"""WITH {RESULTS}, d AS (SELECT concat_ws('/', '/out', replace(country, ' ', '_'), coalesce(doc_type, 'unknown'),
      regexp_replace(substring(replace(replace(replace(company, '/', '_'), ':', '_'), ' ', '_'), 1, 50), '_+$', ''), year, replace(filename, '.pdf', '')) AS base FROM routed WHERE status = 'success'),
    e AS (SELECT DISTINCT base, unnest(list_concat(CASE WHEN (length(base) + ascii(right(base, 1))) % 5 = 0 THEN [0] ELSE [] END, CASE WHEN (length(base) + ascii(right(base, 1))) % 7 = 0 THEN [1, 3] ELSE [] END)) AS k FROM d),
    g AS (SELECT base, count(*) AS n FROM d GROUP BY 1),
    free AS (SELECT base, n, unnest(range(0, n + 4)) AS k FROM g),
    ranked AS (SELECT f.base, f.n, f.k, row_number() OVER (PARTITION BY f.base ORDER BY f.k) AS r FROM free f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.base = f.base AND e.k = f.k))
    SELECT base || CASE WHEN k = 0 THEN '' ELSE '_' || k END || '.pdf' AS dest_path, 1::BIGINT AS n_files FROM ranked WHERE r <= n"""
)
def organize_free_names(spark, sf_dir):
    """Destinations beside files that are there: each row takes the first free name of its destination."""
    plan = organize_plan(_results(spark, sf_dir), "/out", use_trash=False, existing=_existing(spark, sf_dir))
    return plan.filter("status = 'success'").groupBy("dest_path").agg(F.count("*").alias("n_files"))


@query(
    f"""WITH {RESULTS} SELECT count(*) AS total_files, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'trash') AS moved_to_trash,
    count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS errors FROM routed"""
)
def organize_report(spark, sf_dir):
    return reports.organize_summary(organize_plan(_results(spark, sf_dir), "/out", use_trash=False))


@query(f"WITH {RESULTS} SELECT coalesce(doc_type, 'unknown') AS doc_type, count(*) AS n FROM routed WHERE status = 'success' GROUP BY 1 ORDER BY n DESC, 1")
def count_by_type(spark, sf_dir):
    return reports.count_by(organize_plan(_results(spark, sf_dir), "/out", use_trash=False).filter("status = 'success'"), "doc_type", "unknown")


@query(
    f"""WITH {RESULTS}, c AS (SELECT company, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM routed WHERE company IS NOT NULL) AS share FROM routed GROUP BY 1)
    SELECT company, n, share, repeat('#', floor(share * 100 / 2)::INT) AS bar FROM c ORDER BY n DESC, company LIMIT 10"""
)
def top_companies(spark, sf_dir):
    """The ten most frequent companies with their shares of all rows."""
    return reports.count_by(_results(spark, sf_dir), "company", limit=10, bar=True)


@query(f"WITH {RESULTS} SELECT coalesce(country, 'unknown') AS country, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM routed WHERE status = 'success') AS share FROM routed WHERE status = 'success' GROUP BY 1")
def count_by_country(spark, sf_dir):
    return reports.count_by(organize_plan(_results(spark, sf_dir), "/out", use_trash=False).filter("status = 'success'"), "country", "unknown", share=True)


@query(
    f"""WITH {RESULTS}, c AS (SELECT company, count(*) AS n FROM routed WHERE company IS NOT NULL GROUP BY 1) SELECT company, n, CASE WHEN length(company) > 25 THEN substring(company, 1, 25) || '...' ELSE company END AS shown FROM c"""
)
def company_names_shown(spark, sf_dir):
    """Companies with their names as the report shows them."""
    return reports.count_by(_results(spark, sf_dir), "company", cut=25)


@query(
    f"""WITH {INVOICES}, g AS (SELECT doc_id, CASE WHEN doc_id % 6 = 2 THEN NULL ELSE CASE doc_id % 4 WHEN 0 THEN 'germany' WHEN 1 THEN 'poland' WHEN 3 THEN 'netherlands' END END AS country,
      CASE WHEN doc_id % 6 <> 2 THEN lower(n_name) END AS company, CASE WHEN doc_id % 6 <> 2 AND doc_id % 7 <> 0 THEN year(o_orderdate) END AS year, lower(substring(n_name, 1, 4)) AS expected FROM invoices)
    SELECT doc_id, coalesce(country = 'poland', false)::INT + coalesce(contains(company, expected), false)::INT + coalesce(year = 1995, false)::INT AS passed, 3 AS total FROM g"""
)
def golden_fields(spark, sf_dir):
    """How many of three expected fields the answers have."""
    a = bind(answers(spark, sf_dir), a=responses.parse_response(F.col("raw_response"), F.col("text")))
    given = a.select("doc_id", "a.country", "a.company", "a.year", F.lit("Poland").alias("expected_country"), F.substring("n_name", 1, 4).alias("expected_company"), F.lit(1995).alias("expected_year"))
    return reports.golden_score(given, ["country", "company", "year"]).select("doc_id", "passed", "total")


_STATS = """SELECT endpoint, count(*) AS requests, count(*) FILTER (error IS NULL) AS successful, count(*) FILTER (error IS NOT NULL) AS failed, coalesce(sum(elapsed) FILTER (error IS NULL), 0.0::DOUBLE) AS total_time,
  min(elapsed) FILTER (error IS NULL) AS min_time, max(elapsed) FILTER (error IS NULL) AS max_time, avg(elapsed) FILTER (error IS NULL) AS avg_time,
  (sum(tokens) FILTER (error IS NULL))::DOUBLE / sum(elapsed) FILTER (error IS NULL) AS tokens_per_sec, (count(*) FILTER (error IS NULL))::DOUBLE / count(*) AS success_rate,
  coalesce(sum(tokens) FILTER (error IS NULL), 0)::BIGINT AS total_tokens FROM log GROUP BY endpoint"""


@query(f"WITH {ENDPOINTS} {_STATS}")
def endpoint_stats(spark, sf_dir):
    return reports.endpoint_stats(endpoint_log(spark, sf_dir))


@query(
    f"""WITH {ENDPOINTS}, s AS ({_STATS}) SELECT string_split(endpoint, ':')[1] AS host, sum(requests)::BIGINT AS requests, sum(successful)::BIGINT AS successful, count(*) AS endpoints,
    sum(total_tokens)::DOUBLE / sum(total_time) AS tokens_per_sec, string_agg(endpoint, ',' ORDER BY endpoint) AS ports FROM s GROUP BY 1"""
)
def host_ranking(spark, sf_dir):
    ranked = reports.host_ranking(reports.endpoint_stats(endpoint_log(spark, sf_dir)), F.substring_index("endpoint", ":", 1))
    return ranked.withColumn("ports", F.array_join("ports", ","))


@query(
    f"""WITH {ENDPOINTS} SELECT string_split(endpoint, ':')[1] AS host, avg(elapsed) AS avg_time, sum(tokens)::DOUBLE / sum(elapsed) AS tokens_per_sec FROM log WHERE error IS NULL GROUP BY 1"""
)
def host_speed(spark, sf_dir):
    return reports.host_speed(endpoint_log(spark, sf_dir), F.substring_index("endpoint", ":", 1))


@query(
    f"""WITH {ENDPOINTS}, g AS (SELECT pdf_file, count(*) AS answers, count(DISTINCT trim(lower(country))) = 1 AS same_country, count(DISTINCT doc_type) = 1 AS same_doc_type,
    list_sort(list_distinct(list(trim(lower(company))))) AS cs, count(DISTINCT year) = 1 AS same_year FROM log WHERE error IS NULL GROUP BY 1),
    c AS (SELECT pdf_file, answers, same_country, same_doc_type, len(cs) = 1 OR (len(cs) = 2 AND (contains(cs[1], cs[2]) OR contains(cs[2], cs[1]))) AS same_company, same_year FROM g)
    SELECT *, same_country AND same_doc_type AND same_company AND same_year AS consistent FROM c"""
)
def consistency(spark, sf_dir):
    return reports.consistency(endpoint_log(spark, sf_dir))


@query(
    """WITH e AS (SELECT 'http://' || h || ':' || p AS endpoint FROM (VALUES ('a'), ('b')) x(h), (VALUES (1), (2), (3)) y(p)), f AS (SELECT p_partkey AS file FROM part ORDER BY p_partkey LIMIT 50) SELECT file, endpoint FROM f, e"""
)
def benchmark_requests(spark, sf_dir):
    """The first fifty files, each asked of every endpoint."""
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file")).orderBy("file").limit(50)
    return reports.requests_for(files, ["a", "b"], [1, 2, 3])


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN turn % 3 ELSE len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) END AS tokens FROM conversations"""
)
def token_fallback(spark, sf_dir):
    """Reported tokens, or words where none are reported."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", reports.token_count((F.col("turn") % 3).cast("long"), F.col("text")).alias("tokens"))


@query(
    "SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'DEAD' WHEN arg_max(event_type, event_id) <> 'error' THEN 'OK' ELSE 'DOWN' END AS status FROM events GROUP BY 1"
)
def endpoint_status(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"))
    return last.select("user_id", reports.endpoint_status(F.col("last") != "error", F.col("user_id") % 7 == 0).alias("status"))


@query(
    f"""WITH {PROGRESS}, s AS (SELECT count(*) AS processed, count(*) FILTER (status = 'ok' AND source = 'template_cache') AS cache_hits, count(*) FILTER (status = 'ok' AND source <> 'template_cache') AS llm_calls,
      count(*) FILTER (status = 'error') AS errors FROM progress WHERE status <> 'pending_llm')
    SELECT *, processed / 100.0::DOUBLE AS files_per_sec, floor((1000000 - processed) / (processed / 100.0::DOUBLE))::BIGINT AS seconds_left FROM s"""
)
def session_counters(spark, sf_dir):
    return reports.session_counters(progress_seed(spark, sf_dir), 100.0, 1_000_000)


_VISION = """v AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'unreadable' END AS error, CASE WHEN c_custkey % 13 = 0 THEN 'blurred' END AS warning,
    CASE c_custkey % 5 WHEN 0 THEN ' north korea ' WHEN 1 THEN 'FRANCE' WHEN 2 THEN NULL WHEN 3 THEN '???' ELSE 'côte: sud/est' END AS country,
    CASE c_custkey % 7 WHEN 0 THEN 'not_a_document' WHEN 1 THEN 'id card' WHEN 2 THEN NULL ELSE 'pass<port>' END AS document_type FROM customer)"""


def _vision(spark, sf_dir):
    k = F.col("c_custkey")
    country = F.when(k % 5 == 0, " north korea ").when(k % 5 == 1, "FRANCE").when(k % 5 == 3, "???").when(k % 5 == 4, "côte: sud/est")
    kind = F.when(k % 7 == 0, "not_a_document").when(k % 7 == 1, "id card").when(k % 7 > 2, "pass<port>")
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), F.when(k % 11 == 0, "unreadable").alias("error"), F.when(k % 13 == 0, "blurred").alias("warning"), country.alias("country"), kind.alias("document_type")
    )


@query(
    f"""WITH {_VISION} SELECT k, CASE WHEN error IS NOT NULL THEN '_errors' WHEN document_type = 'not_a_document' OR warning IS NOT NULL THEN '_unknown'
      ELSE CASE k % 5 WHEN 0 THEN 'North_Korea' WHEN 1 THEN 'France' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'unknown' ELSE 'Côte_Sudest' END || '/' ||
           CASE k % 7 WHEN 1 THEN 'id_card' WHEN 2 THEN 'unknown' ELSE 'passport' END END AS folder FROM v"""
)
def vision_folder(spark, sf_dir):
    return reports.vision_folder(_vision(spark, sf_dir)).select("k", "folder")


@query(f"WITH {_VISION} SELECT coalesce(country, '?') || '/' || coalesce(document_type, '?') AS key, count(*) AS n FROM v WHERE error IS NULL GROUP BY 1")
def vision_counts(spark, sf_dir):
    return reports.vision_counts(_vision(spark, sf_dir))


_FAKES = """f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'unreadable' END AS error, CASE WHEN p_partkey % 2 = 0 THEN 'blurred' END AS warning,
    CASE WHEN p_partkey % 5 = 0 THEN 'John DOE' ELSE p_name END AS full_name, lpad(p_partkey::VARCHAR, 7, '0') AS document_number FROM part)"""


@query(
    f"""WITH {_FAKES} SELECT k, CASE WHEN error IS NULL AND ({" OR ".join(f"contains(lower({c}), '{p}')" for c in ("full_name", "document_number") for p in SUSPICIOUS_PATTERNS)}) THEN 'suspicious_data' ELSE warning END AS warning FROM f"""
)
def suspicious_values(spark, sf_dir):
    """Results whose fields look invented."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("k"), F.when(k % 11 == 0, "unreadable").alias("error"), F.when(k % 2 == 0, "blurred").alias("warning"), F.when(k % 5 == 0, "John DOE").otherwise(F.col("p_name")).alias("full_name"),
        F.lpad(k.cast("string"), 7, "0").alias("document_number"),
    )
    return reports.mark_suspicious(rows, ["full_name", "document_number"]).select("k", "warning")


@query(
    """WITH e AS (SELECT DISTINCT 'host' || user_id % 40 AS endpoint FROM events), p AS (SELECT 'host' || user_id % 40 AS endpoint, event_id, event_type <> 'error' AS ok FROM events WHERE user_id % 40 <> 7)
    SELECT e.endpoint, arg_max(ok, event_id) AS available, max(event_id) AS probed_at, count(event_id) AS probes FROM e LEFT JOIN p USING (endpoint) GROUP BY 1"""
)
def endpoint_probes(spark, sf_dir):
    """What the latest probe of every endpoint said; the third column counts probes that got no answer at all as none."""
    e = table(spark, sf_dir, "events").withColumn("endpoint", F.concat(F.lit("host"), (F.col("user_id") % 40).cast("string")))
    probes = e.filter("user_id % 40 <> 7").select("endpoint", F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return reports.probed(e.select("endpoint").distinct(), probes).withColumn("probes", F.coalesce("probes", F.lit(0)))


@query("SELECT CASE event_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN NULL ELSE 'Unknown' END AS country, count(*) AS n FROM events GROUP BY 1")
def notebook_counts(spark, sf_dir):
    """A field that is there, null, or absent."""
    r = F.when(F.col("event_id") % 3 == 0, F.lit('{"country": "x"}')).when(F.col("event_id") % 3 == 1, F.lit('{"country": null}')).otherwise("{}")
    return reports.notebook_counts(table(spark, sf_dir, "events").select(r.alias("result")), "country", "Unknown")


@query(
    """WITH t AS (SELECT event_id, ts, date_trunc('day', ts) + INTERVAL 1380 MINUTE AS s FROM events), n AS (SELECT event_id, floor(epoch_us(CASE WHEN s <= ts THEN s + INTERVAL 1 DAY ELSE s END) / 1000000.0 - epoch_us(ts) / 1000000.0)::BIGINT AS seconds FROM t)
    SELECT event_id, seconds, seconds // 3600 || 'h ' || seconds % 3600 // 60 || 'm' AS shown FROM n"""
)
def time_until_night(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", progress.seconds_until(F.col("ts"), 1380).alias("seconds"))
    return e.withColumn("shown", progress.hours_minutes(F.col("seconds")))


@query(
    f"""WITH {PROGRESS}, w AS (SELECT *, status IN ('pending', 'pending_llm') AND id % 3 = 0 AS gone FROM progress)
    SELECT id, CASE WHEN gone THEN 'error' ELSE status END AS status, CASE WHEN gone THEN 'File not found (already moved?)' ELSE error_msg END AS error_msg FROM w"""
)
def missing_files(spark, sf_dir):
    p = progress_seed(spark, sf_dir)
    return progress.missing_files(p, p.filter("id % 3 > 0").select("file_path")).select("id", "status", "error_msg")


@query(f"WITH {PROGRESS}, s AS (SELECT folder, {_MEASURES} FROM progress GROUP BY folder) SELECT folder, total, ok, errors, pending + pending_llm AS pending FROM s")
def folder_rollup(spark, sf_dir):
    return progress.folder_rollup(progress.folder_stats(progress_seed(spark, sf_dir)))


@query(
    """WITH l AS (SELECT conv_id, turn, role <> 'system' AS later, CASE role WHEN 'system' THEN 'Instructions: ' WHEN 'assistant' THEN 'Assistant: ' ELSE 'User: ' END || text AS line FROM conversations)
    SELECT conv_id, md5(string_agg(line, chr(10) || chr(10) ORDER BY later, turn, line) || chr(10) || chr(10) || 'Assistant:') AS digest FROM l GROUP BY 1"""
)
def chat_flatten(spark, sf_dir):
    return chat.flatten(table(spark, sf_dir, "conversations")).select("conv_id", F.md5("prompt").alias("digest"))


@query(
    """WITH l AS (SELECT conv_id, turn, role, array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), ' +', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS shown FROM conversations)
    SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END AS role, md5('user=Answer in JSON.|user=text one|model={}|user=' || shown) AS digest FROM l"""
)
def chat_messages(spark, sf_dir):
    """The prompt for every turn's text, with roles as another model names them."""
    said = chat.messages(F.coalesce("text", F.lit("")), "Answer in JSON.", [("text one", "{}")])
    shown = F.array_join(F.transform(said, lambda m: F.concat(chat.role_for_model(m["role"]), F.lit("="), m["content"])), "|")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.role_for_model(F.col("role")).alias("role"), F.md5(shown).alias("digest"))


@query("SELECT event_id, hour(ts) * 60 + minute(ts) >= 1380 OR hour(ts) * 60 + minute(ts) < 360 AS is_night, hour(ts) * 60 + minute(ts) >= 1380 OR hour(ts) * 60 + minute(ts) < 360 OR event_id % 7 = 0 AS may_ask FROM events")
def night_mode(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", can_use_llm(F.hour("ts"), F.minute("ts")).alias("is_night"), can_use_llm(F.hour("ts"), F.minute("ts"), force=F.col("event_id") % 7 == 0).alias("may_ask")
    )


@query("SELECT doc_id, ['a', 'b', 'c'][(row_number() OVER (ORDER BY doc_id) - 1) % 3 + 1] AS endpoint FROM documents")
def round_robin(spark, sf_dir):
    return reports.round_robin(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", ["a", "b", "c"])


def _suffixed(suffixes: str) -> str:
    name = f"trim(regexp_extract({HEAD}, '([A-Z][A-Za-z]+(?:\\s+[A-Z][A-Za-z]+){{0,3}})\\s+(?:{suffixes})', 1))"
    return f"CASE WHEN length({name}) BETWEEN 3 AND 50 THEN lower({name}) END"


@query(
    f"""WITH g AS (SELECT doc_id, text, {_normal("text")} AS n, concat_ws('|', {", ".join(_offset(k) for k in ("amount", "date", "email", "iban", "vat"))}) AS s FROM documents),
    p AS (SELECT doc_id, CASE WHEN n = '' THEN 'empty' ELSE substring(n, 1, 500) END AS h, CASE WHEN n = '' THEN 'empty' ELSE 's' || s END AS s,
      CASE WHEN n <> '' THEN coalesce({_suffixed("GMBH|AG|SA|SAS|SRL|LTD|PLC|INC|BV|NV|SP Z O O")}, {_suffixed("ENERGIE|ENERGY|TELECOM|MOBILE|BANK")}) END AS c FROM g),
    j AS (SELECT a.doc_id, a.doc_id <> b.doc_id AS other, b.doc_id AS b_id, a.h = b.h AS h, a.s = b.s AS s, coalesce(a.c = b.c, false) AS c, a.c IS NOT DISTINCT FROM b.c AS c0,
      coalesce(a.c <> b.c AND (contains(a.c, b.c) OR contains(b.c, a.c)), false) AS within FROM p a, p b)
    SELECT doc_id, min(b_id) FILTER (h AND s AND c0) AS class_id, count(*) FILTER (other AND h AND s AND c0) AS n_same, count(*) FILTER (other AND h) AS n_header, count(*) FILTER (other AND s) AS n_structure,
      count(*) FILTER (other AND c) AS n_hint, count(*) FILTER (within) AS n_contained FROM j GROUP BY 1"""
)
def fingerprint_similarity(spark, sf_dir):
    """For every document how many others share its fingerprint, header, structure or hint, or have a hint that holds its own or lies in it."""
    return likeness.likeness_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_headers(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


