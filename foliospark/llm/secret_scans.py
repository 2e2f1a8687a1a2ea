"""Secret scans: certain secrets by pattern, weak ones by linking the parts of a credential.

Certain spans are assignments (``assign``), access identifiers (``access``) and long hex strings
(``hex``). Weak candidates are identifiers given by a label (``ident``), opaque mixed-case tokens
(``opaque``) and endpoints (``endpoint``). An interval join within scopes of ``scope`` characters
links identifiers to secrets and endpoints; a weak candidate is reported only where complementary
parts co-occur: an ``ident`` beside a secret, an ``opaque`` beside an identifier, an ``endpoint``
beside both an identifier and a secret. Only DataFrame functions are used.

Defined results: a null text counts as empty and has no spans. Rows that repeat are scanned alike
and all returned; a null id is kept. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_spans import match_spans, render
from .store import materialize

# Fixed values of the contract.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]++)"
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?:\G|(?<![0-9a-f]))[0-9a-f]{32,}+"

IDENT = r"(?i:access_?key_?id|client_?id|account_?id|user_?name|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.@-]{3,}+"
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+={0,2}"
ENDPOINT = r"(?<![A-Za-z0-9])(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp)://[^\s\"'<>]++"

SCOPE = 200


def _mixed(m: Column) -> Column:
    return m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: id, base and linked spans as arrays of (start, ord, end, kind)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    t = F.col("_t")
    low = F.col("_t")
    found = (
        docs.select(F.col(id_col).alias("_id"), text.alias("_t"))
        .select(
            "_id",
            F.xxhash64("_t").alias("_h"),
            match_spans(t, ASSIGN, "assign", 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 8, low.rlike("[:=]")).alias("a"),
            match_spans(t, ACCESS, "access", 1, None, t.contains("AKIA")).alias("b"),
            match_spans(t, HEX, "hex", 2).alias("c"),
            match_spans(t, IDENT, "ident", 3, None, low.rlike("[:=]")).alias("d"),
            match_spans(t, OPAQUE, "opaque", 4, _mixed).alias("e"),
            match_spans(t, ENDPOINT, "endpoint", 5, None, t.contains("://")).alias("f"),
        )
        .select("_id", "_h", F.concat("a", "b", "c").alias("base"), F.concat("d", "e", "f").alias("weak"))
    )
    found = materialize(found, "secret_spans")

    # every candidate once a row; identical rows have identical spans, so the set of rows is enough
    spans = (
        found.filter(F.size("weak") > 0)
        .select("_id", "_h", F.explode(F.array_union("base", "weak")).alias("s"))
        .select("_id", "_h", "s.start", "s.end", "s.kind", "s.ord")
        .distinct()
    )
    role = F.when(F.col("kind").isin("access", "ident"), "identifier").when(F.col("kind") == "endpoint", "endpoint").otherwise("secret")
    spans = materialize(spans.withColumn("role", role), "secret_candidates")
    first, last = F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope)
    weak = spans.filter(F.col("ord") >= 3).withColumn("cell", F.explode(F.sequence(first, last)))
    # a partner lies in every cell it touches, so it is found from inside as well
    other = (
        spans.filter(F.col("role") != "endpoint")
        .select(
            "_id", "_h", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("role").alias("o_role"),
            F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("cell"),
        )
    )
    linked = (
        weak.alias("w")
        .join(
            other.alias("o"),
            F.col("w._id").eqNullSafe(F.col("o._id"))
            & (F.col("w._h") == F.col("o._h"))
            & (F.col("w.cell") == F.col("o.cell"))
            & (F.col("w.role") != F.col("o.o_role"))
            & (F.col("o_start") < F.col("w.end") + scope)
            & (F.col("o_end") > F.col("w.start") - scope),
        )
        .groupBy("w._id", "w._h", "w.start", "w.end", "w.kind", "w.ord")
        .agg(F.max((F.col("o_role") == "identifier").cast("int")).alias("id_near"), F.max((F.col("o_role") == "secret").cast("int")).alias("secret_near"))
    )
    kept = linked.filter(
        ((F.col("kind") == "ident") & (F.col("secret_near") == 1))
        | ((F.col("kind") == "opaque") & (F.col("id_near") == 1))
        | ((F.col("kind") == "endpoint") & (F.col("id_near") == 1) & (F.col("secret_near") == 1))
    )
    added = kept.groupBy(F.col("_id").alias("a_id"), F.col("_h").alias("a_h")).agg(
        F.sort_array(F.collect_list(F.struct("start", "ord", "end", "kind"))).alias("added")
    )
    none = F.array().cast("array<struct<start:bigint,ord:int,end:bigint,kind:string>>")
    return found.join(added, F.col("_id").eqNullSafe(F.col("a_id")) & (F.col("_h") == F.col("a_h")), "left").select(
        F.col("_id").alias(id_col), "base", F.coalesce("added", none).alias("added")
    )


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the certain spans, and all spans as text."""

    def count(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    return scanned.select(
        F.col(id_col), count("assign"), count("access"), count("hex"),
        F.sha2(render(F.col("base")), 256).alias("base_sha256"),
        render(F.concat("base", "added")).alias("spans"),
    )
