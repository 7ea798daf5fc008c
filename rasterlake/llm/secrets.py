"""Secret scans with an incremental blob ledger, in DataFrame and SQL functions only.

Every version of every path is addressed by the SHA-256 of its content.  The
ledger, a folder of Parquet files, has one row per (blob, rule version) that was
scanned: the spans found in it.  A scan takes the versions, drops the blobs that the
stored ledger has under the rule version, scans one copy of each of the rest, appends
to the ledger, reads it back, and joins the findings to all paths and versions that
hold the blob.  Copies are scanned once, and a later scan with the same ledger scans
only what is new; a new rule version scans all again.

Texts are read twice: once for their addresses, once to scan them where they stand.
Between, a list says which blobs are in the ledger and, for each that occurs more
than once, the one row whose text is scanned; texts are joined to that list by address.

Rules find leftmost non-overlapping matches.  Spans are (kind, start, end) in
code points, end exclusive.  The base kinds are assign, access and hex; pem and
token add headers of private keys and well-known token prefixes.

Edge cases.  Null content counts as empty, which has no spans.  Repeated
(path, version) rows each get their findings.  A blob with thousands of paths is
one row until the last join, whose hot keys adaptive execution splits.  Spans that
start together go in the order of the rules.  Very long texts are scanned whole.  No
rows: none.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, new_folder

#: Kind, pattern (for Java and RE2 alike), group that has a least length, that length.
RULES = [
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"(AKIA[A-Z0-9]+)", 20),
    ("hex", r"([0-9a-f]+)", 24),
    ("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1),
    ("token", r"((?:ghp_|gho_|xoxb-|xoxp-|sk_live_)[A-Za-z0-9-]+)", 20),
]
#: Changes with RULES: a ledger row counts only for the version that made it.
RULE_VERSION = 1
#: What a text must hold for a rule to be tried at all; a run of 24 is the only cheap test for hex.
_HINT = {
    "assign": "(?i)password|passwd|secret|token|api_?key",
    "access": "AKIA[A-Z0-9]{16}",
    "hex": "[0-9a-f]{24}",
    "pem": "PRIVATE KEY-----",
    "token": "ghp_|gho_|xoxb-|xoxp-|sk_live_",
}
_SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _rule_spans(text: Column, rank: int, kind: str, pattern: str, least: int) -> Column:
    """Spans of one rule: the text is taken apart into (gap, match, group) triples, whose lengths give the places."""
    whole = f"(?s)(.*?)(?:({pattern})|\\z)"
    parts = [F.regexp_extract_all(text, F.lit(whole), F.lit(i)) for i in (1, 2, 3)]
    sized = F.arrays_zip(*(F.transform(p, lambda x: F.length(x).cast("bigint")).alias(n) for p, n in zip(parts, "gmv")))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + x["g"], acc["at"] + x["g"] + x["m"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["v"] >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(_HINT[kind]), F.aggregate(sized, empty, step)["spans"]).otherwise(F.array().cast(_SPANS))


def spans_of(text: Column) -> Column:
    """All spans of a text, by start, then in the order of RULES."""
    return F.array_sort(F.concat(*(_rule_spans(text, i, k, p, n) for i, (k, p, n) in enumerate(RULES))))


#: Addresses (32 bytes) and spans (about 60) together up to which a list is broadcast; beyond, it is joined by a shuffle.
BROADCAST_BLOBS = 200_000
_LEDGER = f"blob_id binary, rule_version int, spans {_SPANS}"


class Ledger:
    """Scanned blobs in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame:
        """blob_id, rule_version, spans of everything scanned so far."""
        try:
            return self.spark.read.schema(_LEDGER).parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # only a folder that is not there yet is an empty ledger
                raise
            return self.spark.createDataFrame([], _LEDGER)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.folder)


def addressed(versions: DataFrame, path: str = "path", content: str = "content", version: str | None = None) -> DataFrame:
    """path, version (null if there is no such column), blob_id, content of every row."""
    text = F.coalesce(F.col(content), F.lit(""))
    number = F.col(version).cast("string") if version else F.lit(None).cast("string")
    return versions.select(F.col(path).alias("path"), number.alias("version"), F.unhex(F.sha2(text, 256)).alias("blob_id"), text.alias("content"))


def _few(blobs: DataFrame, name: str, weight: Column | None = None) -> DataFrame:
    """A written list of addresses, marked for broadcast up to BROADCAST_BLOBS; weight: what a row counts for."""
    table = gathered(blobs, name)
    size = table.agg(F.coalesce(F.sum(F.lit(1) if weight is None else weight), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= BROADCAST_BLOBS else table


def keys_of(blobs: DataFrame) -> DataFrame:
    """path, version and blob_id of every row, written."""
    return gathered(blobs.select("path", "version", "blob_id"), "addresses")


def scan_unseen(blobs: DataFrame, ledger: DataFrame | None, rule_version: int = RULE_VERSION, keys: DataFrame | None = None) -> DataFrame:
    """Ledger rows (blob_id, rule_version, spans) of blobs that the ledger has not under this rule version.

    ``keys`` are the written addresses of ``blobs``, if they are there already.  Of a
    repeated blob the row of the least (path, version) is scanned; of rows equal in all
    of these one ledger row is kept.
    """
    keys = keys_of(blobs) if keys is None else keys
    held = keys.groupBy("blob_id").agg(F.count("*").alias("n"), F.min(F.struct("path", "version")).alias("pick"))
    seen = F.lit(False)
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == rule_version).select("blob_id").distinct().withColumn("known", F.lit(True))
        held, seen = held.join(known, "blob_id", "left"), F.col("known").isNotNull()
    held = _few(held.select("blob_id", "n", "pick", seen.alias("seen")).filter((F.col("n") > 1) | F.col("seen")), "held")
    met = blobs.join(held, "blob_id", "left")
    picked = F.col("path").eqNullSafe(F.col("pick.path")) & F.col("version").eqNullSafe(F.col("pick.version"))
    unseen = met.filter(F.col("seen").isNull() | (~F.col("seen") & picked))
    return unseen.select("blob_id", F.lit(rule_version).alias("rule_version"), spans_of(F.col("content")).alias("spans")).dropDuplicates(["blob_id"])


def scan(versions: DataFrame, path: str = "path", content: str = "content", ledger: Ledger | None = None, version: str | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """path, version, blob_id, spans of every row; what was scanned is in the ledger (one of its own if none is given)."""
    spark = versions.sparkSession
    ledger = ledger or Ledger(spark, new_folder(spark, "ledger"))
    blobs = addressed(versions, path, content, version)
    keys = keys_of(blobs)
    ledger.append(scan_unseen(blobs, ledger.rows(), rule_version, keys))
    found = ledger.rows().filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob_id", "spans").dropDuplicates(["blob_id"])
    findings = keys.join(found, "blob_id", "left")
    return findings.select("path", "version", "blob_id", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(findings: DataFrame) -> DataFrame:
    spans = F.col("spans")

    def count(k: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")

    base = F.filter(spans, lambda s: s["rank"] < 3)
    return findings.select(F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mask."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        apart = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mask)).alias("out"))
        overlap = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] < acc["at"], overlap).otherwise(apart)

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), F.length(text))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns with secrets masked; n_chars, where there is one, follows the text."""
    spark = docs.sparkSession
    ledger = Ledger(spark, new_folder(spark, "ledger"))
    keyed = docs.withColumn("__blob", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    ledger.append(scan_unseen(addressed(docs, id_col, text_col), None))
    found = _few(ledger.rows().filter(F.size("spans") > 0).select(F.col("blob_id").alias("__blob"), F.col("spans").alias("__spans")), "found", F.size("__spans") + 1)
    out = keyed.join(found, "__blob", "left").withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(redacted(F.col(text_col), F.col("__spans"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast("bigint")))
    return out.select(*docs.columns)


def _sql() -> str:
    def rule(rank: int, kind: str, pattern: str, least: int) -> str:
        p = f"(?s)(.*?)(?:({pattern})|\\z)".replace("'", "''")
        return f"""
  SELECT r, {rank} AS rank, '{kind}' AS kind, s + g AS start, s + g + m AS stop FROM (
    SELECT r, g, m, v, coalesce(sum(g + m) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
      SELECT r, unnest(range(len(a))) AS i, length(unnest(a)) AS g, length(unnest(b)) AS m, length(unnest(c)) AS v FROM (
        SELECT r, regexp_extract_all(text, '{p}', 1) AS a, regexp_extract_all(text, '{p}', 2) AS b, regexp_extract_all(text, '{p}', 3) AS c FROM d
        WHERE regexp_matches(text, '{_HINT[kind].replace("'", "''")}'))))
  WHERE v >= {least}"""

    union = " UNION ALL ".join(rule(i, *r) for i, r in enumerate(RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({union}),
j AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans
  FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (r)
"""


SECRETS_SQL = _sql()
