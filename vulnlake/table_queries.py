"""Registered queries of table functions, joins by place, versioned files and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scan import register_scan_code
from .operators import metrics
from .operators.joins import as_of_join, containing
from .operators.reach import reachable
from .plans import jobs
from .query_sql import ORACLE_SQL as _SQL
from .query_sql import _FIX
from .samples import code_corpus, corpus_sql
from .schemas import FINDING_NAMES
from .sources.versions import FileTable
from .staging import shared_path
from .streaming import sessions as S
from .streaming import store
from .streaming.watch import latest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # A pattern: a stream takes a plain path for a folder, and tables may be files.
    return spark.readStream.schema(_table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def scan_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text rules through the table function, partitioned by file."""
    register_scan_code(spark)
    view = f"corpus_{uuid.uuid4().hex}"
    code_corpus(spark, sf_dir).select("file", "code").createOrReplaceTempView(view)
    return spark.sql(f"SELECT f.* FROM scan_code(TABLE(SELECT file, code FROM {view}) PARTITION BY file) f").select(*FINDING_NAMES)


def scan_function_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weaknesses in commands alone, file by file in a lateral join."""
    register_scan_code(spark)
    view = f"corpus_{uuid.uuid4().hex}"
    code_corpus(spark, sf_dir).select("file", "code").createOrReplaceTempView(view)
    rows = spark.sql(f"SELECT f.* FROM {view} c, LATERAL scan_code(c.file, c.code, cwes => 'CWE-78') f")
    return rows.select("file", "ruleId", "cweId", "severity", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"), "evidence")


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last view at or before it."""
    events = _table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("viewed_at"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return as_of_join(bought, views, ["user_id"], "ts", "viewed_at", tie=["view_id"])


def next_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view with the user's first error after it."""
    events = _table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select("user_id", F.col("ts").alias("failed_at"), F.col("event_id").alias("error_id"))
    viewed = events.where("event_type = 'view'").select("user_id", "ts", "event_id")
    return as_of_join(viewed, errors, ["user_id"], "ts", "failed_at", strict=True, direction="forward", tie=["error_id"])


def _incidents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clicks as points; errors as intervals of a length in seconds that follows their value."""
    events = _table(spark, sf_dir, "events")
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    points = events.where("event_type = 'click'").select("user_id", "event_id", second.alias("at"))
    spans = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), second.alias("begins"), (second + F.floor(F.col("value") * 3000)).alias("ends"))
    return points, spans


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containing(*_incidents(spark, sf_dir), ["user_id"], "at", "begins", "ends")


def innermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containing(*_incidents(spark, sf_dir), ["user_id"], "at", "begins", "ends", how="left", innermost=True)


def taint_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of ref_taint_closure over tables of edges and seeds."""
    orders = _table(spark, sf_dir, "orders")
    name = lambda c: F.concat(F.lit("v"), (F.col(c) % 40).cast("string"))
    rows = orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("file"), name("o_custkey").alias("src"), name("o_orderkey").alias("dst"), F.col("o_orderpriority").startswith("1").alias("seed"))
    return reachable(rows.where("seed").select("file", F.col("src").alias("name")), rows.select("file", "src", "dst"))


def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users by pauses of eight hours, as a stream puts them out."""
    path, values = shared_path(spark, "sessions"), {"total": "cents"}
    events = _stream(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    found = S.sessions(events, gap="8 hours", delay="2 hours", values=values)
    query = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("user_id bigint, started timestamp, ended timestamp, events bigint, total bigint").parquet(f"{path}/out")


def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions from the table."""
    events = _table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return S.closed(S.sessions(events, gap="8 hours", delay="2 hours", values={"total": "cents"}), events, delay="2 hours")


def latest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user from keyed state."""
    path = shared_path(spark, "latest")
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", store.PROVIDER)
    try:
        out = store.latest_contents(_stream(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ("ts", "event_id"))
        write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
        query = out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held) if held else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return latest(spark.read.parquet(f"{path}/out"), "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type", "saves")


def versioned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and their number of lines, after every third file was replaced and every seventh emptied."""
    table = FileTable(spark, shared_path(spark, "files"), buckets=16)
    rows = code_corpus(spark, sf_dir).select("file", F.size(F.split("code", "\n", -1)).cast("long").alias("lines"), "part_key")
    table.replace(rows.withColumn("version", F.lit(1)))
    table.replace(rows.where("part_key % 3 = 0").withColumn("lines", F.col("lines") + 1000).withColumn("version", F.lit(2)), keys=rows.where("part_key % 7 = 0"))
    return table.read().select("file", "lines", "version")


def observed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of an enriching run over suppliers as documents; every tenth can't be parsed. The write counts."""
    path = F.concat(F.lit("/src/part-"), (F.col("s_suppkey") * 3).cast("string"), F.lit(".py"))
    docs = _table(spark, sf_dir, "supplier").select(path.alias("path"), F.lit("SAFE-NONCWE").alias("cwe_folder"), F.when(F.col("s_suppkey") % 10 == 0, "{").alias("_corrupt_record"))
    counted = jobs.enrich_observed(docs, code_corpus(spark, sf_dir), shared_path(spark, "enriched"))
    return spark.createDataFrame([tuple(counted[k] for k in ("processed", "skipped", "errors"))], "processed bigint, skipped bigint, errors bigint")


def grouped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores by flag, by language and over all, in one pass; a line has one or two flags."""
    from .queries import _scores

    rows = _scores(spark, sf_dir).withColumn("flags", F.when(F.col("l_linenumber") == 1, F.array(F.lit("first"), "language")).otherwise(F.array("language")))
    out = metrics.grouped_means(rows.select("flags", "language", "fix", "reduced"), ["fix", "reduced"], ["flags", "language"])
    return out.select("grouping", "group", F.round("fix", 6).alias("fix"), F.round("reduced", 6).alias("reduced"), "samples")


QUERIES = {f"ref_{f.__name__}": f for f in (
    scan_function, scan_function_lateral, as_of, next_error, contained, innermost, taint_tables, session_stream, session_table, latest_stream, versioned_files, observed_counters, grouped_scores,
)}

_CLOSED = """WITH e AS (
  SELECT user_id, ts, CAST(round(value * 100) AS BIGINT) AS cents,
         CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL
), n AS (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM e
)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 8 HOUR AS ended, count(*) AS events, CAST(sum(cents) AS BIGINT) AS total FROM n GROUP BY user_id, nth
HAVING max(ts) + INTERVAL 8 HOUR <= (SELECT date_trunc('milliseconds', max(ts) - INTERVAL 2 HOUR) FROM events)"""
_POINTS = """points AS (SELECT user_id, event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS at_second FROM events WHERE event_type = 'click'),
spans AS (SELECT user_id, event_id AS error_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS begins, CAST(floor(epoch_us(ts) / 1000000) + floor(value * 3000) AS BIGINT) AS ends FROM events WHERE event_type = 'error')"""
_GROUPS = f"""s AS (SELECT CASE l_returnflag WHEN 'R' THEN 'java' WHEN 'A' THEN 'python' ELSE 'c' END AS language, l_linenumber, CAST({_FIX} AS DOUBLE) AS fix, l_quantity / 50 AS reduced FROM lineitem),
f AS (SELECT language AS flag, fix, reduced FROM s UNION ALL SELECT 'first', fix, reduced FROM s WHERE l_linenumber = 1)"""

ORACLE_SQL = {
    "ref_scan_function": _SQL["ref_text_findings"],
    "ref_scan_function_lateral": _SQL["ref_command_injection"],
    "ref_as_of": """SELECT p.user_id, p.ts, p.event_id, v.ts AS viewed_at, v.event_id AS view_id, v.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.ts <= p.ts
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC NULLS LAST, v.event_id DESC) = 1""",
    "ref_next_error": """SELECT p.user_id, p.ts, p.event_id, v.ts AS failed_at, v.event_id AS error_id
FROM (SELECT * FROM events WHERE event_type = 'view') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') v ON p.user_id = v.user_id AND v.ts > p.ts
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts NULLS LAST, v.event_id) = 1""",
    "ref_contained": f"""WITH {_POINTS} SELECT p.user_id, p.event_id, at_second AS "at", error_id, begins, ends FROM points p JOIN spans s ON p.user_id = s.user_id AND begins <= at_second AND at_second < ends""",
    "ref_innermost": f"""WITH {_POINTS} SELECT p.user_id, p.event_id, at_second AS "at", error_id, begins, ends FROM points p LEFT JOIN spans s ON p.user_id = s.user_id AND begins <= at_second AND at_second < ends
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY ends - begins, begins, error_id) = 1""",
    "ref_taint_tables": _SQL["ref_taint_closure"],
    "ref_session_stream": _CLOSED,
    "ref_session_table": _CLOSED,
    "ref_latest_stream": "SELECT user_id, event_id, event_type, count(*) OVER (PARTITION BY user_id) AS saves FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "ref_versioned_files": f"""WITH {corpus_sql()}, l AS (SELECT file, part_key, CAST(len(string_split(code, chr(10))) AS BIGINT) AS lines FROM corpus)
SELECT file, CASE WHEN part_key % 3 = 0 THEN lines + 1000 ELSE lines END AS lines, CASE WHEN part_key % 3 = 0 THEN 2 ELSE 1 END AS version FROM l WHERE part_key % 3 = 0 OR part_key % 7 <> 0""",
    "ref_observed_counters": _SQL["ref_run_counters"],
    "ref_grouped_scores": f"""WITH {_GROUPS}
SELECT 'flags' AS "grouping", flag AS "group", round(avg(fix), 6) AS fix, round(avg(reduced), 6) AS reduced, count(*) AS samples FROM f GROUP BY flag
UNION ALL SELECT 'language', language, round(avg(fix), 6), round(avg(reduced), 6), count(*) FROM s GROUP BY language
UNION ALL SELECT 'all', NULL, round(avg(fix), 6), round(avg(reduced), 6), count(*) FROM s""",
}
