"""Files to rows and back: message files, NDJSON, listings of archives, link and file-name extraction, chunking."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import scalars as S

MESSAGE = "text string, speaker string, timestamp string, conversation_id string, tenant_id string, group_id string, message_id string, metadata map<string,string>"
# The data set of each source, the filing forms, and when a request is tried again.
DATASETS = {"fannie": "fhfa_enterprise_pudb", "ginnie": "disclosure_data_bulk", "edgar": "cmbs_abs_ee"}
FORMS = ("ABS-EE", "ABS-EE/A")
EXHIBIT = r"(?i)^.*102.*\.xml$"
RETRY_CODES = (429, 500, 502, 503, 504)
TRIES, SPACING = 5, 0.12
RECORD = "source string, dataset string, record_id string, event_date string, file_path string, metadata map<string,string>"


def read_messages(spark: SparkSession, path: str, now: str, tenant: str = "default", conversation: str = "default") -> tuple[DataFrame, DataFrame]:
    """A document {"messages": [...]} to message rows and, apart, the rows that lack a text or speaker."""
    raw = spark.read.schema(f"messages array<struct<{', '.join(f'{c.split()[0]}:{c.split(None, 1)[1]}' for c in _columns(MESSAGE))}>>").option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("messages").alias("seq", "m")).select("seq", "m.*")
    rows = rows.withColumn("conversation_id", F.coalesce("conversation_id", F.lit(conversation))).withColumn("tenant_id", F.coalesce("tenant_id", F.lit(tenant)))
    rows = rows.withColumn("group_id", S.effective_group(F.col("group_id"), F.col("conversation_id"))).withColumn("timestamp", S.parse_time(F.coalesce("timestamp", F.lit(now))))
    rows = rows.withColumn("message_id", F.coalesce("message_id", F.substring(F.sha2(F.concat_ws(":", "conversation_id", "seq", "text"), 256), 1, 16)))
    good = F.col("text").isNotNull() & F.col("speaker").isNotNull()
    return rows.where(good), rows.where(~good)


def _columns(ddl: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return [*out, word.strip()]


def read_ndjson(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(parts: DataFrame | dict[str, DataFrame], path: str) -> None:
    """A report as indented JSON, written by Spark, so the path may be on any file system: a one-row result, or lists of rows by name.  Reports are small by nature: totals, metrics, bins."""
    rows = lambda df: [json.loads(r) for r in df.toJSON().collect()]
    report = {k: rows(df) for k, df in parts.items()} if isinstance(parts, dict) else (rows(parts.limit(1)) or [{}])[0]
    spark = (next(iter(parts.values())) if isinstance(parts, dict) else parts).sparkSession
    spark.createDataFrame([(json.dumps(report, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def export(tables: dict[str, DataFrame], tenant: str, path: str) -> None:
    for name, df in tables.items():
        (df.where(F.col("tenant_id") == tenant) if "tenant_id" in df.columns else df).write.mode("overwrite").json(f"{path}/{name}")


#: Rows of a file of a stored graph.
FILE_ROWS = 1_000_000


def write_graph(edges: DataFrame, path: str, *, file_rows: int = FILE_ROWS) -> None:
    """Edges by tenant, current ones apart from history, in files of near start times, with a manifest of the files.

    Tenant, state and start settle the range a row falls in, so a file holds a
    stretch of time; within it rows are sorted by source.  The manifest has a row
    for each file: tenant, whether current, rows, least and greatest source, least start
    and greatest end of truth and of belief (null: open).  The schema is kept with it.
    """
    spark = edges.sparkSession
    current = edges["valid_to"].isNull() & edges["recorded_to"].isNull()
    n = max(1, -(-edges.count() // file_rows))
    by = ["tenant_id", "current", "valid_from", "source_id"]
    edges.withColumn("current", current).repartitionByRange(n, *by).sortWithinPartitions("tenant_id", "current", "source_id", "valid_from").write.mode("overwrite").partitionBy("tenant_id", "current").parquet(f"{path}/data")
    spark.createDataFrame([(edges.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    rows = _graph_rows(spark, path, [f"{path}/data"])
    last = lambda c: F.when(F.count_if(F.col(c).isNull()) == 0, F.max(c)).alias(f"{c}_last")
    files = rows.groupBy("tenant_id", "current", F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("source_id").alias("source_first"), F.max("source_id").alias("source_last"), *[F.min(f"{x}_from").alias(f"{x}_first") for x in ("valid", "recorded")], last("valid_to"), last("recorded_to"),
    )
    files.coalesce(1).write.mode("overwrite").parquet(f"{path}/files")


def _graph_schema(spark: SparkSession, path: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema", wholetext=True).first()[0]))


def _graph_rows(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """Rows of the files with the types they had when written, those of the folders' names too."""
    schema = _graph_schema(spark, path)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("current", T.BooleanType())])).option("basePath", f"{path}/data").parquet(*files)


def graph_files(spark: SparkSession, path: str, *, tenant: str | None = None, current: bool | None = None, source: str | None = None, valid_at: Column | None = None, known_at: Column | None = None) -> DataFrame:
    """The manifest's rows of files that may hold such edges; an interval axis that isn't asked for excludes nothing."""
    files = spark.read.parquet(f"{path}/files")
    for name, value in (("tenant_id", tenant), ("current", current)):
        files = files.where(F.col(name) == value) if value is not None else files
    files = files.where((F.col("source_first") <= source) & (F.col("source_last") >= source)) if source is not None else files
    for axis, at in (("valid", valid_at), ("recorded", known_at)):
        end = F.col(f"{axis}_to_last")
        files = files.where((F.col(f"{axis}_first") <= at) & (end.isNull() | (end > at))) if at is not None else files
    return files


def read_graph(spark: SparkSession, path: str, tenant: str | None = None, current: bool | None = None, **asked) -> DataFrame:
    """The edges that write_graph wrote, with their types.  The manifest chooses the files (see graph_files), so others aren't opened, and rows are filtered by the same."""
    names = [r["file"] for r in graph_files(spark, path, tenant=tenant, current=current, **asked).select("file").collect()]  # a row for each FILE_ROWS edges
    if not names:
        return spark.createDataFrame([], T.StructType([*_graph_schema(spark, path).fields, T.StructField("current", T.BooleanType())]))
    rows = _graph_rows(spark, path, names)
    rows = rows.where(F.col("tenant_id") == tenant) if tenant is not None else rows
    rows = rows.where(F.col("current") == current) if current is not None else rows
    rows = rows.where(F.col("source_id") == asked["source"]) if asked.get("source") is not None else rows
    for axis, at in (("valid", asked.get("valid_at")), ("recorded", asked.get("known_at"))):
        rows = rows.where((F.col(f"{axis}_from") <= at) & (F.col(f"{axis}_to").isNull() | (F.col(f"{axis}_to") > at))) if at is not None else rows
    return rows.select(*_graph_schema(spark, path).names, "current")


EVIDENCE = "array<struct<message_id string, text string, context string, observed_at string>>"


def decode_edges(rows: DataFrame) -> DataFrame:
    """Edges as a store keeps them (JSON strings and ISO times) to typed rows; what can't be read becomes null, evidence an empty list."""
    times = {c: S.parse_time(F.col(c)) for c in ("valid_from", "valid_to", "recorded_from", "recorded_to") if dict(rows.dtypes).get(c) == "string"}
    evidence = {"structured_evidence": F.coalesce(F.from_json("structured_evidence", EVIDENCE), F.array().cast(EVIDENCE))} if "structured_evidence" in rows.columns else {}
    return rows.withColumns(times | evidence | {"version": F.coalesce(F.col("version").cast("long"), F.lit(1)), "confidence": F.col("confidence").cast("double")})


def decode_entities(rows: DataFrame) -> DataFrame:
    """Entities as a store keeps them; missing lists are empty, metadata is a map of strings."""
    times = {c: S.parse_time(F.col(c)) for c in ("created_at", "last_mentioned") if dict(rows.dtypes).get(c) == "string"}
    lists = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("aliases", "source_messages")}
    return rows.withColumns(times | lists | {"metadata": F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))})


def decode_facts(rows: DataFrame) -> DataFrame:
    """Facts as a store keeps them to typed rows with their status."""
    times = {c: S.parse_time(F.col(c)) for c in ("valid_from", "valid_to") if dict(rows.dtypes).get(c) == "string"}
    return rows.withColumns(times | {"confidence": F.col("confidence").cast("double")}).withColumn("status", F.when(F.col("valid_to").isNull(), "active").otherwise("superseded"))


def meta_dates(spark: SparkSession, path: str) -> DataFrame:
    """file_path and filing date of each *.meta.json; null where the file is no JSON or the date no text."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").text(path, wholetext=True)
    date = F.try_variant_get(F.try_parse_json("value"), "$.filing_date", "variant")
    return raw.select(F.col("_metadata.file_path").alias("file_path"), F.when(F.schema_of_variant(date) == "STRING", F.try_variant_get(date, "$", "string")).alias("filing_date"))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Filing records of *.meta.json files; malformed ones and those without text accession and date are left out."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").text(path, wholetext=True)
    j = F.try_parse_json("value")
    s = lambda k: F.try_variant_get(j, f"$.{k}", "string")
    typed = (F.schema_of_variant(F.try_variant_get(j, "$.accession", "variant")) == "STRING") & (F.schema_of_variant(F.try_variant_get(j, "$.filing_date", "variant")) == "STRING")
    rows = raw.where(typed).select(s("accession").alias("record_id"), s("filing_date").alias("event_date"), s("cik").alias("cik"), s("entity_name").alias("entity_name"), s("source_url").alias("source_url"), F.col("_metadata.file_path").alias("file_path"))
    meta = F.create_map(*[x for k in ("cik", "entity_name", "source_url") for x in (F.lit(k), F.col(k))])
    return rows.select(F.lit("edgar").alias("source"), F.lit(DATASETS["edgar"]).alias("dataset"), "record_id", "event_date", "file_path", meta.alias("metadata"))


def archives(spark: SparkSession, path: str, source: str, recursive: bool) -> DataFrame:
    """*.zip files by name and size, without their content; dates by year, or by month from the file's or the folder's name."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", recursive).load(path).select("path", "length")
    stem = F.regexp_extract("path", r"([^/]+)\.zip$", 1)
    year, month = S.extract_year(stem), F.coalesce(S.extract_yyyymm(stem), S.extract_yyyymm(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)))
    date = F.concat(year, F.lit("-01-01")) if not recursive else F.date_format(F.to_date(month, "yyyyMM"), "yyyy-MM-dd")
    return raw.select(F.lit(source).alias("source"), stem.alias("record_id"), date.alias("event_date"), F.col("path").alias("file_path"), F.col("length").alias("bytes"))


def corpus(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """Text files as messages; the id follows path and time of change."""
    raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"))
    return raw.withColumn("message_id", F.substring(F.sha2(F.concat_ws(":", "path", F.col("changed").cast("string")), 256), 1, 16))


def links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Distinct links of the pages with the number of pages that have them."""
    found = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(html_col, F.lit(r'href="([^"]+)"'), F.lit(1)))).alias("link"))
    return found.groupBy("link").agg(F.count(F.lit(1)).alias("pages"))


def zip_links(found: DataFrame, start_year: int) -> DataFrame:
    """Links to archives of the wanted series from a year on."""
    year = S.extract_year(F.col("link"))
    low = F.lower("link")
    return found.where(low.endswith(".zip") & (F.contains(low, F.lit("pudb")) | F.contains(low, F.lit("enterprise"))) & (year.isNull() | (year.cast("int") >= start_year))).select("link").distinct()


def period_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"_(20\d{2}(?:0[1-9]|1[0-2]))\.[A-Za-z]+$", 1), F.lit(""))


def latest_periods(files: DataFrame, n: int) -> DataFrame:
    """Files of the n latest distinct periods."""
    dated = files.withColumn("period", period_of(F.col("name"))).where(F.col("period").isNotNull())
    top = dated.select("period").distinct().orderBy(F.desc("period")).limit(n)
    return dated.join(F.broadcast(top), "period")


def with_prefix(files: DataFrame, prefixes: list[str]) -> DataFrame:
    return files.where(F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.col("name"), p)))


def recent_periods(today: Column, n: int) -> Column:
    """The months of the last n steps of 30 days, ascending, each once."""
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.date_format(F.date_sub(today, k * 30), "yyyyMM"))))


def cik_names(hits: DataFrame) -> DataFrame:
    """(seq, ciks, names) to the last name of each CIK."""
    pairs = hits.select("seq", F.posexplode(F.arrays_zip("ciks", "names")).alias("i", "p"))
    return pairs.groupBy(F.col("p.ciks").alias("cik")).agg(F.max_by("p.names", F.struct("seq", "i")).alias("name"))


def filings(submissions: DataFrame, start_date: str | None = None) -> DataFrame:
    """(cik, forms, accessions, dates) to a row per filing of the wanted forms, from a date on."""
    rows = submissions.select("cik", F.posexplode(F.arrays_zip("forms", "accessions", "dates")).alias("position", "f"))
    rows = rows.where(F.col("f.forms").isin(*FORMS)).select("cik", "position", F.col("f.accessions").alias("accession"), F.col("f.dates").alias("date"))
    return rows.where(F.col("date") >= start_date) if start_date else rows


def exhibit_name(names: Column) -> Column:
    """The first file name of a filing's index that is the exhibit; null if there is none."""
    return F.get(F.filter(names, lambda n: n.rlike(EXHIBIT)), F.lit(0))


def retry_delay(attempt: int, retry_after: str | None = None) -> float:
    """Seconds before a request is tried again: what the header asks for if it is a number above 0, else doubling from half a second."""
    try:
        asked = float(retry_after or 0)
    except ValueError:
        asked = 0.0
    return asked if asked > 0 else 0.5 * 2**attempt


def template_sha256(path: str) -> str:
    """Hex digest of a prompt template on the driver; empty if there is no such file."""
    file = Path(path)
    return hashlib.sha256(file.read_bytes()).hexdigest() if file.is_file() else ""


def safe_file_name(title: Column) -> Column:
    return F.substring(F.regexp_replace(title, r"[^A-Za-z0-9._-]+", "_"), 1, 100)


def chunk_text(docs: DataFrame, max_words: int = 4000, text_col: str = "text") -> DataFrame:
    """Paragraphs packed greedily; one that is over the limit alone is a chunk of its own."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        words = F.size(F.filter(F.split(p, r"\s+"), lambda w: w != ""))
        fits = (acc["n"] == 0) | (acc["n"] + words <= max_words)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
            F.when(acc["n"] == 0, p).when(fits, F.concat(acc["open"], F.lit("\n\n"), p)).otherwise(p).alias("open"),
            F.when(fits, acc["n"] + words).otherwise(words).alias("n"),
        )

    chunks = F.aggregate(F.filter(F.split(text_col, "\n\n"), lambda p: F.trim(p) != ""), zero, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    return docs.select("doc_id", F.posexplode(chunks).alias("chunk", "text"))
