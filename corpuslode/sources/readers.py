"""Readers of texts, extraction records, question sets, trace logs and SQL dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNKS = "array<struct<text:string,terms:array<string>,keywords:array<string>,start_char:int,end_char:int,entities:array<struct<text:string,label:string,score:double,start:int,end:int>>>>"
EXTRACTION = f"source_file string, avg_confidence double, total_entities int, is_low_confidence boolean, error string, headings array<struct<heading:string,level:int,chunks:{CHUNKS}>>"


def text_files(spark: SparkSession, path: str, pattern: str = "*.{md,txt}") -> DataFrame:
    """(path, text) of files below path, UTF-8 or else Latin-1."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1")).alias("text"))


def extractions(spark: SparkSession, path: str) -> DataFrame:
    """Extraction records of a folder of JSON files, doc_id the file's stem; records without chunks are left out."""
    rows = spark.read.schema(EXTRACTION).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    rows = rows.withColumn("doc_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))
    return rows.where(F.exists("headings", lambda h: F.size(h["chunks"]) > 0))


def chunk_rows(records: DataFrame) -> DataFrame:
    """A row for each chunk of extraction records (doc_id, headings), entities as label -> distinct texts in first order."""
    h = records.select("doc_id", F.posexplode("headings").alias("heading_index", "h"))
    c = h.select("doc_id", "heading_index", F.col("h.heading").alias("heading"), F.col("h.level").alias("level"), F.posexplode("h.chunks").alias("chunk_index", "c"))
    labels = F.array_distinct(F.transform("c.entities", lambda e: e["label"]))
    by_label = F.transform(labels, lambda x: F.struct(x.alias("label"), F.array_distinct(F.transform(F.filter("c.entities", lambda e: e["label"] == x), lambda e: e["text"])).alias("texts")))
    return c.select("doc_id", "heading_index", "heading", "level", "chunk_index", F.col("c.text").alias("text"), "c.keywords", "c.start_char", "c.end_char", by_label.alias("entities"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """The questions of benchmark files ({per_question: [...]})."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select(F.explode("per_question").alias("q")).select(F.col("q.id").alias("question_id"), F.col("q.question").alias("question"), F.col("q.target_doc_id").alias("target_doc_id"))


def parse_trace(lines: DataFrame) -> DataFrame:
    """(request_id, seq, stage, message) of log lines (value, line) `[request] stage=S | message`; others are left out."""
    part = lambda g: F.regexp_extract("value", r"^\[([^\]]+)\] stage=(\S+) \| (.*)$", g)
    rows = lines.select(part(1).alias("request_id"), part(2).alias("stage"), part(3).alias("message"), "line").where("request_id <> ''")
    return rows.select("request_id", F.row_number().over(Window.partitionBy("request_id").orderBy("line")).alias("seq"), "stage", "message")


def tagged_sentences(lines: DataFrame) -> DataFrame:
    """(doc, start, entity, label) of BIO-tagged lines (doc, line, token, tag): islands of B- and the I- that follow."""
    w = Window.partitionBy("doc").orderBy("line")
    rows = lines.withColumn("label", F.regexp_replace("tag", "^[BI]-", ""))
    begins = F.col("tag").startswith("B-") | (F.col("tag").startswith("I-") & ~F.coalesce((F.lag("label").over(w) == F.col("label")) & (F.lag("tag").over(w) != "O"), F.lit(False)))
    rows = rows.withColumn("island", F.sum(begins.cast("int")).over(w)).where("tag <> 'O'")
    spans = rows.groupBy("doc", "island").agg(F.min("line").alias("start"), F.array_sort(F.collect_list(F.struct("line", "token"))).alias("t"), F.first("label").alias("label"))
    return spans.select("doc", "start", F.array_join(F.transform("t", lambda x: x["token"]), " ").alias("entity"), "label")


def dump_rows(lines: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Rows of SQL dump lines (value) `INSERT INTO t VALUES (...),(...);`, the first row of a key kept."""
    tuples = F.regexp_extract_all("value", F.lit(r"\(((?:[^'()]|'(?:[^'\\]|''|\\.)*')*)\)"), F.lit(1))
    rows = lines.where(F.upper("value").startswith("INSERT INTO")).select(F.regexp_replace("value", r"(?i)^INSERT INTO .*? VALUES\s*", "").alias("value"))
    fields = F.regexp_extract_all("row", F.lit(r"('(?:[^'\\]|''|\\.)*'|[^,']+)(?:,|$)"), F.lit(1))
    rows = rows.select(F.explode(tuples).alias("row")).select(F.transform(fields, lambda x: F.trim(x)).alias("f"))
    plain = lambda x: F.when(F.upper(x) == "NULL", None).when(x.startswith("'"), F.regexp_replace(F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), "''", "'"), r"\\(.)", "$1")).otherwise(x)
    return rows.select(*[plain(F.get("f", F.lit(i))).alias(c) for i, c in enumerate(columns)]).dropDuplicates([key])


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term, list) of JSON files that hold lists of terms under their names."""
    raw = spark.read.option("wholetext", True).text(path)
    lists = raw.select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return lists.select(F.explode("m").alias("list", "terms")).select(F.explode("terms").alias("term"), "list").distinct()
