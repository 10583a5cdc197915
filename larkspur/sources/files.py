"""Files as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import store
from larkspur.sources.conversations import extension
from larkspur.sources.shared import saved

# The extensions of text files, and the limits of a file that is taken in.
EXTENSIONS = ".go .py .js .ts .md .txt .yaml .yml .json .toml .rs .java .c .h .cpp .rb .php .sh .css .html .sql .xml .csv .log .env .cfg .ini .conf .jsonl".split()
LARGEST, SMALLEST_CONTENT = 10 * 1024 * 1024, 10


def wanted(path: Column, size: Column) -> Column:
    """Whether a file is taken in: not empty, at most 10 MiB, a text file's extension or none."""
    ext = extension(path)
    return (size > 0) & (size <= LARGEST) & ((ext == "") | ext.isin(EXTENSIONS))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (path, size, content) of the wanted files below a folder, large ones unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.filter((F.col("length") > 0) & (F.col("length") <= LARGEST)).filter(wanted(F.col("path"), F.col("length")))
    return files.select("path", F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("content")).filter(F.octet_length("content") >= SMALLEST_CONTENT)


def mined(files: DataFrame, wing: str, stored: DataFrame) -> DataFrame:
    """New drawers of files (path, content): the room is detected, the path is the source. Ids follow the paths. Rooms
    are those of the new drawers' own contents, so files of one path, of which each may be new, don't meet in pairs."""
    items = files.select(F.xxhash64("path").alias("drawer_id"), "content", F.lit(wing).alias("wing"), F.lit("facts").alias("hall"), F.col("path").alias("source_file"), F.lit("file").alias("source_type"))
    new = saved(store.add_drawers(stored, items).withColumn("_row", F.monotonically_increasing_id()), "mined")
    return new.join(store.detect_rooms(new, "_row", "content"), "_row").drop("_row")


def mining_report(files: DataFrame, new: DataFrame) -> DataFrame:
    """One row: files processed, drawers created, duplicates skipped."""
    return files.agg(F.count("*").alias("processed")).crossJoin(new.agg(F.count("*").alias("created"))).withColumn("duplicates", F.col("processed") - F.col("created"))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The question sets with haystack sessions: one row a question."""
    schema = "question_id string, question_type string, question string, answer variant, haystack_sessions array<array<struct<role:string,content:string>>>, haystack_session_ids array<string>, answer_session_ids array<string>"
    return spark.read.schema(schema).json(path, multiLine=True)


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """The long dialogues with questions: one row a sample."""
    schema = "sample_id string, qa array<struct<question:string,answer:variant,adversarial_answer:string,evidence:array<string>,category:int>>, conversation map<string,variant>"
    return spark.read.schema(schema).json(path, multiLine=True)


def read_evidence_cases(spark: SparkSession, path: str) -> DataFrame:
    """The evidence cases: one row a case."""
    schema = "evidenceItems array<struct<question:string,answer:string,category:string>>, conversations array<struct<id:string,containsEvidence:boolean,messages:array<struct<speaker:string,text:string>>>>, contextSize int"
    return spark.read.schema(schema).json(path, multiLine=True)
