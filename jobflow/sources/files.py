"""Text, JSON and CSV inputs."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from jobflow.functions.text import strip
from jobflow.operators.indexing import with_row_index
from jobflow.operators.keywords import parse_keywords
from jobflow.schema import BROAD_POSTING, REGISTRY_RECORD


#: lines per chunk of a running sum over a file
CHUNK_LINES = 100_000
#: bytes of profiles that one task reads
READ_BYTES = 1 << 26
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_lines(spark: SparkSession, path: str, trimmed: bool = True) -> DataFrame:
    """(seq, line) in file order; blank lines dropped and ends trimmed unless told otherwise."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
    )
    if trimmed:
        lines = lines.withColumn("line", strip(F.col("line"))).where(F.col("line") != "")
    return with_row_index(lines, ["file", "block", "at"], "seq").select("seq", "line")


def json_strings(lines: DataFrame, arrays: bool = False) -> DataFrame:
    """(seq, pos, row): strings of JSON array text; elements that are not strings are dropped.

    With ``arrays`` every line is an array of its own. Otherwise the lines are those of one
    pretty-printed array: a line is an element, and only elements of the outer array count, so
    strings inside a nested list or object are dropped with it. Depth follows from the brackets
    that open and close on the lines before, outside strings; its running sum is taken per chunk
    of lines, then over the chunks.
    """
    text = F.regexp_replace("line", r",\s*$", "")
    value = F.try_parse_json(text)
    if arrays:
        items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
        strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
        return lines.select("seq", F.posexplode(strings).alias("pos", "v")).select(
            "seq", "pos", F.try_variant_get("v", "$", "string").alias("row")
        )
    bare = F.regexp_replace(F.regexp_replace("line", r"\\.", ""), '"[^"]*"', "")  # without escapes, then strings
    step = F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]"))
    chunked = lines.select("seq", text.alias("text"), value.alias("v"), step.alias("step"), F.floor(F.col("seq") / CHUNK_LINES).alias("chunk"))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    opened = chunked.groupBy("chunk").agg(F.sum("step").alias("all")).select(
        "chunk", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("opened"))
    inside = Window.partitionBy("chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.col("opened") + F.coalesce(F.sum("step").over(inside), F.lit(0))
    return chunked.join(opened, "chunk").withColumn("depth", depth).where(
        (F.col("depth") == 1) & F.col("v").isNotNull() & (F.schema_of_variant("v") == "STRING")
    ).select("seq", F.lit(0).alias("pos"), F.try_variant_get("v", "$", "string").alias("row"))


def read_mailbox(spark: SparkSession, path: str, arrays: bool = False) -> DataFrame:
    """Mailbox rows (seq, row) from a pretty-printed JSON array file, or from lines that are arrays."""
    rows = json_strings(read_lines(spark, path), arrays)
    return with_row_index(rows.withColumnRenamed("seq", "line"), ["line", "pos"], "seq").select("seq", "row")


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """(keyword, at) of a saved keyword file: a row per keyword, first spelling, in file order of ``at``."""
    pieces = read_lines(spark, path).select("seq", F.posexplode(parse_keywords(F.col("line"))).alias("pos", "keyword"))
    first = pieces.groupBy(F.lower("keyword").alias("low")).agg(F.min(F.struct("seq", "pos", "keyword")).alias("first"))
    return first.select("first.keyword", F.struct("first.seq", "first.pos").alias("at"))


def read_registry(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """Raw registry from JSON lines, or from one JSON array per file."""
    return spark.read.schema(REGISTRY_RECORD).json(path, multiLine=array_file)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result CSV as text columns, by the names of its header; a missing or empty one has no rows and
    all fields of a posting."""
    none = spark.createDataFrame([], BROAD_POSTING).drop("seq")
    try:
        found = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    except AnalysisException:
        return none
    return found if found.columns else none


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of uploaded plain-text or markdown profiles. Folders are listed by some tasks per
    core: Spark's own number is a task per folder, up to 10,000. Files are read by some tasks per core, more
    only where a task would get over ``READ_BYTES``: Spark's own number is a task per 32 small files."""
    before, some = spark.conf.get(_LISTING, None), 4 * spark.sparkContext.defaultParallelism
    spark.conf.set(_LISTING, str(some))
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md}").load(path)
    finally:
        spark.conf.unset(_LISTING) if before is None else spark.conf.set(_LISTING, before)
    size = int(files._jdf.queryExecution().analyzed().stats().sizeInBytes())  # of the listed files
    files = files.coalesce(max(some, -(-size // READ_BYTES)))
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
