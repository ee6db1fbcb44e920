"""Result files. Every writer is a distributed Spark write; folders replace single files."""

import os

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from jobflow.operators.evidence import registry_by_name
from jobflow.operators.indexing import with_row_index
from jobflow.schema import BROAD_FIELDS, COMPANY_FIELDS
from jobflow.session import make_folder

#: folders to which the files of a column's values are dealt
FOLDERS = 256
#: postings per chunk file of a run that does not say otherwise
CHUNK_ROWS = 10_000
_RULE = "\n\n" + "-" * 80 + "\n\n"

#: fixed values: labels of a posting in a text chunk
BROAD_LABELS = [
    ("Title:       ", "title"), ("Institution: ", "institution"), ("Location:    ", "location"),
    ("Source:      ", "source"), ("Posted:      ", "date_posted"), ("URL:         ", "url"),
]
COMPANY_LABELS = [
    ("Title:       ", "title"), ("Institution: ", "institution"), ("Location:    ", "location"),
    ("Source:      ", "source"), ("Posted:      ", "date_posted"), ("Career Page: ", "career_page"),
    ("ATS:         ", "ats_platform"), ("URL:         ", "url"),
]
BROAD_PLACEHOLDER, COMPANY_PLACEHOLDER = "(fetch from URL)", "(no description)"


def write_csv(df: DataFrame, path: str, fields=None) -> None:
    """Header, fixed columns, every value quoted, quotes doubled."""
    rows = df.select(*fields) if fields else df
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_broad_csv(df: DataFrame, path: str) -> None:
    write_csv(df, path, BROAD_FIELDS)


def write_company_csv(df: DataFrame, path: str) -> None:
    write_csv(df, path, COMPANY_FIELDS)


def _posting_text(number: Column, labels, placeholder: str) -> Column:
    lines = [F.lit("Job "), number.cast("string"), F.lit("\n")]
    for label, field in labels:
        lines += [F.lit(label), F.coalesce(field, F.lit("")), F.lit("\n")]
    body = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.lit(placeholder))
    return F.concat(*lines, F.lit("Description:\n"), body, F.lit(_RULE))


def text_chunks(df: DataFrame, order, rows: int = CHUNK_ROWS, company: bool = False) -> DataFrame:
    """(chunk_file, value): texts of ``rows`` postings each, in order."""
    labels, placeholder = (COMPANY_LABELS, COMPANY_PLACEHOLDER) if company else (BROAD_LABELS, BROAD_PLACEHOLDER)
    placed = with_row_index(df, order, "at")
    number = F.col("at") % rows + 1
    parts = placed.select(
        F.floor(F.col("at") / rows).alias("chunk"), number.alias("number"),
        _posting_text(number, labels, placeholder).alias("text"),
    )
    name = F.concat(F.lit("jobs_"), F.lpad((F.col("chunk") + 1).cast("string"), F.greatest(F.lit(4), F.length((F.col("chunk") + 1).cast("string"))), F.lit("0")), F.lit(".txt"))
    # a chunk never holds more than ``rows`` postings
    return parts.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("texts")).select(
        name.alias("chunk_file"), F.array_join(F.transform("texts", lambda t: t["text"]), "").alias("value")
    )


def write_text_chunks(df: DataFrame, path: str, order, rows: int = CHUNK_ROWS, company: bool = False) -> None:
    """One sub-folder per chunk; chunks of an earlier run are replaced."""
    chunks = text_chunks(df, order, rows, company)
    # the writer ends each value with a line feed, so the value gives up its own last one
    chunks = chunks.withColumn("value", F.expr("left(value, length(value) - 1)"))
    chunks.write.mode("overwrite").partitionBy("chunk_file").text(path)


def write_lines(df: DataFrame, path: str, line_sep: str = "\n") -> None:
    """One text column as lines."""
    df.write.mode("overwrite").option("lineSep", line_sep).text(path)


def write_text_per(df: DataFrame, key: str, path: str) -> None:
    """A text file per value of the integer column ``key``, with the column ``value`` of its rows as lines;
    the file's path has ``key=value`` in it.

    On a mounted folder the tasks write the files themselves, in ``FOLDERS`` folders: Spark's own writer
    starts processes there for the permissions of every file, and its commit moves one folder per file. A file
    appears whole under a name that follows from the key, so a task that runs again replaces it. Other
    stores get Spark's writer, a folder per value.
    """
    root = make_folder(df.sparkSession, path)
    if root is None:
        df.select(key, "value").repartition(key).write.mode("append").partitionBy(key).text(path)
        return
    name = F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit(".txt"))
    folder = F.concat(F.lit("folder="), F.pmod(F.hash(key), F.lit(FOLDERS)).cast("string"))
    lines = df.select(folder.alias("folder"), name.alias("name"), F.col("value").cast("binary").alias("value"))

    def run(batches):
        attempt, made, at, out, n = TaskContext.get().taskAttemptId(), set(), None, None, 0

        def close():
            out.close()
            os.replace(out.name, f"{root}/{at[0]}/{at[1]}")

        for batch in batches:
            for place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place[:2] != at:
                    if out is not None:
                        close()
                    at, n = place[:2], n + 1
                    if at[0] not in made:
                        os.makedirs(f"{root}/{at[0]}", exist_ok=True)
                        made.add(at[0])
                    out = open(f"{root}/{at[0]}/.{at[1]}.{attempt}", "wb")  # noqa: SIM115 (rows of a file may span batches)
                out.write((place[2] or b"") + b"\n")
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    dealt = lines.repartition("folder", "name").sortWithinPartitions("folder", "name")
    dealt.mapInArrow(run, "files long").write.format("noop").mode("overwrite").save()


def write_unmatched(unmatched: DataFrame, path: str) -> None:
    """Unmatched mailbox rows with separator lines."""
    write_lines(unmatched.select("row"), path, "\n---\n")


def registry_rows(registry: DataFrame) -> DataFrame:
    """Registry in CSV form: lists joined by semicolons."""
    lists = [c for c in ("ats_hints", "company_domains", "sender_domains", "sender_emails", "aliases") if c in registry.columns]
    return registry.select("company", "count", *[F.array_join(c, ";").alias(c) for c in lists])


def write_registry(registry: DataFrame, path: str) -> None:
    """Registry as JSON, CSV and name list, sorted by name."""
    ordered = registry_by_name(registry)
    ordered.write.mode("overwrite").json(f"{path}/json")
    registry_rows(ordered).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")
    write_lines(ordered.select("company"), f"{path}/names")


def write_registry_rows(rows: DataFrame, path: str) -> None:
    """The rows behind a registry, one JSON line per company and row, beside its records."""
    rows.select("company", "at", "row").write.mode("overwrite").json(f"{path}/rows")


def write_report(totals: DataFrame, ranked: DataFrame, unmatched: DataFrame, path: str) -> None:
    """Report: totals, companies by count, first unmatched rows. Companies stay one row each."""
    totals.write.mode("overwrite").json(f"{path}/totals")
    ranked.withColumn("sources", F.array(F.lit("rows"))).write.mode("overwrite").json(f"{path}/companies")
    unmatched.write.mode("overwrite").json(f"{path}/unmatched")


def write_keywords(keywords: DataFrame, path: str) -> None:
    """Keyword file from a frame with a ``keywords`` array."""
    write_lines(keywords.select(F.explode("keywords").alias("keyword")), path)
