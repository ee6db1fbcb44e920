"""Mailbox rows to company evidence."""

from pyspark.sql import DataFrame, Window, functions as F

from jobflow import rules
from jobflow.functions import names, text
from jobflow.session import cut_lineage

def match_rows(rows: DataFrame, owner_name: str | None = None) -> DataFrame:
    """Mailbox rows with the names they hold, their companies, and the evidence they carry (narrow)."""
    row = F.col("row")
    found = F.array_distinct(F.filter("named", lambda c: ~c.isin(rules.GENERIC_COMPANIES)))
    sender = F.when(
        F.col("sender_domain").isNotNull() & ~text.is_vendor_domain(F.col("sender_domain")),
        F.array("sender_domain"),
    ).otherwise(F.array().cast("array<string>"))
    return (
        text.computed(rows, "named", names.row_candidates(row, owner_name)).withColumn("companies", found)
        .withColumn("sender_email", text.sender_email(row))
        .withColumn("sender_domain", text.email_domain(F.col("sender_email")))
        .withColumn("ats_hints", text.ats_hints(row))
        .withColumn("company_domains", F.array_union(text.company_domains(row), sender))
    )


def unmatched_rows(matched: DataFrame) -> DataFrame:
    return matched.where(F.size("companies") == 0).select("seq", "row")


def union_sets(df: DataFrame, key: str, sets: dict) -> DataFrame:
    """Per key the sorted union of each array column. Values are made distinct in a map-side
    combined aggregate first, so a busy key shuffles its distinct values only."""

    def tagged(name, column):
        return F.transform(column, lambda v: F.struct(F.lit(name).alias("kind"), v.alias("value")))

    members = F.concat(*[tagged(name, column) for name, column in sets.items()])
    distinct = df.select(key, F.explode_outer(members).alias("m")).select(key, "m.kind", "m.value").distinct()
    return distinct.groupBy(key).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == name, F.col("value")))).alias(name)
        for name in sets
    ])


def first_rows(rows: DataFrame, keep: int, chars: int, owner_name: str | None = None) -> DataFrame:
    """First ``keep`` rows per company by ``at``, cut to ``chars``, with the names the cut text holds.

    All but ``keep`` rows per company and task drop out before the shuffle.
    """
    w = Window.partitionBy("company").orderBy("at")
    first = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    cut = first.select("company", "at", text.prefix(F.col("row"), chars).alias("row"))
    return text.computed(cut, "named", names.row_candidates(F.col("row"), owner_name))


def with_examples(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Records with their rows as an ``examples`` array; ``rows`` must be limited per company."""
    listed = rows.groupBy("company").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "row"))), lambda e: e["row"]).alias("examples")
    )
    return records.join(listed, "company", "left").withColumn(
        "examples", F.coalesce("examples", F.array().cast("array<string>"))
    )


def evidence_facts(matched: DataFrame) -> DataFrame:
    """Rows that name a company, written once: the rule ladders are the costly part."""
    return cut_lineage(matched.where(F.size("companies") > 0))


def company_rows(facts: DataFrame) -> DataFrame:
    """(company, at, row, named): every matched row of every company, in full."""
    return facts.select(F.explode("companies").alias("company"), F.col("seq").alias("at"), "row", "named")


def company_records(facts: DataFrame) -> DataFrame:
    """Raw registry: one record per company with its row count and the sets of its evidence."""
    per_company = facts.drop("row", "named").withColumn("company", F.explode("companies"))
    counts = per_company.groupBy("company").agg(F.count("*").alias("count"))

    def one(name):
        return F.array_compact(F.array(name))

    sets = union_sets(per_company, "company", {
        "ats_hints": F.col("ats_hints"), "company_domains": F.col("company_domains"),
        "sender_domains": one("sender_domain"), "sender_emails": one("sender_email"),
    })
    return counts.join(sets, "company").select(
        "company", "count", "ats_hints", "company_domains", "sender_domains", "sender_emails"
    )


def registry_by_name(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.lower("company"), "company")


def registry_by_count(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.desc("count"), F.lower("company"), "company")


def report_totals(matched: DataFrame) -> DataFrame:
    """One row: rows read, companies found, rows without a company."""
    return (
        matched.select(F.posexplode_outer("companies").alias("pos", "company"))
        .agg(
            F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("rows_processed"),
            F.count_distinct("company").alias("unique_companies"),
            F.count_if(F.col("company").isNull()).alias("unmatched_count"),
        )
    )


def raw_candidate_lines(matched: DataFrame) -> DataFrame:
    """(seq, row, companies): the rows of the report that name a company, with what they name."""
    return matched.where(F.size("companies") > 0).select("seq", "row", F.array_sort("companies").alias("companies"))


def report_unmatched(matched: DataFrame, keep: int | None = None) -> DataFrame:
    """Unmatched rows of the report in order; with ``keep`` the first ones."""
    ordered = unmatched_rows(matched).orderBy("seq")
    return ordered if keep is None else ordered.limit(keep)
