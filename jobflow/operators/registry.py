"""Company registry: resolve each record's name by weighted evidence, merge, rank."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobflow import rules
from jobflow.functions import names, text
from jobflow.functions.text import let
from jobflow.operators.evidence import union_sets
from jobflow.operators.filters import keyword_match

#: fixed values: votes of the record's own name, an example, an address, a domain
OWN_VOTES, EXAMPLE_VOTES, EMAIL_VOTES, DOMAIN_VOTES = 2, 5, 3, 3


def _none():
    return F.array().cast("array<string>")


def _label(root: Column) -> Column:
    return F.substring_index(root, ".", 1)


def _email_roots(emails: Column) -> Column:
    return F.transform(emails, lambda e: text.registrable_domain(text.email_domain(e)))


def vote_texts(personal=None) -> Column:
    """Array of (text, weight): everything in a record, but its rows, that may name its company."""
    personal = rules.PERSONAL_DOMAINS if personal is None else personal

    def weighted(values, weight):
        return F.transform(values, lambda v: F.struct(v.alias("text"), F.lit(weight).alias("weight")))

    def from_email(e):
        return let(
            text.registrable_domain(text.email_domain(e)),
            lambda root: F.when(root.isin(personal), _none())
            .when(text.is_vendor_domain(root), text.sender_local_tokens(e))
            .otherwise(F.array(_label(root))),
        )

    roots = F.filter(
        F.transform(F.col("company_domains"), text.registrable_domain),
        lambda r: ~r.isin(personal) & ~text.is_vendor_domain(r),
    )
    return F.concat(
        weighted(F.array("company"), OWN_VOTES),
        weighted(F.flatten(F.transform("sender_emails", from_email)), EMAIL_VOTES),
        weighted(F.transform(roots, _label), DOMAIN_VOTES),
    )


def registry_votes(records: DataFrame, rows: DataFrame, owner_name: str | None = None, personal=None) -> DataFrame:
    """(company, candidate, votes): weighted votes per record, repeats counted.

    Every name in every row of ``rows`` (company, at, row, named) votes for its company.
    """
    ballots = records.select("company", F.explode(vote_texts(personal)).alias("v")).select("company", "v.*")
    ballots = ballots.unionByName(rows.select(
        "company", F.explode("named").alias("text"), F.lit(EXAMPLE_VOTES).alias("weight")
    ))
    # the same text often votes many times: add up before the rule ladder, not after
    texts = ballots.groupBy("company", "text").agg(F.sum("weight").alias("weight"))
    return (
        text.computed(texts, "candidate", names.candidate_name(F.col("text"), owner_name))
        .where(F.col("candidate").isNotNull())
        .groupBy("company", "candidate")
        .agg(F.sum("weight").alias("votes"))
    )


def resolve_names(votes: DataFrame, owner_name: str | None = None) -> DataFrame:
    """(company, resolved): most votes, then the shorter, then the alphabetically first name."""
    best = votes.groupBy("company").agg(
        F.min(F.struct(
            (-F.col("votes")).alias("v"), F.length("candidate").alias("n"), F.lower("candidate").alias("l"), "candidate"
        )).alias("best")
    ).select("company", F.col("best.candidate").alias("resolved"))
    return best.where(
        names.is_valid_company_name(F.col("resolved"), owner_name) & ~names.is_generic_role_name(F.col("resolved"))
    )


def cleaned_domains(personal=None) -> Column:
    """Sorted own roots of a record: company and sender domains, no personal, vendor or file names."""
    personal = rules.PERSONAL_DOMAINS if personal is None else personal

    def own(root):
        return ~root.isin(personal) & ~text.is_vendor_domain(root)

    def not_file(root):
        out = F.lit(True)
        for s in rules.DOMAIN_ASSET_SUFFIXES:
            out = out & ~root.endswith(s)
        return out

    roots = F.filter(F.transform("company_domains", text.registrable_domain), lambda r: own(r) & not_file(r))
    return F.array_sort(F.array_union(roots, F.filter(_email_roots(F.col("sender_emails")), own)))


def _overrides(table: dict, company: Column) -> Column:
    return F.coalesce(F.split(text.lookup({k: " ".join(v) for k, v in table.items()}, company), " "), _none())


def file_rows(registry: DataFrame, owner_name: str | None = None) -> DataFrame:
    """(company, at, row, named) of a registry that keeps its rows as ``examples``, as files do."""
    rows = registry.select("company", F.posexplode("examples").alias("at", "row"))
    return text.computed(rows, "named", names.row_candidates(F.col("row"), owner_name))


def merge_registry(records: DataFrame, resolved: DataFrame, personal=None) -> DataFrame:
    """Clean registry: records of one resolved company merged into one."""
    records = records.join(resolved, "company").withColumn("domains", cleaned_domains(personal))
    counts = records.groupBy("resolved").agg(F.sum("count").alias("count"))
    sender_roots = F.transform(
        F.filter(F.col("sender_domains"), lambda d: d != ""), text.registrable_domain
    )
    sets = union_sets(records, "resolved", {
        "aliases": F.array("company"), "ats_hints": F.col("ats_hints"), "company_domains": F.col("domains"),
        "sender_domains": sender_roots, "sender_emails": F.col("sender_emails"),
    })
    company = F.col("resolved")
    return counts.join(sets, "resolved").select(
        company.alias("company"), "count", "aliases", "ats_hints",
        F.array_sort(
            F.array_union("company_domains", _overrides(rules.COMPANY_DOMAIN_OVERRIDES, company))
        ).alias("company_domains"),
        "sender_domains", "sender_emails",
    )


def merged_rows(rows: DataFrame, resolved: DataFrame, keep: int | None = None) -> DataFrame:
    """(company, at, row): the distinct rows of each resolved company; with ``keep`` its first ones."""
    at = F.struct(F.lower("company").alias("by"), "company", "at")
    named = rows.join(resolved, "company").select(F.col("resolved"), at.alias("at"), "row")
    distinct = named.groupBy(F.col("resolved").alias("company"), "row").agg(F.min("at").alias("at"))
    if keep is None:
        return distinct.select("company", "at", "row")
    rank = F.row_number().over(Window.partitionBy("company").orderBy("at"))
    return distinct.withColumn("rank", rank).where(F.col("rank") <= keep).select("company", "at", "row")


def rank_companies(clean: DataFrame, rows: DataFrame, keywords, strong=(), support=()) -> DataFrame:
    """Clean records with ``priority``, their evidence weight for the search order; ``rows`` as of
    :func:`merged_rows`."""
    relevant = rows.where(keyword_match(F.col("company"), F.col("row"), keywords, strong, support))
    counts = relevant.groupBy("company").agg(F.count("*").alias("_relevant"))
    weight = (
        F.col("count")
        + F.when(F.size("ats_hints") > 0, 3).otherwise(0)
        + F.when(F.size("company_domains") > 0, 2).otherwise(0)
        + 5 * F.coalesce("_relevant", F.lit(0))
    )
    return clean.join(counts, "company", "left").withColumn("priority", weight).drop("_relevant")


def top_companies(ranked: DataFrame, n: int | None = None) -> DataFrame:
    """The n records to search first; all of them without n."""
    if not n:
        return ranked
    return ranked.orderBy(F.desc("priority"), F.lower("company"), "company").limit(n)


def watchlist_registry(names_frame: DataFrame, column: str = "company") -> DataFrame:
    """Minimal raw registry from a list of company names."""
    empty = [_none().alias(c) for c in
             ("ats_hints", "company_domains", "sender_domains", "sender_emails", "examples")]
    return names_frame.select(F.col(column).alias("company"), F.lit(1).cast("long").alias("count"), *empty)
