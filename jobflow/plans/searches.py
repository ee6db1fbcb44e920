"""The product's four runs as job chains. Stage order is meaning and is kept."""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from jobflow.operators import dedup, discovery, evidence, filters, metrics, registry, scoring
from jobflow.operators.indexing import with_row_index
from jobflow.schema import BROAD_FIELDS, COMPANY_FIELDS
from jobflow.session import cut_lineage
from jobflow.sinks import writers
from jobflow.sources import routing


class BroadRun(NamedTuple):
    postings: DataFrame
    result: "BroadResult"
    sources: DataFrame
    funnel: DataFrame


class BroadResult(NamedTuple):
    raw: DataFrame
    merged: DataFrame
    recent: DataFrame
    clean: DataFrame


class CompanyResult(NamedTuple):
    registry: DataFrame
    raw: DataFrame
    filtered: DataFrame
    deduped: DataFrame
    skips: DataFrame


class MailboxResult(NamedTuple):
    registry: DataFrame
    rows: DataFrame
    ranked: DataFrame
    totals: DataFrame
    unmatched: DataFrame


def sequence_sources(frames) -> DataFrame:
    """All sources as one posting frame; ``seq`` follows source order, then each source's own.

    Each frame keeps its own order in ``seq`` or in ``at`` (any comparable value).
    """
    kinds: dict = {}
    for frame in frames:
        own = "seq" if "seq" in frame.columns else "at"
        kinds.setdefault(frame.schema[own].dataType, f"_own{len(kinds)}")
    placed = []
    for rank, frame in enumerate(frames):
        own = "seq" if "seq" in frame.columns else "at"
        # frames whose places have one type share a key column; of the others' columns theirs are null
        places = [(F.col(own) if kind == frame.schema[own].dataType else F.lit(None).cast(kind)).alias(name)
                  for kind, name in kinds.items()]
        # rows of one place are told apart by a hash, so that no long text becomes a sort key
        placed.append(frame.select(
            F.lit(rank).alias("_rank"), *places, F.xxhash64(*BROAD_FIELDS).alias("_hash"), *BROAD_FIELDS))
    union = reduce(DataFrame.unionByName, placed).fillna("", BROAD_FIELDS)
    return with_row_index(union, ["_rank", *kinds.values(), "_hash"], "seq").select("seq", *BROAD_FIELDS)


def broad_search(postings: DataFrame, as_of, days_old: int = 30, strict: bool = True, phrases=None) -> BroadResult:
    """Merge entities first (a merge can bring a date), then recency, then restrictions."""
    merged = cut_lineage(dedup.merge_entities(postings))
    recent = filters.filter_recent(merged, as_of, days_old, strict)
    return BroadResult(postings, merged, recent, filters.filter_restricted(recent, phrases))


def broad_run(frames, as_of, days_old: int = 30, strict: bool = True, phrases=None) -> BroadRun:
    """Landed sources to the broad result, with postings per source and rows left after each stage."""
    postings = sequence_sources(frames)  # written once, by its sort
    result = broad_search(postings, as_of, days_old, strict, phrases)
    raw = postings.agg(F.count("*").alias("rows")).select(F.lit("raw").alias("stage"), "rows")
    # what is left of the merged table is counted in one scan of it, not in one per stage
    later = metrics.stage_funnel(result.merged, {
        "recent": filters.is_recent_broad(F.col("date_posted"), as_of, days_old, strict),
        "clean": ~filters.is_restricted(F.col("title"), F.col("description"), phrases),
    }).withColumnRenamed("raw", "merged").unpivot([], ["merged", "recent", "clean"], "stage", "rows")
    return BroadRun(postings, result, metrics.source_counts(postings), raw.unionByName(later))


def save_broad(result: DataFrame, path: str, chunk_rows: int = writers.CHUNK_ROWS, skip_empty: bool = False) -> None:
    """CSV, text chunks and, when empty descriptions are left out, their urls."""
    kept = result
    if skip_empty:
        kept, empty = filters.split_empty_descriptions(result)
        writers.write_lines(empty, f"{path}/empty_urls")
    writers.write_broad_csv(kept, f"{path}/csv")
    writers.write_text_chunks(kept, f"{path}/chunks", ["seq"], chunk_rows)


def company_results(postings: DataFrame, as_of, keywords, strong=(), support=(), days_old: int = 30) -> DataFrame:
    """Filter, then deduplicate in two passes."""
    return dedup.dedupe_two_pass(filters.filter_postings(postings, as_of, keywords, strong, support, days_old))


def company_search(
    records: DataFrame, rows: DataFrame, documents: dict, pages: DataFrame, scraped_at: str, as_of, keywords, strong=(),
    support=(), results: DataFrame | None = None, max_companies: int | None = None, days_old: int = 30,
    owner_name: str | None = None,
) -> CompanyResult:
    """Registry to postings: resolve, rank, find boards, read landed answers, filter, deduplicate.

    ``records`` and ``rows`` are those of ``mailbox_registry``, or a saved registry and its ``file_rows``.
    """
    resolved = cut_lineage(registry.resolve_names(registry.registry_votes(records, rows, owner_name), owner_name))
    clean = cut_lineage(filters.blocked_companies(registry.merge_registry(records, resolved)))
    ranked = registry.rank_companies(clean, registry.merged_rows(rows, resolved), keywords, strong, support)
    chosen = registry.top_companies(ranked, max_companies)
    boards = discovery.discovery_urls(chosen, pages, results).withColumnRenamed("url", "board_url")
    found = routing.collect_postings(boards, documents, pages, scraped_at, keywords, strong, support)
    order = [F.lower("institution"), "institution", "career_page", "url", F.xxhash64(*COMPANY_FIELDS)]
    raw = with_row_index(found.select(*COMPANY_FIELDS), order, "seq")
    filtered = filters.filter_postings(raw, as_of, keywords, strong, support, days_old)
    errors = routing.document_errors(boards, documents, pages)
    skips = routing.skip_log(boards.select("company"), raw, errors)
    return CompanyResult(clean, raw, filtered, dedup.dedupe_two_pass(filtered), skips)


def save_company(result: CompanyResult, path: str, chunk_rows: int = writers.CHUNK_ROWS) -> None:
    ordered = dedup.in_result_order(result.deduped)
    writers.write_company_csv(ordered, f"{path}/csv")
    order = [F.lower("institution"), F.lower("title"), F.lower("location"), "order_seq"]
    writers.write_text_chunks(result.deduped, f"{path}/chunks", order, chunk_rows, company=True)
    writers.write_lines(result.skips, f"{path}/skips")
    writers.write_registry(result.registry, f"{path}/registry")


def mailbox_registry(rows: DataFrame, owner_name: str | None = None) -> MailboxResult:
    """Mailbox rows to the raw registry, the ranked report and the unmatched rows."""
    matched = cut_lineage(evidence.match_rows(rows, owner_name))
    facts = evidence.evidence_facts(matched)
    found = cut_lineage(evidence.company_records(facts))
    return MailboxResult(
        found, evidence.company_rows(facts), evidence.registry_by_count(found), evidence.report_totals(matched), evidence.unmatched_rows(matched)
    )


def save_mailbox(result: MailboxResult, path: str) -> None:
    writers.write_registry(result.registry, f"{path}/registry")
    writers.write_registry_rows(result.rows, f"{path}/registry")
    writers.write_unmatched(result.unmatched.orderBy("seq"), f"{path}/unmatched")
    writers.write_report(result.totals, result.ranked, result.unmatched, f"{path}/report")


def score_postings(postings: DataFrame, replies: DataFrame, max_jobs: int | None = None) -> DataFrame:
    """Postings with scores from landed replies, best first; those beyond the cap stay unscored."""
    numbered = scoring.number_jobs(postings, ["seq"], max_jobs)
    scored = scoring.apply_scores(numbered, replies)
    return scoring.keep_unscored(postings, scored).orderBy(F.desc_nulls_last("ai_score"), "seq")
