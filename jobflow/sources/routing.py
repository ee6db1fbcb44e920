"""Which reader a board needs, and what happens when it yields nothing."""

from pyspark.sql import DataFrame, functions as F

from jobflow.functions import urls
from jobflow.operators.dedup import distinct_boards
from jobflow.operators.metrics import union_sources
from jobflow.session import cut_lineage
from jobflow.sources import landed as L
from jobflow.sources import pages as P

API_BOARDS = ["greenhouse", "lever", "smartrecruiters", "workday"]


def route_boards(boards: DataFrame) -> DataFrame:
    """(company, board_url) plus board_type, detail flag and route."""
    kind, detail = F.col("board_type"), F.col("is_detail")
    return (
        distinct_boards(boards)
        .withColumn("board_type", urls.board_type(F.col("board_url")))
        .withColumn("is_detail", urls.is_job_detail_url(F.col("board_url")))
        .withColumn(
            "route",
            F.when(kind.isin(API_BOARDS), kind)
            .when(kind.isNotNull() & detail, "page_then_board")
            .when(kind.isNotNull(), "board").when(detail, "page").otherwise("board"),
        )
    )


def collect_postings(
    boards: DataFrame, documents: dict, pages: DataFrame, scraped_at: str, keywords, strong=(), support=()
) -> DataFrame:
    """Postings of all boards.

    ``documents`` maps a route to landed API documents (board_url, json ...); ``details`` holds
    the posting details, ``pages`` the landed pages (url, html).
    """
    routed = cut_lineage(route_boards(boards))

    def docs(route):
        on = routed.where(F.col("route") == route).select("company", "board_url")
        return on.join(documents[route].drop("company"), "board_url")

    parts = []
    if "greenhouse" in documents:
        parts.append(L.greenhouse(docs("greenhouse"), scraped_at))
    if "lever" in documents:
        parts.append(L.lever(docs("lever"), scraped_at))
    if "smartrecruiters" in documents:
        parts.append(L.smartrecruiters(docs("smartrecruiters"), documents["details"], scraped_at))
    fallback = routed.where((F.col("route") == "workday") & F.col("is_detail"))
    if "workday" in documents:
        workday = cut_lineage(L.workday_boards(docs("workday"), scraped_at))
        parts.append(workday)
        served = workday.select(F.col("institution").alias("company"), F.col("career_page").alias("board_url"))
        fallback = fallback.join(served.distinct(), ["company", "board_url"], "left_anti")

    def as_pages(frame):
        return P.parse_pages(frame.select(
            "company", F.col("board_url").alias("url"), F.col("board_url").alias("career_page")
        ).join(pages, "url"))

    on_page = routed.where(F.col("route").isin("page", "page_then_board"))
    first = cut_lineage(P.job_page_postings(as_pages(on_page), scraped_at))
    parts += [first, P.job_page_postings(as_pages(fallback), scraped_at)]
    done = first.select(F.col("institution").alias("company"), F.col("career_page").alias("board_url")).distinct()
    retry = routed.where(F.col("route") == "page_then_board").join(done, ["company", "board_url"], "left_anti")
    rest = routed.where(F.col("route") == "board").unionByName(retry)
    rest = rest.select("company", F.col("board_url").alias("url"))
    parts.append(P.board_postings(rest, pages, scraped_at, keywords, strong, support))
    return union_sources(*parts)


def bad_documents(landed: DataFrame) -> DataFrame:
    """(company, board_url, error) of landed documents that are not JSON."""
    broken = F.try_parse_json("json").isNull()
    return landed.where(broken).select("company", "board_url", F.lit("malformed document").alias("error"))


def document_errors(boards: DataFrame, documents: dict, pages: DataFrame | None = None) -> DataFrame:
    """(company, board_url, error) of the broken documents, and with ``pages`` (url, html) the broken
    pages, landed for (company, board_url) boards."""
    routed = route_boards(boards)
    parts = [
        bad_documents(routed.where(F.col("route") == route).select("company", "board_url").join(
            documents[route].drop("company"), "board_url"))
        for route in API_BOARDS if route in documents and "json" in documents[route].columns
    ]
    if pages is not None:
        own = routed.select("company", F.col("board_url").alias("url")).distinct().join(pages.select("url", "html"), "url")
        parts.append(P.page_errors(own).select("company", "board_url", "error"))
    if not parts:
        return boards.select("company", "board_url", F.lit("").alias("error")).limit(0)
    return union_sources(*parts)


def skip_log(companies: DataFrame, postings: DataFrame, errors: DataFrame) -> DataFrame:
    """Skip-log lines: errors, and companies with neither postings nor errors."""
    quiet = companies.select("company").distinct().join(
        postings.select(F.col("institution").alias("company")).distinct(), "company", "left_anti"
    ).join(errors.select("company").distinct(), "company", "left_anti")
    return errors.select(F.concat_ws("\t", "company", "board_url", "error").alias("line")).unionByName(
        quiet.select(F.concat(F.col("company"), F.lit("\tNO_RESULTS")).alias("line"))
    )
