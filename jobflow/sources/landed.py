"""Landed search results and board API documents to postings."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobflow import rules
from jobflow.functions import dates, html, urls

from jobflow.operators.dedup import first_per_key
from jobflow.operators.filters import build_posting
from jobflow.schema import (
    BROAD_FIELDS, GREENHOUSE_JSON, LEVER_JSON, SMARTRECRUITERS_DETAIL_JSON,
    SMARTRECRUITERS_LIST_JSON, WORKDAY_JSON,
)

def first_filled(*columns: Column) -> Column:
    """First value that is neither NULL nor blank, else blank."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def broad_posting(df: DataFrame, scraped_at: str, *keep: str, **fields: Column) -> DataFrame:
    """Broad posting rows; fields that are not given are blank."""
    fields.setdefault("scraped_at", F.lit(scraped_at))
    return df.select(
        *keep, *[F.coalesce(fields[f], F.lit("")).alias(f) if f in fields else F.lit("").alias(f) for f in BROAD_FIELDS]
    )


def search_request(
    results: DataFrame, as_of, days_old: int = 30, is_remote: bool | None = None, job_type: str = "",
    keep: int | None = None,
) -> DataFrame:
    """What a board search returns: young enough and matching; with ``keep`` that many per keyword and site."""
    posted = dates.parse_posted_date(F.col("date_posted"), as_of, plus_adds_one=False)
    rows = results.where(posted >= dates.cutoff(as_of, days_old))
    if is_remote is not None:
        rows = rows.where(F.lower("is_remote") == str(is_remote).lower())
    if job_type:
        rows = rows.where(F.lower("job_type") == job_type.lower())
    if keep is None:
        return rows
    w = Window.partitionBy("keyword", "site").orderBy("seq")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).drop("rank")


def board_search(results: DataFrame, scraped_at: str) -> DataFrame:
    """Search results of all boards as broad postings."""
    c = F.col
    return broad_posting(
        results, scraped_at, "seq", title=c("title"), institution=c("company"), location=c("location"),
        description=c("description"), url=first_filled(c("job_url"), c("job_url_direct")),
        source=F.concat(F.lit("jobspy/"), "site"), date_posted=c("date_posted"), min_amount=c("min_amount"),
        max_amount=c("max_amount"), currency=c("currency"),
        salary_interval=first_filled(c("interval"), c("salary_interval")), job_type=c("job_type"),
        is_remote=c("is_remote"),
    )


def _workday_jobs(landed: DataFrame, *keep: str) -> DataFrame:
    jobs = F.from_json("json", WORKDAY_JSON)["jobPostings"]
    return landed.select(*keep, F.posexplode(jobs).alias("pos", "job")).select(*keep, "pos", "job.*")


def _workday_date() -> Column:
    return first_filled(*[F.col(c) for c in ("postedOn", "startDate", "postedDate", "externalPostedDate")])


def workday_portals(landed: DataFrame, scraped_at: str, portals=None) -> DataFrame:
    """Laboratory portals: (host, query_pos, json) to broad postings, first per url and portal."""
    portals = rules.WORKDAY_PORTALS if portals is None else portals
    listed = F.array(*[F.lit(host) for _, host, _ in portals])
    name = F.try_element_at(
        F.create_map(*[F.lit(x) for portal, host, _ in portals for x in (host, portal)]), F.col("host")
    )
    # portals are read in listed order
    at = F.struct(F.array_position(listed, F.col("host")).alias("portal_pos"), "query_pos")
    asked = landed.withColumn("portal", name).where("portal IS NOT NULL").withColumn("query_pos", at)
    jobs = _workday_jobs(asked, "portal", "host", "query_pos")
    path = F.col("externalPath")
    url = F.when(first_filled(path) != "", F.concat(F.lit("https://"), "host", path)).otherwise("")
    rows = broad_posting(
        jobs, scraped_at, "portal", "query_pos", "pos", title=F.col("title"), institution=F.col("portal"),
        location=first_filled(F.col("locationsText"), F.col("primaryLocation")), description=F.col("briefDesc"),
        url=url, source=F.concat(F.lit("workday/"), F.lower("portal")), date_posted=_workday_date(),
    ).withColumn("at", F.struct("query_pos", "pos"))
    return first_per_key(rows, ["portal", "url"], "at").drop("portal", "query_pos", "pos")


def workday_boards(landed: DataFrame, scraped_at: str) -> DataFrame:
    """Company boards: (company, board_url, api_url, offset, json) to postings, all pages."""
    jobs = _workday_jobs(landed, "company", "board_url", "api_url", "offset")
    path = F.col("externalPath")
    url = F.when(first_filled(path) != "", urls.join_url(F.col("board_url"), path)).otherwise(F.col("board_url"))
    first = first_per_key(
        jobs.withColumn("job_url", url).withColumn("at", F.struct("offset", "pos")),
        ["company", "board_url", "api_url", "job_url"], "at",
    )
    return build_posting(
        first, scraped_at, title=F.col("title"), institution=F.col("company"),
        location=first_filled(F.col("locationsText"), F.col("primaryLocation")), url=F.col("job_url"),
        description=F.col("briefDesc"), source=F.lit("career/workday"), date_posted=_workday_date(),
        career_page=F.col("board_url"), ats_platform=F.lit("workday"),
    )


def greenhouse(landed: DataFrame, scraped_at: str) -> DataFrame:
    """(company, board_url, json) to postings."""
    jobs = landed.where(F.col("board_url").rlike(r"greenhouse\.io/[^/?#]+")).select(
        "company", "board_url", F.explode(F.from_json("json", GREENHOUSE_JSON)["jobs"]).alias("job")
    ).withColumn("text", html.html_text(F.col("job.content")))
    return build_posting(
        jobs, scraped_at, title=F.col("job.title"), institution=F.col("company"), location=F.col("job.location.name"),
        url=F.coalesce("job.absolute_url", "board_url"), description=F.col("text"),
        source=F.lit("career/greenhouse"), date_posted=first_filled(F.col("job.updated_at"), F.col("job.created_at")),
        career_page=F.col("board_url"), ats_platform=F.lit("greenhouse"),
    )


def lever(landed: DataFrame, scraped_at: str) -> DataFrame:
    """(company, board_url, json) to postings; list sections are flattened to text."""
    jobs = landed.where(F.col("board_url").rlike(r"jobs\.lever\.co/[^/?#]+")).select(
        "company", "board_url", F.explode(F.from_json("json", LEVER_JSON)).alias("job")
    )
    lists = F.col("job.lists")
    sections = F.try_variant_get(lists, "$", "array<struct<text:string,content:string>>")
    listed = F.when(
        F.schema_of_variant(lists).startswith("ARRAY"),
        F.array_join(F.flatten(F.transform(sections, lambda s: F.array_compact(F.array(s["text"], s["content"])))), " "),
    ).otherwise(F.try_variant_get(lists, "$", "string"))
    # sections hold markup
    jobs = jobs.withColumn("listed", html.html_text(F.coalesce(listed, F.lit(""))))
    parts = F.filter(
        F.array("job.descriptionPlain", "job.additionalPlain", "listed"), lambda p: p.isNotNull() & (p != "")
    )
    created = F.when(F.coalesce("job.createdAt", F.lit(0)) != 0, dates.epoch_millis_iso(F.col("job.createdAt")))
    return build_posting(
        jobs, scraped_at, title=F.col("job.text"), institution=F.col("company"), location=F.col("job.categories.location"),
        url=F.coalesce("job.hostedUrl", "board_url"), description=F.array_join(parts, " "),
        source=F.lit("career/lever"), date_posted=created, career_page=F.col("board_url"), ats_platform=F.lit("lever"),
    )


def smartrecruiters(landed: DataFrame, details: DataFrame, scraped_at: str) -> DataFrame:
    """(company, board_url, json) lists with (board_url, id, json) details, joined on the posting id."""
    jobs = landed.where(F.col("board_url").rlike(r"smartrecruiters\.com/[^/?#]+")).select(
        "company", "board_url", F.explode(F.from_json("json", SMARTRECRUITERS_LIST_JSON)["content"]).alias("job")
    ).select("company", "board_url", "job.*")
    sections = F.from_json("json", SMARTRECRUITERS_DETAIL_JSON)["jobAd"]["sections"]
    texts = F.transform(F.map_values(sections), lambda s: s["text"])
    described = details.select("board_url", "id", html.html_texts(texts).alias("text"))
    rows = jobs.join(described, ["board_url", "id"], "left")
    place = F.array_join(
        F.filter(F.array("location.city", "location.region", "location.country"), lambda p: p.isNotNull() & (p != "")), " "
    )
    return build_posting(
        rows, scraped_at, title=F.col("name"), institution=F.col("company"), location=place,
        url=F.coalesce("ref", "board_url"), description=F.col("text"), source=F.lit("career/smartrecruiters"),
        date_posted=F.col("releasedDate"), career_page=F.col("board_url"), ats_platform=F.lit("smartrecruiters"),
    )
