"""Record shapes. Posting fields are strings and a missing value is the empty string."""

from pyspark.sql import types as T

BROAD_FIELDS = [
    "title", "institution", "location", "url", "description", "source", "date_posted",
    "scraped_at", "min_amount", "max_amount", "currency", "salary_interval", "job_type", "is_remote",
]
COMPANY_FIELDS = [
    "title", "institution", "location", "url", "description", "source", "date_posted",
    "scraped_at", "career_page", "ats_platform",
]


def _strings(names):
    return [T.StructField(n, T.StringType()) for n in names]


_STRINGS = T.ArrayType(T.StringType())

#: ``seq`` is the ingest ordinal that order-dependent operators follow.
BROAD_POSTING = T.StructType([T.StructField("seq", T.LongType()), *_strings(BROAD_FIELDS)])
COMPANY_POSTING = T.StructType([T.StructField("seq", T.LongType()), *_strings(COMPANY_FIELDS)])
MAIL_ROW = T.StructType([T.StructField("seq", T.LongType()), T.StructField("row", T.StringType())])
REGISTRY_LISTS = ["ats_hints", "company_domains", "sender_domains", "sender_emails", "examples"]
REGISTRY_RECORD = T.StructType(
    [T.StructField("company", T.StringType()), T.StructField("count", T.LongType())]
    + [T.StructField(n, _STRINGS) for n in REGISTRY_LISTS]
)
CLEAN_REGISTRY_RECORD = T.StructType([*REGISTRY_RECORD.fields, T.StructField("aliases", _STRINGS)])

GREENHOUSE_JSON = (
    "jobs array<struct<title string, absolute_url string, content string, updated_at string,"
    " created_at string, location struct<name string>>>"
)
LEVER_JSON = (
    "array<struct<text string, hostedUrl string, createdAt bigint, descriptionPlain string,"
    " additionalPlain string, lists variant, categories struct<location string>>>"
)
SMARTRECRUITERS_LIST_JSON = (
    "content array<struct<id string, name string, ref string, releasedDate string,"
    " location struct<city string, region string, country string>>>"
)
SMARTRECRUITERS_DETAIL_JSON = "jobAd struct<sections map<string, struct<text string>>>"
WORKDAY_JSON = (
    "jobPostings array<struct<title string, externalPath string, locationsText string,"
    " primaryLocation string, briefDesc string, postedOn string, startDate string,"
    " postedDate string, externalPostedDate string>>"
)
REVIEW_JSON = (
    "quality_score int, summary string, weak array<string>, redundant array<array<string>>,"
    " suggestions array<string>"
)
