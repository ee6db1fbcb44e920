"""Data side of model-assisted scoring: prompts out, landed replies in."""

from pyspark.sql import Column, DataFrame, functions as F

from jobflow import rules
from jobflow.functions.text import first_items, let, prefix, strip
from jobflow.operators.indexing import with_row_index
from jobflow.schema import REVIEW_JSON

_LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def number_jobs(df: DataFrame, order, max_jobs: int | None = None) -> DataFrame:
    """Postings (the first ``max_jobs`` where asked) with ``rank``, ``batch_id`` and ``pos`` (1-based in the batch)."""
    ranked = with_row_index(df if max_jobs is None else df.orderBy(*order).limit(max_jobs), order, "rank")
    return ranked.withColumn("batch_id", F.floor(F.col("rank") / rules.SCORE_BATCH)).withColumn(
        "pos", (F.col("rank") % rules.SCORE_BATCH + 1).cast("int")
    )


def score_prompts(
    numbered: DataFrame, profile: str, chars: int | None = None, profile_chars: int | None = None
) -> DataFrame:
    """(batch_id, jobs, prompt): one prompt per batch of at most ten postings; limits cut descriptions and profile."""
    block = F.concat(
        F.lit("\nJOB "), F.col("pos").cast("string"), F.lit(": "), F.col("title"), F.lit(" at "), F.col("institution"),
        F.lit("\n"), prefix(F.col("description"), chars), F.lit("\n"),
    )
    batches = numbered.groupBy("batch_id").agg(
        F.count("*").alias("jobs"), F.array_sort(F.collect_list(F.struct("pos", block.alias("block")))).alias("blocks")
    )
    return batches.select(
        "batch_id", "jobs",
        F.concat(
            F.lit(rules.SCORE_PROMPT_HEAD + profile[:profile_chars] + "\n\nJobs:\n"),
            F.array_join(F.transform("blocks", lambda b: b["block"]), ""),
            F.lit("\nReply with exactly "), F.col("jobs").cast("string"), F.lit(rules.SCORE_PROMPT_TAIL),
        ).alias("prompt"),
    )


def reply_text(provider: Column, raw_json: Column) -> Column:
    """Text of a model reply in any of the five provider shapes; NULL when it is not one."""
    def texts(items):
        return F.filter(F.transform(items, lambda i: i["text"]), lambda t: t.isNotNull() & (t != ""))

    def lines(values):
        return strip(F.array_join(values, "\n"))

    item = "array<struct<text:string>>"
    openai = F.from_json(raw_json, f"output_text string, output array<struct<content:{item}>>")
    gemini = F.from_json(raw_json, f"candidates array<struct<content:struct<parts:{item}>>>")
    anthropic = F.from_json(raw_json, f"content {item}")
    mistral = F.from_json(raw_json, "choices array<struct<message:struct<content:string>>>")
    cohere = F.from_json(raw_json, f"message struct<content:{item}>")
    none = F.array().cast(item)
    return (
        F.when(F.try_parse_json(raw_json).isNull() | reply_error(raw_json).isNotNull(), F.lit(None).cast("string"))
        .when(provider == "openai", F.coalesce(
            F.nullif(openai["output_text"], F.lit("")),
            lines(texts(F.flatten(F.transform(openai["output"], lambda o: F.coalesce(o["content"], none))))), F.lit(""),
        ))
        .when(provider == "gemini", lines(texts(F.flatten(
            F.transform(gemini["candidates"], lambda c: F.coalesce(c["content"]["parts"], none))
        ))))
        .when(provider == "anthropic", lines(texts(anthropic["content"])))
        .when(provider == "mistral", strip(F.get(mistral["choices"], F.lit(0))["message"]["content"]))
        .when(provider == "cohere", lines(texts(cohere["message"]["content"])))
    )


def reply_error(raw_json: Column) -> Column:
    """Error detail of a failed reply, NULL when there is none."""
    doc = F.try_parse_json(raw_json)
    return F.coalesce(
        F.nullif(F.try_variant_get(doc, "$.error.message", "string"), F.lit("")),
        F.when(F.schema_of_variant(F.try_variant_get(doc, "$.message", "variant")) == "STRING",
               F.nullif(F.try_variant_get(doc, "$.message", "string"), F.lit(""))),
    )


def parse_scores(replies: DataFrame) -> DataFrame:
    """(batch_id, pos, score, reason) of replies (batch_id, text): scored lines by position."""
    lines = F.filter(
        F.split(strip(F.col("text")), _LINES), lambda l: l.contains("SCORE=") & l.contains("REASON=")
    )
    each = replies.where(F.col("text").isNotNull()).select("batch_id", F.posexplode(lines).alias("at", "line"))
    number = strip(F.split(F.split("line", "SCORE=")[1], r"\|")[0])
    return each.select(
        "batch_id", (F.col("at") + 1).alias("pos"),
        F.coalesce(F.when(number.rlike(r"^[+-]?\d+$"), number.try_cast("int")), F.lit(rules.DEFAULT_SCORE)).alias("score"),
        strip(F.split("line", "REASON=")[1]).alias("reason"),
    )


def apply_scores(numbered: DataFrame, replies: DataFrame) -> DataFrame:
    """Numbered postings with ``ai_score`` and ``ai_reason``; gaps get the default score."""
    answered = replies.where(F.col("text").isNotNull()).select("batch_id", F.lit(True).alias("answered")).distinct()
    scored = numbered.join(parse_scores(replies), ["batch_id", "pos"], "left").join(answered, "batch_id", "left")
    return scored.select(
        *numbered.columns,
        F.coalesce("score", F.lit(rules.DEFAULT_SCORE)).alias("ai_score"),
        F.coalesce(
            "reason", F.when(F.col("answered"), rules.UNPARSED_REASON).otherwise(rules.FAILED_REASON)
        ).alias("ai_reason"),
    )


def keep_unscored(df: DataFrame, scored: DataFrame) -> DataFrame:
    """All postings; those beyond the scoring cap keep a NULL score."""
    return df.join(scored.select("seq", "ai_score", "ai_reason"), "seq", "left")


def rank_scored(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("ai_score"), "rank")


def fill_prompt(template: str, **parts: Column) -> Column:
    """A fixed prompt text with column values in its named places."""
    pieces, rest = [], template
    while "{" in rest:
        lead, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(lead), parts[name]]
    return F.concat(*pieces, F.lit(rest))


def suggest_prompt(profile: Column, existing: Column, keep: int | None = None, chars: int | None = None) -> Column:
    listed = F.when(F.size(existing) > 0, F.array_join(first_items(existing, keep), "\n")).otherwise("(none yet)")
    return fill_prompt(rules.SUGGEST_PROMPT, profile=prefix(profile, chars), existing=listed)


def merge_suggestions(existing: Column, reply: Column) -> Column:
    """Existing keywords, then the reply's lines; exact repeats dropped."""
    lines = F.filter(F.transform(F.split(strip(reply), _LINES), strip), lambda l: l != "")
    return F.array_distinct(F.concat(existing, lines))


def review_prompt(keywords: Column, profile: Column, chars: int | None = None) -> Column:
    listed = F.array_join(F.transform(keywords, lambda k: F.concat(F.lit("- "), k)), "\n")
    context = F.when(
        profile != "", F.concat(F.lit("\nCandidate profile (for context):\n"), prefix(profile, chars))
    ).otherwise("")
    return F.concat(F.lit(rules.REVIEW_PROMPT_HEAD), listed, context, F.lit(rules.REVIEW_PROMPT_TAIL))


def parse_review(reply: Column, chars: int | None = None) -> Column:
    """Review struct of a reply; when it is not JSON the summary holds it (its first ``chars`` where asked)."""
    bare = strip(F.btrim(F.btrim(strip(reply), F.lit("`json")), F.lit("`")))

    def read(raw):
        empty = F.array().cast("array<string>")
        fallback = F.struct(
            F.lit(None).cast("int").alias("quality_score"), prefix(raw, chars).alias("summary"),
            empty.alias("weak"), F.array().cast("array<array<string>>").alias("redundant"), empty.alias("suggestions"),
        )
        return F.when(F.try_parse_json(raw).isNotNull(), F.from_json(raw, REVIEW_JSON)).otherwise(fallback)

    return let(bare, read)


def cover_letter_prompt(profile: str, chars: int | None = None, profile_chars: int | None = None) -> Column:
    return _posting_prompt(rules.COVER_LETTER_PROMPT, profile[:profile_chars], chars)


def fit_prompt(profile: str, chars: int | None = None, profile_chars: int | None = None) -> Column:
    return _posting_prompt(rules.FIT_PROMPT, profile[:profile_chars], chars)


def _posting_prompt(template, profile, chars):
    return fill_prompt(
        template, profile=F.lit(profile), title=F.coalesce("title", F.lit("N/A")),
        institution=F.coalesce("institution", F.lit("N/A")), description=prefix(F.col("description"), chars),
    )


def digest_lines(df: DataFrame, order, n: int | None = None) -> DataFrame:
    """(at, line): mail lines of all postings, or of the first n; best score first within those."""
    chosen = df if n is None else df.orderBy(*order).limit(n)
    scored = "ai_score" in df.columns
    by = [F.desc_nulls_last("ai_score"), *order] if scored else order
    score = F.when(F.col("ai_score").isNotNull(), F.concat(F.lit("[AI score: "), F.col("ai_score").cast("string"), F.lit("/10] "))) if scored else F.lit("")
    reason = F.when(F.col("ai_reason").isNotNull(), F.concat(F.lit("\n   → "), "ai_reason")) if scored else F.lit("")

    def part(name, lead):
        return F.when(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(lead), F.col(name)))

    line = F.concat(*[F.coalesce(p, F.lit("")) for p in (
        score, F.concat("title", F.lit(" @ "), "institution"), part("date_posted", "  |  "), part("source", "  |  "),
        part("url", "\n   "), reason,
    )])
    at = F.col("at") + 1
    return with_row_index(chosen, by, "at").select(at.alias("at"), F.concat(at.cast("string"), F.lit(". "), line).alias("line"))


def digest(df: DataFrame, order, n: int) -> DataFrame:
    """One row with the mail text of the first n postings."""
    return digest_lines(df, order, n).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda e: e["line"]), "\n\n").alias("digest")
    )


def pick_posting(df: DataFrame, order, index: int) -> DataFrame:
    """The selected posting (the last one when the index is past the end) and its panel label."""
    numbered = with_row_index(df, order, "_at")
    picked = numbered.where(F.col("_at") <= index).orderBy(F.desc("_at")).limit(1).drop("_at")
    name = F.concat(F.coalesce("title", F.lit("?")), F.lit(" @ "), F.coalesce("institution", F.lit("?")))
    if "ai_score" in df.columns:
        name = F.when(
            F.coalesce("ai_score", F.lit(0)) != 0,
            F.concat(F.lit("★ "), F.col("ai_score").cast("string"), F.lit("/10 · "), name),
        ).otherwise(name)
    return picked.withColumn("label", name)
