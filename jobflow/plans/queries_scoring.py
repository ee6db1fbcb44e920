"""Scoring tables, prompts, digests and run logs."""

from pyspark.sql import functions as F

from jobflow import rules
from jobflow.fixtures import POSTINGS_DOCS_SQL, RUN_LOG_SQL, log_lines, postings_docs, run_log, table
from jobflow.operators import runlog, scoring
from jobflow.operators.indexing import with_row_index
from jobflow.operators.keywords import parse_lines
from jobflow.plans import sql as S
from jobflow.plans.catalog import ORACLES, query
from jobflow.streaming import runlines, runlog as stream

PROFILE = "Structural engineer; ten years of simulation work.\nPython, finite elements."
_NUMBERED = f"(SELECT *, row_number() OVER (ORDER BY seq) - 1 AS rank FROM ({POSTINGS_DOCS_SQL}))"


def _numbered(spark, sf):
    return scoring.number_jobs(postings_docs(spark, sf), ["seq"], max_jobs=None)


def _prompts_sql(text):
    return f"""SELECT batch_id, jobs, {S.q(rules.SCORE_PROMPT_HEAD + PROFILE + chr(10) + chr(10) + 'Jobs:' + chr(10))} || blocks || chr(10) || 'Reply with exactly ' || jobs || {S.q(rules.SCORE_PROMPT_TAIL)} AS prompt
FROM (SELECT rank // 10 AS batch_id, count(*) AS jobs, string_agg(chr(10) || 'JOB ' || (rank % 10 + 1) || ': ' || title || ' at ' || institution || chr(10)
  || {text} || chr(10), '' ORDER BY rank) AS blocks FROM {_NUMBERED} GROUP BY 1)"""


@query("score_prompts", _prompts_sql("description"))
def score_prompts(spark, sf):
    return scoring.score_prompts(_numbered(spark, sf), PROFILE)


@query("score_prompts_limited", _prompts_sql("substr(description, 1, 300)"))
def score_prompts_limited(spark, sf):
    return scoring.score_prompts(_numbered(spark, sf), PROFILE, chars=300, profile_chars=1500)


_PROVIDERS = ["openai", "gemini", "anthropic", "mistral", "cohere"]


def replies(spark, sf):
    """Landed replies, one batch per assistant turn, in the five provider shapes; some lines are cut."""
    turns = table(spark, sf, "conversations").where("role = 'assistant'")
    turns = with_row_index(turns.select("conv_id", "turn", "text"), ["conv_id", "turn", "text"], "batch_id")
    c, t = F.col("conv_id"), F.col("turn")
    word = F.regexp_extract("text", r"^(\S+)", 1)
    score = F.when(c % 5 == 0, "high").otherwise((c % 10 + 1).cast("string"))
    body = F.concat(
        F.lit("Here you go:\nJOB 1: SCORE="), score, F.lit(" | REASON="), word, F.lit(" fits \nJOB 2: SCORE=3\nJOB 3: SCORE= "),
        t % 7, F.lit("|REASON=also REASON=x\n"),
    )
    item = F.array(F.struct(body.alias("text")))
    provider = F.element_at(F.array(*[F.lit(p) for p in _PROVIDERS]), (c % 5 + 1).cast("int"))
    shapes = {
        "openai": F.to_json(F.struct(F.array(F.struct(item.alias("content"))).alias("output"))),
        "gemini": F.to_json(F.struct(F.array(F.struct(F.struct(item.alias("parts")).alias("content"))).alias("candidates"))),
        "anthropic": F.to_json(F.struct(item.alias("content"))),
        "mistral": F.to_json(F.struct(F.array(F.struct(F.struct(body.alias("content")).alias("message"))).alias("choices"))),
        "cohere": F.to_json(F.struct(F.struct(item.alias("content")).alias("message"))),
    }
    raw = F.lit(None).cast("string")
    for name, shape in shapes.items():
        raw = F.when(provider == name, shape).otherwise(raw)
    raw = F.when(c % 11 == 0, '{"error": {"message": "quota used up"}}').when(c % 13 == 0, "<html>").otherwise(raw)
    return turns.select(
        "batch_id", provider.alias("provider"), raw.alias("raw_json"), body.alias("body")
    )


_REPLY_SQL = """SELECT row_number() OVER (ORDER BY conv_id, turn, text) - 1 AS batch_id, conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 5 ELSE conv_id % 10 + 1 END AS score1,
  regexp_extract(text, '^(\\S+)', 1) AS word, conv_id % 11 = 0 OR conv_id % 13 = 0 AS failed,
  CASE WHEN conv_id % 11 = 0 THEN 'quota used up' END AS error FROM conversations WHERE role = 'assistant'"""


def _texts(spark, sf):
    return replies(spark, sf).withColumn("text", scoring.reply_text(F.col("provider"), F.col("raw_json")))


@query("reply_text", f"""SELECT batch_id, CASE WHEN NOT failed THEN 'Here you go:' || chr(10) || 'JOB 1: SCORE=' || CASE WHEN conv_id % 5 = 0 THEN 'high' ELSE CAST(score1 AS VARCHAR) END
  || ' | REASON=' || word || ' fits ' || chr(10) || 'JOB 2: SCORE=3' || chr(10) || 'JOB 3: SCORE= ' || (turn % 7) || '|REASON=also REASON=x' END AS text, error FROM ({_REPLY_SQL})""")
def reply_text(spark, sf):
    return _texts(spark, sf).select("batch_id", "text", scoring.reply_error(F.col("raw_json")).alias("error"))


_PARSED = f"""SELECT batch_id, 1 AS pos, CAST(score1 AS INT) AS score, word || ' fits' AS reason FROM ({_REPLY_SQL}) WHERE NOT failed
UNION ALL SELECT batch_id, 2, CAST(turn % 7 AS INT), 'also' FROM ({_REPLY_SQL}) WHERE NOT failed"""


@query("score_parse", _PARSED)
def score_parse(spark, sf):
    return scoring.parse_scores(_texts(spark, sf).select("batch_id", "text"))


_SCORED = f"""SELECT n.*, coalesce(p.score, 5) AS ai_score, coalesce(p.reason, CASE WHEN a.batch_id IS NOT NULL THEN 'Could not parse' ELSE 'Scoring error' END) AS ai_reason
FROM {_NUMBERED} n LEFT JOIN ({_PARSED}) p ON n.rank // 10 = p.batch_id AND n.rank % 10 + 1 = p.pos
LEFT JOIN (SELECT DISTINCT batch_id FROM ({_REPLY_SQL}) WHERE NOT failed) a ON n.rank // 10 = a.batch_id"""


def _scored(spark, sf):
    return scoring.apply_scores(_numbered(spark, sf), _texts(spark, sf).select("batch_id", "text"))


@query("score_rank", f"SELECT seq, rank, ai_score, ai_reason FROM ({_SCORED})")
def score_rank(spark, sf):
    return scoring.rank_scored(_scored(spark, sf)).select("seq", "rank", "ai_score", "ai_reason")


def _kept(spark, sf, max_jobs=None):
    top = scoring.number_jobs(postings_docs(spark, sf), ["seq"], max_jobs)
    scored = scoring.apply_scores(top, _texts(spark, sf).select("batch_id", "text"))
    return scoring.keep_unscored(postings_docs(spark, sf), scored).select("seq", "ai_score")


@query("score_all_kept", f"SELECT seq, ai_score FROM ({_SCORED})")
def score_all_kept(spark, sf):
    return _kept(spark, sf)


@query("score_all_kept_limited", f"""SELECT p.seq, s.ai_score FROM ({POSTINGS_DOCS_SQL}) p LEFT JOIN (SELECT seq, ai_score FROM ({_SCORED}) WHERE rank < {rules.SCORED_JOBS}) s USING (seq)""")
def score_all_kept_limited(spark, sf):
    return _kept(spark, sf, rules.SCORED_JOBS)


@query("suggest_merge", """SELECT conv_id, turn, array_to_string(list_filter(k, lambda v, i: list_position(k, v) = i), '|') AS keywords
FROM (SELECT conv_id, turn, list_concat(['data', 'Thing'], list_filter(list_transform(string_split(trim(text), chr(10)), lambda l: trim(l)), lambda l: l <> '')) AS k FROM conversations)""")
def suggest_merge(spark, sf):
    existing = F.array(F.lit("data"), F.lit("Thing"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(scoring.merge_suggestions(existing, F.col("text")), "|").alias("keywords")
    )


@query("suggest_prompts", f"""SELECT p_partkey, replace(replace({S.q(rules.SUGGEST_PROMPT)}, '{{profile}}', p_type || ' engineer'), '{{existing}}', replace(p_name, ' ', chr(10))) AS prompt FROM part""")
def suggest_prompts(spark, sf):
    existing = parse_lines(F.replace(F.col("p_name"), F.lit(" "), F.lit("\n")))
    return table(spark, sf, "part").select(
        "p_partkey", scoring.suggest_prompt(F.concat("p_type", F.lit(" engineer")), existing).alias("prompt")
    )


@query("review_prompts", f"""SELECT p_partkey, {S.q(rules.REVIEW_PROMPT_HEAD)} || '- ' || replace(p_name, ' ', chr(10) || '- ')
  || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'Candidate profile (for context):' || chr(10) || p_type ELSE '' END || {S.q(rules.REVIEW_PROMPT_TAIL)} AS prompt FROM part""")
def review_prompts(spark, sf):
    words = parse_lines(F.replace(F.col("p_name"), F.lit(" "), F.lit("\n")))
    profile = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("")
    return table(spark, sf, "part").select("p_partkey", scoring.review_prompt(words, profile).alias("prompt"))


def _review_sql(summary):
    return f"""SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN CAST(conv_id % 10 AS INT) END AS quality_score,
  CASE WHEN conv_id % 2 = 0 THEN 'ok' ELSE {summary} END AS summary,
  CASE WHEN conv_id % 2 = 0 THEN role ELSE '' END AS weak, CASE WHEN conv_id % 2 = 0 THEN 'a+b' ELSE '' END AS redundant FROM conversations"""


def _reviews(spark, sf, chars=None):
    doc = F.to_json(F.struct(
        (F.col("conv_id") % 10).alias("quality_score"), F.lit("ok").alias("summary"), F.array("role").alias("weak"),
        F.array(F.array(F.lit("a"), F.lit("b"))).alias("redundant"),
    ))
    raw = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("```json\n"), doc, F.lit("\n```"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", scoring.parse_review(raw, chars).alias("r")).select(
        "conv_id", "turn", "r.quality_score", "r.summary", F.array_join("r.weak", "|").alias("weak"),
        F.array_join(F.transform("r.redundant", lambda p: F.array_join(p, "+")), "|").alias("redundant"),
    )


_BARE_REPLY = "trim(trim(trim(text), '`json'), '`')"


@query("review_parse", _review_sql(_BARE_REPLY))
def review_parse(spark, sf):
    return _reviews(spark, sf)


@query("review_parse_limited", _review_sql(f"substr({_BARE_REPLY}, 1, 300)"))
def review_parse_limited(spark, sf):
    return _reviews(spark, sf, 300)


def _fill(template, profile, description="description"):
    out = S.q(template)
    for name, value in (("profile", S.q(profile)), ("title", "title"), ("institution", "institution"), ("description", description)):
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


@query("posting_prompts", f"SELECT seq, {_fill(rules.COVER_LETTER_PROMPT, PROFILE)} AS letter, {_fill(rules.FIT_PROMPT, PROFILE)} AS fit FROM ({POSTINGS_DOCS_SQL})")
def posting_prompts(spark, sf):
    return postings_docs(spark, sf).select(
        "seq", scoring.cover_letter_prompt(PROFILE).alias("letter"), scoring.fit_prompt(PROFILE).alias("fit")
    )


_CUT = "substr(description, 1, 800)"


@query("posting_prompts_limited", f"SELECT seq, {_fill(rules.COVER_LETTER_PROMPT, PROFILE, _CUT)} AS letter, {_fill(rules.FIT_PROMPT, PROFILE, _CUT)} AS fit FROM ({POSTINGS_DOCS_SQL})")
def posting_prompts_limited(spark, sf):
    return postings_docs(spark, sf).select(
        "seq", scoring.cover_letter_prompt(PROFILE, 800, 2000).alias("letter"), scoring.fit_prompt(PROFILE, 800, 1500).alias("fit")
    )


_MAIL_LINE = """pos || '. [AI score: ' || ai_score || '/10] ' || title || ' @ ' || institution || CASE WHEN date_posted <> '' THEN '  |  ' || date_posted ELSE '' END
  || CASE WHEN source <> '' THEN '  |  ' || source ELSE '' END || CASE WHEN url <> '' THEN chr(10) || '   ' || url ELSE '' END || chr(10) || '   → ' || ai_reason"""
_POSED = f"SELECT *, row_number() OVER (ORDER BY ai_score DESC, rank) AS pos FROM ({_SCORED})"


@query("digest", f"SELECT pos AS at, {_MAIL_LINE} AS line FROM ({_POSED})")
def digest(spark, sf):
    return scoring.digest_lines(_scored(spark, sf), ["rank"])


@query("digest_limited", f"SELECT string_agg({_MAIL_LINE}, chr(10) || chr(10) ORDER BY pos) AS digest FROM ({_POSED} WHERE rank < 30)")
def digest_limited(spark, sf):
    return scoring.digest(_scored(spark, sf), ["rank"], 30)


@query("posting_pick", f"""SELECT seq, '★ ' || ai_score || '/10 · ' || title || ' @ ' || institution AS label FROM ({_SCORED}) ORDER BY rank LIMIT 1 OFFSET 17""")
def posting_pick(spark, sf):
    return scoring.pick_posting(_scored(spark, sf), ["rank"], 17).select("seq", "label")


def _progress_sql():
    def ladder(value_of):
        arms = []
        for any_of, all_of, lo, hi, message in rules.PROGRESS_RULES:
            also = "".join(f" AND contains(lower(line), {S.q(w)})" for w in all_of)
            arms.append(f"WHEN {S.contains_any('lower(line)', any_of)}{also} THEN {value_of(lo, hi, message)}")
        return " ".join(arms)

    pct = ladder(lambda lo, hi, message: f"greatest({lo}, least({hi}, n))")
    text = ladder(lambda lo, hi, message: S.q(message))
    return f"""SELECT run_id, line_no, line, n, CAST(CASE {pct} ELSE least(72, 8 + n // 3) END AS INT) AS progress,
      CASE {text} ELSE 'Searching… (' || n || ' steps)' END AS message,
      coalesce(max(TRY_CAST(regexp_extract(lower(line), 'total:\\s*([0-9]+)', 1) AS BIGINT)) OVER (PARTITION BY run_id ORDER BY line_no), 0) AS jobs_found
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS n FROM ({RUN_LOG_SQL}) WHERE trim(line) <> '')"""


@query("log_progress", f"SELECT run_id, line_no, n, progress, message FROM ({_progress_sql()})")
def log_progress(spark, sf):
    return runlog.log_progress(run_log(spark, sf), chunk_rows=3000).select("run_id", "line_no", "n", "progress", "message")


@query("log_jobs_found", f"SELECT run_id, line_no, jobs_found FROM ({_progress_sql()})")
def log_jobs_found(spark, sf):
    return runlog.log_progress(run_log(spark, sf)).select("run_id", "line_no", "jobs_found")


@query("log_tail", f"""SELECT run_id, string_agg(line, chr(10) ORDER BY line_no) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) AS back
  FROM ({RUN_LOG_SQL}) WHERE trim(line) <> '') WHERE back <= 80 GROUP BY run_id""")
def log_tail(spark, sf):
    return runlog.log_tail(run_log(spark, sf), runlog.TAIL_LINES)


_LAST = f"SELECT run_id, arg_max(progress, line_no) AS progress, arg_max(message, line_no) AS message, max(jobs_found) AS jobs_found, arg_max(n, line_no) AS n FROM ({_progress_sql()}) GROUP BY run_id"


@query("log_eta", f"""SELECT run_id, progress, message, jobs_found, CASE WHEN progress > 8 THEN floor(secs) END AS seconds_left,
  CASE WHEN progress <= 8 THEN '' WHEN secs > 60 THEN '~' || CAST(floor(secs / 60) AS BIGINT) || 'm ' || CAST(floor(secs % 60) AS BIGINT) || 's remaining' ELSE '~' || CAST(floor(secs) AS BIGINT) || 's remaining' END AS remaining
FROM (SELECT *, greatest(0.0, e / (progress / 100) - e) AS secs FROM (SELECT l.*, epoch_us(TIMESTAMP '2024-01-31 00:00:00') / 1e6 - epoch_us(started_at) / 1e6 AS e
  FROM ({_LAST}) l JOIN (SELECT user_id AS run_id, min(ts) AS started_at FROM events GROUP BY user_id) USING (run_id)))""")
def log_eta(spark, sf):
    log = run_log(spark, sf)
    started = log.groupBy("run_id").agg(F.min("ts").cast("timestamp").alias("started_at"))
    states = runlog.latest_state(runlog.log_progress(log))
    out = runlog.remaining_time(states, started, "2024-01-31 00:00:00")
    return out.select("run_id", "progress", "message", "jobs_found", F.floor("left").cast("double").alias("seconds_left"), "remaining")


@query("log_stream", f"SELECT run_id, n, jobs_found, progress, message FROM ({_LAST})")
def log_stream(spark, sf):
    return stream.run_to_end(_log_stream(spark, sf))


def _log_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return log_lines(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


@query("log_stream_lines", f"SELECT run_id, line_no, line, n, progress, message, jobs_found FROM ({_progress_sql()})")
def log_stream_lines(spark, sf):
    return runlines.written_lines(spark, runlines.follow_to_end(_log_stream(spark, sf), chunk_rows=3000))


@query("log_stream_tail", f"""SELECT run_id, n, jobs_found, progress, message, tail FROM ({_LAST}) JOIN ({ORACLES["log_tail"]}) USING (run_id)""")
def log_stream_tail(spark, sf):
    return runlines.newest_lines_state(spark, runlines.follow_to_end(_log_stream(spark, sf), chunk_rows=3000))
