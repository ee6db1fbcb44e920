"""Company names from mailbox rows and the evidence behind them."""

from pyspark.sql import functions as F

from jobflow.fixtures import MAIL_ROWS_SQL, dealt, mail_rows, table
from jobflow.functions import names
from jobflow.functions.text import computed
from jobflow.operators import evidence
from jobflow.plans import name_sql as N
from jobflow.plans.catalog import query
from jobflow.schema import REGISTRY_LISTS

_RAW_SQL = f"""SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN p_name || ' Careers' WHEN 1 THEN '(' || p_name || ') Talent Acquisition'
  WHEN 2 THEN p_type WHEN 3 THEN 'the ' || p_name || ' University HR' WHEN 4 THEN 'GE' WHEN 5 THEN p_name || ' (' || p_brand || ')'
  WHEN 6 THEN 'Your ' || p_name WHEN 7 THEN lower(p_brand) ELSE p_name || ' | ' || p_type END AS raw FROM part"""


def raw_names(spark, sf):
    k, name = F.col("p_partkey") % 9, F.col("p_name")
    raw = (
        F.when(k == 0, F.concat(name, F.lit(" Careers")))
        .when(k == 1, F.concat(F.lit("("), name, F.lit(") Talent Acquisition"))).when(k == 2, F.col("p_type"))
        .when(k == 3, F.concat(F.lit("the "), name, F.lit(" University HR"))).when(k == 4, "GE")
        .when(k == 5, F.concat(name, F.lit(" ("), "p_brand", F.lit(")"))).when(k == 6, F.concat(F.lit("Your "), name))
        .when(k == 7, F.lower("p_brand")).otherwise(F.concat(name, F.lit(" | "), "p_type"))
    )
    return dealt(table(spark, sf, "part").select("p_partkey", raw.alias("raw")))


@query("canonical_names", f"SELECT p_partkey, raw, name FROM ({N.canonical(_RAW_SQL)})")
def canonical_names(spark, sf):
    return raw_names(spark, sf).withColumn("name", names.canonical_name(F.col("raw")))


@query("sender_company", N.sender(MAIL_ROWS_SQL))
def sender_company(spark, sf):
    return mail_rows(spark, sf).select("seq", names.sender_company(F.col("row")).alias("name"))


@query("mail_candidates", f"SELECT seq, string_agg(name, '|' ORDER BY name) AS names FROM ({N.candidates(MAIL_ROWS_SQL)}) GROUP BY seq")
def mail_candidates(spark, sf):
    found = computed(mail_rows(spark, sf), "names", names.row_candidates(F.col("row")))
    return found.where(F.size("names") > 0).select("seq", F.array_join(F.array_sort("names"), "|").alias("names"))


_CAND_SQL = f"""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_name || ' - Simulation Engineer opening' WHEN 1 THEN 'The recruiting team at ' || p_name
  WHEN 2 THEN 'Stress Analyst at ' || p_name || ' at Big Corp' WHEN 3 THEN 'workable' WHEN 4 THEN 'Our ' || p_name || ' careers site'
  WHEN 5 THEN 'lead engineer' WHEN 6 THEN p_name || ' at site - lab at ' || p_type || ' - analyst' ELSE p_name || ' Talent Acquisition job' END AS raw FROM part"""


@query("candidate_names", f"""SELECT p_partkey, raw, name FROM ({_CAND_SQL}) LEFT JOIN ({N.candidate(_CAND_SQL)}) USING (raw)""")
def candidate_names(spark, sf):
    k, n = F.col("p_partkey") % 8, F.col("p_name")
    raw = (
        F.when(k == 0, F.concat(n, F.lit(" - Simulation Engineer opening")))
        .when(k == 1, F.concat(F.lit("The recruiting team at "), n))
        .when(k == 2, F.concat(F.lit("Stress Analyst at "), n, F.lit(" at Big Corp"))).when(k == 3, "workable")
        .when(k == 4, F.concat(F.lit("Our "), n, F.lit(" careers site"))).when(k == 5, "lead engineer")
        .when(k == 6, F.concat(n, F.lit(" at site - lab at "), "p_type", F.lit(" - analyst")))
        .otherwise(F.concat(n, F.lit(" Talent Acquisition job")))
    )
    return dealt(table(spark, sf, "part").select("p_partkey", raw.alias("raw"))).withColumn(
        "name", names.candidate_name(F.col("raw"))
    )


def joined(*columns):
    return [F.array_join(c, ";").alias(c) for c in columns]


_SETS = f"""SELECT company, count, {N.joined('ev_vals', 'company', 'hint')} AS ats_hints, {N.joined('ev_vals', 'company', 'domain')} AS company_domains,
  {N.joined('ev_vals', 'company', 'sender')} AS sender_domains, {N.joined('ev_vals', 'company', 'email')} AS sender_emails"""
_SET_LISTS = [c for c in REGISTRY_LISTS if c != "examples"]


def _facts(spark, sf):
    return evidence.evidence_facts(evidence.match_rows(mail_rows(spark, sf)))


@query("company_evidence", f"WITH {N.evidence_ctes(MAIL_ROWS_SQL)} {_SETS} FROM ev_count b")
def company_evidence(spark, sf):
    return evidence.company_records(_facts(spark, sf)).select("company", "count", *joined(*_SET_LISTS))


@query("company_evidence_limited", f"""WITH {N.evidence_ctes(MAIL_ROWS_SQL, True)} {_SETS},
  (SELECT string_agg(example, ';' ORDER BY rank) FROM ev_example x WHERE x.company = b.company) AS examples FROM ev_count b""")
def company_evidence_limited(spark, sf):
    facts = _facts(spark, sf)
    rows = evidence.first_rows(evidence.company_rows(facts), keep=3, chars=400)
    return evidence.with_examples(evidence.company_records(facts), rows).select("company", "count", *joined(*REGISTRY_LISTS))


@query("company_rows", f"WITH {N.evidence_ctes(MAIL_ROWS_SQL)} SELECT company, seq, row FROM cand JOIN mail USING (seq)")
def company_rows(spark, sf):
    return evidence.company_rows(_facts(spark, sf)).select("company", F.col("at").alias("seq"), "row")


@query("unmatched_rows", f"""WITH {N.evidence_ctes(MAIL_ROWS_SQL)}
SELECT seq, row FROM mail WHERE seq NOT IN (SELECT seq FROM cand)""")
def unmatched_rows(spark, sf):
    return evidence.unmatched_rows(evidence.match_rows(mail_rows(spark, sf)))


@query("raw_candidate_lines", f"""WITH {N.evidence_ctes(MAIL_ROWS_SQL)}
SELECT seq, row, string_agg(company, '|' ORDER BY company) AS companies FROM cand JOIN mail USING (seq) GROUP BY seq, row""")
def raw_candidate_lines(spark, sf):
    lines = evidence.raw_candidate_lines(evidence.match_rows(mail_rows(spark, sf)))
    return lines.select("seq", "row", F.array_join("companies", "|").alias("companies"))


@query("registry_report", f"""WITH {N.evidence_ctes(MAIL_ROWS_SQL)}
SELECT (SELECT count(*) FROM mail) AS rows_processed, (SELECT count(*) FROM ev_count) AS unique_companies,
  (SELECT count(*) FROM mail WHERE seq NOT IN (SELECT seq FROM cand)) AS unmatched_count""")
def registry_report(spark, sf):
    return evidence.report_totals(evidence.match_rows(mail_rows(spark, sf)))
