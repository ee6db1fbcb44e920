"""Golden rows for the semantics that are easy to get wrong."""

import datetime

import pytest
from pyspark.sql import functions as F

from jobflow.functions import dates, html, names, text, urls
from jobflow.operators import dedup, filters, keywords, scoring
from jobflow.sources import files, pages

AS_OF = "2024-01-31 00:00:00"


def ask(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_identity_text_keeps_trailing_separator(spark):
    assert ask(spark, ["Engineer!", "Engineer", " A  b c ", "!!!"], text.normalize_text) == ["engineer ", "engineer", "a b c", " "]


def test_restriction_phrases_are_substrings(spark):
    got = ask(spark, ["military base", "nothing", "Green Card holder"], lambda v: filters.is_restricted(v, F.lit("")))
    assert got == [True, False, True]
    bounded = ask(spark, ["military base", "ITAR rules"], lambda v: filters.is_restricted(v, F.lit(""), word_boundary=True))
    assert bounded == [False, True]


@pytest.mark.parametrize("first,want", [
    (False, [True, False, True, True, True, False, False, True, True]),
    (True, [True, True, True, True, True, False, False, True, True]),
])
def test_locations(spark, first, want):
    values = ["", "San Francisco, CA", "Austin, TX", "Remote - DE", "Boise USA", "Berlin DE", "Boston", "Fort Collins CO", "Somewhere, United States"]
    assert ask(spark, values, lambda v: filters.location_allowed(v, states_first=first)) == want


def test_posting_dates(spark):
    day = datetime.datetime(2024, 1, 31)
    values = ["30+ days ago", "Posted Today", "Mon 01-05", "Jan 5, 2024", "1/5/2024", "2024", "yesterday", "2024-01-05T10:00:00+0200", None]
    company = ask(spark, values, lambda v: dates.parse_posted_date(v, AS_OF, True))
    broad = ask(spark, values[:1], lambda v: dates.parse_posted_date(v, AS_OF, False))
    assert broad == [day - datetime.timedelta(days=30)]
    assert company[0] == day - datetime.timedelta(days=31)
    assert company[1] is None and company[5] is None and company[8] is None
    assert company[2] == datetime.datetime(1900, 1, 5)
    assert company[3] == company[4] == datetime.datetime(2024, 1, 5)
    assert company[6] == day - datetime.timedelta(days=1)
    assert company[7] == datetime.datetime(2024, 1, 5, 8)
    assert ask(spark, ["Posted Today"], lambda v: dates.parse_posted_date(v, AS_OF, True, lenient_words=True)) == [day]


def test_urls(spark):
    assert ask(spark, ["HTTPS://H/a/?gh=1&UTM_s=2&k&ref=3#x", "https://h/a?a=~*", "", "  "], urls.normalize_url) == [
        "https://h/a?gh=1&k=", "https://h/a?a=~*", "", ""
    ]
    assert ask(spark, ["https://h/a/?gh=1", "https://h/a?gh=2#z", "http://h//"], urls.clean_url) == ["https://h/a", "https://h/a", "http://h"]
    base = F.lit("https://h.x/a/b/c?q=1#f")
    links = ["../d", "./e?z=1", "g/../k", "/m", "//n.y/o", "?p=2", "#r", "", "mailto:x@y", "../../../up"]
    assert ask(spark, links, lambda v: urls.join_url(base, v)) == [
        "https://h.x/a/d", "https://h.x/a/b/e?z=1", "https://h.x/a/b/k", "https://h.x/m", "https://n.y/o",
        "https://h.x/a/b/c?p=2", "https://h.x/a/b/c?q=1#r", "https://h.x/a/b/c?q=1#f", "mailto:x@y", "https://h.x/up",
    ]


def test_names(spark):
    assert ask(spark, ["applied materials careers", "The", "GE", "orNL careers", "a@b", "Foo (US)", "linkedin", "x1"], names.canonical_name) == [
        "Applied Materials", None, "GE", "Oak Ridge National Laboratory", None, "Foo (US", None, "x1"
    ]  # the closing bracket goes with the edge characters, before brackets are looked at
    rows = ["Information about your application to Applied Materials today", "thank you for applying to Big Co - job"]
    got = ask(spark, rows, names.row_candidates)
    assert "Applied" in got[0] and "Big Co" in got[1]
    assert ask(spark, ["Simulation role at Acme at Beta", "lam", "no-reply", "Acme - FEA engineer", "engineer"], names.candidate_name) == [
        "Beta", "Lam Research", None, "Acme", None
    ]
    owned = ask(spark, ["thank you for applying to Acme, Sam your file"], lambda v: names.row_candidates(v, "Sam"))
    assert owned == [["Acme"]]


def test_ats_hints_are_substrings(spark):
    assert ask(spark, ["a clever plan", "see adjoin.com"], text.ats_hints) == [["lever"], ["join"]]


def test_keywords(spark):
    assert ask(spark, ["a # x, y\nA\n b "], keywords.parse_keywords) == [["a", "y", "b"]]
    assert ask(spark, ["a b,a"], keywords.parse_lines) == [["a", "b"]]
    once = ask(spark, ["B, a, b"], keywords.parse_keywords)[0]
    assert ask(spark, ["\n".join(once)], keywords.parse_keywords)[0] == once
    match = lambda v: filters.keyword_match(v, F.lit("fast car parts"), ["++", "art"])
    assert ask(spark, ["x"], match) == [True]
    assert ask(spark, ["x"], lambda v: filters.keyword_match(v, F.lit("y"), ["++"])) == [False]


def test_page_text_rules(spark):
    page = "<html><head><title>T &amp; U</title><style>p{}</style></head><body><!-- no --><nav>Menu</nav><h1>A<b>B</b></h1><p>one<p>two<script>var t='</p>'</script></body></html>"
    got = spark.createDataFrame([(page,)], "h string").select(html.parse_page(F.col("h")).alias("p")).first().p
    assert got.text == "T & U Menu A B one two"
    assert got.main_text == "Menu A B one two"
    assert got.readable == "T & U\nA\nB\none\ntwo"
    assert (got.h1, got.title) == ("A B", "T & U")


def test_jsonld_shapes(spark):
    job = '{"@type":"JobPosting","title":"T","jobLocation":{"address":{"addressLocality":"L","addressCountry":"US"}}}'
    docs = [f"[{job},3]", f'{{"@graph":[{job},{job}]}}', job, "{broken", "[]", '{"@type":"Thing"}']
    df = spark.createDataFrame([(i, [d]) for i, d in enumerate(docs)], "i int, s array<string>")
    got = [r.p for r in df.select("i", pages.jsonld_postings(F.col("s")).alias("p")).orderBy("i").collect()]
    assert [len(p) for p in got] == [1, 2, 1, 0, 0, 0]
    assert got[0][0].location == "L US"


def test_score_lines(spark):
    reply = "JOB 1: SCORE= 7 | REASON=good REASON=more\nnoise\nJOB 2: SCORE=x|REASON= bad "
    got = scoring.parse_scores(spark.createDataFrame([(0, reply)], "batch_id long, text string")).orderBy("pos").collect()
    assert [(r.pos, r.score, r.reason) for r in got] == [(1, 7, "good"), (2, 5, "bad")]


def test_review_fallback(spark):
    good, bad = '```json\n{"quality_score": 3, "summary": "s", "weak": ["w"]}\n```', "bad reply"
    got = ask(spark, [good, bad], scoring.parse_review)
    assert (got[0].quality_score, got[0].weak) == (3, ["w"])
    assert (got[1].quality_score, got[1].summary, got[1].weak) == (None, "bad reply", [])


def test_mailbox_array_keeps_strings_only(spark, tmp_path):
    (tmp_path / "rows.json").write_text('[\n  "a, b",\n  3,\n  {"x": 1},\n  "c"\n]\n')
    got = files.read_mailbox(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.row) for r in got] == [(0, "a, b"), (1, "c")]


def test_missing_results_give_an_empty_frame(spark, tmp_path):
    assert files.read_results(spark, str(tmp_path / "none")).count() == 0


def test_two_pass_does_not_depend_on_partitioning(spark):
    from jobflow.fixtures import postings_docs

    df = postings_docs(spark, "/root/testdata/sf0.001")
    runs = [sorted((r.seq, r.order_seq) for r in dedup.dedupe_two_pass(df.repartition(n)).collect()) for n in (1, 17)]
    assert runs[0] == runs[1]
    kept = dedup.dedupe_two_pass(df).select(*[text.normalize_key(F.col(c)).alias(c) for c in ("title", "institution", "location")])
    assert kept.count() == kept.distinct().count()


def test_page_parser_is_linear_in_links():
    import time

    def seconds(n):
        page = "<body>" + "<p>text <a href='/jobs/1'>link</a>" * n
        begin = time.perf_counter()
        parsed = html._Page(page)
        assert [len(html._READERS[f](parsed)) for f in ("anchors", "text")][0] == n
        return time.perf_counter() - begin

    seconds(500)
    assert seconds(8000) < 3 * seconds(4000)


def test_unclosed_elements_keep_their_text():
    page = html._Page("<div><a href='x'>one <b>two</div>three<script>no</script></p><h1>four")
    assert [a["text"] for a in html._anchors(page)] == ["one two"]
    assert page.text() == "one two three four" and page.first_text("h1") == "four"


def test_caller_text_is_matched_as_written(spark):
    got = ask(spark, ["Dear C. (Kit) Ltd", "we use c++ here"], lambda v: filters.is_restricted(v, F.lit(""), ["c++ here"], word_boundary=True))
    assert got == [False, True]
    assert ask(spark, ["C. (Kit) Works", "Acme Robotics"], lambda v: names.is_valid_company_name(v, "C. (Kit)"))[1]


def test_nested_lists_of_a_mailbox_array_are_dropped(spark, tmp_path):
    (tmp_path / "box.json").write_text('[\n  "a, ]",\n  ["b", "c"],\n  {"k": "d"},\n  [\n    "e"\n  ],\n  {\n  "x":\n  "f"\n  },\n  5,\n  "g \\" ["\n]\n')
    assert [r.row for r in files.read_mailbox(spark, str(tmp_path)).orderBy("seq").collect()] == ["a, ]", 'g " [']


def test_metrics_of_missing_results(spark, tmp_path):
    from jobflow.operators import metrics

    row = metrics.result_metrics(files.read_results(spark, str(tmp_path / "none"))).first()
    assert tuple(row) == (0, 0, 0, 0)
    narrow = spark.createDataFrame([("t", "o")], "title string, institution string")
    assert tuple(metrics.result_metrics(narrow).first()) == (1, 1, 0, 0)


def test_keyword_repeats_keep_the_first_spelling(spark):
    got = ask(spark, ["b, A\na,B, c,,b #x"], lambda v: F.array_join(keywords.parse_keywords(v), "|"))
    assert got == ["b|A|c"]
