"""The company run from a saved registry to postings and skips, on rows written out by hand."""

import random

from jobflow.functions import html
from jobflow.operators import registry
from jobflow.plans import searches
from jobflow.sources import pages

AS_OF = "2024-01-31 00:00:00"
RECORD = ("company string, count long, ats_hints array<string>, company_domains array<string>,"
          " sender_domains array<string>, sender_emails array<string>, examples array<string>")


def test_company_run_gives_postings_and_skips(spark):
    raw = spark.createDataFrame([
        ("Acme", 2, ["greenhouse"], ["acme.com"], [], [], []),
        ("Zoox", 1, [], ["zoox.com"], [], [], []),
        ("Ansys", 3, [], ["ansys.com"], [], [], ["thank you for applying to Ansys"]),
    ], RECORD)
    landed = spark.createDataFrame([
        ("https://ansys.com/careers", "<body><a href='/jobs/1'>Data Scientist role</a><a href='/about'>about us</a></body>"),
        ("https://ansys.com/jobs/1", "<body><h1>Data Scientist</h1><p>Posted on 2024-01-22</p></body>"),
    ], "url string, html string")
    broken = spark.createDataFrame([("https://boards.greenhouse.io/acme", "oops{")], "board_url string, json string")
    found = searches.company_search(
        raw, registry.file_rows(raw), {"greenhouse": broken}, landed, "2024-01-31T00:00:00+00:00", AS_OF, ["data scientist"])
    assert {r.company for r in found.registry.collect()} == {"Acme", "Zoox", "Ansys"}
    assert {(r.institution, r.title, r.url) for r in found.deduped.collect()} == {
        ("Ansys", "Data Scientist", "https://ansys.com/jobs/1")}
    assert sorted(r.line for r in found.skips.collect()) == [
        "Acme\thttps://boards.greenhouse.io/acme\tmalformed document", "Zoox\tNO_RESULTS"]


def test_a_broken_page_is_a_skip_line(spark):
    """The company of a page that no parser accepts gets an error line; the other company is searched."""
    raw = spark.createDataFrame([
        ("Zoox", 1, [], ["zoox.com"], [], [], ["thank you for applying to Zoox"]),
        ("Ansys", 3, [], ["ansys.com"], [], [], ["thank you for applying to Ansys"]),
    ], RECORD)
    landed = spark.createDataFrame([
        ("https://ansys.com/careers", "<body><a href='/jobs/1'>Data Scientist role</a></body>"),
        ("https://ansys.com/jobs/1", "<body><h1>Data Scientist</h1><p>Posted on 2024-01-22</p></body>"),
        ("https://zoox.com/careers", "<body><a href='/jobs/2'>Data Scientist role</a><![foo bar]></body>"),
    ], "url string, html string")
    found = searches.company_search(
        raw, registry.file_rows(raw), {}, landed, "2024-01-31T00:00:00+00:00", AS_OF, ["data scientist"])
    assert {r.institution for r in found.deduped.collect()} == {"Ansys"}
    lines = [r.line for r in found.skips.collect()]
    assert "Zoox\thttps://zoox.com/careers\tmalformed page" in lines and not any(x.startswith("Ansys") for x in lines)


def test_any_bytes_are_a_page_or_an_error(spark):
    rnd = random.Random(2)
    piece = lambda: rnd.choice(["<", ">", "<!", "<![", "]>", "&#", "<a href=", "x", "</", "<!--", "--", "\x00", "é", "<?", "'", '"', "[CDATA[",
                                "if ", "foo", " ", "<!doctype", "p", "=", "/"])
    rows = [(k, "c", f"u{k}", "".join(piece() for _ in range(rnd.randint(0, 30)))) for k in range(1000)]
    rows += [(1000, "c", "u1000", "<![foo bar]>x<p>y"), (1001, "c", "u1001", None)]
    df = spark.createDataFrame(rows, "page_id long, company string, url string, html string")
    read = df.select("url", html.parse_page(df.html).alias("page")).collect()
    assert len(read) == len(rows)
    bad = {r.url for r in read if r.page.error is not None}
    assert "u1000" in bad and "u1001" not in bad and len(bad) < len(rows) // 2
    assert all(r.page.text == "" and not r.page.anchors for r in read if r.url in bad)
    assert {r.board_url for r in pages.page_errors(df).collect()} == bad


def test_limits_are_choices(spark):
    """The published number of companies is an argument; without it all are searched."""
    ranked = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "company string, priority long")
    assert [r.company for r in registry.top_companies(ranked, 2).collect()] == ["c", "a"]
    assert registry.top_companies(ranked).count() == 3
