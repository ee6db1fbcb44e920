"""Vector, page and archive operators, and the pipeline, with odd rows."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import models
from jobflow.llm import ann, html_text, near_vectors, warc

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(seed=0):
    """Clusters of near vectors, a common vector, and rows that take no part."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 25)):
            v = centre + rng.standard_normal(16) * 0.15 * rng.random()
            rows.append((v * rng.uniform(0.5, 2), c % 3))
    rows += [(np.ones(16), 1)] * 40 + [(np.ones(16) * 2, 1)] + [(np.ones(16), None), (np.zeros(16), 1), (None, 1)]
    out = [(i * 5, None if v is None else [float(x) for x in np.float32(v)], lab) for i, (v, lab) in enumerate(rows)]
    n = len(out) * 5
    return out + [(n, [float("nan")] * 16, 1), (n + 5, [float("inf")] + [1.0] * 15, 1), (n + 10, [None] + [1.0] * 15, 1),
                  (n + 15, [1.0] * 8, 1), (n + 20, [], 1)]


def good(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return (a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum())


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "query_rows": 30}])
def test_near_vectors_match_brute_force(spark, options):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).withColumn("kept", F.lit("clash")).repartition(4)
    got = {r.vec_id: r for r in near_vectors.near_vectors(df, **options).collect()}
    use = [r for r in rows if good(r[1]) and r[2] is not None]
    links = [(a[0], b[0]) for k, a in enumerate(use) for b in use[:k]
             if a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.98]
    root = models.roots([r[0] for r in rows], links)
    counts = {r[0]: 0 for r in rows}
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {
        i: (counts[i], root[i], root[i] == i) for i in root}


def test_graph_search_recall():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((150, 24)), 8, axis=0) + rng.standard_normal((1200, 24)) * 0.05
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    graph = near_vectors.build_graph(x)
    hit = np.zeros((1200, 1200), bool)
    hit[near_vectors.audited_search(graph, x)] = True
    true = x @ x.T >= near_vectors.THRESHOLD
    assert (hit & true).sum() >= 0.99 * true.sum()


def test_nearest_match_brute_force(spark):
    rows = vector_rows(1)
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("clash")).repartition(4)
    got = {}
    for r in ann.search(df, block_rows=64, query_rows=4).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    use = [r for r in rows if good(r[1])]
    hits = total = 0
    for i, v, _ in use:
        if i % 20 == 0:
            best = sorted(((-float(np.dot(np.array(v, float), np.array(w, float))), j) for j, w, _ in use if j != i and len(w) == len(v)))[:20]
            mine = [got.get(i, {}).get(k + 1) for k in range(len(best))]
            assert len(got.get(i, {})) == len(best)
            for (s, j), m in zip(best, mine, strict=True):
                total += 1
                hits += j == m[0]
                assert m[1] == pytest.approx(float(np.dot(np.array(v, float), np.array(dict((a, b) for a, b, _ in use)[m[0]], float))))
    assert hits >= 0.98 * total


def test_error_bounds_hold():
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((2000, 48)) * rng.uniform(0.1, 5, (2000, 1)), rng.standard_normal((50, 48))
    turn = ann.rotation(48)
    estimate, error = ann.bounds(q, ann.encode(x, turn), turn)
    assert (np.abs(estimate - q @ x.T) <= error).mean() > 0.999


def test_codes_choose_what_is_reranked(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((4000, 64))
    x[3000:] = x[:1] + rng.standard_normal((1000, 64)) * 0.1  # a quarter of the rows near one another
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS).repartition(4)
    codes = ann.coded(df)
    assert len(codes.first().code) == ann.BITS // 8
    _, asked = ann.candidates(codes, block_rows=1000, query_rows=50)
    got = asked.select("dim", F.explode("asked").alias("query"), "row").collect()
    assert len(got) == len({(r.query, r.row) for r in got})
    far = {r.row for r in codes.where("vec_id < 3000").select("row").collect()}
    assert sum(r.query in far for r in got) < 0.1 * 150 * 4000
    assert len(got) < 0.1 * 200 * 4000
    exact = x.astype(float) @ x[::20].T.astype(float)
    np.fill_diagonal(exact[::20], -np.inf)
    best = np.sort(np.argsort(-exact, axis=0)[:20], axis=0)
    found = ann.search(df, block_rows=1000, query_rows=50).toPandas()
    assert (found.groupby("query_id").size() == 20).all()
    hits = sum(len(set(best[:, q // 20]) & set(f["vec_id"])) for q, f in found.groupby("query_id"))
    assert hits >= 0.999 * best.size


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head>
<body><header class="top"><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="sidebar"><p>Side text that is long enough to look like an article, if only it were not where it is.</p></div>
<article><header><h1>A &amp; B &#233;</h1></header><p>First   <b>bold</b>
text &lt;here&gt;.<p>Second<br>line.<div class='ad'>Buy!</div><form><input name=q><button>Go</button></form><p>.
<aside>Related</aside><blockquote>Quote &copy; &nbsp; end</blockquote></article>
<section class="comments"><article class="comment"><p>Reader says something</p></article></section><footer>&copy; 2024</footer></body></html>"""


def test_page_text():
    assert html_text.main_text(PAGE) == "A & B é\nFirst bold text <here>.\nSecond line.\n.\nQuote © end"
    long = "Words of the main text that go on for a while. " * 3
    page = f"<body><div class=menu>Menu</div><p>{long}</p><p>Short.</p><p>{long}</p><div class='footer'>Foot</div>"
    assert html_text.main_text(page) == f"{long.strip()}\nShort.\n{long.strip()}"
    assert html_text.main_text("") == "" and html_text.main_text("<p") == ""
    assert html_text.main_text("<article><p>cut off here &am") == "cut off here &am"
    assert html_text.main_text("<article><p>a<!-- x --></p><p>b<scr") == "a\nb"


def test_page_text_around_an_article():
    long = ("Words of the main text that go on for a while. " * 3).strip()
    teaser = "<article><p>Also new</p></article>"
    links = "<p>" + "<a href='/x'>A link of a list of links to other pages</a> " * 5 + "</p>"
    page = f"<body>{teaser}<p>a</p><p>b</p><p>c</p><div class='layout with-sidebar'><p>{long}</p><p>Short.</p><p>{long}</p></div><p></p>{links}"
    text = html_text.main_text(page)
    assert f"{long}\nShort.\n{long}" in text and "Also new" not in text
    assert html_text.main_text(f"<main><p>{long}</p><p>x</p></main>{links}") == f"{long}\nx"
    assert html_text.main_text(f"<main><p>{long}</p></main><div class='site-footer'><p>{long}</p></div>") == long
    assert html_text.main_text(f"<main><p>{long}</p><p>{long}</p></main><div><p>{long}</p></div>") == "\n".join([long] * 3)


@pytest.mark.parametrize("tag", ["div", "section", "ul", "aside"])
@pytest.mark.parametrize("name", [
    "comment-list", "comments-section", "user-comments", "comments", "related-posts", "share-buttons", "ad-slot", "cookie-bar",
    "newsletter-box", "sidebar-inner", "site-nav", "left-sidebar", "post-comments", "widget_area", "promo-banner", "main-menu"])
def test_blocks_of_compound_names_go(tag, name):
    text = "Words of the main text that go on for a while, and then some more of them to the end of it. "
    other = f"<{tag} class='x {name}'><p>{text * 2}</p><p>Somebody says something here.</p></{tag}>"
    body = f"<h1>Title</h1><p>{text}</p><p>Short.</p>"
    assert html_text.main_text(f"<body><article>{body}{other}<p>End.</p></article>{other}</body>") == f"Title\n{text.strip()}\nShort.\nEnd."
    assert html_text.main_text(f"<body>{other}<div>{body}</div>{other}</body>") == f"Title\n{text.strip()}\nShort."


@pytest.mark.parametrize("name", ["with-sidebar", "has-comments", "no-nav", "layout-sidebar", "content-sidebar-wrap", "tag-social",
                                  "category-search", "story", "headline", "adventure", "commentary", "shareholder-news"])
def test_blocks_that_only_have_such_parts_stay(name):
    text = "Words of the main text that go on for a while, and then some more of them to the end of it."
    assert html_text.main_text(f"<body><div class='{name}'><p>{text}</p><p>Short.</p></div></body>") == f"{text}\nShort."
    assert html_text.main_text(f"<article class='post {name} comments-open'><p>{text}</p></article>") == text


def test_page_text_is_linear():
    import time

    def seconds(n):
        page = "<article>" + "<div class='a'><a href='x'>t</a><p>u &amp; v" * n
        begin = time.perf_counter()
        assert html_text.main_text(page).count("\n") >= n
        return time.perf_counter() - begin

    seconds(500)
    assert seconds(8000) < 5 * max(seconds(2000), 0.02) * 2


def test_given_pages(spark):
    got = {r.page_id: r.text for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = r.html.partition("<article>")[2].partition("</article>")[0]
        inner = __import__("re").sub(r"<[^>]*\Z", "", inner)
        blocks = __import__("re").split(r"<(?:/?p|/?h1|br)>", inner)
        blocks = [" ".join(__import__("html").unescape(__import__("re").sub(r"<[^>]+>", "", b)).split()) for b in blocks]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_pages_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "<article>x"), (2, "u", "")], "page_id long, url string, html string")
    rows = html_text.extract(df.withColumn("text", F.lit("clash"))).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in rows) == [("1", "", 0), ("2", "", 0), ("2", "", 0), ("None", "x", 1)]


def records(n=30):
    rnd = random.Random(1)
    out = []
    for k in range(n):
        body = ("<p>%d</p>" % k + "é\r\n\r\nWARC text " * rnd.randint(0, 40)).encode()
        digest = hashlib.sha1(body).hexdigest()
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n"
        out.append(head.encode() + body + b"\r\n\r\n")
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_recovers_later_records(packed):
    parts = [gzip.compress(r) if packed else r for r in records()]
    whole = list(warc.salvage(b"".join(parts)))
    assert [r["record_id"] for r in whole] == [str(k) for k in range(30)] and not any("gap_bytes" in r for r in whole)
    broken = list(parts)
    middle = len(broken[7]) // 2
    broken[7] = broken[7][:middle] + b"#" + broken[7][middle + 1:]
    broken[12] = broken[12][:-20]
    broken[29] = broken[29][:-9]
    data = b"garbage" + b"".join(broken)
    rows = list(warc.salvage(data))
    found = [int(r["record_id"]) for r in rows if "gap_bytes" not in r]
    assert found == [k for k in range(30) if k not in (7, 12, 29)]
    gaps = sum(r["gap_bytes"] for r in rows if "gap_bytes" in r)
    assert gaps == 7 + len(broken[7]) + len(broken[12]) + len(broken[29])
    assert list(warc.salvage(b"")) == []


def test_archive_round_trip(spark, tmp_path):
    big = "long payload é " * 200
    rows = [(1, "a", big), (2, "b", big), (3, "c", "small"), (4, "d", "small"), (5, None, None), (6, "x\r\ny", ""), (7, "e", big + "!")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    path = str(tmp_path / "archive")
    warc.write_archive(warc.archive_records(df), path, file_records=2)
    got = {int(r.record_id): r for r in warc.read_archive(spark, path).collect() if r.gap_bytes is None}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("revisit", "2"), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None),
        6: ("response", None), 7: ("response", None)}
    for i, _, html in rows:
        assert got[i].payload_digest == hashlib.sha1((html or "").encode()).hexdigest()
        assert bytes(got[i].payload) == (b"" if i == 1 else (html or "").encode())


def test_archive_query_of_odd_rows(spark, tmp_path):
    big = "long payload é " * 200
    rows = [(1, "a", big), (3, "b", big), (3, "b", big), (None, "c", big), (None, None, None), (4, "d", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.op10_warc(spark, str(tmp_path)).collect())
    n = len(big.encode())
    assert got == [("1", n, "revisit", 3), ("3", n, "response", None), ("3", n, "response", None), ("4", 1, "response", None),
                   ("None", 0, "response", None), ("None", n, "response", None)]


def test_empty_tables(spark, tmp_path):
    vectors = spark.createDataFrame([], VECTORS)
    assert near_vectors.near_vectors(vectors).count() == 0 and ann.search(vectors).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(pages).count() == 0
    path = str(tmp_path / "none")
    warc.write_archive(warc.archive_records(pages), path)
    assert warc.read_archive(spark, path).count() == 0


def test_pipeline_stages(spark):
    """Every stage against a brute-force version on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        kept[name] = (before, docs.collect())
        if name != "pieces":
            assert docs.columns == columns
    assert list(stages) == ["quality", "near_copies", "passages", "mix", "pieces"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = kept["quality"]
    ids = {r.doc_id for r in after}
    assert all(r.doc_id in ids for r in before if labels.get(r.doc_id) == 1)
    assert sum(r.doc_id in ids for r in before if labels.get(r.doc_id) == 0) <= 0.3 * sum(labels.get(r.doc_id) == 0 for r in before)
    before, after = kept["near_copies"]
    root = models.near_copies([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in root.items() if i == c)
    before, after = kept["passages"]
    want = models.cut_passages([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: r.text for r in after} == {i: w[0] for i, w in want.items()}
    before, after = kept["mix"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    assert sum(len(models.words(r.text)) for r in after) == pytest.approx(sum(len(models.words(r.text)) for r in before), rel=0.05)
    assert all(r.round_trip for r in kept["pieces"][1]) and len(kept["pieces"][1]) == len(after)
