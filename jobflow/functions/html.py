"""Page parsing on executors: one Arrow-batched pass per page with the standard HTML tokenizer.

Spark has no HTML reader, so this is the one place where rows visit Python. The helper only
turns a page into plain columns; every rule about links, dates, titles and postings is a
Column expression elsewhere.
"""

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(["script", "style", "template"])
_CHROME = frozenset(["script", "style", "template", "nav", "footer", "header"])

#: pages whose facts a worker holds at once, whatever the size of an Arrow batch
PAGE_SLICE = 128

PAGE_FIELDS = {
    "text": "string", "main_text": "string", "readable": "string", "h1": "string", "title": "string",
    "meta_date": "string", "anchors": "array<struct<href:string,text:string>>", "jsonld": "array<string>", "error": "string",
}
RECORD_SCHEMA = (
    "array<struct<href:string,title:string,institution:string,location:string,posted:string>>"
)

#: fixed values: where each record-style site keeps its fields
ACADEMIC_TABLE = {
    "row": [("tr", "class*", "job")],
    "links": ["/ajo/jobs/"],
    "cells": {"institution": 1, "location": 2},
}
HIGHER_ED_ROWS = {
    "row": [("", "class", "record-row"), ("tr", "class", "row-striped")],
    "links": ["/faculty/", "/research/", "/jobs/"],
    "classes": {
        "institution": ["col-inst", "institution"],
        "location": ["col-location", "location"],
        "posted": ["col-date", "date", "posted"],
    },
}
PORTAL_ANCHORS = {"anchor_classes": ["job-listing-title"], "below_classes": ["job-title"]}
LAB_ANCHORS = {"anchor_attr": "data-job-id", "below_classes": ["job-title", "title"]}


class _Page(HTMLParser):
    """A page as opened elements and text runs, built in one linear pass.

    Elements are numbered as they open, so what lies inside one is a range of element numbers and a
    range of runs; each run knows whether it is hidden or part of the page's frame. A source that
    the parser rejects is a page without elements and text, and ``error`` says why: one bad page
    never ends a job.
    """

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self._begin()
        self.error = None
        try:
            self.feed(source or "")
            self.close()
        except Exception as e:  # whatever a landed page makes the parser raise is a fact of that page
            self.error = f"{type(e).__name__}: {e}"
            self._begin()
        self.flush()
        while self.path:
            self._pop()

    def _begin(self):
        self.elements, self.parents, self.ends = [], [], []  # (tag, attributes), parent, element behind the last inside
        self.runs, self.spans = [], []  # (data, hidden, chrome), and per element its range of runs
        self.path, self.open, self.pending = [], {}, []
        self.hidden = self.chrome = 0

    def flush(self):
        if self.pending:
            self.runs.append(("".join(self.pending), self.hidden > 0, self.chrome > 0))
            self.pending = []

    def _pop(self):
        ident = self.path.pop()
        tag = self.elements[ident][0]
        self.open[tag] -= 1
        self.hidden -= tag in _HIDDEN
        self.chrome -= tag in _CHROME
        self.ends[ident] = len(self.elements)
        self.spans[ident][1] = len(self.runs)

    def handle_starttag(self, tag, attrs):
        self.flush()
        ident = len(self.elements)
        self.elements.append((tag, {k: v or "" for k, v in attrs}))
        self.parents.append(self.path[-1] if self.path else -1)
        self.ends.append(ident + 1)
        self.spans.append([len(self.runs), len(self.runs)])
        if tag not in _VOID:
            self.path.append(ident)
            self.open[tag] = self.open.get(tag, 0) + 1
            self.hidden += tag in _HIDDEN
            self.chrome += tag in _CHROME

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        while self.open.get(tag):
            last = self.elements[self.path[-1]][0] == tag
            self._pop()
            if last:
                return

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def text(self, inside=None, joiner=" ", frame=True):
        """Visible text of the page, or of one element; without the page's frame if asked."""
        runs = self.runs if inside is None else self.runs[slice(*self.spans[inside])]
        pieces = (data.strip() for data, hidden, chrome in runs if not (hidden if frame else chrome))
        return joiner.join(p for p in pieces if p)

    def source(self, inside):
        """All character data of an element, hidden or not."""
        return "".join(data for data, _, _ in self.runs[slice(*self.spans[inside])])

    def find(self, tag, inside=None):
        within = range(len(self.elements)) if inside is None else range(inside + 1, self.ends[inside])
        return [i for i in within if self.elements[i][0] == tag]

    def first_text(self, tag):
        hit = next((i for i, e in enumerate(self.elements) if e[0] == tag), None)
        return None if hit is None else self.text(hit)

    def classes(self, ident):
        return self.elements[ident][1].get("class", "").split()

    def has_class(self, ident, names):
        return any(n in self.classes(ident) for n in names)


def _main_text(page):
    main = (page.find("main") or page.find("body") or [None])[0]
    return page.text(main)


def _meta_date(page):
    for attr, value in (("property", "article:published_time"), ("name", "date")):
        for i in page.find("meta"):
            if page.elements[i][1].get(attr) == value:
                return page.elements[i][1].get("content")
    return None


def _anchors(page):
    return [
        {"href": page.elements[i][1]["href"].strip(), "text": page.text(i)}
        for i in page.find("a")
        if "href" in page.elements[i][1]
    ]


def _jsonld(page):
    return [
        page.source(i) for i in page.find("script") if page.elements[i][1].get("type") == "application/ld+json"
    ]


_READERS = {
    "text": _Page.text, "main_text": _main_text, "readable": lambda page: page.text(joiner="\n", frame=False),
    "h1": lambda page: page.first_text("h1"), "title": lambda page: page.first_text("title"),
    "meta_date": _meta_date, "anchors": _anchors, "jsonld": _jsonld,
    "error": lambda page: page.error,
}


def slices(batches, rows=PAGE_SLICE):
    """The rows of Arrow batches in small pieces, so that what a worker makes of them is soon sent on."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start:start + rows]


def parse_page(html, *fields):
    """Struct column of page facts: those of ``PAGE_FIELDS`` that are named, else all."""
    fields = fields or tuple(PAGE_FIELDS)

    @F.pandas_udf(", ".join(f"{f} {PAGE_FIELDS[f]}" for f in fields))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in slices(batches):
            parsed = map(_Page, pages)
            yield pd.DataFrame([tuple(_READERS[f](page) for f in fields) for page in parsed], columns=list(fields))

    return run(html)


def html_text(html):
    """Visible text of an HTML fragment, pieces joined by one blank."""

    @F.pandas_udf("string")
    def run(fragments: pd.Series) -> pd.Series:
        return pd.Series([_Page(f).text() for f in fragments], dtype=object)

    return run(html)


def _record_rows(source, site):
    page = _Page(source)
    rows = []
    for row, (tag, attrs) in enumerate(page.elements):
        if not any(
            (not want or tag == want)
            and (value in attrs.get("class", "") if how == "class*" else page.has_class(row, [value]))
            for want, how, value in site["row"]
        ):
            continue
        links = [a for a in page.find("a", row) if "href" in page.elements[a][1]]
        link = next(
            (a for part in site["links"] for a in links if part in page.elements[a][1]["href"]), None
        )
        if link is None:
            continue
        out = {"href": page.elements[link][1]["href"], "title": page.text(link, "")}
        cells = page.find("td", row)
        for field in ("institution", "location", "posted"):
            at = site.get("cells", {}).get(field)
            hit = cells[at] if at is not None and at < len(cells) else next(
                (i for i in range(row + 1, page.ends[row]) if page.has_class(i, site.get("classes", {}).get(field, []))), None
            )
            out[field] = "" if hit is None else page.text(hit, "")
        rows.append(out)
    return rows


def _anchor_rows(source, site):
    page = _Page(source)
    rows, below = [], []
    for i, (tag, _) in enumerate(page.elements):  # whether an element lies below a listing's heading
        up = page.parents[i]
        below.append(up >= 0 and (
            below[up] or page.elements[up][0] == "h2" or page.has_class(up, site["below_classes"])
        ))
        if tag != "a":
            continue
        attrs = page.elements[i][1]
        if page.has_class(i, site.get("anchor_classes", [])) or site.get("anchor_attr") in attrs or below[i]:
            rows.append({
                "href": attrs.get("href", ""), "title": page.text(i, ""),
                "institution": "", "location": "", "posted": "",
            })
    return rows


def parse_records(html, site):
    """Array of posting records found on a search page of a record-style site."""

    @F.pandas_udf(RECORD_SCHEMA)
    def run(pages: pd.Series) -> pd.Series:
        reader = _record_rows if "row" in site else _anchor_rows
        return pd.Series([reader(p, site) for p in pages], dtype=object)

    return run(html)


def html_texts(fragments):
    """Visible text of an array of HTML fragments, all joined by one blank."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        joined = [
            None if row is None else " ".join(_Page(f).text() for f in row if f is not None) for row in rows
        ]
        return pd.Series(joined, dtype=object)

    return run(fragments)
