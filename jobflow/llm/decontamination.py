"""Benchmark decontamination by winnowing, in built-in expressions only.

Words are runs of digits, a-z (A-Z count as a-z) and characters beyond ASCII. A benchmark item's windows
are its runs of ``span`` words; an item of fewer words is one window. Hashes of ``gram`` words are
winnowed: of every ``width`` neighbouring grams the one of smallest hash (the last of equals) is a
fingerprint, where gram + width - 1 is the window's length. So two texts that share a window share a
fingerprint inside it: the guarantee holds for every window, at every place.

Fingerprints of documents that the benchmark has too are hits (a semi join on hashes; nothing is
multiplied). Around a hit all windows that contain it are spelled out, and join the benchmark's distinct
windows by their words: no hash decides alone. Short items need fingerprints of their own length; a
document is winnowed once per length that the benchmark has, ``span`` at most.

Windows with the same list of items form a class, and documents with the same set of classes a
signature. Items are listed once per signature, so a window that a third of all documents and a third of
all items share is not multiplied out.

Null texts have no words. Documents are told apart by id and two text hashes, so rows that share an id,
or have none, and differ in text have results of their own, and repeated rows repeat the result. Items
that share an id are one item; a null id is the item ``null``. Ties between grams cannot lose a window. Empty
tables: no documents give no rows, no items no hits. Extra columns are not read.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobflow.llm.common import written
from jobflow.llm.registry import query

SPAN, GRAM = 10, 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: the same words before A-Z are lower-cased
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "".join(map(chr, range(65, 91)))


def words_of(text):
    """Words of a text column; ``lower`` may change other letters, so it is for ASCII texts alone."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.regexp_extract_all(F.coalesce(folded, F.lit("")), F.lit(WORD), F.lit(0))


def _once(df: DataFrame, name: str, value) -> DataFrame:
    """Add a column computed once per row: nothing is moved or copied through a generator."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def scheme(length: int, gram: int = GRAM) -> tuple[int, int]:
    """(gram, width) whose winnowing guarantees every shared run of ``length`` words."""
    size = min(gram, (length + 1) // 2)
    return size, length - size + 1


def fingerprints(rows: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """Of rows with ``hashes`` (of words): the other columns, the gram's position ``at`` and its ``print``."""
    size, width = scheme(length, gram)
    keys = [c for c in rows.columns if c != "hashes"]
    more = "".join(f", hashes[i + {k}]" for k in range(1, size))
    rows = _once(rows, "grams", F.expr(
        f"transform(slice(hashes, 1, greatest(size(hashes) - {size - 1}, 0)), (x, i) -> xxhash64({length}, x{more}))"))
    least = f"least(x{''.join(f', grams[i + {k}]' for k in range(1, width))})" if width > 1 else "x"
    rows = _once(rows.drop("hashes"), "least", F.expr(
        f"transform(slice(grams, 1, greatest(size(grams) - {width - 1}, 0)), (x, i) -> {least})"))
    last = "".join(f"WHEN grams[i + {k}] = x THEN i + {k} " for k in range(width - 1, 0, -1))
    place = f"CASE {last}ELSE i END" if last else "i"
    return rows.select(*keys, F.explode(F.expr(
        f"transform(array_distinct(transform(least, (x, i) -> {place})), i -> named_struct('at', i, 'print', grams[i]))")
    ).alias("_f")).select(*keys, F.col("_f.at").alias("at"), F.col("_f.print").alias("print"))


def _hashed(rows: DataFrame) -> DataFrame:
    return _once(rows, "hashes", F.transform("words", lambda w: F.xxhash64(w))).drop("words")


def windows_of(bench: DataFrame, span: int = SPAN) -> DataFrame:
    """(length, window, item): every distinct window of every item, as its words joined by blanks."""
    rows = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    rows = _once(rows, "words", words_of(F.col("text"))).where("size(words) > 0").drop("text")
    rows = rows.withColumn("length", F.least(F.size("words"), F.lit(span)))
    every = F.expr("transform(sequence(1, size(words) - length + 1), i -> array_join(slice(words, i, length), ' '))")
    return rows.select("length", F.explode(every).alias("window"), "item").distinct()


def _key(docs: DataFrame) -> list:
    """Columns that tell documents apart: id and two hashes of the text under different seeds."""
    return [F.col("doc_id"), F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit(1), "text").alias("_k2")]


KEY = ["doc_id", "_k1", "_k2"]


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the document key, null ids included; the hashes are the join's hash keys."""
    right = right.withColumnsRenamed({c: f"r{c}" for c in KEY})
    on = (F.col("_k1") == F.col("r_k1")) & (F.col("_k2") == F.col("r_k2")) & F.col("doc_id").eqNullSafe(F.col("rdoc_id"))
    return left.join(right, on, how).drop(*[f"r{c}" for c in KEY])


def find_hits(docs: DataFrame, windows: DataFrame, gram: int = GRAM) -> DataFrame:
    """(doc_id, _k1, _k2, begin, length, window): every place of a document where a window occurs."""
    plain = windows.select("length", "window").distinct()
    lengths = sorted(r.length for r in plain.select("length").distinct().collect())  # at most ``span`` numbers
    texts = docs.where("text IS NOT NULL")
    hashed = _hashed(_once(texts.select(*_key(texts), "text"), "words", words_of(F.col("text"))).drop("text"))
    found = []
    for length in lengths:
        own = plain.where(F.col("length") == length).select(F.split("window", " ").alias("words"))
        prints = fingerprints(_hashed(own), length, gram).select("print").distinct()
        hit = fingerprints(hashed, length, gram).join(prints, "print", "left_semi")
        found.append(hit.groupBy(*KEY).agg(F.collect_set("at").alias("at")).withColumn("length", F.lit(length)))
    if not found:
        return docs.select(*_key(docs), F.lit(0).alias("begin"), F.lit(0).alias("length"), F.lit("").alias("window")).limit(0)
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    hits = written(hits, "prints").groupBy(*KEY).agg(F.collect_list(F.struct("length", "at")).alias("_hits"))
    rows = _same(texts.select(*_key(texts), "text"), hits, "inner")  # repeated rows repeat their hits
    rows = _once(rows, "words", words_of(F.col("text"))).drop("text")
    width = "(x.length - CASE " + " ".join(f"WHEN x.length = {n} THEN {scheme(n, gram)[0]}" for n in lengths) + " END)"
    begins = f"""flatten(transform(_hits, x -> transform(array_distinct(flatten(transform(x.at, p ->
        sequence(greatest(p - {width}, 0), least(p, size(words) - x.length))))),
        b -> named_struct('begin', b, 'length', x.length, 'window', array_join(slice(words, b + 1, x.length), ' ')))))"""
    rows = rows.select(*KEY, F.explode(F.expr(begins)).alias("_w")).select(*KEY, "_w.*")
    return rows.join(plain, ["length", "window"], "left_semi").select(*KEY, "begin", "length", "window")


def decontaminate(docs: DataFrame, bench: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: doc_id, ``n_words``, ``n_hit`` (words inside occurring windows), ``spans`` (those
    words' ranges, from 0, end excluded) and ``items`` (ids of items with occurring windows, sorted as texts)."""
    docs = docs.select("doc_id", "text")
    windows = written(windows_of(bench, span), "windows")
    listed = windows.groupBy("length", "window").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn(
        "class", F.md5(F.array_join("items", "\x00")))
    listed = written(listed, "classes")
    hits = find_hits(docs, windows, gram).join(listed.select("length", "window", "class"), ["length", "window"])
    per = hits.groupBy(*KEY).agg(
        F.sort_array(F.collect_set(F.struct("begin", (F.col("begin") + F.col("length")).alias("end")))).alias("places"),
        F.sort_array(F.collect_set("class")).alias("classes"))
    merged = F.expr("""aggregate(places, CAST(array() AS array<struct<begin:int,end:int>>), (s, x) ->
        IF(size(s) > 0 AND x.begin <= s[size(s) - 1].end,
           concat(slice(s, 1, size(s) - 1), array(named_struct('begin', s[size(s) - 1].begin, 'end',
             greatest(x.end, s[size(s) - 1].end)))), concat(s, array(x))))""")
    per = written(per.select(*KEY, merged.alias("spans"), "classes", F.md5(F.array_join("classes", "")).alias("sign")), "hits")
    signs = per.groupBy("sign").agg(F.first("classes").alias("classes")).select("sign", F.explode("classes").alias("class"))
    of_class = listed.groupBy("class").agg(F.first("items").alias("items"))
    items = signs.join(of_class, "class").select("sign", F.explode("items").alias("item")).groupBy("sign").agg(
        F.sort_array(F.collect_set("item")).alias("items"))
    per = per.join(items, "sign").select(*KEY, "spans", "items")
    counted = docs.select(*_key(docs), F.coalesce(F.regexp_count("text", F.lit(ANY_CASE)), F.lit(0)).cast("long").alias("n_words"))
    none = F.expr("CAST(array() AS array<struct<begin:int,end:int>>)")
    return _same(counted, per, "left").select(
        "doc_id", "n_words", F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items")).withColumn(
        "n_hit", F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.begin)"))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''),
    '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') AS w FROM benchmark),
b2 AS (SELECT item, w, least(len(w), {SPAN}) AS m FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM b2)),
dw AS (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b2) WHERE len(w) >= m)),
hits AS (SELECT rid, m, i, win FROM dw WHERE (m, win) IN (SELECT (m, win) FROM bw)),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hits) GROUP BY rid),
named AS (SELECT DISTINCT rid, item FROM hits JOIN bw USING (m, win)),
listed AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM named GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(l.n, 0) AS BIGINT) AS n_items, sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (rid) LEFT JOIN listed l USING (rid)
"""


@query("op12_decontaminate", OP12_SQL)
def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, bench).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
