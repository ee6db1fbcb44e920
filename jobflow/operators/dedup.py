"""Deduplication and entity merge of postings.

``merge_entities`` gives every row the entity it would join if rows were taken one by one in
``seq`` order, and merges each entity's fields. The sequential rule is:

* a row whose url key is known joins the entity that owns the url; else a row whose identity
  key is known joins the entity the key points to; else it starts an entity;
* blank fields of the entity are filled from the row; a row of strictly higher quality
  (has description, has date, url length) also replaces five fields;
* the entity is then known under its current url key and identity key, old keys stay valid.

A row's choice depends only on earlier rows. So the assignment is computed as a fixpoint:
guess all entities, derive from the guess which keys were known when, let every row choose
again, and stop when no row changes. Each round makes at least the next dependency level
final, and a table that does not change is the sequential answer. All rounds are joins and
map-side combined aggregates; no group is ever collected, whatever its size. Rounds see numbers
only: every url key and identity key has one, and the texts of an identity are looked up where an
entity takes it on.

``mode="component"`` is the coarser rule: rows that share a url key or an identity key, directly or
through other rows, are one entity. Its fields are filled and replaced in ``seq`` order as above.
"""

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobflow.functions.text import is_blank, normalize_key, normalize_text, strip
from jobflow.functions.urls import clean_url, normalize_url
from jobflow.operators.graph import connected_components
from jobflow.schema import BROAD_FIELDS
from jobflow.session import cut_lineage, discard

log = logging.getLogger(__name__)

#: fields a better row replaces in an entity
REPLACED_FIELDS = ["description", "date_posted", "url", "source", "scraped_at"]
_BIT = {name: 1 << i for i, name in enumerate(BROAD_FIELDS)}
_PARTS = ["title", "institution", "location"]


def identity_key(title: Column, institution: Column, location: Column) -> Column:
    return F.concat_ws("|", *[normalize_text(F.coalesce(c, F.lit(""))) for c in (title, institution, location)])


def row_quality(description: Column, date_posted: Column, url: Column) -> Column:
    """How good a row is; structs compare field by field."""
    return F.struct(
        (~is_blank(description)).cast("int").alias("has_description"),
        (~is_blank(date_posted)).cast("int").alias("has_date"),
        F.length(strip(F.coalesce(url, F.lit("")))).alias("url_length"),
    )


def entity_facts(df: DataFrame) -> DataFrame:
    """The few narrow columns the assignment needs; descriptions stay behind."""
    filled = reduce(
        lambda a, b: a + b,
        [F.when(is_blank(F.col(n)), 0).otherwise(bit) for n, bit in _BIT.items()],
    )
    url = F.coalesce(F.col("url"), F.lit(""))
    return df.select(
        "seq",
        normalize_url(url).alias("url_key"),
        *[normalize_text(F.coalesce(F.col(n), F.lit(""))).alias(f"{n}_key") for n in _PARTS],
        filled.cast("int").alias("filled"),
        F.length(strip(url)).alias("url_len"),
    )


def _has(name: str) -> Column:
    return F.col("filled").bitwiseAND(F.lit(_BIT[name])) != 0


def _first(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("seq")))


def _with_entity_times(state: DataFrame, written: list) -> DataFrame:
    """Rows plus, per entity, when it started and when each kind of fact first came in.

    The aggregate is written first: an aggregate keeps its partitioning, so a join on top of it has
    no exchange that adaptive execution could split where an entity holds very many rows.
    """
    times = state.groupBy("entity").agg(
        F.min("seq").alias("first_seq"),
        _first(_has("description")).alias("t_description"),
        _first(_has("date_posted")).alias("t_date"),
        _first(F.col("url_len") > 0).alias("t_url"),
        *[_first(_has(n)).alias(f"t_{n}") for n in _PARTS],
    )
    times = cut_lineage(times, written)
    own = F.when(_has("description"), 2).otherwise(0) + F.when(_has("date_posted"), 1).otherwise(0)
    before = F.when(F.col("t_description") < F.col("seq"), 2).otherwise(0) + F.when(
        F.col("t_date") < F.col("seq"), 1
    ).otherwise(0)
    return (
        state.join(times, "entity")
        .withColumn("starts", F.col("seq") == F.col("first_seq"))
        .withColumn("own_class", own)
        .withColumn("phase", before)
        .withColumn("class_win", ~F.col("starts") & (F.col("own_class") > F.col("phase")))
    )


def _url_records(rows: DataFrame, url: str = "url_id") -> DataFrame:
    """Rows that won by a longer url at equal class, or gave a url to an entity without one.

    (entity, seq, ``url``, filled, fill_only). While (has description, has date) of the entity
    stays the same, url lengths only grow, so the winners are the strict running maxima. They
    follow from the first row of each length, which is a small aggregate even for a huge entity.
    """
    fills = ~F.col("starts") & (F.col("seq") == F.col("t_url")) & (F.col("own_class") < F.col("phase"))
    equal = ~F.col("starts") & (F.col("own_class") == F.col("phase")) & (F.col("url_len") > 0)
    candidate = equal | fills

    def at(condition, value=None):
        return F.max(F.when(condition, F.col("url_len") if value is None else value))

    levels = rows.groupBy("entity").agg(
        at(F.col("starts")).alias("start_len"),
        *[at(candidate & (F.col("phase") == c)).alias(f"best_{c}") for c in range(4)],
        *[at(F.col("class_win") & (F.col("phase") == c)).alias(f"jump_{c}") for c in range(4)],
    )
    # url length of the entity when it enters each phase
    current, entry = F.col("start_len"), []
    for c in range(4):
        entry.append(current.alias(f"entry_{c}"))
        jump = F.coalesce(F.col(f"jump_{c}"), F.lit(0))
        current = F.when(jump > 0, jump).otherwise(F.greatest(current, F.coalesce(F.col(f"best_{c}"), F.lit(0))))
    levels = levels.select("entity", *entry)

    # numbers first, which a hash aggregate takes without sorting the rows; the rows of the records after
    key = ["entity", "phase", "url_len"]
    rows = rows.where(candidate)
    firsts = rows.groupBy(*key).agg(F.min("seq").alias("seq"))
    longer_first = Window.partitionBy("entity", "phase").orderBy(F.desc("url_len")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    entry_len = F.element_at(F.array(*[F.col(f"entry_{c}") for c in range(4)]), F.col("phase") + 1)
    records = (
        firsts.join(levels, "entity")
        .where(F.col("url_len") > entry_len)
        .withColumn("longer_at", F.min("seq").over(longer_first))
        .where(F.col("longer_at").isNull() | (F.col("seq") < F.col("longer_at")))
        .select(*key, "seq")
    )
    found = rows.select(*key, "seq", url, "filled", fills.alias("fill_only")).join(records, [*key, "seq"])
    # one row each, also where rows share a seq
    return found.groupBy(*key).agg(F.min(F.struct("seq", url, "filled", "fill_only")).alias("row")).select("entity", "row.*")


def _url_owners(rows: DataFrame) -> DataFrame:
    """Per url key: the entity that first carried it and when. A url never changes hands."""
    direct = rows.where(F.col("starts") | (F.col("class_win") & (F.col("url_len") > 0)))
    carried = direct.select("entity", "seq", "url_id").unionByName(
        _url_records(rows).select("entity", "seq", "url_id")
    )
    return (
        carried.where(F.col("url_id").isNotNull())
        .groupBy("url_id")
        .agg(F.min(F.struct("seq", "entity")).alias("own"))
        .select("url_id", F.col("own.seq").alias("owned_at"), F.col("own.entity").alias("url_entity"))
    )


def _identity_spans(rows: DataFrame, identities: DataFrame) -> DataFrame:
    """(identity_id, entity, start, end): the at most four identities an entity goes through, of
    those that a row has."""
    donors = rows.where(
        F.col("starts") | reduce(lambda a, b: a | b, [F.col("seq") == F.col(f"t_{n}") for n in _PARTS])
    ).join(identities.select("identity_id", *[f"{n}_key" for n in _PARTS]), "identity_id")
    parts = donors.groupBy("entity").agg(
        F.first("first_seq").alias("first_seq"),
        *[F.first(f"t_{n}").alias(f"t_{n}") for n in _PARTS],
        *[F.max(F.when(F.col("starts"), F.col(f"{n}_key"))).alias(f"start_{n}") for n in _PARTS],
        *[F.max(F.when(F.col("seq") == F.col(f"t_{n}"), F.col(f"{n}_key"))).alias(f"given_{n}") for n in _PARTS],
    )
    starts = F.array_sort(F.array_distinct(F.array_compact(
        F.array("first_seq", *[F.col(f"t_{n}") for n in _PARTS])
    )))
    spans = parts.withColumn("starts", starts).select("*", F.posexplode("starts").alias("i", "start"))
    key = F.concat_ws("|", *[
        F.when(F.col(f"t_{n}") <= F.col("start"), F.col(f"given_{n}")).otherwise(F.col(f"start_{n}"))
        for n in _PARTS
    ])
    spans = spans.select(
        key.alias("identity"), "entity", "start", F.try_element_at("starts", F.col("i") + 2).alias("end")
    )
    return spans.join(identities.select("identity", "identity_id"), "identity").drop("identity")


def _shared_identity(rows: DataFrame, spans: DataFrame, asks: DataFrame, chunk_rows: int) -> DataFrame:
    """(seq, shared_entity) for the rows ``asks``, whose identity key several entities carried.

    Such a key points to the entity that merged a row most recently. The look-up is an
    as-of search done in two levels: inside fixed seq chunks, then across chunk summaries,
    so one busy key spreads over many tasks.
    """
    shared_spans = spans.join(asks.select("identity_id").distinct(), "identity_id").withColumnRenamed(
        "entity", "span_entity")
    touches = rows.select("entity", "seq").join(
        shared_spans, (F.col("entity") == F.col("span_entity"))
        & (F.col("seq") >= F.col("start")) & (F.col("end").isNull() | (F.col("seq") < F.col("end"))),
    ).select("identity_id", "seq", F.col("entity").alias("touched"))
    both = touches.withColumn("ask", F.lit(False)).unionByName(
        asks.select("identity_id", "seq", F.lit(None).cast("long").alias("touched"), F.lit(True).alias("ask"))
    ).withColumn("chunk", F.floor(F.col("seq") / chunk_rows))
    # at the same seq the question comes before the row's own merge
    inside = Window.partitionBy("identity_id", "chunk").orderBy("seq", F.desc("ask")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    found = both.withColumn("near", F.last("touched", ignorenulls=True).over(inside)).where("ask")
    across = Window.partitionBy("identity_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        both.groupBy("identity_id", "chunk")
        .agg(F.max_by("touched", F.when(F.col("touched").isNotNull(), F.col("seq"))).alias("closing"))
        .withColumn("far", F.last("closing", ignorenulls=True).over(across))
        .select("identity_id", "chunk", "far")
    )
    return found.join(earlier, ["identity_id", "chunk"]).select(
        "seq", F.coalesce("near", "far").alias("shared_entity")
    )


def _next_assignment(state: DataFrame, identities: DataFrame, chunk_rows: int, written: list) -> DataFrame:
    """Every row chooses again, given what the current assignment says was known when."""
    # both frames feed several joins below: written once instead of computed once per use
    rows = cut_lineage(_with_entity_times(state, written).drop("t_description", "t_date"), written)
    owners = cut_lineage(_url_owners(rows), written)
    spans = cut_lineage(_identity_spans(rows, identities), written)
    single = spans.groupBy("identity_id").agg(
        F.min("start").alias("known_at"), F.min("entity").alias("lo"), F.max("entity").alias("hi")
    )
    single = cut_lineage(single, written)
    by_url = F.when(F.col("owned_at") < F.col("seq"), F.col("url_entity"))
    by_identity = F.when(F.col("lo") == F.col("hi"), F.when(F.col("known_at") < F.col("seq"), F.col("lo")))
    choice = F.coalesce(by_url, by_identity)
    following = state.join(owners, "url_id", "left").join(single, "identity_id", "left").select(
        *state.columns[:-1], F.col("entity").alias("old_entity"), F.coalesce(choice, F.col("seq")).alias("entity"),
        (choice.isNull() & F.coalesce(F.col("lo") != F.col("hi"), F.lit(False))).alias("asks"),
    )
    following = cut_lineage(following, written)
    asks = following.where("asks")
    if asks.limit(1).count():
        found = asks.join(_shared_identity(rows, spans, asks, chunk_rows), "seq", "left")
        found = found.withColumn("entity", F.coalesce("shared_entity", "seq")).select(following.columns)
        following = following.where(~F.col("asks")).unionByName(cut_lineage(found, written))
    return following.drop("asks")


def _numbered(facts: DataFrame, written: list):
    """Facts with a number per url key (null where blank) and per identity key, first guess included, and
    (identities) the texts behind the numbers of identities. Written tables: numbers stay as they are."""
    keys = [f"{n}_key" for n in _PARTS]
    facts = cut_lineage(facts.withColumn("identity", F.concat_ws("|", *keys)), written)
    urls = facts.where(F.col("url_key") != "").select("url_key").distinct()
    urls = cut_lineage(urls.withColumn("url_id", F.monotonically_increasing_id()), written)
    # first guess: rows of one identity are one entity
    identities = facts.groupBy("identity", *keys).agg(F.min("seq").alias("entity"))
    identities = cut_lineage(identities.withColumn("identity_id", F.monotonically_increasing_id()), written)
    state = facts.join(identities.select("identity", "identity_id", "entity"), "identity").join(urls, "url_key", "left")
    return state.select("seq", "url_id", "identity_id", "filled", "url_len", "entity"), identities


def assign_entities(facts: DataFrame, chunk_rows: int = 1_000_000, max_rounds: int | None = None):
    """Numbered facts plus ``entity``, the seq of the row that starts the row's entity; and the paths behind the frame."""
    spark, aside, done = facts.sparkSession, [], []
    state, identities = _numbered(facts, aside)
    state = cut_lineage(state, done)
    rounds = 0
    while True:
        fresh: list = []
        following = _next_assignment(state, identities, chunk_rows, fresh)
        changed = following.where(F.col("entity") != F.col("old_entity")).count()
        state = following.drop("old_entity")
        discard(spark, done)  # the round before is no longer read
        done = fresh
        rounds += 1
        log.info("entity merge, round %d: %d rows changed their entity", rounds, changed)
        if not changed:
            discard(spark, aside)
            return state, done
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"entities still change after {rounds} rounds")


def assign_components(facts: DataFrame):
    """Facts plus ``entity``, the smallest seq among all rows linked by keys; and the paths behind the frame.

    Rows of one identity are one node from the start, so only links between identities are left: each
    url ties its identities to the smallest of them. An empty url links nothing; the identity of
    rows without title, institution and location links them like any other.
    """
    written: list = []
    aside: list = []
    facts = facts.withColumn("identity", F.concat_ws("|", *[F.col(f"{n}_key") for n in _PARTS]))
    nodes = cut_lineage(facts.groupBy("identity").agg(F.min("seq").alias("node")), aside)
    rows = cut_lineage(facts.join(nodes, "identity"), written)
    carried = cut_lineage(rows.where(F.col("url_key") != "").select("url_key", "node").distinct(), aside)
    hubs = cut_lineage(carried.groupBy("url_key").agg(F.min("node").alias("hub")), aside)
    found = connected_components(carried.join(hubs, "url_key"), "node", "hub", written)
    discard(facts.sparkSession, aside)
    linked = rows.join(found, "node", "left")
    return linked.withColumn("entity", F.coalesce("component", "node")).drop("node", "component"), written


def entity_donors(assigned: DataFrame, written: list) -> DataFrame:
    """Per entity and field: the seq of the row whose value the entity ends up with."""
    rows = _with_entity_times(assigned, written)
    url = "url_id" if "url_id" in assigned.columns else "url_key"
    records = _url_records(rows, url).where(~F.col("fill_only"))
    wins = rows.where("class_win").select("entity", "seq", "filled").unionByName(
        records.select("entity", "seq", "filled")
    )
    last_win = wins.groupBy("entity").agg(
        *[F.max(F.when(_has(n), F.col("seq"))).alias(f"win_{n}") for n in REPLACED_FIELDS]
    )
    first_value = assigned.groupBy("entity").agg(*[_first(_has(n)).alias(f"first_{n}") for n in BROAD_FIELDS])
    return first_value.join(last_win, "entity", "left").select(
        "entity",
        *[
            F.coalesce(
                *([F.col(f"win_{n}")] if n in REPLACED_FIELDS else []), F.col(f"first_{n}"), F.col("entity")
            ).alias(n)
            for n in BROAD_FIELDS
        ],
    )


def merge_entities(df: DataFrame, chunk_rows: int = 1_000_000, mode: str = "replay") -> DataFrame:
    """One merged posting per entity; ``seq`` is the ordinal of the row that started it.

    ``mode`` is ``replay`` (rows taken one by one, as the module says) or ``component`` (all rows
    linked by keys are one entity).
    """
    if mode == "replay":
        assigned, paths = assign_entities(entity_facts(df), chunk_rows)
    elif mode == "component":
        assigned, paths = assign_components(entity_facts(df))
        assigned = cut_lineage(assigned, paths)
    else:
        raise ValueError(f"mode is replay or component, not {mode!r}")
    donors = entity_donors(assigned, paths)
    wanted = donors.select(
        "entity",
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("field"), F.col(n).alias("seq")) for n in BROAD_FIELDS
        ])).alias("need"),
    ).groupBy("entity", "need.seq").agg(F.collect_set("need.field").alias("fields"))
    wanted = cut_lineage(wanted)
    discard(df.sparkSession, paths)
    return (
        df.select("seq", *BROAD_FIELDS)  # other columns may be named like ours
        .join(wanted, "seq")
        .groupBy("entity")
        .agg(*[F.max(F.when(F.array_contains("fields", n), F.col(n))).alias(n) for n in BROAD_FIELDS])
        .withColumnRenamed("entity", "seq")
    )


def first_per_key(df: DataFrame, keys, order: str = "seq") -> DataFrame:
    """First row of each key by ``order``, combined before the shuffle."""
    others = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(F.min(F.struct(order, *others)).alias("row"))
    return best.select(*keys, "row.*").select(*df.columns)


def distinct_boards(df: DataFrame) -> DataFrame:
    """Each cleaned board url once per company."""
    return df.withColumn("board_url", clean_url(F.col("board_url"))).dropDuplicates(["company", "board_url"])


def dedupe_two_pass(df: DataFrame) -> DataFrame:
    """Best row per (title, institution, location, url), then per (title, institution, location).

    Better means a longer description, then a date, then a url; the first row wins ties of
    the first pass, the first url group those of the second. Both passes are combined before
    the shuffle and carry only numbers; the winners' text is fetched at the end by ``seq``.
    """
    text = lambda n: F.coalesce(F.col(n), F.lit(""))
    keyed = df.select(
        "seq",
        normalize_key(text("title")).alias("title_key"),
        normalize_key(text("institution")).alias("institution_key"),
        normalize_key(text("location")).alias("location_key"),
        clean_url(text("url")).alias("url_key"),
        F.length(text("description")).alias("length"),
        (text("date_posted") != "").cast("int").alias("dated"),
        (text("url") != "").cast("int").alias("linked"),
    )
    names = ["title_key", "institution_key", "location_key"]
    per_url = keyed.groupBy(*names, "url_key").agg(
        F.max(F.struct("length", "dated", "linked", (-F.col("seq")).alias("back"))).alias("best"),
        F.min("seq").alias("group_seq"),
    )
    per_name = per_url.groupBy(*names).agg(
        F.max(F.struct(
            "best.length", "best.dated", "best.linked", (-F.col("group_seq")).alias("group_back"),
            (-F.col("best.back")).alias("seq"),
        )).alias("best"),
        F.min("group_seq").alias("order_seq"),
    )
    winners = per_name.select(F.col("best.seq").alias("seq"), "order_seq")
    return df.join(winners, "seq")


def in_result_order(df: DataFrame) -> DataFrame:
    """Order of the company result: institution, title, location (any case), then first seen."""
    return df.orderBy(F.lower("institution"), F.lower("title"), F.lower("location"), "order_seq")
