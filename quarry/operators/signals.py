"""Merge of accepted candidates into signals, and the store of signals.

The store has two tables. ``signals`` has one row a key: SIGNAL, the payload being that of the best
member by trust, confidence, time and id. ``members`` holds what a signal gathers, one row for each
(key, what, value): its evidence, fingerprints, sources, projects and what was merged into it. So no
signal's lists are ever held in one row, and a merge depends neither on order nor on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.components import components
from quarry.operators.extract import PAYLOAD

SIGNAL = ("kind", "key", "id", *PAYLOAD, "summary", "trust", "confidence", "first_ms", "last_ms", "support", "project", "status")
GATHERED = {"evidence": "evidence_id", "fingerprint": "fingerprint", "label": "label", "project": "project"}


def seen_ms(observed: Column, now_ms: Column) -> Column:
    """When a candidate was observed; now, if that isn't said or isn't a time."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(observed)), now_ms)


def summary(kind: Column) -> Column:
    """What a signal says in one line."""
    said = {"tech_preference": F.concat("subject", F.lit(" ("), "detail", F.lit("): "), "reason"), "decision": F.concat_ws(": ", "subject", "body"), "work_style": F.col("body"), "profile_fact": F.col("body"), "timeline_event": F.concat_ws(" ", "detail", "subject")}
    out = F
    for name, text in said.items():
        out = out.when(kind == name, text)
    return out.otherwise(F.col("subject"))


def wrong_kind(candidates: DataFrame, kind: str) -> DataFrame:
    """Candidates that a merge of ``kind`` must not take: they go to quarantine."""
    return candidates.where(F.col("kind") != kind)


def resolved(candidates: DataFrame, members: DataFrame | None) -> DataFrame:
    """``candidates`` with the key of the signal that holds their fingerprint, if one does, else their own."""
    if members is None:
        return candidates
    known = members.where("what = 'fingerprint'").groupBy(F.col("value").alias("fingerprint")).agg(F.min("key").alias("known"))
    return candidates.join(known, "fingerprint", "left").withColumn("key", F.coalesce("known", "key")).drop("known")


def merge(candidates: DataFrame, kind: str, now_ms: Column, signals: DataFrame | None = None, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(signals, members) of ``kind`` after the candidates of that kind are merged into the store, if
    there is one. A rerun with the same candidates gives the same tables. A key's first signal gives
    the id; where no signal had the key, its best candidate does."""
    rows = resolved(candidates.where(F.col("kind") == kind), members)
    seen = seen_ms(F.col("observed"), now_ms)
    new = rows.select(*(F.col(c) for c in ("kind", "key", "id", *PAYLOAD, "trust", "confidence")), seen.alias("first_ms"), seen.alias("last_ms"), "project", F.lit(False).alias("old"))
    gathered = F.explode(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(w).alias("what"), F.col(c).alias("value"))) for w, c in GATHERED.items()], F.struct(F.lit("merged").alias("what"), F.col("id").alias("value"))), lambda x: x.isNotNull()))
    held = rows.select("key", gathered.alias("m")).select("key", "m.what", "m.value")
    evidence = rows.select("key", F.col("evidence_id").alias("value")).where("value is not null")  # the signals need no other members
    if signals is not None:
        own = signals.where(F.col("kind") == kind)
        new = new.unionByName(own.select(*new.columns[:-1], F.lit(True).alias("old")))
        before = members.join(own.select("key"), "key", "left_semi")
        held = held.unionByName(before)
        evidence = evidence.unionByName(before.where("what = 'evidence'").select("key", "value"))
    held = held.distinct()
    rank = F.struct((-F.col("trust")).alias("t"), (-F.col("confidence")).alias("c"), (-F.col("last_ms")).alias("m"), F.col("id"))
    best = F.min_by(F.struct("id", *PAYLOAD), rank)
    out = new.groupBy("key").agg(  # by the key only, as the support is, so that the join needs no other exchange
        best.alias("best"), F.min(F.when(F.col("old"), F.struct("first_ms", "id"))).alias("first"), F.max("trust").alias("trust"), F.max("confidence").alias("confidence"),
        F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.min("project").alias("project"),
    )
    support = evidence.distinct().groupBy("key").agg(F.count("*").alias("support"))
    out = out.join(support, "key", "left").select(F.lit(kind).alias("kind"), "key", F.coalesce("first.id", "best.id").alias("id"), *[F.col(f"best.{c}").alias(c) for c in PAYLOAD], "trust", "confidence", "first_ms", "last_ms", F.coalesce("support", F.lit(0)).alias("support"), "project", F.lit("active").alias("status"))
    return out.withColumn("summary", summary(F.col("kind"))).select(*SIGNAL), held


def owners(signals: DataFrame, members: DataFrame) -> DataFrame:
    """(id, root): signals that come to own one key or share a fingerprint, with the least id of those that
    such chains reach. A fingerprint links its signals to the first of them, so it gives as many links
    as it has signals."""
    held = signals.select("kind", "key", "id").join(members.where("what = 'fingerprint'").select("key", F.col("value").alias("print")), "key", "left")
    marks = held.select("kind", "id", F.explode(F.array(F.concat(F.lit("k:"), "key"), F.concat(F.lit("f:"), "print"))).alias("mark")).where("mark is not null").distinct()
    first = marks.groupBy("kind", "mark").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = marks.join(first, ["kind", "mark"]).select("a", F.col("id").alias("b")).distinct()
    found = components(links)
    return signals.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def unite(signals: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store after signals that ``owners`` links are one: payload, project and key of the best by trust,
    confidence, time and id, whose id it has, too; the others' ids are among its members as ``merged-signal``."""
    rows = signals.join(owners(signals, members), "id")
    rank = F.struct((-F.col("trust")).alias("t"), (-F.col("confidence")).alias("c"), (-F.col("last_ms")).alias("m"), F.col("id"))
    best = F.min_by(F.struct("kind", "key", "id", *PAYLOAD, "summary", "project", "status"), rank).alias("best")
    out = rows.groupBy("root").agg(best, F.max("trust").alias("trust"), F.max("confidence").alias("confidence"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))
    to = rows.select("key", "root", "id").join(out.select("root", F.col("best.key").alias("to"), F.col("best.id").alias("best_id")), "root")
    held = members.join(to.select("key", "to"), "key").select(F.col("to").alias("key"), "what", "value")
    held = held.unionByName(to.where("id <> best_id").select(F.col("to").alias("key"), F.lit("merged-signal").alias("what"), F.col("id").alias("value"))).distinct()
    support = held.where("what = 'evidence'").groupBy("key").agg(F.count("*").alias("support"))
    out = out.withColumn("key", F.col("best.key")).join(support, "key", "left")
    columns = {c: F.col(f"best.{c}") for c in ("kind", "id", *PAYLOAD, "summary", "project", "status")}
    return out.withColumns(columns).withColumn("support", F.coalesce("support", F.lit(0))).select(*SIGNAL), held


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; both have one row a key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key, by map-side aggregation where the order allows a struct."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def replace_kind(store: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    return store.where(F.col("kind") != kind).unionByName(new)


def consistent(signals: DataFrame, members: DataFrame) -> DataFrame:
    """What is wrong with a store, none if all is well: (key, problem)."""
    support = members.where("what = 'evidence'").groupBy("key").agg(F.count("*").alias("n"))
    met = signals.join(support, "key", "full")
    problem = F.when(F.col("id").isNull(), "members without signal").when(F.coalesce("n", F.lit(0)) != F.col("support"), "support differs").when(F.col("first_ms") > F.col("last_ms"), "times reversed")
    return met.select("key", problem.alias("problem")).where("problem is not null")


def fold(candidates: DataFrame) -> DataFrame:
    """The same candidates folded one after the other in the order of ``arrival``, as a sequential
    engine does: a payload is replaced only by a candidate that beats the signal's greatest trust,
    confidence and time so far. Signals by key: (key, id, body, trust, confidence, members)."""
    rows = F.array_sort(F.collect_list(F.struct("arrival", "id", F.coalesce("body", F.lit("")).alias("body"), "trust", "confidence", "ms")))

    def take(a: Column, x: Column) -> Column:
        better = (x["trust"] > a["trust"]) | ((x["trust"] == a["trust"]) & ((x["confidence"] > a["confidence"]) | ((x["confidence"] == a["confidence"]) & ((x["ms"] > a["ms"]) | ((x["ms"] == a["ms"]) & (x["id"] < a["id"]))))))
        return F.struct(a["id"].alias("id"), F.when(better, x["body"]).otherwise(a["body"]).alias("body"), F.greatest(a["trust"], x["trust"]).alias("trust"), F.greatest(a["confidence"], x["confidence"]).alias("confidence"), F.greatest(a["ms"], x["ms"]).alias("ms"))

    all_ = candidates.groupBy("key").agg(rows.alias("all"))
    first = F.struct(*[F.col("all")[0][c].alias(c) for c in ("id", "body", "trust", "confidence", "ms")])
    return all_.select("key", F.aggregate("all", first, take).alias("s"), F.size("all").alias("members")).select("key", "s.id", "s.body", "s.trust", "s.confidence", "members")
