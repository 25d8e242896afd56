"""Ingestion as pure functions: a state and a command table in, new versions of the tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """One row a key: the first in the order. The engine limits groups before it sorts them."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def guardrail(confidence, before, after):
    """A run is broken if unsure, if it lost over half of three or more rules, or if it found none."""
    return (confidence < 0.6) | ((before >= 3) & (after < 0.5 * before)) | (after == 0)


def _rows_of(rules: DataFrame, results: DataFrame, **fixed) -> DataFrame:
    """The rules that results bring, as rows of ``rules``: what a result does not name is null, or as in ``fixed``."""
    each = results.select(*(c for c in results.columns if c != "rules"), F.explode("rules").alias("_r"))
    has = set(each.schema["_r"].dataType.names)
    given = {"is_deleted": F.lit(False), "is_manual_edit": F.lit(False)} | fixed
    return each.select(*(given[c].alias(c) if c in given else F.col(f"_r.{c}").alias(c) if c in has else F.col(c) if c in each.columns else F.lit(None).cast(rules.schema[c].dataType).alias(c) for c in rules.columns))


def apply_runs(sources: DataFrame, rules: DataFrame, results: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply extraction results: (sources, rules, runs) in their next versions.

    ``results`` has source_id, confidence and rules (array of structs of rule columns); of several for
    a source the surest is taken. ``identifier`` and ``config_json``, where results have them, replace the
    source's when a run is good (sources that are read from a picture or a document keep the page's
    address so). A broken result keeps the rules, stamps first_broken_at once and leaves the review as
    it is. A good one soft-deletes live rules that no one edited, adds the new ones, approves the
    source and clears first_broken_at; rules_removed counts what it deleted.
    """
    results = best_by(results, ["source_id"], [F.desc("confidence"), F.desc(F.size("rules"))])
    live = rules.filter("not is_deleted").groupBy("source_id").agg(F.count("*").alias("before"), F.count(F.when(~F.col("is_manual_edit"), 1)).alias("theirs"))
    judged = results.join(live, "source_id", "left").fillna(0, ["before", "theirs"]).withColumn("after", F.size("rules")).withColumn("broken", guardrail(F.col("confidence"), F.col("before"), F.col("after")))
    brought = [c for c in ("identifier", "config_json") if c in results.columns and c in sources.columns]
    verdict = judged.select(F.col("source_id").alias("id"), F.col("confidence").alias("_c"), "broken", *(F.col(c).alias(f"_{c}") for c in brought))
    joined = sources.join(verdict, "id", "left")
    hit, good = F.col("broken").isNotNull(), F.coalesce(~F.col("broken"), F.lit(False))
    changed = {
        "confidence": F.when(hit, F.col("_c")).otherwise(F.col("confidence")) if "confidence" in sources.columns else None,
        "run_status": F.when(F.col("broken"), "broken").when(hit, "ok").otherwise(F.col("run_status")),
        "review_status": F.when(good, "approved").otherwise(F.col("review_status")),
        "first_broken_at": F.when(F.col("broken"), F.coalesce("first_broken_at", as_of)).when(~good, F.col("first_broken_at")),
        "last_run_at": F.when(hit, as_of).otherwise(F.col("last_run_at")),
    } | {c: F.when(good, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in brought}
    new_sources = joined.select(*(changed[c].alias(c) if changed.get(c) is not None else F.col(c) for c in sources.columns))
    taken = judged.filter("not broken")
    replaced = rules.join(taken.select("source_id", F.lit(True).alias("_r")), "source_id", "left")
    kept = replaced.withColumn("is_deleted", F.col("is_deleted") | (F.coalesce("_r", F.lit(False)) & ~F.col("is_manual_edit"))).select(*rules.columns)
    fresh = _rows_of(rules, taken, source_id=F.col("source_id"))
    count = lambda c: F.when(F.col("broken"), 0).otherwise(F.col(c))
    runs = judged.select("source_id", as_of.alias("started_at"), F.when(F.col("broken"), "broken").otherwise("ok").alias("status"), count("after").alias("rules_added"), count("theirs").alias("rules_removed"))
    return new_sources, kept.unionByName(fresh), runs


def create_sources(sources: DataFrame, rules: DataFrame, created: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Add sources with their rules; what was there for the same place and identifier is superseded.

    ``created`` has the columns of sources (review_status may be null) and rules. Superseded sources
    are rejected with a note and lose all live rules, edited ones too. A source whose strategy is
    'failed' is rejected at once; a broken or failed run stamps first_broken_at.
    """
    by = best_by(created, ["place_id", "identifier"], [F.desc("id")])
    old = sources.join(by.select("place_id", "identifier", F.lit(True).alias("_new")), ["place_id", "identifier"], "left").withColumn("_gone", F.coalesce("_new", F.lit(False)) & (F.col("review_status") != "rejected"))
    note = F.concat(F.lit("superseded by new extraction on "), F.date_format(as_of, "yyyy-MM-dd"))
    kept = old.select(*(F.when(F.col("_gone"), "rejected").otherwise(F.col(c)).alias(c) if c == "review_status" else F.when(F.col("_gone"), note).otherwise(F.col(c)).alias(c) if c == "reviewer_notes" else F.col(c) for c in sources.columns))
    failed = F.coalesce(F.col("strategy") == "failed", F.lit(False))
    changed = {
        "review_status": F.when(failed, "rejected").otherwise(F.coalesce("review_status", F.lit("pending"))),
        "reviewer_notes": F.when(failed, "auto-rejected: cascade returned no useful rules"),
        "first_broken_at": F.when(F.col("run_status").isin("broken", "error"), as_of),
    }
    added = by.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in sources.columns))
    gone = old.filter("_gone").select(F.col("id").alias("source_id"), F.lit(True).alias("_g"))
    remain = rules.join(gone, "source_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_g", F.lit(False))).select(*rules.columns)
    return kept.unionByName(added), remain.unionByName(_rows_of(rules, by.select(F.col("id").alias("source_id"), "place_id", "rules"), source_id=F.col("source_id")))


def apply_mail(sources: DataFrame, rules: DataFrame, places: DataFrame, letters: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What letters make of (outcomes, sources, rules).

    ``letters`` has id, identifier, match_domain, confidence and rules. Without rules or under 0.5 a
    letter is skipped. A known identifier is refreshed: if regular rules fall under the guardrail it
    turns broken and keeps its rules and its review, else its regular rules, edited ones too, are
    replaced and special ones added with priority 10. Other letters are to be attached to the place
    with their domain, or to make a new one: the outcome says which, and ``create_sources`` adds them.
    """
    known = sources.filter("kind = 'email_newsletter'").groupBy("identifier").agg(F.min("id").alias("source_id"))
    domain = places.filter("match_domain is not null").groupBy("match_domain").agg(F.min("id").alias("same_place"))
    regular = rules.filter("not is_deleted and special_kind = 'regular'").groupBy("source_id").agg(F.count("*").alias("before"))
    after = F.size(F.filter("rules", lambda r: F.coalesce(r["special_kind"], F.lit("regular")) == "regular"))
    read = letters.join(known, "identifier", "left").join(domain, "match_domain", "left").join(regular, "source_id", "left").fillna(0, ["before"]).withColumn("after", after)
    skipped = (F.size("rules") == 0) | (F.col("confidence") < 0.5)
    outcome = F.when(skipped, "skipped").when(F.col("source_id").isNotNull(), F.when(guardrail(F.col("confidence"), F.col("before"), F.col("after")), "broken").otherwise("refresh")).when(F.col("same_place").isNotNull(), "attach").otherwise("create")
    told = read.withColumn("outcome", outcome)
    outcomes = told.select("id", "outcome", F.when(F.col("outcome").isin("refresh", "broken"), F.col("source_id")).alias("source_id"), F.when(F.col("outcome") == "attach", F.col("same_place")).alias("place_id"))
    last = best_by(told.filter("outcome in ('refresh', 'broken')"), ["source_id"], [F.desc("id")])
    joined = sources.join(last.select(F.col("source_id").alias("id"), "outcome", F.col("confidence").alias("_c")), "id", "left")
    hit, broken = F.col("outcome").isNotNull(), F.coalesce(F.col("outcome") == "broken", F.lit(False))
    changed = {
        "run_status": F.when(broken, "broken").when(hit, "ok").otherwise(F.col("run_status")),
        "first_broken_at": F.when(broken, F.coalesce("first_broken_at", as_of)).when(~hit, F.col("first_broken_at")),
        "last_run_at": F.when(hit, as_of).otherwise(F.col("last_run_at")),
        "last_received_at": F.when(hit, as_of).otherwise(F.col("last_received_at")),
        "confidence": F.when(hit, F.col("_c")).otherwise(F.col("confidence")),
    }
    new_sources = joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in sources.columns))
    good = last.filter("outcome = 'refresh'")
    replaced = rules.join(good.filter("after > 0").select("source_id", F.lit(True).alias("_r")), "source_id", "left")
    kept = replaced.withColumn("is_deleted", F.col("is_deleted") | (F.coalesce("_r", F.lit(False)) & (F.col("special_kind") == "regular"))).select(*rules.columns)
    owner = good.join(sources.select(F.col("id").alias("source_id"), F.col("place_id").alias("_place")), "source_id").drop("same_place")
    special = F.coalesce(F.col("_r.special_kind"), F.lit("regular"))
    fresh = _rows_of(rules, owner, source_id=F.col("source_id"), place_id=F.col("_place"), special_kind=special, **({"priority": F.when(special == "regular", 0).otherwise(10)} if "priority" in rules.columns else {}))
    return outcomes, new_sources, kept.unionByName(fresh)


def edit_rules(rules: DataFrame, edits: DataFrame) -> DataFrame:
    """Manual edits: the newest of each rule (id, at, verb 'edit' or 'delete', and the fields of an edit).

    An edit sets all its fields, null ones too; a deletion is soft. Both mark the rule as edited, so
    that runs leave it alone.
    """
    last = best_by(edits, ["id"], [F.desc("at")])
    fields = [c for c in edits.columns if c not in ("id", "at", "verb") and c in rules.columns]
    joined = rules.join(last.select("id", "verb", *(F.col(c).alias(f"_{c}") for c in fields)), "id", "left")
    edit, hit = F.coalesce(F.col("verb") == "edit", F.lit(False)), F.col("verb").isNotNull()
    changed = {c: F.when(edit, F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}
    changed["is_deleted"] = F.col("is_deleted") | F.coalesce(F.col("verb") == "delete", F.lit(False))
    changed["is_manual_edit"] = F.col("is_manual_edit") | hit
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in rules.columns))
