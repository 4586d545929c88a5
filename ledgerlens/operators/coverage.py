"""What becomes of semantic units: one disposition each, the validated units of a message, and text that no unit covers."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .consolidation import streamed
from .joins import without_overlap


def disposition() -> Column:
    """disposition and reasons of a unit with columns authorities (number), conflicting, ceiling, unresolved, durability,
    kind, epistemic and supported. Doubt about the authority comes first, then references, then what the unit is."""
    c = F.col
    doubt = (c("authorities") != 1) | c("conflicting") | (c("ceiling") != "normal")
    named = F.array_join(
        F.array_compact(F.array(F.when(c("authorities") > 1, "cross_authority_span"), F.when(c("conflicting"), "conflicting_persisted_authority"), F.when(c("ceiling") != "normal", "privacy_or_sensitivity_ceiling"))), ","
    )
    asks = (c("kind") == "question") | c("epistemic").isin("hypothetical", "questioned")
    unsure = (c("durability") == "unknown") | (c("epistemic") == "unknown")
    rules = [
        (c("authorities") == 0, "needs_review", F.lit("missing_persisted_authority")),
        (doubt, "needs_review", named),
        (c("unresolved"), "unresolved_reference", F.lit("ambiguous_or_unresolved_reference")),
        (c("durability") == "context_only", "context_only", F.lit("context_only")),
        ((c("kind") == "instruction") & (c("durability") == "transient"), "transient_instruction", F.lit("transient_instruction")),
        (asks, "context_only", F.lit("non_asserted_or_question")),
        (unsure, "needs_review", F.lit("unknown_durability_or_epistemic_status")),
        (~c("supported"), "unsupported", F.lit("route_mapping_unsupported")),
        (c("durability") != "durable", "unsupported", F.lit("durability_not_candidate_eligible")),
    ]
    pick = lambda i: F.coalesce(*(F.when(r[0], r[i] if i == 2 else F.lit(r[i])) for r in rules))
    return F.struct(F.coalesce(pick(1), F.lit("durable_candidate")).alias("disposition"), F.coalesce(pick(2), F.lit("durable_policy_eligible")).alias("reason"))


def validated(units: DataFrame) -> DataFrame:
    """units (message, at, id, start, end, evidence, raw) with ``reason``: null if accepted, else why not.

    Units are taken in the order of ``at``; what is rejected for its own faults never stands in another one's way. Of
    units that repeat an id or overlap, the first accepted one stays. Units are streamed in order, and of a message only
    the accepted ids and spans are held, sorted.
    """
    c = F.col
    fault = (
        F.when(c("id").isNull() | (c("id") == ""), "malformed_record").when(c("start").isNull() | c("end").isNull(), "malformed_record").when(c("start") >= c("end"), "span_inverted")
        .when((c("start") < 0) | (c("end") > F.length("raw")), "span_out_of_range").when(F.expr("substring(raw, start + 1, end - start)") != c("evidence"), "evidence_mismatch")
    )
    own = units.select(c("message").alias("key"), "at", "id", "start", "end", fault.alias("fault"))
    verdict = streamed(own, ["at"], lambda _: (set(), [], []), _accepted, f"at {units.schema['at'].dataType.simpleString()}, reason string").withColumnRenamed("key", "message")
    return units.join(verdict, ["message", "at"])


def _accepted(state: tuple, r: dict) -> tuple[tuple, dict]:
    """The ids, starts and ends accepted so far, and the reason against this unit. Accepted spans do not overlap, so both lists are sorted."""
    ids, starts, ends = state
    reason = r["fault"]
    if reason != "malformed_record":
        if r["id"] in ids:
            reason = "duplicate_unit_id"
        elif reason is None:
            at = bisect_left(starts, r["end"])
            if at and ends[at - 1] > r["start"]:
                reason = "units_overlap"
            else:
                ids.add(r["id"])
                starts.insert(at, r["start"])
                ends.insert(at, r["end"])
    return state, {"at": r["at"], "reason": reason}


def uncovered(tokens: DataFrame, spans: DataFrame, authority: str | None = None) -> DataFrame:
    """message, start, end, tokens of the runs of neighbouring tokens that no span overlaps.

    tokens: message, place, start, end. spans: message, start, end, which may overlap each other. authority: a column of
    tokens; a run ends where it changes, and it is returned too.
    """
    more = [authority] if authority else []
    free = without_overlap(tokens.select("message", "place", "start", "end", *more), spans.select("message", "start", "end"), ["message"])
    run = Window.partitionBy("message", *more).orderBy("place")
    own = free.withColumn("run", F.col("place") - F.row_number().over(run))
    return own.groupBy("message", "run", *more).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("tokens")).drop("run")


def plan(units: DataFrame, tokens: DataFrame, authority: str | None = None) -> DataFrame:
    """The coverage plan: an item for each accepted unit with its one disposition, and one for each run of text that none covers.

    units: what ``validated`` and ``disposition`` ask for. tokens: message, place, start, end. Items have message, item_id,
    unit_id (null for text), start, end, disposition, reason, proposal (a unit that may become a candidate), status (of
    the whole plan: needs_review if any item does, else complete). Units that are not accepted are no items, and what they
    spanned counts as not covered.
    """
    accepted = validated(units).where("reason is null").drop("reason").withColumn("d", disposition())
    own = accepted.select("message", F.col("id").alias("unit_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "d.disposition", "d.reason")
    rest = uncovered(tokens, own.select("message", "start", "end"), authority)
    left = rest.select("message", F.lit(None).cast(own.schema["unit_id"].dataType).alias("unit_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit("unsupported").alias("disposition"), F.lit("uncovered_material").alias("reason"))
    items = own.unionByName(left)
    item_id = F.sha2(F.concat_ws(":", "message", F.coalesce(F.col("unit_id").cast("string"), F.lit("-")), "start", "end"), 256)
    doubt = F.max(F.col("disposition") == "needs_review").over(Window.partitionBy("message"))
    return items.withColumns({"item_id": item_id, "proposal": F.col("disposition") == "durable_candidate", "status": F.when(doubt, "needs_review").otherwise("complete")})


def faults(items: DataFrame, units: DataFrame) -> DataFrame:
    """What breaks a plan (fault, message): accepted units without an item or with two, items that share an id, and units that overlap uncovered text. Empty for a sound one."""
    accepted = validated(units).where("reason is null").select("message", F.col("id").alias("unit_id"))
    own = items.where("unit_id is not null").groupBy("message", "unit_id").agg(F.count("*").alias("n"))
    counts = accepted.groupBy("message", "unit_id").agg(F.count("*").alias("units")).join(own, ["message", "unit_id"], "full")
    unlike = counts.where("units is null or n is null or n <> 1 or units <> 1").select(F.lit("not_one_item_per_unit").alias("fault"), "message")
    twice = items.groupBy("item_id").agg(F.count("*").alias("n"), F.min("message").alias("message")).where("n > 1").select(F.lit("item_identity_collision").alias("fault"), "message")
    text, spans = (items.where(f"unit_id is {x}").select("message", "start", "end") for x in ("null", "not null"))
    free = without_overlap(text, spans, ["message"])
    hit = text.exceptAll(free).select(F.lit("covered_twice").alias("fault"), "message")
    return unlike.unionByName(twice).unionByName(hit)
