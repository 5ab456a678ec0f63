"""Scoring operators over evidence rows: carve-outs (R15), corroboration cap (R13),
level roll-up (R14), reason (R16), decision validation (J1), run results (U1, H10, D4).

Evidence columns: evidence_id, vendor, condition, level, outlet, tier, in_scope,
new_models_only, is_breach, is_going_concern, is_resolution, published_at.
Order of rules (X3): scope -> carve-outs -> cap -> roll-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions import cells


def risk_flag(level: Column) -> Column:
    """Flagged at the fixed threshold."""
    return level >= F.lit(rules.FLAG_THRESHOLD)


def _with_carve_outs(evidence: DataFrame) -> DataFrame:
    """Evidence with the carve-out rules (R15) that fire on each row, as columns.

    "Older than some resolution" equals "older than the latest resolution", so the range
    condition becomes an equi-join with one summary row per vendor (no pairs).
    """
    per_vendor = evidence.groupBy("vendor").agg(
        F.max(F.when(F.col("is_resolution"), F.col("published_at"))).alias("_resolved_at"),
        F.bool_or(F.col("is_going_concern")).alias("_going_concern"),
    )
    e = evidence.join(per_vendor, "vendor", "left")
    resolved = F.coalesce(F.col("is_breach") & (F.col("published_at") < F.col("_resolved_at")), F.lit(False))
    warned = F.coalesce(F.col("_going_concern"), F.lit(False))
    return e.withColumns({
        "_dropped": resolved & ~warned, "_stands": resolved & warned,
        "_capped": F.coalesce(F.col("new_models_only"), F.lit(False)) & (F.col("level") > rules.NEW_MODELS_ONLY_CAP)})


def adjusted_evidence(evidence: DataFrame) -> DataFrame:
    """New-models-only restrictions cap at 4; breach evidence older than the vendor's
    latest resolving item is dropped unless a going-concern warning stands."""
    adj = F.when(F.col("_capped"), F.lit(rules.NEW_MODELS_ONLY_CAP)).otherwise(F.col("level"))
    return _with_carve_outs(evidence).where(~F.col("_dropped")).select(
        "evidence_id", "vendor", "condition", "level", adj.alias("adj_level"),
        "outlet", "tier", "in_scope", "published_at",
    )


# What the trace says of a condition, in its order.
TRACE_RULES = (("_capped", "covers new models only, capped at 4"), ("_dropped", "resolved by a later refinancing"),
               ("_stands", "not cleared by refinancing, a going-concern warning stands"))


def rule_trace(evidence: DataFrame) -> DataFrame:
    """Which carve-out capped, dropped or kept which condition, one text per vendor.

    The set behind it is bounded by the rules times the conditions of a vendor, and it is combined map-side."""
    x = _with_carve_outs(evidence).where("in_scope")
    fired = F.filter(F.array(*[F.when(F.col(c), F.struct(F.lit(i).alias("rule"), F.col("condition"), F.lit(text).alias("text")))
                               for i, (c, text) in enumerate(TRACE_RULES)]), lambda r: r.isNotNull())
    g = x.select("vendor", F.explode(fired).alias("r")).groupBy("vendor").agg(F.sort_array(F.collect_set("r")).alias("_t"))
    return g.select("vendor", F.array_join(F.transform("_t", lambda r: F.concat(r["condition"], F.lit(" "), r["text"])), ", ").alias("trace"))


def corroborated_conditions(adjusted: DataFrame) -> DataFrame:
    """Per (vendor, condition) of in-scope evidence, level 4-5 seen only in one
    non-primary outlet counts as 3 (capped); a primary source counts at face value."""
    g = adjusted.where(F.col("in_scope")).groupBy("vendor", "condition").agg(
        F.max("adj_level").alias("level"),
        F.min("tier").alias("min_tier"),
        F.countDistinct("outlet").alias("n_outlets"),
    )
    capped = (
        (F.col("level") >= rules.CAP_FROM_LEVEL) & (F.col("min_tier") > rules.PRIMARY_TIER) & (F.col("n_outlets") < 2)
    )
    return g.select(
        "vendor", "condition", "level", "min_tier", "n_outlets", capped.alias("capped"),
        F.when(capped, F.lit(rules.CAP_LEVEL)).otherwise(F.col("level")).alias("eff_level"),
    )


def vendor_rollup(conditions: DataFrame) -> DataFrame:
    """R14 per vendor: highest effective level; two distinct (uncapped) level-3 conditions
    give 4; two level-4 conditions give 5; in-scope evidence floors the level at 1 (X1, X2, X4)."""
    g = conditions.groupBy("vendor").agg(
        F.max("eff_level").alias("max_level"),
        F.count_if((F.col("eff_level") == 3) & ~F.col("capped")).alias("n_level3"),
        F.count_if(F.col("eff_level") == 4).alias("n_level4"),
        F.count(F.lit(1)).alias("n_conditions"),
        F.max_by(
            F.struct("condition", "eff_level", "capped"),
            F.struct("eff_level", "level", "n_outlets", "condition"),
        ).alias("_driver"),
    )
    esc4 = F.when(F.col("n_level3") >= 2, F.lit(4)).otherwise(F.lit(0))
    esc5 = F.when(F.col("n_level4") >= 2, F.lit(5)).otherwise(F.lit(0))
    level = F.greatest(F.lit(1), F.col("max_level"), esc4, esc5)
    return g.select(
        "vendor", level.alias("in_scope_level"), "max_level", "n_level3", "n_level4", "n_conditions",
        F.col("_driver.condition").alias("driver_condition"),
        F.col("_driver.eff_level").alias("driver_level"),
        F.col("_driver.capped").alias("driver_capped"),
    )


def excluded_events(adjusted: DataFrame) -> DataFrame:
    """Out-of-scope conditions per vendor, for R14's "all out of scope -> 1" and R16.

    The set is bounded by the number of distinct conditions (a rule table)."""
    return adjusted.where(~F.col("in_scope")).groupBy("vendor").agg(
        F.count(F.lit(1)).alias("n_excluded"),
        F.array_join(F.sort_array(F.collect_set("condition")), ", ").alias("excluded"),
    )


def risk_score(book: DataFrame, adjusted: DataFrame, trace: DataFrame | None = None) -> DataFrame:
    """R13 -> R14 over the whole book: one level per book row (0 when nothing was found).

    ``trace`` (of ``rule_trace``) adds what the carve-outs did, for the reason."""
    rolled = vendor_rollup(corroborated_conditions(adjusted))
    excl = excluded_events(adjusted)
    j = book.select("book_row_id", "vendor").join(rolled, "vendor", "left").join(excl, "vendor", "left")
    j = j.withColumn("trace", F.lit(None).cast("string")) if trace is None else j.join(trace, "vendor", "left")
    level = (
        F.when(F.col("in_scope_level").isNotNull(), F.col("in_scope_level"))
        .when(F.col("n_excluded") > 0, F.lit(1))
        .otherwise(F.lit(0))
    )
    return j.select(
        "book_row_id", "vendor", level.alias("risk_level"), risk_flag(level).alias("is_risk"),
        F.coalesce(F.col("n_conditions"), F.lit(0)).alias("n_conditions"),
        F.coalesce(F.col("n_excluded"), F.lit(0)).alias("n_excluded"),
        "driver_condition", "driver_level", "driver_capped", "n_level3", "n_level4", "max_level", "excluded", "trace",
    )


def risk_reason(scored: DataFrame) -> DataFrame:
    """The reason names the driving condition and level, any escalation or cap, the carve-outs
    and what they did, and the events excluded as out of scope."""
    lvl = F.col("risk_level").cast("string")
    main = (
        F.when(F.col("risk_level") == 0, F.lit("No in-scope or out-of-scope events found"))
        .when(F.col("driver_condition").isNull(), F.lit("Only out-of-scope events reported; level 1"))
        .otherwise(F.concat(F.lit("Level "), lvl, F.lit(" driven by "), F.col("driver_condition")))
    )
    escalation = (
        F.when(F.col("n_level4") >= 2, F.lit("two or more level-4 conditions"))
        .when((F.col("n_level3") >= 2) & (F.col("risk_level") == 4) & (F.col("max_level") < 4),
              F.lit("two or more level-3 conditions"))
    )
    capped = F.when(F.col("driver_capped"), F.lit("single press source, capped at 3 pending confirmation"))
    excluded = F.when(F.col("excluded").isNotNull(), F.concat(F.lit("excluded as out of scope: "), F.col("excluded")))
    carved = F.when(F.col("trace").isNotNull(), F.concat(F.lit("carve-outs: "), F.col("trace")))
    reason = F.concat(F.concat_ws("; ", main, escalation, capped, carved, excluded), F.lit("."))
    return scored.select("book_row_id", "vendor", "risk_level", "is_risk", "driver_condition", reason.alias("risk_reason"))


# --- decisions -------------------------------------------------------------------------

DECISION_SCHEMA = "Risk_Reason string, Risk_level int"


def parse_decisions(raw: DataFrame, json_col: str = "payload") -> DataFrame:
    """Structured decisions from JSON text, explicit schema, PERMISSIVE (bad -> NULLs)."""
    d = F.from_json(F.col(json_col), DECISION_SCHEMA, {"mode": "PERMISSIVE"})
    return raw.withColumn("_d", d).select(
        *[c for c in raw.columns if c != json_col],
        F.col("_d.Risk_level").alias("risk_level"),
        F.col("_d.Risk_Reason").alias("risk_reason"),
    )


def validate_decisions(decisions: DataFrame) -> DataFrame:
    """Level in 0..5 and a reason present; bad rows carry a quarantine reason and
    stay in the output (the batch goes on)."""
    lvl, why = F.col("risk_level"), F.col("risk_reason")
    problem = (
        F.when(lvl.isNull(), F.lit("missing level"))
        .when((lvl < rules.LEVEL_MIN) | (lvl > rules.LEVEL_MAX), F.lit("level out of range"))
        .when(why.isNull() | (cells.strip(why) == ""), F.lit("missing reason"))
    )
    return decisions.withColumn("quarantine_reason", problem).withColumn(
        "is_valid", F.col("quarantine_reason").isNull()
    ).withColumn("is_risk", F.when(F.col("is_valid"), risk_flag(lvl)))


def run_results(validated: DataFrame) -> DataFrame:
    """U1 + H10: success rows and error rows in one table, with the label and done line."""
    research_file = F.concat(
        F.lit("Research/"), cells.vendor_key("vendor"), F.lit("/"), cells.note_file_name("decided_at")
    )
    ok = validated.where(F.col("is_valid")).select(
        "decision_id", "vendor", "risk_level", F.col("is_risk").alias("flagged"),
        F.col("risk_reason").alias("reason"), research_file.alias("research_file"),
    )
    failed = validated.where(~F.col("is_valid")).select(
        "decision_id", "vendor", F.lit(None).cast("int").alias("risk_level"), F.lit(None).cast("boolean").alias("flagged"),
        F.concat(F.lit("Error: "), F.col("quarantine_reason")).alias("reason"), F.lit("").alias("research_file"),
    )
    res = ok.unionByName(failed)
    label = F.when(F.col("flagged"), F.lit(rules.RESULT_FLAGGED_LABEL)).when(~F.col("flagged"), F.lit(rules.RESULT_CLEAR_LABEL))
    done = F.when(
        F.col("flagged").isNotNull(),
        F.concat(F.lit("**Done** — level "), F.col("risk_level").cast("string"), F.lit(" ("), label, F.lit("). "), F.col("reason")),
    ).otherwise(F.concat(F.lit("**Error:** "), F.col("reason")))
    return res.select("*", label.alias("label"), done.alias("log_line"))


def run_summary(results: DataFrame) -> DataFrame:
    """Processed, ok, failed, flagged."""
    return results.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("flagged").isNotNull()).alias("ok"),
        F.count_if(F.col("flagged").isNull()).alias("failed"),
        F.count_if(F.col("flagged")).alias("flagged"),
    )
