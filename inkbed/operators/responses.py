"""Answers of a model as an input table: parsed, checked against what was asked, the last attempt kept.  No model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbed.functions.text import canonical

_CONCEPT = "ARRAY<STRUCT<concept_id: STRING, proposition: STRING, concept_type: STRING, source_span_ids: ARRAY<STRING>, confidence: DOUBLE>>"
#: What a field is where the answer leaves it out.
DEFAULTS = {"concept_type": "definition", "confidence": 0.8}


def _shape(json: Column) -> Column:
    """array, object or null for what isn't JSON of either kind."""
    value = F.try_parse_json(json)
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(value.isNotNull(), "other")


def parse_concepts(rows: DataFrame) -> DataFrame:
    """M-02 to M-04: answers (window_id, abstention, text) as window_id, abstention, concept_id, confidence, concept_type.

    An answer that abstains, is no JSON or no array has one row with the abstention; an empty array has none.
    """
    shape = _shape(F.col("text"))
    why = F.when(F.col("abstention").isNotNull(), F.col("abstention")).when(shape.isNull(), "invalid_json").when(shape != "array", "expected_array_got_single_record")
    own = rows.select("window_id", why.alias("abstention"), F.from_json("text", _CONCEPT).alias("_c"))
    none = own.filter("abstention IS NOT NULL").select("window_id", "abstention", F.lit(None).cast("string").alias("concept_id"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("concept_type"))
    found = own.filter("abstention IS NULL").select("window_id", "abstention", F.explode("_c").alias("c"))
    filled = found.select("window_id", "abstention", F.coalesce("c.concept_id", F.lit("")).alias("concept_id"), *[F.coalesce(f"c.{k}", F.lit(DEFAULTS[k])).alias(k) for k in ("confidence", "concept_type")])
    return none.unionByName(filled)


_VERDICT = "ARRAY<STRUCT<concept_id: STRING, verdict: STRING, reconstruction: STRING, comparison: STRING, confidence: DOUBLE, evidence_span_ids: ARRAY<STRING>>>"


def critic_verdicts(rows: DataFrame) -> DataFrame:
    """M-03: answers of the reconstruction critic (window_id, abstention, text) as window_id, concept_id, verdict, confidence, evidence (spans).

    A field that is left out has its default: an empty id, unresolved, 0.5, no spans.  An answer that abstains, is no JSON or no array gives no
    verdict, so that its concepts stay unjudged (critic_gaps).
    """
    fine = F.col("abstention").isNull() & (_shape(F.col("text")) == "array")
    found = rows.filter(fine).select("window_id", F.explode(F.from_json("text", _VERDICT)).alias("v"))
    default = lambda c, v: F.coalesce(f"v.{c}", F.lit(v)).alias(c)
    evidence = F.coalesce(F.size("v.evidence_span_ids"), F.lit(0))
    return found.select("window_id", default("concept_id", ""), default("verdict", "unresolved"), default("confidence", 0.5), F.greatest(evidence, F.lit(0)).cast("bigint").alias("evidence"))


def critic_gaps(concepts: DataFrame, verdicts: DataFrame, accepted: tuple[str, ...] = ("supported",)) -> DataFrame:
    """M-03: concepts (window_id, concept_id) that aren't confirmed: reason unjudged, or the verdicts that are not accepted, sorted and joined.

    Of several verdicts on one concept any that isn't accepted counts: the gate fails closed.
    """
    bad = F.array_sort(F.collect_set(F.when(~F.col("verdict").isin(*accepted), F.col("verdict"))))
    judged = verdicts.groupBy("window_id", "concept_id").agg(bad.alias("_bad"))
    rows = concepts.select("window_id", "concept_id").join(judged, ["window_id", "concept_id"], "left")
    reason = F.when(F.col("_bad").isNull(), "unjudged").when(F.size("_bad") > 0, F.array_join("_bad", ","))
    return rows.select("window_id", "concept_id", reason.alias("reason")).filter("reason IS NOT NULL")


def check_rewrites(answers: DataFrame, required: DataFrame, least: int = 10) -> DataFrame:
    """M-05: answers (unit_id, abstention, text) for units with concepts to map (required: unit_id, concept_id): unit_id, reason, acceptable.

    Refused: abstentions, what is no JSON object, unmapped concepts, and outputs of fewer than ``least`` characters.
    """
    own = answers.select("unit_id", "abstention", _shape(F.col("text")).alias("_shape"), F.from_json("text", "replacement_latex STRING, concept_correspondences ARRAY<STRUCT<source_concept_id: STRING>>").alias("_r"))
    mapped = own.select("unit_id", F.explode("_r.concept_correspondences").alias("c")).select("unit_id", F.col("c.source_concept_id").alias("concept_id")).distinct()
    lost = required.join(mapped, ["unit_id", "concept_id"], "left_anti").groupBy("unit_id").agg(F.array_join(F.sort_array(F.collect_set("concept_id")), ", ").alias("_lost"))
    reason = (
        F.when(F.col("abstention").isNotNull(), F.col("abstention"))
        .when(F.col("_shape").isNull(), "json_decode_failed")
        .when(F.col("_shape") != "object", "expected_dict_got_other")
        .when(F.col("_lost").isNotNull(), F.concat(F.lit("incomplete_concept_mapping: "), "_lost"))
        .when(F.length(F.coalesce("_r.replacement_latex", F.lit(""))) < least, "truncated_output")
    )
    return own.join(lost, "unit_id", "left").select("unit_id", reason.alias("reason"), reason.isNull().alias("acceptable"))


def latest_attempt(rows: DataFrame, most: int) -> DataFrame:
    """M-08: the result of each unit's last attempt (unit, attempt, result), retries beyond ``most`` not counted; of two of one number the greatest result."""
    return rows.filter(F.col("attempt") <= most).groupBy("unit").agg(F.max("attempt").cast("bigint").alias("attempts_to"), F.max(F.struct("attempt", "result"))["result"].alias("result"))


def freeze(rows: DataFrame, by: str, key: str, columns: list[str], accepted: Column) -> DataFrame:
    """M-13: rows, accepted rows and a canonical hash of each inventory; only hashes are gathered, for each inventory."""
    one = F.sha2(canonical(*(F.col(c) for c in columns)), 256)
    hashes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), one.alias("h")))), lambda x: x["h"]), "")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(accepted).alias("accepted"), F.sha2(hashes, 256).alias("signature"))
