"""Reconciliation of machine-readable and visual values, plausibility and overall confidence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidoc.functions.refdata import WEIGHTS
from evidoc.functions.text import same_transliterated
from evidoc.settings import DEFAULTS

#: Evidence field, column of the parsed zone, visual field, check of the zone.
WIRING = (
    ("passport_number", "passport_number", "passport_number", "number_ok"),
    ("surname", "surname", "surname", None),
    ("given_names", "given_names", "given_names", None),
    ("date_of_birth", "date_of_birth", "date_of_birth", "birth_ok"),
    ("sex", "sex", "sex", None),
    ("expiry_date", "expiry_date", "date_of_expiry", "expiry_ok"),
    ("nationality", "nationality", "nationality", None),
    ("date_of_issue", None, "date_of_issue", None),
    ("place_of_birth", None, "place_of_birth", None),
    ("issuing_authority", None, "issuing_authority", None),
)


def reconcile(field: Column, zone: Column, visual: Column, check: Column, visual_confidence: Column) -> Column:
    """A struct: value, confidence, source, matched, review, status and warning of one field.

    Equal values (but for case, accents, blanks and fillers) verify each other; of different ones a
    passed check decides for the zone, else a review; one value alone is worth what its check or its
    visual confidence is worth; none needs a review. Empty strings are missing.
    """
    zone, visual = F.nullif(zone, F.lit("")), F.nullif(visual, F.lit(""))
    none, both = zone.isNull() & visual.isNull(), zone.isNotNull() & visual.isNotNull()
    title = F.initcap(F.replace(field, F.lit("_"), F.lit(" ")))
    equal = both & ((F.upper(F.trim(zone)) == F.upper(F.trim(visual))) | same_transliterated(zone, visual))
    passed, failed = F.coalesce(check, F.lit(False)), ~F.coalesce(check, F.lit(True))
    only_zone = zone.isNotNull() & visual.isNull()

    def out(value, confidence, source, matched, review, status, warning=None):
        return F.struct(
            value.alias("value"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"), F.lit(matched).alias("matched"),
            (F.lit(review) if isinstance(review, bool) else review).alias("review"), (F.lit(status) if isinstance(status, str) else status).alias("status"),
            (F.lit(None).cast("string") if warning is None else warning).alias("warning"),
        )

    differ = F.concat(title, F.lit(" differs: zone '"), zone, F.lit("', visual '"), visual, F.lit("'."))
    fuller = F.when(F.length(visual) >= F.length(zone), visual).otherwise(zone)
    both_confidence = F.least(F.lit(0.999), F.greatest(F.lit(0.95), F.coalesce(visual_confidence, F.lit(0.0))) + 0.05)
    low = visual_confidence < DEFAULTS.visual_confidence_floor
    needs, warns, fine = "NEEDS REVIEW", "VERIFIED WITH WARNING", "VERIFIED"
    return (
        F.when(none, out(F.lit(None).cast("string"), F.lit(0.0), "none", False, True, needs, F.concat(title, F.lit(" could not be extracted reliably."))))
        .when(equal, out(fuller, both_confidence, "both", True, False, F.when(failed, F.lit(warns)).otherwise(fine)))
        .when(both & passed, out(zone, F.lit(0.92), "mrz", False, False, warns, differ))
        .when(both, out(zone, F.lit(0.55), "mrz", False, True, needs, differ))
        .when(only_zone & passed, out(zone, F.lit(0.96), "mrz", False, False, fine))
        .when(only_zone & failed, out(zone, F.lit(0.45), "mrz", False, True, needs))
        .when(only_zone, out(zone, F.lit(0.75), "mrz", False, False, warns))
        .otherwise(out(visual, F.round(visual_confidence, 3), "visual", False, low, F.when(low, F.lit(needs)).otherwise(fine)))
    )


def evidence(zones: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per document and field: ``zones`` (doc_id, parsed) unpivoted, joined with the visual
    ``fields`` (doc_id, field, value, confidence) and reconciled. A document needs a row in
    ``zones``; its ``parsed`` may be null."""
    p = lambda name: F.lit(None).cast("string") if name is None else F.col(f"parsed.{name}").cast("string")
    check = lambda name: F.lit(None).cast("boolean") if name is None else F.col(f"parsed.{name}")
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.lit(f).alias("field"), F.lit(v).alias("visual_field"), p(z).alias("zone"), check(c).alias("check"))
            for k, (f, z, v, c) in enumerate(WIRING)
        ]
    )
    long = zones.select("doc_id", F.inline(rows))
    seen = fields.select("doc_id", F.col("field").alias("visual_field"), F.col("value").alias("visual"), F.col("confidence").alias("visual_confidence"))
    joined = long.join(seen, ["doc_id", "visual_field"], "left")
    result = reconcile(F.col("field"), F.col("zone"), F.col("visual"), F.col("check"), F.col("visual_confidence"))
    return joined.withColumn("__r", result).select("doc_id", "k", "field", "zone", "visual", "check", "__r.*")


def implausible(birth: Column, issue: Column, expiry: Column) -> Column:
    """Warnings about dates that cannot be: birth or issue on or after the expiry."""
    two = F.array(
        F.when(birth >= expiry, F.lit("Date of birth is not before the expiry date.")),
        F.when(issue >= expiry, F.lit("Date of issue is not before the expiry date.")),
    )
    return F.filter(two, lambda w: w.isNotNull())


def overall_confidence(
    weighted: Column, review: Column, acceptable: Column, glare: Column, blur_score: Column, zone_valid: Column
) -> Column:
    """The confidence of a document from its weighted evidence and its circumstances, to three
    digits; what is a hair below a half goes up, so that the order of a sum does not matter."""
    score = F.when(review, F.least(weighted, F.lit(0.60))).otherwise(weighted)
    score = F.when(~acceptable, score * 0.70).when(glare | (blur_score < 0.5), score * 0.88).otherwise(score)
    score = F.when(zone_valid, F.least(F.lit(1.0), score * 1.05)).otherwise(F.least(score, F.lit(0.75)))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.999), score)) + 1e-9, 3)


def documents(evidence_rows: DataFrame, quality: DataFrame, zones: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """One row per document: its fields, warnings in order, review flag and overall confidence.

    ``quality``: doc_id, acceptable, glare, blur_score, feedback (array of strings).
    """
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("field")), F.lit(0.0))
    names = [w[0] for w in WIRING]
    fold = evidence_rows.groupBy("doc_id").agg(
        *[F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names],
        F.sum(weight * F.col("confidence")).alias("weighted"),
        F.bool_or("review").alias("any_review"),
        F.array_sort(F.collect_list(F.when(F.col("warning").isNotNull(), F.struct("k", "warning")))).alias("warnings"),
    )
    valid = zones.select("doc_id", F.coalesce(F.col("parsed.valid"), F.lit(False)).alias("zone_valid"))
    rows = fold.join(quality, "doc_id", "left").join(valid, "doc_id", "left")
    odd = implausible(F.col("date_of_birth"), F.col("date_of_issue"), F.col("expiry_date"))
    review = F.col("any_review") | (F.size(odd) > 0)
    yes = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    score = overall_confidence(F.col("weighted"), review, yes("acceptable", True), yes("glare", False), yes("blur_score", 1.0), F.col("zone_valid"))
    feedback = F.coalesce(F.col("feedback"), F.array().cast("array<string>"))
    return rows.select(
        "doc_id", *names, review.alias("review"), score.alias("overall"), F.concat(feedback, F.transform("warnings", lambda w: w["warning"]), odd).alias("warnings")
    )
