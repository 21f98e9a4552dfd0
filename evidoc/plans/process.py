"""From text boxes and measurements to reconciled, scored records: the main path, as one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidoc.functions.refdata import LABELS
from evidoc.operators import candidates, imaging, reconcile, visual
from evidoc.settings import DEFAULTS

#: Share of a page's height below which its machine-readable zone is looked for. Fixed value.
ZONE_TOP = 0.65


def zones(boxes: DataFrame, strict: bool = True, reference_year: int = DEFAULTS.reference_year) -> DataFrame:
    """doc_id and the best parse of each page that has a readable zone."""
    low = boxes.filter(F.col("y1") >= F.col("height") * ZONE_TOP)
    pairs = candidates.adjacent_pairs(candidates.rows_of(low), ["doc_id"])
    return candidates.best_parse(candidates.judged(pairs, strict, reference_year), ["doc_id"]).select("doc_id", "parsed", "line1", "line2", "score")


def process(
    boxes: DataFrame, measurements: DataFrame, labels: Mapping[str, Sequence[str]] = LABELS, strict: bool = True, reference_year: int = DEFAULTS.reference_year
) -> DataFrame:
    """One record per page of ``measurements``: fields, warnings, review flag and confidence."""
    pages = measurements.select("doc_id").distinct()
    parsed = pages.join(zones(boxes, strict, reference_year).select("doc_id", "parsed"), "doc_id", "left")
    rows = reconcile.evidence(parsed, visual.extract(boxes, labels))
    return reconcile.documents(rows, imaging.quality(measurements), parsed)
