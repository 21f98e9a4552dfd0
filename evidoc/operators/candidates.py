"""From text fragments to the best parse of a machine-readable zone.

Fragments of a page are grouped into rows, rows become candidate lines, lines pair up, pairs are
gated, repaired, parsed and ranked. Folds over one page's fragments are array functions; everything
else is a projection or a window by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidoc.functions.checkdigit import passing_checks
from evidoc.functions.text import clean_line
from evidoc.operators.mrz import candidate_score, parse, plausible_line1
from evidoc.operators.repair import repair_lines
from evidoc.settings import DEFAULTS


def single_line(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of an isolated strip: its fragments from left to right as one line, and each fragment
    that is long enough by itself; ``ord`` -1 marks the joined line."""
    parts = F.array_sort(F.collect_list(F.struct("x1", "ord", "text", "confidence")))
    joined = fragments.groupBy(*keys).agg(parts.alias("p"), F.avg("confidence").alias("confidence"))
    whole = joined.select(*keys, F.lit(-1).alias("ord"), clean_line(F.array_join(F.transform("p", lambda x: x["text"]), "")).alias("line"), "confidence")
    own = fragments.select(*keys, "ord", clean_line(F.col("text")).alias("line"), "confidence")
    return whole.unionByName(own).filter(F.length("line") >= DEFAULTS.min_line_chars)


def rows_of(fragments: DataFrame) -> DataFrame:
    """doc_id, row_ord, line, confidence: fragments, from the top, join the first row whose first
    fragment they overlap by more than half the lower height; a row reads from left to right."""
    item = F.struct("y1", "ord", "x1", "y2", "text", "confidence")
    pages = fragments.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))  # one page's boxes
    none = F.array().cast("array<array<struct<y1:int,ord:int,x1:int,y2:int,text:string,confidence:double>>>")

    def place(rows: Column, v: Column) -> Column:
        def fits(r: Column) -> Column:
            a = F.get(r, 0)
            over = F.least(a["y2"], v["y2"]) - F.greatest(a["y1"], v["y1"])
            return F.greatest(F.lit(0), over) > 0.5 * F.least(a["y2"] - a["y1"], v["y2"] - v["y1"])

        at = F.array_position(F.transform(rows, fits), F.lit(True))  # from 1; 0: no row fits
        put = F.transform(rows, lambda r, k: F.when(k + 1 == at, F.concat(r, F.array(v))).otherwise(r))
        return F.when(at > 0, put).otherwise(F.concat(rows, F.array(F.array(v))))

    typed = F.transform(
        "items",
        lambda v: F.struct(
            v["y1"].cast("int").alias("y1"), v["ord"].cast("int").alias("ord"), v["x1"].cast("int").alias("x1"), v["y2"].cast("int").alias("y2"),
            v["text"].alias("text"), v["confidence"].cast("double").alias("confidence"),
        ),
    )
    grouped = pages.select("doc_id", F.posexplode(F.aggregate(typed, none, place)).alias("row_ord", "r"))
    sorted_row = F.array_sort(F.transform("r", lambda v: F.struct(v["x1"].alias("x1"), v["ord"].alias("ord"), v["text"].alias("text"))))
    mean = F.aggregate(F.transform("r", lambda v: v["confidence"]), F.lit(0.0), lambda a, v: a + v) / F.size("r")
    return grouped.select("doc_id", "row_ord", clean_line(F.array_join(F.transform(sorted_row, lambda v: v["text"]), "")).alias("line"), mean.alias("confidence"))


def adjacent_pairs(rows: DataFrame, keys: list[str], order: str = "row_ord") -> DataFrame:
    """Each candidate line that is long enough with the next one: visit, line1, line2, confidence."""
    w = Window.partitionBy(*keys).orderBy(order)
    long = rows.filter(F.length("line") >= DEFAULTS.min_line_chars)
    out = long.select(
        *keys, (F.row_number().over(w) - 1).alias("visit"), F.col("line").alias("line1"), F.lead("line").over(w).alias("line2"),
        ((F.col("confidence") + F.lead("confidence").over(w)) / 2).alias("confidence"),
    )
    return out.filter("line2 is not null")


def crossed_pairs(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Every first-line candidate with every second-line candidate of the same strips (``keys``)."""
    a = first.select(*keys, F.col("line").alias("line1"), F.col("ord").alias("o1"), F.col("confidence").alias("c1"))
    b = second.select(*keys, F.col("line").alias("line2"), F.col("ord").alias("o2"), F.col("confidence").alias("c2"))
    w = Window.partitionBy(*keys).orderBy("o1", "o2")
    return a.join(b, keys).select(*keys, (F.row_number().over(w) - 1).alias("visit"), "line1", "line2", ((F.col("c1") + F.col("c2")) / 2).alias("confidence"))


def judged(pairs: DataFrame, strict: bool = True, reference_year: int = DEFAULTS.reference_year) -> DataFrame:
    """Pairs whose first line is plausible, repaired and parsed, with their score."""
    good = pairs.filter(plausible_line1(F.col("line1")))
    fixed = good.withColumn("__r", repair_lines(F.col("line1"), F.col("line2"), strict))
    parsed = fixed.withColumn("parsed", parse(F.col("__r.line1"), F.col("__r.line2"), reference_year))
    score = candidate_score(F.col("__r.line1"), F.col("parsed")) + 0.5 * F.col("confidence")
    return parsed.withColumn("score", score).withColumn("line1", F.col("__r.line1")).withColumn("line2", F.col("__r.line2")).drop("__r")


def best_parse(candidates: DataFrame, keys: list[str], visit: str = "visit") -> DataFrame:
    """The first valid parse in visiting order, else the one of the highest score (the earliest)."""
    valid = F.col("parsed.valid")
    order = [valid.desc(), F.when(valid, F.col(visit)).asc(), F.desc("score"), F.col(visit).asc()]
    w = Window.partitionBy(*keys).orderBy(*order)
    return candidates.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def resolve_orientation(crops: DataFrame, enough: int = 3, floor: float = 0.15) -> DataFrame:
    """Of parses per document, turn (0: upright, 1: turned) and crop (with ``presence``), the best.

    Crops below ``floor`` are left out, unless a turn has no other: then its first one stays. The
    turned page only counts where no upright crop passes ``enough`` checks. The first valid parse by
    presence wins, else the most passing checks.
    """
    p = F.col("parsed")
    checks = passing_checks(p["number_ok"], p["birth_ok"], p["expiry_ok"], p["composite_ok"])
    turn = Window.partitionBy("doc_id", "turn")
    rows = crops.withColumn("checks", checks).withColumn("__best", F.max("presence").over(turn)).withColumn("__first", F.min("crop").over(turn))
    rows = rows.filter((F.col("presence") >= floor) | ((F.col("__best") < floor) & (F.col("crop") == F.col("__first"))))
    upright = F.max(F.when(F.col("turn") == 0, F.col("checks"))).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("__upright", upright).filter((F.col("turn") == 0) | (F.coalesce("__upright", F.lit(-1)) < enough))
    valid = F.coalesce(p["valid"], F.lit(False))
    visiting = [F.col("turn"), F.desc("presence"), F.col("crop")]
    w = Window.partitionBy("doc_id").orderBy(valid.desc(), F.when(~valid, F.col("checks")).desc(), *visiting)
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k", "__best", "__first", "__upright")
