"""Fields of the visual zone: label anchors, values in and next to label boxes, reconcilable values.

Input is a table of text boxes: ``doc_id``, ``ord`` (the reader's order, which decides ties),
``text``, ``confidence``, ``x1``, ``y1``, ``x2``, ``y2`` and the page's ``width`` and ``height``.
All joins and windows are by ``doc_id``; no document is gathered anywhere else. What needs a page as a
whole (values next to labels, all fields) shuffles the boxes once, by document, and works on one array
of boxes a page.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidoc.functions.refdata import LABELS, SEX_TOKENS
from evidoc.functions.text import caseless, let, literal_map, sql_literal, visual_date
from evidoc.operators.labels import with_matches

#: Labels by field, or a label table's index.
Labels = Mapping[str, Sequence[str]] | DataFrame

#: Shapes of document numbers and of names.
NUMBER = r"^(?=[A-Z0-9]{6,12}$)(?=.*[0-9])[A-Z0-9]+$"
NAME_LETTER = "[A-Za-zÀ-ÖÙ-öù-üÇçĞğİıÖöŞşÜü]"
DATES = ("date_of_birth", "date_of_issue", "date_of_expiry")
#: Columns of a marked box.
BOX = ("ord", "text", "confidence", "x1", "y1", "x2", "y2", "width", "height", "m", "label")
#: Of a value box and its label box, what a chain of values needs.
PLACE = ("ord", "x1", "x2", "y1", "y2", "l_y1", "l_y2")


def with_bounds(boxes: DataFrame, box: str = "box") -> DataFrame:
    """Append x1, y1, x2, y2 of a column of corner points."""
    side = lambda f, k: f(F.transform(F.col(box), lambda p: p[k]))
    return boxes.withColumns({"x1": side(F.array_min, 0), "y1": side(F.array_min, 1), "x2": side(F.array_max, 0), "y2": side(F.array_max, 1)})


def not_machine_zone(text: Column) -> Column:
    """Whether a box's text is no machine-readable line."""
    return ~(F.contains(text, F.lit("<<")) | ((F.length(F.replace(text, F.lit(" "), F.lit(""))) >= 40) & F.contains(text, F.lit("<"))))


def label_matches(text: Column, labels: Mapping[str, Sequence[str]] = LABELS) -> Column:
    """Labels in a text, in the order of their places: structs of ``start``, ``stop`` (places in the
    text) and ``field``. Longer labels take their place before shorter ones that overlap them; a
    label stands as whole words, in any case."""
    pairs = sorted(((field, label) for field, own in labels.items() for label in own), key=lambda x: -len(x[1]))
    plain = lambda x: x.replace("İ", "i").lower().replace("ı", "i")
    rows = [(k, plain(v), len(v), f) for k, (f, v) in enumerate(pairs)]
    texts = sorted({v for _, v, _, _ in rows}, key=lambda x: (-len(x), x))
    # At a place where the longest label stands, the others that stand there are its beginnings that end with a word.
    in_word = lambda x: re.match(r"\w", x) or unicodedata.category(x[0])[0] == "M" if x else False
    begins = lambda long, v: long.startswith(v) and not in_word(long[len(v) :])
    struct = lambda k, v, n, f: f"named_struct('k', {k}, 'n', {n}, 'field', {sql_literal(f)})"
    entries = [f"{sql_literal(x)}, array({', '.join(struct(*r) for r in rows if begins(x, r[1]))})" for x in texts]
    standing = F.expr(f"map({', '.join(entries)})" if entries else "cast(map() as map<string,array<struct<k:int,n:int,field:string>>>)")
    escaped = lambda x: re.sub(r"([^\w ])", r"\\\1", x)
    # Labels of the same first letter are tried only where it stands; of these the longest comes first.
    longest = "|".join(f"{escaped(c)}(?:{'|'.join(escaped(x[1:]) for x in texts if x[:1] == c)})" for c in sorted({x[:1] for x in texts}))
    # From the end of the last match on: what is before a place, the longest label there, and one character of it.
    place = F.lit(rf"(?Us)\G.*?(?<!\w)(?=({longest})(?!\w)).")
    none = F.array().cast("array<struct<start:int,stop:int,field:string>>")
    seen = F.array().cast("array<struct<k:int,start:int,stop:int,field:string>>")

    def add(s: Column, x: Column) -> Column:
        """One more place: ``end`` is behind its first character."""
        end = s["end"] + F.length(x["upto"])
        own = F.transform(F.element_at(standing, x["label"]), lambda v: F.struct(v["k"].alias("k"), (end - 1).alias("start"), (end - 1 + v["n"]).alias("stop"), v["field"].alias("field")))
        return F.struct(end.alias("end"), F.concat(s["all"], own).alias("all"))

    def found(low: Column) -> Column:
        parts = F.zip_with(F.regexp_extract_all(low, place, F.lit(0)), F.regexp_extract_all(low, place, F.lit(1)), lambda u, v: F.struct(u.alias("upto"), v.alias("label")))
        in_turn = F.array_sort(F.aggregate(parts, F.struct(F.lit(0).alias("end"), seen.alias("all")), add, lambda s: s["all"]))
        clear = lambda done, x: ~F.exists(done, lambda d: (x["start"] < d["stop"]) & (x["stop"] > d["start"]))
        own = lambda x: F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["field"].alias("field")))
        return F.array_sort(F.aggregate(in_turn, none, lambda done, x: F.when(clear(done, x), F.concat(done, own(x))).otherwise(done)))

    # One expression tells most boxes apart; only those with a label look for its place.
    any_label = F.lit(rf"(?U)(?<!\w)(?:{longest})(?!\w)")
    return let(caseless(text), lambda low: F.when(F.rlike(low, any_label), found(low)).otherwise(none))


def label_field(text: Column, labels: Mapping[str, Sequence[str]] = LABELS) -> Column:
    """The field of the first label in a text, or null."""
    return F.get(label_matches(F.lower(text), labels), 0)["field"]


def sex_of(value: Column) -> Column:
    """M, F or X if all sex tokens in a value mean the same, else empty."""
    tokens = F.split(F.upper(value), r"[\s/]+")
    known = F.array_distinct(F.filter(F.transform(tokens, lambda t: F.try_element_at(literal_map(SEX_TOKENS), t)), lambda t: t.isNotNull()))
    return F.when(F.size(known) == 1, F.get(known, 0)).otherwise("")


def normalized(field: Column, value: Column) -> Column:
    """A field's value without surrounding punctuation; dates as ISO, numbers without blanks."""
    bare = F.regexp_replace(value, r"^[ :./\-\t]+|[ :./\-\t]+$", "")
    return let(
        bare,
        lambda v: F.when(field.isin(*DATES), F.coalesce(visual_date(v).cast("string"), F.lit("")))
        .when(field == "passport_number", F.upper(F.replace(v, F.lit(" "), F.lit(""))))
        .when(field == "sex", sex_of(v))
        .otherwise(v),
    )


def acceptable(field: Column, value: Column) -> Column:
    """Whether a normalised value can be the field's."""

    def ok(v: Column) -> Column:
        own = (
            F.when(field == "passport_number", v.rlike(NUMBER))
            .when(field == "sex", v.rlike("^[MFX]$"))
            .when(field.isin(*DATES), v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))
            .when(field == "nationality", v.rlike(r"^[\p{L} /\-().]{2,60}$"))
            .when(field.isin("surname", "given_names"), v.rlike(NAME_LETTER))
            .when(field == "place_of_birth", v.rlike("[A-Za-z]") & (F.length(v) >= 2))
            .otherwise(F.lit(True))
        )
        return (v != "") & own

    return let(value, ok)


def marked(boxes: DataFrame, labels: Labels = LABELS) -> DataFrame:
    """Boxes outside the machine-readable zone with ``m``, the labels in their text, and ``label``, the
    field of the first one. A mapping of labels is looked for within the row; a table of labels, as
    ``labels.index`` makes it, is joined to the boxes' pieces."""
    rows = boxes.filter(not_machine_zone(F.col("text")))
    rows = with_matches(rows, ["doc_id", "ord"], labels) if isinstance(labels, DataFrame) else rows.withColumn("m", label_matches(F.col("text"), labels))
    return rows.withColumn("label", F.get("m", 0)["field"])


def accepted(df: DataFrame, keep: Sequence[str], field: Column, raw: Column) -> DataFrame:
    """Columns ``keep``, ``field`` and the normalised ``value``, where the field can have it. The
    value is generated, so that it is not worked out again for the filter."""
    own = let(normalized(field, raw), lambda v: F.struct(field.alias("field"), v.alias("value"), acceptable(field, v).alias("__ok")))
    return df.select(*keep, F.inline(F.array(own))).filter("__ok").drop("__ok")


def inline_values(boxes: DataFrame, labels: Labels = LABELS) -> DataFrame:
    """doc_id, field, value, confidence: values between a label and the next one in the same box. Of
    repeated fields the last wins."""
    last = F.max_by(F.struct("value", "confidence"), F.struct("ord", "k"))
    return _inline(marked(boxes, labels)).groupBy("doc_id", "field").agg(last.alias("v")).select("doc_id", "field", "v.*")


def _inline(rows: DataFrame) -> DataFrame:
    each = rows.select("doc_id", "ord", "text", "confidence", "m", F.posexplode("m").alias("k", "own"))
    following = F.coalesce(F.get("m", F.col("k") + 1)["start"], F.length("text"))
    raw = F.substr(F.col("text"), F.col("own.stop") + 1, following - F.col("own.stop"))
    return accepted(each, ["doc_id", "ord", "k", "confidence"], F.col("own.field"), raw)


def adjacent_candidates(marked_boxes: DataFrame) -> DataFrame:
    """Label boxes with value boxes below or to the right of them and a score for each. An equi-join
    on the document with the geometry as its residual condition."""
    rows = marked_boxes
    anchors = rows.filter("label is not null").select(
        "doc_id", F.col("label").alias("field"), F.col("ord").alias("l_ord"), *[F.col(c).alias(f"l_{c}") for c in ("x1", "y1", "x2", "y2")], "width", "height"
    )
    values = rows.filter("label is null").select("doc_id", "ord", "text", "confidence", "x1", "y1", "x2", "y2")
    return near(anchors.join(values, "doc_id"))


def beside(label: Callable[[str], Column], value: Callable[[str], Column]) -> Column:
    """Two structs of ``way`` (0: the value box is below the label box, 1: right of it) and ``score``, which is
    null where it is not. The functions give a box's columns."""
    high, wide = label("y2") - label("y1"), label("x2") - label("x1")
    drop, shift, gap = value("y1") - label("y2"), F.abs(value("x1") - label("x1")), value("x1") - label("x2")
    over_x = F.least(label("x2"), value("x2")) - F.greatest(label("x1"), value("x1"))
    over_y = F.least(label("y2"), value("y2")) - F.greatest(label("y1"), value("y1"))
    below = drop.between(0, F.greatest(high * 3.0, label("height") * 0.06)) & ((over_x > 0) | (shift < F.greatest(F.lit(80.0), label("width") * 0.06)))
    right = gap.between(0, F.greatest(wide * 1.5, label("width") * 0.15)) & (F.greatest(F.lit(0), over_y) > high * 0.3)
    score_below = 0.7 / (1.0 + drop / F.greatest(F.lit(1), high)) + 0.3 / (1.0 + shift / F.greatest(F.lit(1), label("width")) * 10)
    score_right = 0.9 / (1.0 + gap / F.greatest(F.lit(1), label("width")) * 20)
    return F.array(F.struct(F.lit(0).alias("way"), F.when(below, score_below).alias("score")), F.struct(F.lit(1).alias("way"), F.when(right, score_right).alias("score")))


def near(pairs: DataFrame) -> DataFrame:
    """The pairs of a label box (columns l_*) and a value box that lie below or right of each other, with
    the ``way`` and its score; a pair may be both."""
    ways = beside(lambda c: F.col(f"l_{c}" if c not in ("width", "height") else c), F.col)
    return pairs.select("*", F.inline(ways)).filter("score is not null")


def pages(marked_boxes: DataFrame) -> DataFrame:
    """doc_id, ``__heads`` (its boxes with a label) and ``__values`` (the others, from left to right): a row a
    page, by one shuffle."""
    box = lambda *names: F.struct(*names, *[n for n in BOX if n not in names])
    head = F.when(F.col("label").isNotNull(), box("ord"))
    value = F.when(F.col("label").isNull(), box("x1", "ord"))
    return marked_boxes.groupBy("doc_id").agg(F.collect_list(head).alias("__heads"), F.array_sort(F.collect_list(value)).alias("__values"))


def chained(rows: DataFrame) -> DataFrame:
    """Per pair of a label and a value box the boxes of the page right of the latter on its line that no
    other field's column claims, chained while gaps are small: appends ``chain``, their texts and mean
    confidence."""
    line_high, middle = F.col("y2") - F.col("y1"), (F.col("y1") + F.col("y2")) / 2.0
    label_high = F.greatest(F.lit(1), F.col("l_y2") - F.col("l_y1"))
    claimed = lambda v: F.exists(
        F.col("__heads"),
        lambda a: (a["label"] != F.col("of")) & (a["x1"] > F.col("x1")) & (a["x1"] <= v["x1"]) & (F.abs(a["y1"] - F.col("l_y1")) < label_high),
    )
    free = F.filter(
        F.col("__values"),
        lambda v: (v["ord"] != F.col("ord")) & (v["x1"] >= F.col("x2")) & (F.abs((v["y1"] + v["y2"]) / 2.0 - middle) < line_high * 0.6) & ~claimed(v),
    )
    start = F.struct(F.trim("text").alias("text"), F.col("confidence").alias("total"), F.lit(1).alias("n"), F.col("x2").alias("right"), F.lit(False).alias("stop"))

    def chain(s: Column, v: Column) -> Column:
        near = ~s["stop"] & (v["x1"] - s["right"]).between(0, line_high * 2.0)
        take = F.struct(
            F.concat(s["text"], F.lit(" "), F.trim(v["text"])).alias("text"), (s["total"] + v["confidence"]).alias("total"), (s["n"] + 1).alias("n"),
            v["x2"].alias("right"), F.lit(False).alias("stop"),
        )
        over = F.struct(s["text"].alias("text"), s["total"].alias("total"), s["n"].alias("n"), s["right"].alias("right"), F.lit(True).alias("stop"))
        return F.when(near, take).otherwise(over)

    end = F.aggregate(free, start, chain, lambda s: F.struct(F.trim(s["text"]).alias("chain"), (s["total"] / s["n"]).alias("joined_confidence")))
    kept = [c for c in rows.columns if c not in ("__values", "__heads")]
    return rows.select(*kept, F.inline(F.array(end)))  # generated, so it is folded once


def adjacent_values(boxes: DataFrame, labels: Labels = LABELS) -> DataFrame:
    """doc_id, field, value, confidence: per field the best acceptable value next to its labels, the
    first label first."""
    # the first label, its best box, the first of equals
    order = F.struct("l_ord", (-F.col("score")).alias("score"), "ord", "way")
    best = F.min_by(F.struct("value", F.col("joined_confidence").alias("confidence")), order)
    return _adjacent(pages(marked(boxes, labels))).groupBy("doc_id", "field").agg(best.alias("v")).select("doc_id", "field", "v.*")


def _adjacent(page: DataFrame) -> DataFrame:
    heads = page.select("doc_id", "__heads", "__values", F.explode("__heads").alias("l"))
    pairs = heads.select("doc_id", "__heads", "__values", "l", F.explode("__values").alias("v"))
    sides = [F.col(f"l.{c}").alias(f"l_{c}") for c in ("ord", "x1", "y1", "x2", "y2")] + [F.col(f"v.{c}") for c in ("ord", "text", "confidence", "x1", "y1", "x2", "y2")]
    found = chained(near(pairs.select("doc_id", "__heads", "__values", F.col("l.label").alias("of"), "l.width", "l.height", *sides)))
    return accepted(found, ["doc_id", "l_ord", "score", "ord", "way", "joined_confidence"], F.col("of"), F.col("chain"))


def number_shape(text: Column) -> tuple[Column, Column, Column]:
    """A text without blanks, whether it is a typical document number, and whether it could be one."""
    bare = F.replace(F.trim(text), F.lit(" "), F.lit(""))
    return bare, bare.rlike("^[A-Z]{1,2}[0-9]{6,9}$"), bare.rlike("^[A-Z0-9]{8,10}$") & bare.rlike("[0-9]") & bare.rlike("[A-Z]")


def standalone_numbers(boxes: DataFrame, labels: Labels = LABELS) -> DataFrame:
    """doc_id, field, value, confidence: the first value box that looks like a document number; for
    a generic shape at nine tenths of its confidence."""
    first = _standalone(marked(boxes, labels)).groupBy("doc_id", "field").agg(F.min_by(F.struct("value", "confidence"), "ord").alias("v"))
    return first.select("doc_id", "field", "v.*")


def _standalone(boxes: DataFrame) -> DataFrame:
    text, typical, generic = number_shape(F.col("text"))
    rows = boxes.filter("label is null").filter(typical | generic)
    sure = F.when(typical, F.col("confidence")).otherwise(F.col("confidence") * 0.9)
    return rows.select("doc_id", F.lit("passport_number").alias("field"), text.alias("value"), sure.alias("confidence"), "ord")


def extract(boxes: DataFrame, labels: Labels = LABELS) -> DataFrame:
    """doc_id, field, value, confidence of all visual fields: values in label boxes first, then those
    next to labels, then a number that stands alone.

    Boxes are marked where they are read and shuffled once, by document; all three ways work on the
    page's array.
    """
    page = pages(marked(boxes, labels))
    chance = lambda of, text, sure, by, order, place: F.struct(
        of.alias("of"), text.alias("text"), sure.alias("confidence"),
        F.struct(F.lit(by).alias("by"), *[F.coalesce(o.cast("double"), F.lit(0.0)).alias(f"o{k}") for k, o in enumerate(order)]).alias("key"),
        *[(place[c] if place else F.lit(None)).cast("long").alias(c) for c in PLACE],
    )
    none = F.lit(0.0)

    def inside(b: Column) -> Column:
        following = lambda k: F.coalesce(F.get(b["m"], k + 1)["start"], F.length(b["text"]))
        raw = lambda x, k: F.substr(b["text"], x["stop"] + 1, following(k) - x["stop"])
        return F.transform(b["m"], lambda x, k: chance(x["field"], raw(x, k), b["confidence"], 0, (-b["ord"], -k, none, none), None))

    def next_to(b: Column) -> Column:
        place = lambda v: {c: b[c[2:]] if c.startswith("l_") else v[c] for c in PLACE}
        ways = lambda v: F.filter(beside(b.__getitem__, v.__getitem__), lambda w: w["score"].isNotNull())
        one = lambda v: F.transform(ways(v), lambda w: chance(b["label"], v["text"], v["confidence"], 1, (b["ord"], -w["score"], v["ord"], w["way"]), place(v)))
        return F.flatten(F.transform("__values", one))

    def alone(v: Column) -> Column:
        text, typical, generic = number_shape(v["text"])
        sure = F.when(typical, v["confidence"]).otherwise(v["confidence"] * 0.9)
        return F.when(typical | generic, F.array(chance(F.lit("passport_number"), text, sure, 2, (v["ord"], none, none, none), None))).otherwise(F.array())

    all_ = F.concat(F.flatten(F.transform("__heads", inside)), F.flatten(F.transform("__heads", next_to)), F.flatten(F.transform("__values", alone)))
    rows = chained(page.select("doc_id", "__heads", "__values", F.inline(all_)))  # without a place, nothing is chained
    found = accepted(rows, ["doc_id", "key", "joined_confidence"], F.col("of"), F.col("chain"))
    best = F.min_by(F.struct("value", F.col("joined_confidence").alias("confidence")), "key")
    return found.groupBy("doc_id", "field").agg(best.alias("v")).select("doc_id", "field", "v.*")
