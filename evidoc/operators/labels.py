"""Labels of any number in texts, by equality of whole pieces.

A label has a shape: its number of words, and how far it goes on before the first and behind the last of
them. Every piece of a text that has the shape of some label meets the label table in one equality join, so
work and shuffles grow with the texts, times the number of shapes, and with the places found, not with the
number of labels that share a word with a text. A filter of ``BITS`` bits, which the labels set, holds back
most pieces that are no label before they are shuffled. A piece travels with its place, so nothing is
compared again at the text. Both sides are shuffled.

Defined results: labels without a letter or digit are left out; a label stands as whole words, in any case,
with the dotted and dotless i alike; of overlapping labels the longer one takes its place, of equally long
ones that of the smaller ``ord`` and then the one further left; texts that are null or have no label have an
empty array. Texts are boxes' texts: a page's line or less, not whole documents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidoc.functions.refdata import LABELS
from evidoc.functions.text import caseless, let

WORD = r"(?U)\W*(\w+)"
#: Bits of the filter, 1 MB at any number of labels.
BITS = 1 << 23
MATCHES = "array<struct<start:int,stop:int,field:string>>"


def of_mapping(spark: SparkSession, labels: Mapping[str, Sequence[str]] = LABELS) -> DataFrame:
    """A label table of a mapping from fields to labels."""
    rows = [(field, label, k) for k, (field, label) in enumerate((f, x) for f, own in labels.items() for x in own)]
    return spark.createDataFrame(rows, "field string, label string, ord int")


def words(low: Column) -> Column:
    """The places (from 0) where a text's words start and where they end."""
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,end:int>>").alias("all"))
    sizes = F.zip_with(*[F.regexp_extract_all(low, F.lit(WORD), F.lit(k)) for k in (0, 1)], lambda piece, word: F.struct(F.length(piece).alias("piece"), F.length(word).alias("word")))

    def add(s: Column, x: Column) -> Column:
        end = s["end"] + x["piece"]
        return F.struct(end.alias("end"), F.concat(s["all"], F.array(F.struct((end - x["word"]).alias("at"), end.alias("end")))).alias("all"))

    return F.aggregate(sizes, none, add, lambda s: s["all"])


def index(labels: DataFrame) -> DataFrame:
    """low (the caseless label), n (its length), words, before and after (its shape), field, ord."""
    low = caseless(F.trim("label"))
    once = labels.select("field", "ord", low.alias("low")).groupBy("field", "low").agg(F.min("ord").alias("ord"))
    own = once.select("field", "ord", "low", F.length("low").alias("n"), words(F.col("low")).alias("__w")).filter("size(__w) > 0")
    return own.select("low", "n", F.size("__w").alias("words"), F.get("__w", 0)["at"].alias("before"), (F.col("n") - F.element_at("__w", -1)["end"]).alias("after"), "field", "ord")


def bit(low: Column) -> Column:
    """Which bit of the filter a label sets."""
    return F.pmod(F.xxhash64(low), F.lit(BITS))


def summary(idx: DataFrame) -> DataFrame:
    """One row with one struct: ``bits``, the filter in numbers of 64 bits, and ``shapes``, all that labels have."""
    at = bit(F.col("low"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    own = idx.select(F.floor(at / 64).alias("slot"), one.alias("bits"), F.struct("words", "before", "after").alias("shape"))
    none = idx.sparkSession.range(BITS // 64).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("bits"), F.lit(None).cast("struct<words:int,before:int,after:int>").alias("shape"))
    slots = own.union(none).groupBy("slot").agg(F.bit_or("bits").alias("bits"), F.collect_set("shape").alias("shapes"))
    bits = F.transform(F.sort_array(F.collect_list(F.struct("slot", "bits"))), lambda x: x["bits"])
    return slots.agg(F.struct(bits.alias("bits"), F.array_distinct(F.flatten(F.collect_list("shapes"))).alias("shapes")))


def pieces(low: Column, shapes: Column) -> Column:
    """Structs of ``piece`` and ``start``: what stands in a text as whole words and has one of the shapes."""

    def at(own: Column, s: Column, i: Column) -> Column:
        first, last = F.get(own, i)["at"], F.get(own, i + s["words"] - 1)["end"]
        # A label that goes on beyond its words needs room for that, and one more character that is in no word or outside the text.
        room_before = first - F.coalesce(F.get(own, i - 1)["end"], F.lit(-1))
        room_after = F.coalesce(F.get(own, i + s["words"])["at"], F.length(low) + 1) - last
        start, stop = first - s["before"], last + s["after"]
        piece = F.when((room_before > s["before"]) & (room_after > s["after"]), F.substr(low, start + 1, stop - start))
        return F.struct(piece.alias("piece"), start.alias("start"))

    def shaped(own: Column, s: Column) -> Column:
        some = F.when(F.size(own) >= s["words"], F.sequence(F.lit(0), F.size(own) - s["words"])).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(some, lambda i: at(own, s, i)), lambda p: p["piece"].isNotNull())

    return let(words(low), lambda own: F.flatten(F.transform(shapes, lambda s: shaped(own, s))))


def passes(piece: Column, bits: Column) -> Column:
    """Whether a piece's bit is set in the filter: of every label it is, of few others."""
    return F.bit_get(F.get(bits, F.floor(bit(piece) / 64).cast("int")), (bit(piece) % 64).cast("int")) == 1


def places(texts: DataFrame, keys: Sequence[str], idx: DataFrame, text: str = "text") -> DataFrame:
    """Columns ``keys``, start, stop, field and ``rank`` (the label's ord) of every place of every label,
    overlaps included.

    Pieces travel without their text. Files say little about how many pieces they hold, so Spark may not send
    either side of the join through the driver, which sees the labels' summary only.
    """
    own = idx.select(*[F.col(n).alias(f"__l_{n}") for n in ("low", "n", "field", "ord")])
    known = summary(idx).scalar()
    rows = texts.select(*keys, caseless(F.col(text)).alias("__low"), known["shapes"].alias("__shapes"))
    each = rows.select(*keys, F.inline(pieces(F.col("__low"), F.col("__shapes"))).alias("__piece", "__start")).filter(passes(F.col("__piece"), known["bits"]))
    found = each.hint("merge").join(own, F.col("__piece") == F.col("__l_low"))
    return found.select(*keys, F.col("__start").alias("start"), (F.col("__start") + F.col("__l_n")).alias("stop"), F.col("__l_field").alias("field"), F.col("__l_ord").alias("rank"))


def chosen(found: Column) -> Column:
    """Of places (structs of start, stop, field, rank) those that stay beside longer ones, by place."""
    ranked = F.array_sort(F.transform(found, lambda x: F.struct((x["start"] - x["stop"]).alias("size"), x["rank"].alias("rank"), x["start"].alias("start"), x["stop"].alias("stop"), x["field"].alias("field"))))
    clear = lambda done, x: ~F.exists(done, lambda d: (x["start"] < d["stop"]) & (x["stop"] > d["start"]))
    own = lambda x: F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["field"].alias("field")))
    return let(ranked, lambda r: F.array_sort(F.aggregate(r, F.array().cast(MATCHES), lambda done, x: F.when(clear(done, x), F.concat(done, own(x))).otherwise(done))))


def with_matches(texts: DataFrame, keys: Sequence[str], idx: DataFrame, text: str = "text", out: str = "m") -> DataFrame:
    """``texts``, one row for each of ``keys``, with ``out``: its labels, as ``visual.label_matches`` has them."""
    found = places(texts, keys, idx, text).groupBy(*keys).agg(chosen(F.collect_list(F.struct("start", "stop", "field", "rank"))).alias(out))
    return texts.join(found.hint("merge"), list(keys), "left").withColumn(out, F.coalesce(F.col(out), F.array().cast(MATCHES)))
