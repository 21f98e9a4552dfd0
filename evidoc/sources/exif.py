"""How a photograph was held: the orientation in a JPEG's metadata, and turning pixels upright.

The walk through a file's segments and its first metadata directory is column work on the binary column,
bounded in steps; only images that must be turned go through Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidoc.functions import raster
from evidoc.functions.text import let

#: Segments and directory entries that are looked at, at most.
SEGMENTS, ENTRIES = 32, 128
# Markers of a JPEG file, of its metadata, and the orientation's tag and type.
START, METADATA, EXIF, ORIENTATION, SHORT = "FFD8", "FFE1", "457869660000", 0x0112, 3
#: Markers behind which no metadata stand: the pixels, and the file's end.
LAST = ("FFDA", "FFD9")
#: Quarters to turn clockwise, by orientation. Fixed values; mirrored ones and the upright one are not turned.
QUARTERS = {3: 2, 6: 1, 8: 3}


def _hex(content: Column, at: Column, n: int) -> Column:
    """Bytes (from place ``at``, from 1) as hexadecimal digits; empty beyond the end."""
    return F.hex(F.substring(content, at, F.lit(n)))


def _number(content: Column, at: Column, n: int, little: Column) -> Column:
    """An unsigned whole number of ``n`` bytes; null where they are not all there."""

    def read(digits: Column) -> Column:
        turned = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(n))])
        return F.when(F.length(digits) == 2 * n, F.conv(F.when(little, turned).otherwise(digits), 16, 10).cast("long"))

    return let(_hex(content, at, n), read)


def metadata_at(content: Column) -> Column:
    """The place (from 1) of the metadata's own header in a JPEG file, or null. Segments are passed over by
    their lengths up to the metadata, the pixels or something that is no segment."""
    none = F.lit(None).cast("long")
    start = F.struct(F.when(_hex(content, F.lit(1), 2) == START, F.lit(3).cast("long")).alias("at"), none.alias("found"))

    def step(s: Column, _: Column) -> Column:
        def segment(x: Column) -> Column:
            here = (x["marker"] == METADATA) & (_hex(content, (s["at"] + 4).cast("int"), 6) == EXIF)
            good = F.startswith(x["marker"], F.lit("FF")) & ~x["marker"].isin(*LAST) & (x["length"] >= 2)
            return F.struct(F.when(good & ~here, s["at"] + 2 + x["length"]).alias("at"), F.when(here, s["at"] + 10).alias("found"))

        own = F.struct(_hex(content, s["at"].cast("int"), 2).alias("marker"), _number(content, (s["at"] + 2).cast("int"), 2, F.lit(False)).alias("length"))
        return F.when(s["at"].isNull() | s["found"].isNotNull(), s).otherwise(let(own, segment))

    return F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), start, step, lambda s: s["found"])


def orientation(content: Column) -> Column:
    """The orientation (1 to 8) that a JPEG file's metadata give, or null: for other files, without
    metadata or orientation, and where these are damaged."""

    def header(at: Column) -> Column:
        order = _hex(content, at.cast("int"), 2)
        return F.struct(at.alias("at"), order.isin("4949", "4D4D").alias("known"), (order == "4949").alias("little"))

    def directory(h: Column) -> Column:
        number = lambda place, n: _number(content, place.cast("int"), n, h["little"])
        first = F.when(h["known"] & (number(h["at"] + 2, 2) == 42), h["at"] + number(h["at"] + 4, 4))
        return F.struct(h["little"].alias("little"), F.when(first < F.octet_length(content), first).alias("first"))

    def value(d: Column) -> Column:
        number = lambda place, n: _number(content, place.cast("int"), n, d["little"])
        places = lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.least(n, F.lit(ENTRIES).cast("long")) - 1), lambda k: d["first"] + 2 + k * 12))
        own = F.filter(let(number(d["first"], 2), places), lambda e: (number(e, 2) == ORIENTATION) & (number(e + 2, 2) == SHORT))
        return F.try_element_at(F.transform(F.slice(own, 1, 1), lambda e: number(e + 8, 2)), F.lit(1))

    found = let(let(let(metadata_at(content), header), directory), value)
    return let(found, lambda v: F.when(v.between(1, 8), v)).cast("int")


def quarters(content: Column) -> Column:
    """How many quarters clockwise a file's pixels must be turned to be upright."""

    def turn(code: Column) -> Column:
        out = F.lit(0)
        for own, n in QUARTERS.items():
            out = F.when(code == own, F.lit(n)).otherwise(out)
        return out

    return let(orientation(content), turn)


def upright(images: DataFrame, turn: str = "turn") -> DataFrame:
    """Images (doc_id, ``image``: Spark's image struct, and quarters to turn) turned upright; those that are
    upright stay in the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: b.schema.get_field_index(n) for n in ("image", turn)}
            for k in range(b.num_rows):  # one image at a time: pixels are large
                row = b.slice(k, 1)
                image, n = row.column(at["image"])[0].as_py(), row.column(at[turn])[0].as_py()
                pixels = np.frombuffer(image["data"], dtype=np.uint8).reshape(image["height"], image["width"], image["nChannels"])
                made = raster.turned(pixels, n)
                image |= {"height": made.shape[0], "width": made.shape[1], "data": made.tobytes()}
                yield row.set_column(at["image"], b.schema.field(at["image"]), pa.array([image], b.schema.field(at["image"]).type))

    lying = images.filter(F.col(turn) > 0).mapInArrow(run, images.schema)
    return images.filter(F.coalesce(F.col(turn), F.lit(0)) == 0).unionByName(lying).select(*[c for c in images.columns if c != turn])
