"""Grey levels as histograms: 256 counts in an array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 256


def lowest(hist: Column) -> Column:
    """The lowest level that occurs, or null."""
    return F.array_min(F.transform(hist, lambda n, v: F.when(n > 0, v)))


def highest(hist: Column) -> Column:
    return F.array_max(F.transform(hist, lambda n, v: F.when(n > 0, v)))


def spread(level: Column, low: Column, high: Column) -> Column:
    """A level after ``low`` to ``high`` are spread over 0 to 255; one tone stays as it is."""
    return F.when(high > low, F.floor((level - low) * 255 / (high - low))).otherwise(level).cast("int")


def otsu(hist: Column) -> Column:
    """The threshold of the largest variance between the levels up to it and those above; of equal ones
    the lowest, and 0 where there is one tone or nothing. One fold over running counts and sums."""
    whole = F.aggregate(
        F.transform(hist, lambda n, v: F.struct(n.alias("n"), (n * v).alias("s"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s")),
        lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), (a["s"] + x["s"]).alias("s")),
    )

    def from_totals(total: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("v"), F.lit(0.0).alias("best"), F.lit(0).alias("at"))

        def step(a: Column, count: Column) -> Column:
            n, s = a["n"] + count, a["s"] + count * a["v"]
            apart = (total["n"] * s - n * total["s"]).cast("double")
            between = F.when((n > 0) & (n < total["n"]), apart * apart / (n * (total["n"] - n))).otherwise(0.0)
            better = between > a["best"]
            return F.struct(n.alias("n"), s.alias("s"), (a["v"] + 1).alias("v"), F.when(better, between).otherwise(a["best"]).alias("best"), F.when(better, a["v"]).otherwise(a["at"]).alias("at"))

        return F.aggregate(hist, start, step, lambda a: a["at"])

    return F.element_at(F.transform(F.array(whole), from_totals), 1)


def smoothed(profile: Column) -> Column:
    """A profile blurred by a bell over a thirtieth of its length (an odd number of places, three at
    least), mirrored at its ends."""
    h = F.size(profile)
    k = F.greatest(F.lit(3), F.floor(h / 30)).cast("int")
    k = F.when(k % 2 == 0, k + 1).otherwise(k)
    # The weights of short bells.
    short = {3: (0.25, 0.5, 0.25), 5: (0.0625, 0.25, 0.375, 0.25, 0.0625), 7: (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125)}
    sigma = ((k - 1) * 0.5 - 1) * 0.3 + 0.8
    bell = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.exp(-F.pow(i - (k - 1) / 2, F.lit(2.0)) / (2 * sigma * sigma)))
    total = F.aggregate(bell, F.lit(0.0), lambda a, w: a + w)
    weights = F.transform(bell, lambda w: w / total)
    for size, own in short.items():
        weights = F.when(k == size, F.array(*map(F.lit, own))).otherwise(weights)
    mirrored = lambda i: F.when(h == 1, F.lit(0)).otherwise(F.abs(h - 1 - F.abs(h - 1 - F.abs(i))))

    def blur(x: Column) -> Column:
        half = F.floor(F.size(x["w"]) / 2).cast("int")
        at = lambda i: F.aggregate(F.transform(x["w"], lambda w, j: w * F.get(x["p"], mirrored(i + j - half).cast("int"))), F.lit(0.0), lambda a, v: a + v)
        return F.when(h > 0, F.transform(F.sequence(F.lit(0), h - 1), at)).otherwise(x["p"])

    return F.element_at(F.transform(F.array(F.struct(weights.alias("w"), profile.alias("p"))), blur), 1)
