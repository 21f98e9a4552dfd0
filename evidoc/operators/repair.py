"""Repair of misread second lines: positional constraints and a checksum-guided search.

Replacing a character shifts the weighted sum by a known amount, so the search works on residues
modulo 10: per row an array of single replacements with their shifts, from which pairs and triples
are formed within the windows and filtered by the residue that is missing. The order in which
candidates are tried is the order of the structs, so the smallest one is the first that passes; no
join and no shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidoc.functions.checkdigit import char_value, chars, check_digit, weight
from evidoc.functions.refdata import CONFUSIONS, DIGIT_TO_LETTER, LETTER_TO_DIGIT
from evidoc.functions.text import let, literal_map

#: Places (from 0) of a second line that hold digits or letters only.
DIGIT_PLACES = (9, 13, 14, 15, 16, 17, 18, 19, 21, 22, 23, 24, 25, 26, 27, 43)
LETTER_PLACES = (10, 11, 12)
SEX_PLACE = 20


def to_digits(s: Column) -> Column:
    """Letters that look like digits become those digits; fillers and other letters stay."""
    return F.translate(F.upper(s), "".join(LETTER_TO_DIGIT), "".join(LETTER_TO_DIGIT.values()))


def to_letters(s: Column) -> Column:
    return F.translate(F.upper(s), "".join(DIGIT_TO_LETTER), "".join(DIGIT_TO_LETTER.values()))


def sex_letter(c: Column) -> Column:
    """M, F and the filler stay; letters like M or F become those; letters like digits are fillers."""
    return (
        F.when(c.isin("M", "F", "<"), c)
        .when(c.isin("W", "N", "H"), F.lit("M"))
        .when(c == "E", F.lit("F"))
        .when(c.isin(*LETTER_TO_DIGIT), F.lit("<"))
        .otherwise(c)
    )


def constrain(line2: Column) -> Column:
    """A second line with each place's kind of character enforced."""
    kinds = [to_digits if i in DIGIT_PLACES else to_letters if i in LETTER_PLACES else sex_letter if i == SEX_PLACE else None for i in range(max(DIGIT_PLACES) + 1)]
    parts, start = [], 0
    for i, kind in enumerate(kinds):  # runs of places of one kind
        if i + 1 == len(kinds) or kinds[i + 1] is not kind:
            own = F.substring(line2, start + 1, i + 1 - start)
            parts.append(kind(own) if kind else own)
            start = i + 1
    return F.concat(*parts, F.substr(line2, F.lit(start + 1)))


def corrections(before: Column, after: Column) -> Column:
    """What differs, as ``place:old>new`` in the order of places."""
    both = F.arrays_zip(chars(before).alias("a"), chars(after).alias("b"))
    pairs = F.transform(both, lambda x, i: F.when(x["a"] != x["b"], F.concat(i.cast("string"), F.lit(":"), x["a"], F.lit(">"), x["b"])))
    return F.filter(pairs, lambda x: x.isNotNull())


def _singles(number: Column, strict: bool) -> Column:
    """Every replacement of one character: q (which ambiguous place), o (which alternative), p (the
    place), a (the character) and d (the shift of the residue)."""
    table = literal_map({k: v.replace("|", "") if strict else v for k, v in CONFUSIONS.items()})
    places = F.filter(
        F.transform(chars(number), lambda c, i: F.struct(i.alias("p"), c.alias("c"), F.try_element_at(table, c).alias("alts"))), lambda x: x["alts"].isNotNull()
    )
    each = F.transform(
        places,
        lambda x, q: F.transform(
            chars(x["alts"]),
            lambda a, o: F.struct(
                q.alias("q"), o.alias("o"), x["p"].alias("p"), a.alias("a"), F.pmod((char_value(a) - char_value(x["c"])) * weight(x["p"]), F.lit(10)).alias("d")
            ),
        ),
    )
    return F.flatten(each)


def repair_number(number: Column, digit: Column, strict: bool = True, width: int | None = None) -> Column:
    """A struct: the repaired number, whether it passes, how many characters were replaced (null: no
    way was found), how many candidates of that many passed, and the check digit as a digit.

    Tried in turn: the number as it is, one replacement, two at most five places apart, and (with
    three to eight ambiguous places) three close together of the first two alternatives each.
    ``strict`` leaves out the alternative ``|``, which is no character of a document number. ``width``
    may say how long numbers are at most.
    """
    wanted = F.when(digit == "<", F.lit(0)).otherwise(F.translate(F.upper(digit), "".join(LETTER_TO_DIGIT), "".join(LETTER_TO_DIGIT.values())).try_cast("int"))
    need = F.pmod(wanted - check_digit(number, width).cast("int"), F.lit(10))
    state = F.struct(need.alias("need"), _singles(number, strict).alias("s"))
    none = F.array().cast("array<struct<q1:int,q2:int,q3:int,o1:int,o2:int,o3:int,p1:int,a1:string,p2:int,a2:string,p3:int,a3:string>>")

    def rank(x: Column, y: Column | None = None, z: Column | None = None) -> Column:
        blank = {"q": F.lit(-1), "o": F.lit(-1), "p": F.lit(-1), "a": F.lit("")}
        xs = [x, y if y is not None else blank, z if z is not None else blank]
        order = [xs[k]["q"].cast("int").alias(f"q{k + 1}") for k in range(3)] + [xs[k]["o"].cast("int").alias(f"o{k + 1}") for k in range(3)]
        tail = [c for k in range(3) for c in (xs[k]["p"].cast("int").alias(f"p{k + 1}"), xs[k]["a"].alias(f"a{k + 1}"))]
        return F.struct(*order, *tail)

    def one(t: Column) -> Column:
        return F.transform(F.filter(t["s"], lambda x: x["d"] == t["need"]), lambda x: rank(x))

    def two(t: Column) -> Column:
        pairs = F.transform(
            t["s"],
            lambda x: F.transform(
                F.filter(t["s"], lambda y: (y["q"] > x["q"]) & (y["q"] <= x["q"] + 5) & ((x["d"] + y["d"]) % 10 == t["need"])), lambda y: rank(x, y)
            ),
        )
        return F.flatten(pairs)

    def three(t: Column) -> Column:
        few = F.filter(t["s"], lambda x: x["o"] < 2)
        triples = F.transform(
            few,
            lambda x: F.flatten(
                F.transform(
                    F.filter(few, lambda y: (y["q"] > x["q"]) & (y["q"] <= x["q"] + 3)),
                    lambda y: F.transform(
                        F.filter(few, lambda z: (z["q"] > y["q"]) & (z["q"] <= y["q"] + 2) & ((x["d"] + y["d"] + z["d"]) % 10 == t["need"])),
                        lambda z: rank(x, y, z),
                    ),
                )
            ),
        )
        ambiguous = F.size(F.array_distinct(F.transform(t["s"], lambda x: x["q"])))
        return F.when(ambiguous.between(3, 8), F.flatten(triples)).otherwise(none)

    def found(t: Column) -> Column:
        first = one(t)
        second = F.when(F.size(first) == 0, two(t)).otherwise(none)
        return let(F.struct(first.alias("a"), second.alias("b")), lambda u: let(
            F.when((F.size(u["a"]) > 0) | (F.size(u["b"]) > 0), none).otherwise(three(t)),
            lambda c: F.struct(
                F.when(F.size(u["a"]) > 0, F.lit(1)).when(F.size(u["b"]) > 0, F.lit(2)).when(F.size(c) > 0, F.lit(3)).alias("n"),
                (F.size(u["a"]) + F.size(u["b"]) + F.size(c)).alias("passing"),
                F.array_min(F.concat(u["a"], u["b"], c)).alias("best"),
            ),
        ))

    def put(s: Column, p: Column, a: Column) -> Column:
        return F.when(p >= 0, F.concat(F.substr(s, F.lit(1), p), a, F.substr(s, p + 2))).otherwise(s)

    def result(r: Column) -> Column:
        b = r["best"]
        fixed = F.when(b.isNull(), number).otherwise(put(put(put(number, b["p1"], b["a1"]), b["p2"], b["a2"]), b["p3"], b["a3"]))
        return F.struct(fixed.alias("number"), b.isNotNull().alias("ok"), r["n"].alias("replaced"), r["passing"].alias("passing"), wanted.cast("string").alias("digit"))

    as_is = F.struct(number.alias("number"), F.lit(True).alias("ok"), F.lit(0).alias("replaced"), F.lit(1).alias("passing"), wanted.cast("string").alias("digit"))
    lost = F.struct(number.alias("number"), F.lit(False).alias("ok"), F.lit(None).cast("int").alias("replaced"), F.lit(0).alias("passing"), wanted.cast("string").alias("digit"))
    return F.when(need.isNull(), lost).when(need == 0, as_is).otherwise(let(let(state, found), result))


def repair_lines(line1: Column, line2: Column, strict: bool = True) -> Column:
    """A struct of both lines repaired: the type letter, letters of the issuer, the second line's
    places and its document number; ``repaired`` has what the number's search found."""
    tidy = lambda s: F.rpad(F.coalesce(F.replace(F.upper(F.trim(s)), F.lit(" "), F.lit("")), F.lit("")), 44, "<")
    a = tidy(line1)
    kind = F.when(F.substring(a, 1, 1).isin("R", "F", "B", "9"), F.lit("P")).otherwise(F.substring(a, 1, 1))
    first = F.concat(kind, F.substring(a, 2, 1), to_letters(F.substring(a, 3, 3)), F.substring(a, 6, 39))
    fixed = let(constrain(tidy(line2)), lambda b: F.struct(b.alias("line2"), repair_number(F.substring(b, 1, 9), F.substring(b, 10, 1), strict, 9).alias("r")))
    return let(
        fixed,
        lambda x: F.struct(
            first.alias("line1"),
            F.concat(x["r"]["number"], F.substring(x["line2"], 10, 35)).alias("line2"),
            corrections(tidy(line2), F.concat(x["r"]["number"], F.substring(x["line2"], 10, 35))).alias("corrections"),
            x["r"].alias("repaired"),
        ),
    )
