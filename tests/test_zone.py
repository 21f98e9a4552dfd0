import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidoc.functions.checkdigit import check_digit, composite_ok, passing_checks, verify
from evidoc.functions.refdata import CONFUSIONS
from evidoc.functions.text import clean_line, fold, same_transliterated
from evidoc.operators import candidates
from evidoc.operators.mrz import build_lines, parse, plausible_line1, resolve_date, with_country_name
from evidoc.operators.repair import constrain, repair_lines, repair_number, to_digits

LINE1 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"
LINE2 = "L898902C36UTO7408122F1204159ZE184226B<<<<<10"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def plain_digit(s):
    values = [int(c) if c.isdigit() else ord(c) - 55 if "A" <= c <= "Z" else 0 for c in s.upper()]
    return str(sum(v * (7, 3, 1)[i % 3] for i, v in enumerate(values)) % 10)


def test_check_digits(spark):
    lit = F.lit
    got = one(spark, *[check_digit(lit(s)) for s in ("L898902C3", "740812", "120415", "", "abc|<Z")])
    assert tuple(got) == ("6", "2", "9", "0", plain_digit("ABC|<Z"))
    got = one(spark, verify(lit("L898902C3"), lit("6")), verify(lit("L898902C3"), lit("7")), verify(lit("<<<"), lit("<")), verify(lit("740812"), lit("")), verify(lit(None).cast("string"), lit("1")))
    assert tuple(got) == (True, False, True, False, False)
    assert tuple(one(spark, composite_ok(lit(LINE2)), composite_ok(lit(LINE2[:-1] + "9")), composite_ok(lit(LINE2[:43])))) == (True, False, False)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ABCXYZ0123456789<", max_size=50), min_size=1, max_size=200))
def test_check_digit_property(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", check_digit(F.col("s")).alias("d")).collect()
    assert all(r["d"] == plain_digit(r["s"]) for r in rows)


def test_passing_checks(spark):
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert tuple(one(spark, passing_checks(t, t, f, t), passing_checks(n, n, n, n), passing_checks(f, f, f, f))) == (3, -1, 0)


def test_parse_of_the_specimen(spark):
    p = one(spark, parse(F.lit(LINE1), F.lit(LINE2)).alias("p"))["p"]
    assert (p["surname"], p["given_names"], p["issuing_country"], p["nationality"], p["sex"]) == ("ERIKSSON", "ANNA MARIA", "UTO", "UTO", "F")
    assert (p["passport_number"], str(p["date_of_birth"]), str(p["expiry_date"]), p["personal_number"]) == ("L898902C3", "1974-08-12", "2012-04-15", "ZE184226B")
    assert p["valid"] and p["personal_ok"]


def test_build_and_parse_round_trip(spark):
    args = [F.lit(x) for x in ("U12345678", "Celik", "Yigitcan Mehmet", "TUR", "TUR", "950415", "m", "340820")]
    lines = one(spark, build_lines(*args).alias("l"))["l"]
    assert len(lines["line1"]) == len(lines["line2"]) == 44
    p = one(spark, parse(F.lit(lines["line1"]), F.lit(lines["line2"])).alias("p"))["p"]
    assert p["valid"] and (p["surname"], p["given_names"], p["sex"], str(p["expiry_date"])) == ("CELIK", "YIGITCAN MEHMET", "M", "2034-08-20")
    assert p["personal_number"] == "" and p["personal_ok"] is None


@pytest.mark.parametrize(
    ("digits", "expiry", "want"),
    [("950415", False, "1995-04-15"), ("150620", False, "2015-06-20"), ("340820", True, "2034-08-20"), ("950231", False, None), ("95O415", False, None), ("991301", False, None), ("050101", True, "2105-01-01"), ("060101", True, "2006-01-01"), ("", False, None)],
)
def test_dates(spark, digits, expiry, want):
    got = one(spark, resolve_date(F.lit(digits), expiry, 2026).cast("string"))[0]
    assert got == want


def test_countries(spark):
    want = {"TUR": "Türkiye", "D<<": "Germany", "D": "Germany", "GBR": "United Kingdom", "KOR": "South Korea", "RKS": "Republic of Kosovo", "ZZZ": "ZZZ", "": None, "<<<": None, "FRA": "France"}
    rows = spark.createDataFrame([(k,) for k in [*want, None]], "code string")
    got = {r["code"]: r["name"] for r in with_country_name(rows, "code", "name").collect()}
    assert got == want | {None: None}
    got = {r["code"]: r["name"] for r in with_country_name(spark.createDataFrame([("GBN",), ("XXB",)], "code string"), "code", "name").collect()}
    assert got["GBN"].startswith("United Kingdom") and got["XXB"].startswith("Refugee")


def test_line_gate(spark):
    lines = {LINE1: True, "TOTDIATIUMYDANOATEOFTRSUEDATEFDEDUVSANC": False, "P<CZESPECIMEN<VZOR<<<<<<<<<<<<<<<<<<<<<<": False, "P<UTOMONONYM<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<": False, "P<D<<MUSTER<<ERIKA<<<<<<<<<<<<<<<": True, LINE1[:27]: False, LINE1.replace("ERIK", "ER1K"): False}
    rows = spark.createDataFrame([(k,) for k in lines], "s string").select("s", plausible_line1(F.col("s")).alias("ok")).collect()
    assert {r["s"]: r["ok"] for r in rows} == lines
    assert one(spark, plausible_line1(F.lit(None).cast("string")))[0] is False


def test_clean_line(spark):
    got = one(spark, clean_line(F.lit(" p«uto eriksson‹‹anna|maria! ")), clean_line(F.lit("a?b¡é漢")))
    assert tuple(got) == ("P<UTO<ERIKSSON<<ANNAMARIA1", "A7B1")


def test_forced_characters(spark):
    assert one(spark, to_digits(F.lit("95O4I5")))[0] == "950415"
    got = one(spark, constrain(F.lit("L898902C3GUT07408I22H12O41S9ZE184226B<<<<<1O")))[0]
    assert got == "L898902C36UTO7408122M1204159ZE184226B<<<<<10"


def test_noisy_lines_are_repaired(spark):
    r = one(spark, repair_lines(F.lit("p<utoeriksson<<anna<maria<<<<<<<<<<<<<<<<<<<"), F.lit("L898902C36UTO74O8122F1204159ZE184226B<<<<<10")).alias("r"))["r"]
    assert r["line1"] == LINE1 and r["line2"] == LINE2 and r["corrections"] == ["15:O>0"]


def brute(number, digit, strict):
    """The candidates in the order of the search, written out."""
    alts = {k: v.replace("|", "") if strict else v for k, v in CONFUSIONS.items()}
    good = lambda s: plain_digit(s) == digit
    if good(number):
        return number, 0, 1
    amb = [i for i, c in enumerate(number) if c in alts]
    put = lambda pairs: "".join(dict(pairs).get(i, c) for i, c in enumerate(number))
    ones = [put([(i, a)]) for i in amb for a in alts[number[i]]]
    twos = (put([(amb[i], a), (amb[j], b)]) for i in range(len(amb)) for j in range(i + 1, min(len(amb), i + 6)) for a in alts[number[amb[i]]] for b in alts[number[amb[j]]])
    threes = (
        put([(amb[i], a), (amb[j], b), (amb[k], c)])
        for i in range(len(amb)) for j in range(i + 1, min(len(amb), i + 4)) for k in range(j + 1, min(len(amb), j + 3))
        for a, b, c in itertools.product(*(alts[number[amb[x]]][:2] for x in (i, j, k)))
    )
    for n, tried in enumerate((ones, twos, threes if 3 <= len(amb) <= 8 else ()), 1):
        passed = [s for s in tried if good(s)]
        if passed:
            return passed[0], n, len(passed)
    return number, None, 0


@pytest.mark.parametrize("strict", [False, True])
def test_number_repair_equals_brute_force(spark, strict):
    import random

    r = random.Random(9)
    cases = [("100000000", "0"), ("UI2345678", plain_digit("U12345678")), ("YYYYYYYYY", "1")]
    for alphabet in ("0123456789", "ABDXYH12", "YTWJ<E", "UVMNRHF<Y"):
        cases += [("".join(r.choice(alphabet) for _ in range(9)), str(r.randrange(10))) for _ in range(150)]
    rows = spark.createDataFrame(cases, "n string, d string").select("n", "d", repair_number(F.col("n"), F.col("d"), strict).alias("r")).collect()
    seen = set()
    for x in rows:
        number, arity, passing = brute(x["n"], x["d"], strict)
        assert (x["r"]["number"], x["r"]["replaced"], x["r"]["passing"], x["r"]["ok"]) == (number, arity, passing, arity is not None), x
        seen.add(arity)
    assert {0, 1, 2, None} <= seen


def test_check_digit_misread(spark):
    r = one(spark, repair_number(F.lit("L898902C3"), F.lit("G")).alias("r"))["r"]
    assert (r["number"], r["digit"], r["ok"], r["replaced"]) == ("L898902C3", "6", True, 0)
    r = one(spark, repair_number(F.lit("100000000"), F.lit("0"), strict=False).alias("r"))["r"]
    assert r["number"] == "|00000000"
    assert one(spark, repair_number(F.lit("L898902C3"), F.lit("Y")).alias("r"))["r"]["ok"] is False


def test_transliteration(spark):
    lit = F.lit
    pairs = {("ÇELİK", "CELIK"): True, ("YİĞİTCAN", "YIGITCAN"): True, ("MÜLLER", "MULLER"): True, ("SMITH", "JONES"): False, ("Øre", "Ore"): False, ("", ""): False, ("DE LA", "DE<LA"): True}
    for (a, b), want in pairs.items():
        assert one(spark, same_transliterated(lit(a), lit(b)))[0] is want
    assert one(spark, fold(lit("straße ı İ ñ Ł")))[0] == "STRASSE I I N Ł"


def test_fragments_of_two_lines(spark):
    cut = [(line[lo:hi], 150 * k, 40 * n) for n, line in enumerate((LINE1, LINE2)) for k, (lo, hi) in enumerate(((0, 15), (15, 30), (30, 44)))]
    rows = [(1, k, t, 0.9, x, y, x + 140, y + 20) for k, (t, x, y) in enumerate(reversed(cut))]
    frags = spark.createDataFrame(rows, "doc_id long, ord int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    best = candidates.best_parse(candidates.judged(candidates.adjacent_pairs(candidates.rows_of(frags), ["doc_id"])), ["doc_id"]).first()
    assert best["parsed"]["valid"] and best["line1"] == LINE1 and best["line2"] == LINE2


def test_rows_join_the_first_row_whose_anchor_they_overlap(spark):
    """C overlaps B but not A, the anchor of the row that B joined: it starts a row."""
    rows = [(1, 0, "A", 1.0, 0, 0, 10, 20), (1, 1, "B", 1.0, 20, 9, 30, 29), (1, 2, "C", 1.0, 40, 18, 50, 38)]
    frags = spark.createDataFrame(rows, "doc_id long, ord int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    got = [(r["row_ord"], r["line"]) for r in candidates.rows_of(frags).orderBy("row_ord").collect()]
    assert got == [(0, "AB"), (1, "C")]
