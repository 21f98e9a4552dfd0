import duckdb
import pytest
from pyspark.sql import functions as F

from evidoc.functions.text import visual_date
from evidoc.operators import visual
from evidoc.plans import catalog

SCHEMA = "doc_id long, ord int, text string, confidence double, x1 int, y1 int, x2 int, y2 int, width int, height int"


def page(spark, *boxes):
    """Boxes (text, left, top, width) on a page of 1400 by 1000."""
    rows = []
    for k, box in enumerate(boxes):
        text, left, top, width = (*box, *(100, 100, 200)[len(box) - 1 :])
        rows.append((1, k, text, 0.95, left, top, left + width, top + 20, 1400, 1000))
    return spark.createDataFrame(rows, SCHEMA)


def fields(spark, *boxes):
    return {r["field"]: r["value"] for r in visual.extract(page(spark, *boxes)).collect()}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("03 KASIM 1988", "1988-11-03"), ("7 gen 2012", "2012-01-07"), ("28 DÉCEMBRE 1971", "1971-12-28"), ("9 OUT 2003", "2003-10-09"), ("4 7 1966", "1966-07-04"), ("30/02/2010", None),
        ("22 OKT / OCT 07", "2007-10-22"), ("2011-12-3", "2011-12-03"), ("6-8-2019", "2019-08-06"), ("11 ŞUB 49", "2049-02-11"), ("11 MRZ 50", "1950-03-11"), ("8 ZZZ/NOV 1983", "1983-11-08"),
        ("", None), ("no date here", None), ("88.77.2001 2 JUL 2004", "2004-07-02"),
    ],
)
def test_visual_dates(spark, text, want):
    assert spark.range(1).select(visual_date(F.lit(text)).cast("string")).first()[0] == want


@pytest.mark.parametrize(
    ("text", "field", "want"),
    [
        ("Apellidos: NÚÑEZ PEÑA", "surname", "NÚÑEZ PEÑA"), ("Vornamen - LOTTE BRITTA", "given_names", "LOTTE BRITTA"), ("Document number: kt 77 31 905", "passport_number", "KT7731905"),
        ("Geschlecht: W", "sex", "F"), ("Gender: ERKEK", "sex", "M"), ("Nazionalità: SVIZZERA", "nationality", "SVIZZERA"), ("Ablaufdatum: 2 FEB 2031", "date_of_expiry", "2031-02-02"),
    ],
)
def test_values_in_labels(spark, text, field, want):
    assert fields(spark, (text,))[field] == want


def test_a_value_below_its_label_and_one_beside(spark):
    got = fields(spark, ("Issuing office", 640, 300, 180), ("LJUBLJANA NORD", 655, 334, 210), ("Birthplace", 90, 610, 120), ("OULU", 235, 612, 80))
    assert got["issuing_authority"] == "LJUBLJANA NORD" and got["place_of_birth"] == "OULU"


def test_a_value_out_of_reach_is_none(spark):
    assert "surname" not in fields(spark, ("Family name", 60, 80, 140), ("HOLMBERG", 900, 700, 120))


def test_a_date_that_does_not_exist_is_no_value(spark):
    assert "date_of_issue" not in fields(spark, ("Issue date", 420, 210, 110), ("30 FEB 2015", 425, 241, 130))


def test_three_labels_in_a_box(spark):
    got = fields(spark, ("Last name: OKAFOR First name: NGOZI Sexe: F", 300, 420, 700))
    assert (got["surname"], got["given_names"], got["sex"]) == ("OKAFOR", "NGOZI", "F")


def test_pieces_of_a_line_are_joined_until_a_wide_gap(spark):
    got = fields(spark, ("Forenames", 510, 150, 130), ("JUN", 512, 178, 44), ("HO", 566, 179, 30), ("KIM", 700, 178, 44))
    assert got["given_names"] == "JUN HO"


def test_a_neighbour_column_keeps_its_value(spark):
    got = fields(spark, ("Surname", 40, 500, 90), ("Uyruğu", 190, 501, 80), ("AYDIN", 42, 527, 95), ("KKTC", 192, 528, 70))
    assert got["surname"] == "AYDIN" and got["nationality"] == "KKTC"


def test_ambiguous_sex_and_repeated_labels(spark):
    got = fields(spark, ("Sex: M/F",), ("Surname: FIRST",), ("Surname: LAST",))
    assert "sex" not in got and got["surname"] == "LAST"


def test_zone_lines_are_left_out(spark):
    got = fields(spark, ("Surname",), ("P<UTOERIKSSON<<ANNA", 100, 125), ("SMITH", 100, 150))
    assert got["surname"] == "SMITH"


def test_number_that_stands_alone(spark):
    rows = {r["field"]: (r["value"], r["confidence"]) for r in visual.extract(page(spark, ("hello",), ("A1B2C3D4", 500, 500))).collect()}
    assert rows["passport_number"][0] == "A1B2C3D4" and abs(rows["passport_number"][1] - 0.855) < 1e-9
    assert fields(spark, ("U1234567",))["passport_number"] == "U1234567"


def test_labels_are_whole_words_and_longest_first(spark):
    match = lambda s: [tuple(m) for m in spark.range(1).select(visual.label_matches(F.lit(s))).first()[0]]
    assert match("unsurnamed nominal") == []
    assert match("issue date of birth") == [(6, 19, "date_of_birth")]
    assert match("SOYADI/SURNAME") == [(0, 6, "surname"), (7, 14, "surname")]
    assert match("DATE DE NAISSANCE") == [(0, 17, "date_of_birth")]
    assert match("") == []


def test_labels_that_begin_alike_stand_in_for_each_other(spark):
    own = {"a": ("no.", "no", "date"), "b": ("date of", "no.", "\u00e9tat"), "c": ("of issue place",)}
    made = spark.range(1).select(visual.label_matches(F.lit("Date of issue place \U0001f600 No. 1 \u00c9TAT nos"), own))
    assert [tuple(m) for m in made.first()[0]] == [(0, 4, "a"), (5, 19, "c"), (22, 25, "a"), (28, 32, "b")]
    table = repr(made._jdf.queryExecution().toString())
    assert "contains(" not in table  # labels are not tried one by one


def test_labels_are_a_parameter(spark):
    own = {"surname": ("sukunimi",)}
    got = visual.inline_values(page(spark, ("Sukunimi: VIRTANEN",), ("Surname: X Y",)), own).collect()
    assert [(r["field"], r["value"]) for r in got] == [("surname", "VIRTANEN")]


def test_bounds(spark):
    boxes = spark.createDataFrame([(1, [[5, 7], [20, 6], [21, 30], [4, 31]])], "doc_id long, box array<array<int>>")
    assert tuple(visual.with_bounds(boxes).first())[2:] == (4, 6, 21, 31)


def test_spatial_join_is_no_nested_loop(spark):
    plan = visual.adjacent_candidates(visual.marked(page(spark, ("Surname",), ("SMITH", 100, 125))))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty(spark):
    assert visual.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_birth_date_that_does_not_exist_ends_no_form(spark, sf, tmp_path):
    """The first order of customer 7 is on 2000-02-29, so the form says 29 FEB 1900."""
    for name in ("nation", "customer", "orders"):
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        if name == "orders":
            rows = rows.withColumn("o_orderdate", F.when(F.col("o_custkey") == 7, F.lit("2000-02-29").cast(rows.schema["o_orderdate"].dataType)).otherwise(F.col("o_orderdate")))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("nation", "customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for query in ("visual_fields", "adjacent_values"):
        got = {tuple(r) for r in catalog.QUERIES[query](spark, str(tmp_path)).select("doc_id", "field", "value", "confidence").collect()}
        want = set(con.execute(f"SELECT doc_id, field, value, confidence FROM ({catalog.ORACLE_SQL[query]})").fetchall())
        assert not got - want and [r[:3] for r in want - got] == [(7, "date_of_birth", "1900-02-29")]  # which is no date
    for query in ("inline_values", "number_fallback"):
        assert [r["field"] for r in catalog.QUERIES[query](spark, str(tmp_path)).filter("doc_id = 7").collect()] == ["sex" if query == "inline_values" else "passport_number"]
