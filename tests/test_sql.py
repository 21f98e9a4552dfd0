from pyspark.sql import functions as F

from evidoc.functions import checkdigit, sql, text
from evidoc.operators import mrz


def test_sql_functions_equal_the_columns(spark):
    sql.register(spark)
    values = [None, "", "L898902C3", "740812", "95O4I5", "a-b<c d", "L898902C36UTO7408122F1204159ZE184226B<<<<<10", "L898902C36UTO7408122F1204159ZE184226B<<<<<19", "950415", "340820", "150620", "991231", "20231", "850231",
              "15 JUIN 1995", "15 JUILLET 95", "15 04 1995", "31.02.1995", "1995-04-15", "15 APR / AVR 1995", "3 SEPTEMBER 07", "12 XXX 1999", "1/2/3", "p<utoeriksson<<anna«maria!?", "ÇELİK", "Müller ß ø Ł é"]
    rows = spark.createDataFrame([(v,) for v in values], "s string")
    c = F.col("s")
    pairs = {
        "mrz_clean(s)": text.clean_line(c), "mrz_check_digit(s)": checkdigit.check_digit(c), "mrz_verify(s, '6')": checkdigit.verify(c, F.lit("6")),
        "mrz_verify(s, '<')": checkdigit.verify(c, F.lit("<")), "mrz_composite_ok(s)": checkdigit.composite_ok(c), "visual_date(s)": text.visual_date(c),
        "mrz_date(s, false, 2026)": mrz.resolve_date(c, False, 2026), "mrz_date(s, true, 2026)": mrz.resolve_date(c, True, 2026), "mrz_date(s, true, 2010)": mrz.resolve_date(c, True, 2010),
        "name_fold(s)": text.fold(c), "names_match(s, 'celik')": text.same_transliterated(c, F.lit("celik")),
    }
    for call, column in pairs.items():
        got = rows.select("s", F.expr(call).alias("a"), column.alias("b")).collect()
        assert [(r["s"], r["a"]) for r in got] == [(r["s"], r["b"]) for r in got], call


def test_sql_functions_need_no_python_and_no_shuffle(spark, capsys):
    sql.register(spark)
    spark.range(3).selectExpr("mrz_check_digit(cast(id AS STRING)) AS d", "visual_date('1.2.2003') AS v").explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Exchange" not in plan and "Project" in plan
