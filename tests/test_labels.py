import random
import re

from pyspark.sql import functions as F

from evidoc.functions.refdata import LABELS
from evidoc.operators import labels, visual


def plain(s):
    return s.replace("İ", "i").lower().replace("ı", "i")


def naive(text, table):
    """Every label at every place; the longest first, then by ord, then from the left."""
    low = plain(text or "")
    found = [(-len(x), k, m, f) for f, x, k in table for m in range(len(low)) if low.startswith(plain(x), m) and not re.match(r"\w", low[m - 1 : m]) and not re.match(r"\w", low[m + len(x) : m + len(x) + 1])]
    out = []
    for n, _, start, field in sorted(found):
        if all(start >= stop or start - n <= first for first, stop, _ in out):
            out.append((start, start - n, field))
    return sorted(out)


def test_matches_equal_trying_every_label(spark):
    r = random.Random(1)
    words = ["date", "of", "birth", "İssue", "no", "no.", "name", "ad", "soyadı", "given", "/", "passport-no", "ÉTAT", "x"]
    some = {" ".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(90)} | {"  ", "/", "."}
    table = [(f"f{k % 5}", x, k) for k, x in enumerate(sorted(some))]
    texts = [None, "", "nothing here", "Date Of Birth/DATE OF BIRTH", "dateofbirth", *(" ".join(r.choice((str.upper, str.lower, str))(r.choice(words)) for _ in range(r.randrange(1, 9))) for _ in range(150))]
    frame = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, ord int, text string").repartition(3)
    own = labels.index(spark.createDataFrame(table, "field string, label string, ord int"))
    got = {x["doc_id"]: [tuple(m) for m in x["m"]] for x in labels.with_matches(frame, ["doc_id", "ord"], own).collect()}
    usable = [(f, x.strip(), k) for f, x, k in table if re.search(r"\w", x)]
    assert got == {k: naive(t, usable) for k, t in enumerate(texts)} and sum(map(bool, got.values())) > 100


def test_the_index_and_the_mapping_agree(spark):
    texts = [f"{a}{s}{b}" for own in LABELS.values() for a in own for s, b in ((" ", "value"), ("/", own[0]), (": ", "SMITH Given names"))]
    frame = spark.createDataFrame([(k, 0, t.upper() if k % 2 else t) for k, t in enumerate(texts)], "doc_id long, ord int, text string")
    both = labels.with_matches(frame, ["doc_id", "ord"], labels.index(labels.of_mapping(spark)), out="a").withColumn("b", visual.label_matches(F.col("text")))
    assert both.filter("a <> b or size(b) = 0").count() == 0


def test_extraction_takes_a_label_table(spark):
    rows = [(1, k, t, 0.9, x, y, x + 200, y + 20, 1400, 1000) for k, (t, x, y) in enumerate([("Nachname: ÇELİK", 100, 100), ("Ausgestellt am", 100, 300), ("15.04.2024", 100, 325), ("C12345678", 600, 100)])]
    boxes = spark.createDataFrame(rows, "doc_id long, ord int, text string, confidence double, x1 int, y1 int, x2 int, y2 int, width int, height int")
    table = spark.createDataFrame([("surname", "nachname", 0), ("date_of_issue", "ausgestellt am", 1)], "field string, label string, ord int")
    got = {r["field"]: r["value"] for r in visual.extract(boxes, labels.index(table)).collect()}
    assert got == {"surname": "ÇELİK", "date_of_issue": "2024-04-15", "passport_number": "C12345678"}


def test_no_labels(spark):
    frame = spark.createDataFrame([(1, 0, "a b")], "doc_id long, ord int, text string")
    none = labels.index(spark.createDataFrame([], "field string, label string, ord int"))
    assert labels.with_matches(frame, ["doc_id", "ord"], none).first()["m"] == []


def nodes(node):
    yield node
    for k in range(node.children().length()):
        yield from nodes(node.children().apply(k))


def test_a_text_meets_no_label_but_those_that_stand_in_it(spark):
    """All labels share words with all texts; what they were compared with grew as their product."""
    r = random.Random(2)
    common = ["to", "the", "of", "in", "on", "at"]
    table = [(f"f{k % 3}", f"{a} {b} {c}", k) for k, (a, b, c) in enumerate((a, b, c) for a in common for b in common for c in common)]
    texts = [" ".join(r.choice(common) for _ in range(30)) for _ in range(40)]
    frame = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, ord int, text string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan with its counts is hidden
    try:
        found = labels.places(frame, ["doc_id", "ord"], labels.index(spark.createDataFrame(table, "field string, label string, ord int")))
        assert len(found.collect()) == 40 * 28
        met = [n.metrics().apply("numOutputRows").value() for n in nodes(found._jdf.queryExecution().executedPlan()) if "Join" in n.nodeName()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert met and max(met) == 40 * 28


def test_labels_with_signs_around_their_words_need_them(spark):
    table = spark.createDataFrame([("a", "no.", 0), ("b", "(no", 1), ("c", "--no", 2), ("d", "no", 3)], "field string, label string, ord int")
    texts = ["no.", "no.x", "x no. ", "(no", "x(no", "x (no)", "--no", "---no", "x--no", "no", "no..", "\U0001f600 no. \U0001f600"]
    frame = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, ord int, text string")
    got = {}
    for x in labels.places(frame, ["doc_id", "ord"], labels.index(table)).collect():
        got.setdefault(texts[x["doc_id"]], set()).add(x["field"])
    want = {t: {f for f, v, _ in (("a", "no.", 0), ("b", "(no", 0), ("c", "--no", 0), ("d", "no", 0)) for m in range(len(t)) if t.startswith(v, m) and not re.match(r"\w", t[m - 1 : m] if m else "") and not re.match(r"\w", t[m + len(v) :])} for t in texts}
    assert got == want
