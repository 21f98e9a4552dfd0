import random

import pytest
from pyspark.sql import types as T

#: Columns that a user's table may also have; their names are those that operators use inside.
EXTRA = ("fp", "node", "root", "size", "shard", "score", "labels", "toxic", "lang_pred", "n_words", "spans", "__cell", "__rank", "__own", "h", "key", "bucket")
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in EXTRA]
)
WORDS = [a + b for a in ("ba", "de", "ki", "lo", "mu", "na", "ro", "su", "ta", "ve") for b in ("ran", "lis", "tor", "men", "dik", "pol", "gas", "hem")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def odd_texts():
    """Texts that are null, empty, blank, short, long, of odd white space, repeated or nearly equal."""
    base = prose(1, 120)
    return [
        None, "", " \n\t ", "one", "one two three", "A B C D", base, base, base + " extra", base.replace("ran", "RAN", 1), prose(2, 6000), "x" * 5000,
        "tabs\tand\x0bforms\x0cand\r\nlines", "ünïcödé wörds ñandú ß İstanbul 漢字 仮名 \U0001f600 done", "<|endoftext|> is ordinary text", "  leading and trailing  ",
        "line\nline\nline\nother\n\n#*$%&|<>", "all rights reserved. Licensed CC BY 4.0 and the GNU General Public License version 3 or later", "123 456 !!! ???", prose(3, 60), prose(3, 60) + " tail words here",
    ]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(k, t, "xx" if k % 2 else None, "s", len(t or ""), *["x"] * len(EXTRA)) for k, t in enumerate(odd_texts())]
    rows += [rows[6], rows[6], (None, "of no id", None, None, None, *["x"] * len(EXTRA))]  # repeated rows, and one without an id
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
