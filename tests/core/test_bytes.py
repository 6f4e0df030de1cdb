"""Files are decoded without Python, and as Python does."""

import random

from pyspark.sql import functions as F

from spanloom.plans import catalogue, further  # noqa: F401
from spanloom.sources import books as B

PARTS = (b"a", b"\xff", b"\xc3", b"\xc3\xa9", b"\xe2\x82", b"\xe2\x82\xac", b"\xf0\x9f\x98", b"\xf0\x9f\x98\x80", b"\xef\xbf\xbd", b"\xef\xbf", b"\xee\x83\xbe", b"\xee\x83\xbe0", b"0", b"1", b"\xed\xa0\x80", b"\xc0\x80", b"\xf4\x90\x80\x80", b"\x80", b"\xf5\x80", b"\n")


def test_bytes_that_are_no_text_are_left_out(spark):
    rng = random.Random(5)
    rows = [(k, bytearray(b"".join(rng.choice(PARTS) for _ in range(rng.randrange(14))))) for k in range(3000)] + [(3000, None)]
    t = spark.createDataFrame(rows, "k long, content binary").select("content", B.decoded(F.col("content")).alias("text")).collect()
    assert [r.text for r in t] == [None if r.content is None else bytes(r.content).decode("utf-8", "ignore") for r in t]


def test_no_worker_holds_files(spark):
    plan = catalogue.queries()["load_books"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
