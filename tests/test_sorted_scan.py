import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirefold.functions.paths import conflict_suffix
from quirefold.operators.sorted_scan import as_of, number

T0 = datetime(2024, 1, 1)


def skewed(spark, n=600):
    r = random.Random(2)
    rows = [(k, r.choice(["hot", "hot", "hot", f"k{r.randrange(40)}", None]), T0 + timedelta(seconds=r.randrange(200)), r.random() < 0.3) for k in range(n)]
    return spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, has boolean")


def test_number_equals_a_window(spark):
    df = skewed(spark)
    want = {(r["id"], r["n"]) for r in df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("ts", "id"))).collect()}
    assert {(r["id"], r["n"]) for r in number(df, ["k"], ["ts", "id"]).collect()} == want
    one = df.withColumn("k", F.lit("all"))
    assert sorted(r["n"] for r in number(one, ["k"], ["ts", "id"]).collect()) == list(range(1, 601))
    assert number(df.limit(0), ["k"], ["id"]).count() == 0


def test_as_of_equals_a_window(spark):
    for df in (skewed(spark), skewed(spark).withColumn("k", F.lit("all")), skewed(spark).withColumn("has", F.col("id") == 17)):
        df = df.withColumn("v", F.when(F.col("has"), F.col("ts")))
        w = Window.partitionBy("k").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        want = {(r["id"], r["last"]) for r in df.withColumn("last", F.max("v").over(w)).collect()}
        assert {(r["id"], r["last"]) for r in as_of(df, ["k"], "ts", "v").collect()} == want
    assert as_of(df.limit(0), ["k"], "ts", "v").count() == 0


def test_suffixes(spark):
    df = spark.createDataFrame([(k, "a/x.md") for k in range(5)] + [(9, "a.b/y"), (10, "a.b/y"), (11, None)], "k long, path string")
    got = {r["k"]: r["path"] for r in conflict_suffix(df, "path", ["k"]).collect()}
    assert got == {0: "a/x.md", 1: "a/x-2.md", 2: "a/x-3.md", 3: "a/x-4.md", 4: "a/x-5.md", 9: "a.b/y", 10: "a.b/y-2", 11: None}
