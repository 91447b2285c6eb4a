"""Words in place as a proof of nearness: it never accepts more than the edit distance does."""

import random

from pyspark.sql import functions as F

from foliant.llm import lines


def test_words_in_place_prove_nearness(spark):
    r = random.Random(3)
    rows = []
    for _ in range(400):
        x = [r.choice(["a", "bc", "def", "ä", "ghijk"]) for _ in range(r.randint(1, 12))]
        y = [r.choice(["zz", "ä", "bc"]) if r.random() < 0.15 else w for w in x if r.random() < 0.97]
        rows.append((" ".join(x), " ".join(y)))
    most = F.floor(F.greatest(F.length("x"), F.length("y")) / 5).cast("int")
    found = spark.createDataFrame(rows, "x string, y string").select("x", "y", lines._aligned(F.col("x"), F.col("y"), most).alias("proved"), lines._within(F.col("x"), F.col("y"), most).alias("near"), (F.levenshtein("x", "y") <= most).alias("want")).collect()
    assert all(f.near == f.want and (f.want or not f.proved) for f in found)
    assert sum(f.proved for f in found) > 100 and sum(f.want and not f.proved for f in found) > 10
    one = spark.range(1).select(lines._aligned(F.lit("one two three four"), F.lit("one two trees four"), F.lit(5)).alias("a"), lines._aligned(F.lit("a b"), F.lit("a b c"), F.lit(9)).alias("b")).head()
    assert one.a and not one.b
