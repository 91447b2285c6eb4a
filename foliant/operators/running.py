"""Running values over ordered rows, also where one key holds most rows; values folded along ancestors.

A window sorts all rows of a key in one task. Here a key with more than HOT_ROWS rows is cut into ranges: each range has its own
window, what ranges pass on to later ones is one row for each, and the two are joined.
"""

from __future__ import annotations

import functools
import math
import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a key that one window may sort.
HOT_ROWS = 5_000_000


#: Rows of an operator's input that one task may take, as far as keys let them be parted.
TASK_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is named and Spark runs on this machine alone."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
        if not path:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="foliant-")
        spark.sparkContext.setCheckpointDir(path)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, held in the shared folder: lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def dealt(rows: DataFrame, by: list[str], count: int | None = None, task_rows: int = 0) -> DataFrame:
    """The same rows, those of a key together, in as many tasks as they need: more than the session's shuffles have, if there are many.

    What a task sorts and holds then doesn't grow with the input. Windows, joins and groups of these keys keep the division.
    """
    tasks = math.ceil((rows.count() if count is None else count) / (task_rows or TASK_ROWS))
    return rows.repartition(tasks, *by) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def gathered(rows: DataFrame, by: list[str], hot_rows: float = HOT_ROWS) -> tuple[DataFrame, float]:
    """rows and the hot_rows for what follows: where no key is larger, rows of a key lie together and nothing need be counted any more.

    Windows and groups of these keys, and of any finer ones, then need neither a count nor a shuffle of their own.
    """
    if hot_rows == math.inf:
        return rows, hot_rows
    size = rows.groupBy(*by).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).head()
    if (size.most or 0) > hot_rows:
        return rows, hot_rows
    tasks = math.ceil((size.all or 0) / TASK_ROWS)
    few = tasks <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(*by) if few else rows.repartition(tasks, *by)), math.inf


@dataclass(frozen=True)
class Scan:
    """kind: sum (nulls count 0), min or last (the last value that isn't null), of all rows so far; `before`: without the row itself."""

    kind: str
    value: Column
    before: bool = False


def _all(conditions: list[Column]) -> Column:
    return functools.reduce(Column.__and__, conditions)


def _over(scan: Scan, value: Column, window: W) -> Column:
    f = {"sum": lambda: F.sum(value), "min": lambda: F.min(value), "last": lambda: F.last(value, True)}[scan.kind]()
    out = f.over(window)
    return F.coalesce(out, F.lit(0)) if scan.kind == "sum" else out


def running(rows: DataFrame, by: list[str], order: list[str], scans: dict[str, Scan], hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with a column for each scan, over the rows of equal `by` in the order of `order` (nulls first), which no two of them share.

    Nulls in `by` are one key. An empty table stays empty. With hot_rows infinite, keys are known to be small and aren't counted.
    """
    size = None if hot_rows == math.inf else rows.groupBy(*by).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).head()
    if size is None or (size.most or 0) <= hot_rows:
        w = W.partitionBy(*by).orderBy(*order)
        return rows.select("*", *[_over(s, s.value, w.rowsBetween(W.unboundedPreceding, -1 if s.before else 0)).alias(c) for c, s in scans.items()])
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size.all / hot_rows))
    values = rows.select("*", *[s.value.alias(f"__v_{c}") for c, s in scans.items()])
    held = cut(values.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()))
    place = F.struct(*order)
    carried = {
        "sum": lambda v: F.coalesce(F.sum(v), F.lit(0)), "min": lambda v: F.min(v),
        "last": lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), place)),
    }
    carry = held.groupBy(*by, "__part").agg(*[carried[s.kind](f"__v_{c}").alias(f"__p_{c}") for c, s in scans.items()])
    earlier = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    carry = carry.select(*[F.col(b).alias(f"__running_key{k}") for k, b in enumerate(by)], F.col("__part").alias("__q"), *[_over(s, F.col(f"__p_{c}"), earlier).alias(f"__c_{c}") for c, s in scans.items()])
    w = W.partitionBy(*by, "__part").orderBy(*order)
    local = held.select("*", *[_over(s, F.col(f"__v_{c}"), w.rowsBetween(W.unboundedPreceding, -1 if s.before else 0)).alias(f"__l_{c}") for c, s in scans.items()])
    met = local.join(carry, _all([*[F.col(b).eqNullSafe(F.col(f"__running_key{k}")) for k, b in enumerate(by)], F.col("__part") == F.col("__q")]))
    joined = {"sum": lambda a, b: a + b, "min": lambda a, b: F.least(a, b), "last": lambda a, b: F.coalesce(a, b)}
    return met.select(*rows.columns, *[joined[s.kind](F.col(f"__l_{c}"), F.col(f"__c_{c}")).alias(c) for c, s in scans.items()])


def nearest_before(rows: DataFrame, marks: DataFrame, by: list[str], at: str, payload: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with the payload of the last mark of their key at or before their place; null where there is none.

    An as-of join by one sort instead of pairs. Of marks at one place the last by payload counts. Rows without a place have none;
    payload columns that rows have already are replaced.
    """
    keep = [c for c in rows.columns if c not in payload]
    left = rows.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*keep).alias("__row"), F.lit(None).cast(marks.select(F.struct(*payload).alias("m")).schema["m"].dataType).alias("__mark"), F.monotonically_increasing_id().alias("__n"))
    right = marks.where(F.col(at).isNotNull()).groupBy(*by, at).agg(F.max(F.struct(*payload)).alias("__mark"))
    right = right.select(*by, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), "__mark", F.lit(0).cast("long").alias("__n"))
    both = cut(left.unionByName(right))  # the numbering of rows has to stay
    found = running(both, by, ["__at", "__side", "__n"], {"__last": Scan("last", F.col("__mark"))}, hot_rows).where("__side = 1")
    return found.select(*[F.col(f"__row.{c}").alias(c) for c in keep], *[F.when(F.col("__at").isNotNull(), F.col(f"__last.{c}")).alias(c) for c in payload])


def along_ancestors(nodes: DataFrame, by: list[str], node: str, parent: str, folds: dict[str, tuple[str, Column]]) -> DataFrame:
    """nodes with a column for each fold ('sum' or 'product', value) over the node and all its ancestors.

    By pointer doubling: in each round a node takes over what its pointer has gathered, and points twice as far, so rounds grow with
    the logarithm of the depth. A parent that is no node ends the way; nodes on or below a cycle get null. Of nodes with equal keys
    any one row counts as the ancestor.
    """
    op = {"sum": lambda a, b: a + b, "product": lambda a, b: a * b}
    key = [*by, node]
    values = nodes.select(*key, F.col(parent).alias("__up"), *[v.alias(c) for c, (_, v) in folds.items()]).dropDuplicates(key)
    known = values.select(*by, F.col(node).alias("__up"), F.lit(True).alias("__known"))
    state = cut(values.join(known, [*by, "__up"], "left").withColumn("__up", F.when(F.col("__known"), F.col("__up"))).drop("__known"))
    for _ in range(max(1, state.count()).bit_length() + 1):
        if state.where("__up is not null").isEmpty():
            break
        done = state.where("__up is null")
        over = state.select(*by, F.col(node).alias("__up"), F.col("__up").alias("__next"), *[F.col(c).alias(f"__{c}") for c in folds])
        went = state.where("__up is not null").join(over, [*by, "__up"])
        went = went.select(*key, F.col("__next").alias("__up"), *[op[k](F.col(c), F.col(f"__{c}")).alias(c) for c, (k, _) in folds.items()])
        state = cut(done.select(*went.columns).unionByName(went))
    found = state.select(*key, *[F.when(F.col("__up").isNull(), F.col(c)).alias(c) for c in folds])
    return nodes.drop(*folds).join(found, key, "left")


def reached(jump: DataFrame, by: list[str]) -> DataFrame:
    """(by, i): the places that are reached from place 1 of each key by jumps (by, i, to), which lead upwards; by doubling.

    Place 1 itself is reached; a jump beyond the places that have one ends the way. Keys are not null, or structs.
    """
    begins = cut(jump.where("i = 1").select(*by, "i"))
    known = jump.select(*by, F.col("i").alias("to")).distinct()
    jump = cut(jump.select(*by, "i", "to").join(known, [*by, "to"], "left_semi").select(*by, "i", "to"))
    while not jump.isEmpty():
        more = begins.join(jump, [*by, "i"]).select(*by, F.col("to").alias("i"))
        begins = cut(begins.unionByName(more).distinct())
        jump = cut(jump.join(jump.select(*by, F.col("i").alias("to"), F.col("to").alias("further")), [*by, "to"]).select(*by, "i", F.col("further").alias("to")))
    return begins
