"""A prefix trie of conversations, merged family by family.

A family is the conversations whose ids share id - id % FAMILY; the conversation with that very id is its base. Each conversation
is rebuilt: the first h turns are the base's (h is a checksum of the id, below HEADS), the rest its own after its first h. Families
are cogrouped with the first turns of their base, rebuilt, and built into a small trie each; only their nodes are shuffled, and equal
nodes of all families merged. A node is known by its depth and 128 bits: the XOR of scrambled hashes of each (position, turn), so
it needs no text, and the running XOR of a very long conversation can be taken in parts.

What a node owes to its subtree is summed along chains. A node's conv_id is its smallest member, and so the nodes of one conv_id
are one path from some depth down, a chain. Chains hang on chains; their sums are added up by doubling, then each chain is summed
from its end. Nodes with one member are a path with one leaf and nothing to save, so they take no part in this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, cut, mix, parts

FAMILY, HEADS = 20, 4
#: Conversations of more turns are numbered and summed in parts, not within their family's group.
LONG = 1 << 16
#: Depths of a chain that one window sums.
SEGMENT = 4096
#: Ids of an end list are written in runs of so many possible ids.
ID_RUN = 1 << 16

KEY = ["k1", "k2", "depth"]
_NODES = "k1 long, k2 long, depth int, p1 long, p2 long, words long, conv_id long, n long, ends array<long>"
_SALT = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))


@dataclass
class Trie:
    nodes: DataFrame  # k1, k2, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends
    ends: DataFrame  # k1, k2, depth, conv_id: the conversations that end at a node


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def own_turns(conv_id: Column) -> Column:
    """How many of its first turns a conversation takes from its base."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def terms(pos: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two scrambled hashes of each turn at its position."""
    p = pos.astype(np.uint64)
    return tuple(mix(h.view(np.uint64) ^ mix(p * salt + U64(1))) for h, salt in zip((h1, h2), _SALT, strict=True))


def _long(t: pa.Table, name: str) -> np.ndarray:
    return np.asarray(t.column(name).combine_chunks()).astype(np.int64) if t.num_rows else np.empty(0, np.int64)


def _family(members: pa.Table, heads: pa.Table) -> pa.Table:
    """The trie of one family, from its turns and its base's first ones."""
    conv, first, turn, h1, h2, n_words, h = (_long(members, c) for c in ("conv_id", "first", "turn", "h1", "h2", "words", "h"))
    order = np.lexsort((h2, h1, turn, first, conv))
    conv, h1, h2, n_words, h = conv[order], h1[order], h2[order], n_words[order], h[order]
    at = np.argsort(_long(heads, "idx"))
    b1, b2, bw = (_long(heads, c)[at] for c in ("b1", "b2", "bw"))
    edge = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1], [True]]))
    path = []
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        k = int(h[a])
        own = slice(min(a + k, z), z)
        t1, t2, w = np.concatenate([b1[:k], h1[own]]), np.concatenate([b2[:k], h2[own]]), np.concatenate([bw[:k], n_words[own]])
        x1, x2 = terms(np.arange(1, len(t1) + 1), t1, t2)
        keys = [np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(x)]).view(np.int64) for x in (x1, x2)]
        path.append((keys[0], keys[1], np.concatenate([[0], w]), np.full(len(w) + 1, conv[a]), np.arange(len(w) + 1)))
    k1, k2, w, conv, depth = (np.concatenate([p[c] for p in path]) for c in range(5))
    p1, p2 = np.concatenate([[0], k1[:-1]]), np.concatenate([[0], k2[:-1]])
    end = np.concatenate([depth[1:] == 0, [True]])
    order = np.lexsort((conv, k2, k1, depth))
    k1, k2, w, conv, depth, p1, p2, end = (x[order] for x in (k1, k2, w, conv, depth, p1, p2, end))
    start = np.flatnonzero(np.concatenate([[True], (depth[1:] != depth[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
    count = np.diff(np.concatenate([start, [len(conv)]]))
    ended = np.add.reduceat(end.astype(np.int64), start)
    ends = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ended)]), pa.int32()), pa.array(conv[end]))
    top = depth[start] == 0
    return pa.table({"k1": k1[start], "k2": k2[start], "depth": depth[start].astype(np.int32), "p1": np.where(top, 0, p1[start]), "p2": np.where(top, 0, p2[start]), "words": w[start], "conv_id": conv[start], "n": count, "ends": ends})


def _numbered(rows: DataFrame) -> DataFrame:
    """idx of each turn in its conversation; a conversation's turns stay dealt to many tasks."""
    spark = rows.sparkSession
    order = ["conv_id", "first", "turn", "h1", "h2"]
    held = cut(rows.repartitionByRange(parts(spark), *order).withColumn("part", F.spark_partition_id()))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offset = held.groupBy("conv_id", "part").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    idx = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order[1:]))
    return held.withColumn("idx", idx).join(offset, ["conv_id", "part"]).withColumn("idx", F.col("idx") + F.col("offset")).drop("offset")


def _long_nodes(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """Nodes of conversations too long for one group, a row for each turn and one for the root, as _family gives them."""
    own = _numbered(turns).where("idx > h").select("conv_id", "base", "h", "idx", "part", "h1", "h2", "words")
    ids = cut(turns.select("conv_id", "base", "h").distinct())
    given = ids.join(heads, (F.col("base") == F.col("of")) & (F.col("idx") <= F.col("h"))).select("conv_id", "idx", F.col("b1").alias("h1"), F.col("b2").alias("h2"), F.col("bw").alias("words"))
    taken = ids.join(given.groupBy("conv_id").agg(F.count("*").alias("taken")), "conv_id", "left").select("conv_id", F.coalesce("taken", F.lit(0)).alias("taken"))
    placed = own.join(taken, "conv_id").withColumn("pos", F.col("idx") - F.col("h") + F.col("taken"))
    root = ids.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(-1).alias("part"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("words"))
    columns = ["conv_id", F.col("pos").cast("long").alias("pos"), F.col("part").cast("int").alias("part"), "h1", "h2", "words"]
    rows = root.unionByName(given.withColumn("pos", F.col("idx")).withColumn("part", F.lit(-1)).select(*columns)).unionByName(placed.select(*columns))

    def scrambled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, h1, h2 = (np.asarray(b.column(k)) for k in (1, 3, 4))
            x1, x2 = terms(pos, h1, h2)
            x1, x2 = (np.where(pos == 0, U64(0), x).view(np.int64) for x in (x1, x2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(x1), pa.array(x2), b.column(5)], ["conv_id", "pos", "part", "x1", "x2", "words"])

    rows = cut(rows.mapInArrow(scrambled, "conv_id long, pos long, part int, x1 long, x2 long, words long"))
    sofar = W.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carry = rows.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("c1"), F.bit_xor("x2").alias("c2"), F.max("pos").alias("top"))
    nil = F.lit(0).cast("long")
    carry = carry.select("conv_id", "part", F.coalesce(F.bit_xor("c1").over(before), nil).alias("c1"), F.coalesce(F.bit_xor("c2").over(before), nil).alias("c2"), F.max("top").over(W.partitionBy("conv_id")).alias("last"))
    keyed = rows.withColumn("r1", F.bit_xor("x1").over(sofar)).withColumn("r2", F.bit_xor("x2").over(sofar)).join(carry, ["conv_id", "part"])
    keyed = keyed.withColumn("k1", F.col("r1").bitwiseXOR(F.col("c1"))).withColumn("k2", F.col("r2").bitwiseXOR(F.col("c2")))
    ends = F.when(F.col("pos") == F.col("last"), F.array("conv_id")).otherwise(F.array().cast("array<long>"))
    return keyed.select("k1", "k2", F.col("pos").cast("int").alias("depth"), F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "words", "conv_id", F.lit(1).cast("long").alias("n"), ends.alias("ends"))


def family_nodes(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", long: int = LONG) -> DataFrame:
    """Nodes of each family's trie: keys, the parent's keys, words of the last text, smallest member, members, ids that end there."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col)]
    turn = F.col(turn_col).cast("long")
    turns = convs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), turn.isNotNull().cast("int").alias("first"), F.coalesce(turn, F.lit(0)).alias("turn"),
        F.xxhash64(*said).alias("h1"), F.xxhash64(F.lit(7), *said).alias("h2"), words(said[1]).alias("words"),
    )
    turns = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", own_turns(F.col("conv_id")))
    # Spark keeps only HEADS - 1 rows of a conversation before this shuffle
    start = W.partitionBy("conv_id").orderBy("first", "turn", "h1", "h2")
    heads = turns.where("conv_id = base").withColumn("idx", F.row_number().over(start).cast("long")).where(F.col("idx") < HEADS).select(F.col("base").alias("of"), "idx", F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("words").alias("bw"))
    far = cut(turns.groupBy("conv_id").count().where(F.col("count") > long).select("conv_id"))
    some = not far.isEmpty()
    near = turns.join(far, "conv_id", "left_anti") if some else turns
    nodes = near.groupBy("base").cogroup(heads.groupBy("of")).applyInArrow(lambda m, b: _family(m, b) if m.num_rows else _nothing(), _NODES)
    return nodes.unionByName(_long_nodes(turns.join(far, "conv_id", "left_semi"), heads)) if some else nodes


def _nothing() -> pa.Table:
    return pa.schema([*[(c, pa.int64()) for c in ("k1", "k2")], ("depth", pa.int32()), *[(c, pa.int64()) for c in ("p1", "p2", "words", "conv_id", "n")], ("ends", pa.list_(pa.int64()))]).empty_table()


def _chain_sums(chains: DataFrame, root: int) -> DataFrame:
    """(chain, leaves, saved) of each chain with all that hang on it, from (chain, up, leaves, saved); by doubling."""
    state = chains
    while not state.where("up is not null").isEmpty():
        add = state.where("up is not null").groupBy(F.col("up").alias("chain")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        # the root's chain hangs on none, so what hangs on it has no further to go
        done, go = state.where(f"up is null or up = {root}").withColumn("up", F.lit(None).cast("long")), state.where(f"up <> {root}")
        go = go.join(state.select(F.col("chain").alias("up"), F.col("up").alias("next")), "up").select("chain", F.col("next").alias("up"), "leaves", "saved")
        state = done.select("chain", "up", "leaves", "saved").unionByName(go).join(add, "chain", "left")
        state = cut(state.select("chain", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
    return state.select("chain", "leaves", "saved")


def conversation_trie(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", long: int = LONG) -> Trie:
    """The trie of all rebuilt conversations.

    Turns are ordered by turn, null first; turns of one number by a hash of role and text, so repeated rows stand side by side and
    both count. Null role or text is empty. Rows without a conversation id belong to no conversation and take no part. No rows
    give no nodes. Extra columns are ignored.
    """
    made = cut(family_nodes(convs, id_col, turn_col, role_col, text_col, long))
    merged = made.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum(F.size("ends")).cast("long").alias("n_ends"), F.first("words").alias("words"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    nodes = cut(merged)
    ends = made.select(*KEY, F.explode("ends").alias("conv_id"))
    top = nodes.where("depth = 0").select("conv_id").head()
    root = top.conv_id if top else 0
    kids = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"))
    kids = kids.agg(F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("singles"))
    core = nodes.where("n > 1 or depth = 0").join(kids, KEY, "left").na.fill(0, ["n_children", "singles"])
    core = cut(core.withColumn("leaves", F.col("singles") + (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("words")))
    # a node below a node with one member has that member too; all others' parents are in the core
    up = core.where("depth > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))

    def parented(rows: DataFrame) -> DataFrame:
        upper = rows.where("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root)).cast("long"))
        return upper.unionByName(rows.where("depth > 1").join(up, ["p1", "p2", "depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id")).select(*upper.columns))

    core = cut(parented(core))
    chains = core.groupBy(F.col("conv_id").alias("chain")).agg(F.min("depth").alias("from"), F.min_by("parent_conv_id", "depth").alias("up"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    chains = cut(chains)
    sums = _chain_sums(chains.select("chain", "up", "leaves", "saved"), root)
    hung = sums.join(chains.where("up is not null").select("chain", "up", "from"), "chain").groupBy(F.col("up").alias("conv_id"), (F.col("from") - 1).alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    core = core.join(hung, ["conv_id", "depth"], "left").withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0)))
    core = cut(core.drop("l", "s").withColumn("segment", F.floor(F.col("depth") / SEGMENT)))
    after = W.partitionBy("conv_id").orderBy(F.desc("segment")).rowsBetween(W.unboundedPreceding, -1)
    later = core.groupBy("conv_id", "segment").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    later = later.select("conv_id", "segment", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(c) for c in ("l", "s")])
    below = W.partitionBy("conv_id", "segment").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    core = core.withColumn("leaves", F.sum("leaves").over(below)).withColumn("saved", F.sum("saved").over(below)).join(later, ["conv_id", "segment"])
    whole = core.select(*KEY, "conv_id", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", (F.col("leaves") + F.col("l")).alias("n_leaves"), (F.col("saved") + F.col("s")).alias("saved_tokens"), "n_ends")
    one = parented(nodes.where("n = 1 and depth > 0"))
    one = one.select(*KEY, "conv_id", "parent_conv_id", F.col("n").alias("n_convs"), (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "n_ends")
    return Trie(whole.unionByName(one), ends)


def end_digests(trie: Trie, id_run: int = ID_RUN) -> DataFrame:
    """The trie's nodes with ends_sha256 of the ids that end there, ascending and joined by commas.

    Ids are gathered in runs of id_run possible ids, so no list is longer; a node with several runs has them read in order by
    one task, which holds a run at a time.
    """
    runs = trie.ends.groupBy(*KEY, F.floor(F.col("conv_id") / id_run).cast("long").alias("run")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    several = trie.nodes.where(F.col("n_ends") > 1).select(*KEY)
    listed = cut(runs.join(several, KEY, "left_semi"))
    count = listed.groupBy(*KEY).agg(F.count("*").alias("runs"), F.first("ids").alias("ids"))
    short = count.where("runs = 1").select(*KEY, F.sha2(F.col("ids").cast("binary"), 256).alias("d"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int32()), ("d", pa.string())])
        for b in batches:
            done = []
            for k1, k2, depth, ids in zip(*[b.column(c).to_pylist() for c in range(4)], strict=True):
                if (k1, k2, depth) != now:
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (k1, k2, depth), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema)
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*now, sha.hexdigest()), strict=True))], schema)

    many = listed.join(count.where("runs > 1").select(*KEY), KEY, "left_semi")
    many = many.repartition(*KEY).sortWithinPartitions(*KEY, "run").select(*KEY, "ids").mapInArrow(digest, "k1 long, k2 long, depth int, d string")
    own = F.when(F.col("n_ends") == 0, F.lit("")).when((F.col("n_ends") == 1) & (F.col("n_convs") == 1), F.col("conv_id").cast("string"))
    easy = trie.nodes.where("n_ends = 0 or (n_ends = 1 and n_convs = 1)").withColumn("ends_sha256", F.sha2(own.cast("binary"), 256))
    alone = trie.ends.join(trie.nodes.where("n_ends = 1 and n_convs > 1").select(*KEY), KEY, "left_semi").select(*KEY, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("d"))
    hard = trie.nodes.where("n_ends > 1 or (n_ends = 1 and n_convs > 1)").join(short.unionByName(many).unionByName(alone).withColumnRenamed("d", "ends_sha256"), KEY)
    return easy.unionByName(hard.select(*easy.columns))
