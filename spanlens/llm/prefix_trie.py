"""The trie of conversation prefixes, its subtree totals by leaf-peeling message passing.

A conversation's turns are numbered and its prefixes named by sums: a turn adds 120 bits of a digest of its depth, role and
text, so a prefix is its depth and a running sum, which needs no turn before it and is carried over ranges. No window holds
a whole conversation, however long it is.

Every node belongs to the path of its longest member (the smallest conv_id of equal ones), which runs from the path's top
straight to a leaf; paths are contracted for the message passing, so that a chain of a million turns is one round and not a
million. A path holds a counter of the children that branch off it. Paths whose counter is 0 send their totals to the node
they branch off, whose path counts down, until only the root's path finishes. Then sums along each path give every node's totals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table

SHARED, STEP = 9, 5
BLOCK, ID_BITS, SALTS = 4096, 12, 8

NO_ENDS = hashlib.sha256(b"").hexdigest()


def _sums_before(rows: DataFrame, key: str, at: str, sums: dict[str, Column]) -> DataFrame:
    """rows with, for each name of sums, the sum of its amount over rows of the same key with a smaller `at` (name) and over all
    of the key (name_all). Windows run over BLOCK numbers of a key and over its blocks' totals."""
    cut = rows.withColumns({f"_{c}": amount for c, amount in sums.items()} | {"_block": F.floor(F.col(at) / BLOCK)})
    totals = cut.groupBy(key, "_block").agg(*(F.sum(f"_{c}").alias(c) for c in sums))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks, whole = before(Window.partitionBy(key).orderBy("_block")), Window.partitionBy(key)
    carried = totals.select(key, "_block", *(F.sum(c).over(blocks).alias(f"{c}_carried") for c in sums), *(F.sum(c).over(whole).alias(f"{c}_all") for c in sums))
    inside = before(Window.partitionBy(key, "_block").orderBy(at))
    out = cut.select("*", *(F.sum(f"_{c}").over(inside).alias(f"{c}_inside") for c in sums)).join(carried, [key, "_block"])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*rows.columns, *((zero(F.col(f"{c}_carried")) + zero(F.col(f"{c}_inside"))).alias(c) for c in sums), *(f"{c}_all" for c in sums))


def turns_in_order(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pos (0 for the first turn), digest, bytes of the text for every turn. Turns are dealt by ranges of the order, so no task holds a long conversation."""
    filled = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    )
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    ordered = filled.select("*", F.monotonically_increasing_id().alias("tie")).repartitionByRange("conv_id", F.asc_nulls_first("turn"), "role", "text", "tie")
    ordered = ordered.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "tie")
    dealt = scratch.write(ordered.select("conv_id", F.monotonically_increasing_id().alias("seq"), F.spark_partition_id().alias("range"), digest.alias("digest"), F.octet_length("text").alias("bytes")))
    spans = dealt.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.min("seq").alias("low"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv_id", "range", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("low")).alias("shift"))
    return scratch.write(dealt.join(spans, ["conv_id", "range"]).select("conv_id", (F.col("seq") + F.col("shift")).alias("pos"), "digest", "bytes"))


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (conv_id, n_turns) and their turns (conv_id, depth from 1, digest, bytes)."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = (F.col("conv_id") - F.col("conv_id") % STEP).alias("base")
    own = sizes.select("conv_id", "n", base, (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("h"))
    shared = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    shared = own.join(shared, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = scratch.write(shared.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))

    heads = turns.where(F.col("pos") < SHARED - 1).withColumnRenamed("conv_id", "base").join(plan.select("conv_id", "base", "k"), "base").where("pos < k")
    tails = turns.join(plan.select("conv_id", "h", "k"), "conv_id").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("k"))
    both = heads.select("conv_id", "pos", "digest", "bytes").unionByName(tails.select("conv_id", "pos", "digest", "bytes"))
    return plan.select("conv_id", "n_turns"), both.select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "bytes")


def _prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each conversation and depth: conv_id, n_turns, depth, bytes, node and the node above it (up)."""
    keyed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "digest"), 256)
    part = lambda i: F.conv(F.substring("keyed", i, 15), 16, 10).cast("decimal(38,0)")
    rows = turns.select("conv_id", "depth", "bytes", keyed.alias("keyed")).select("conv_id", "depth", "bytes", part(1).alias("x"), part(16).alias("y"))
    summed = _sums_before(rows, "conv_id", "depth", {"a": F.col("x"), "b": F.col("y")})
    name = lambda depth, a, b: F.concat_ws(":", depth, a, b)
    node, up = name(F.col("depth"), F.col("a") + F.col("x"), F.col("b") + F.col("y")), name(F.col("depth") - 1, F.col("a"), F.col("b"))
    below = summed.select("conv_id", "depth", "bytes", node.alias("node"), up.alias("up")).join(convs, "conv_id")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).alias("bytes"), F.lit("0:0:0").alias("node"), F.lit(None).cast("string").alias("up"), "n_turns")
    return below.unionByName(root)


def _nodes(prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """node, up, depth, conv_id, n_convs, n_children, path, own (tokens it saves), up_conv, up_path."""
    by_node = prefixes.groupBy("node").agg(
        F.first("up").alias("up"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.max(F.struct("n_turns", (-F.col("conv_id")).alias("back"))).alias("longest"), ((F.count("*") - 1) * F.first("bytes")).alias("own"),
    )
    found = scratch.write(by_node.select("node", "up", "depth", "conv_id", "n_convs", "own", (-F.col("longest.back")).alias("path"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")))
    children = found.groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"))
    above = found.select(F.col("node").alias("up"), F.col("conv_id").alias("up_conv"), F.col("path").alias("up_path"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    linked = found.join(above, ["up", "salt"], "left").drop("salt").join(children, "node", "left")
    return scratch.write(linked.withColumn("n_children", F.coalesce("n_children", F.lit(0))))


def _peel(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """What each node gets from the paths that branch off it: node, leaves, saved. A round finishes the paths whose counter is 0."""
    tops = nodes.where("up IS NULL OR path <> up_path")
    own = nodes.groupBy("path").agg(F.sum("own").alias("saved"))
    counters = tops.groupBy(F.col("up_path").alias("path")).agg(F.count("*").alias("waiting"))
    state = tops.select("path", "up", "up_path").join(own, "path").join(counters, "path", "left")
    state = scratch.write(state.select("path", "up", "up_path", F.lit(1).cast("long").alias("leaves"), "saved", F.coalesce("waiting", F.lit(0)).alias("waiting")))
    got = None
    while not state.isEmpty():
        sent = scratch.write(state.where("waiting = 0 AND up IS NOT NULL").select("up", "up_path", "leaves", "saved"))
        got = sent if got is None else got.unionByName(sent)
        news = sent.groupBy(F.col("up_path").alias("path")).agg(F.count("*").alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        after = state.where("waiting > 0").join(news, "path", "left").select(
            "path", "up", "up_path", *((F.col(c) + zero(m)).alias(c) for c, m in (("leaves", "more_leaves"), ("saved", "more_saved"))), (F.col("waiting") - zero("n")).alias("waiting")
        )
        before, state = state, scratch.write(after)
        scratch.drop(before)
    got = nodes.sparkSession.createDataFrame([], "up string, up_path long, leaves long, saved long") if got is None else got
    return got.groupBy(F.col("up").alias("node")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A SHA-256 for each node of its parts in turn, which come sorted; a node's list is never held whole."""
    now, running, first = None, None, True
    made = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([running.hexdigest()])], ["node", "ends_sha256"])
    for batch in batches:
        for node, part in zip(batch.column("node").to_pylist(), batch.column("ids")):
            if node != now:
                if now is not None:
                    yield made()
                now, running, first = node, hashlib.sha256(), True
            running.update(part.as_buffer() if first else b"," + part.as_buffer().to_pybytes())
            first = False
    if now is not None:
        yield made()


def _ends(prefixes: DataFrame) -> DataFrame:
    """node, ends_sha256 for nodes where conversations end: ids are sorted and joined in ranges, then digested range by range."""
    ends = prefixes.where("depth = n_turns").groupBy("node", F.shiftright("conv_id", ID_BITS).alias("part"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = ends.agg(ids.alias("ids")).repartition("node").sortWithinPartitions("node", "part")
    return parts.select("node", "ids").mapInArrow(_digest, "node string, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie, as op12 describes it, from conversations (conv_id, turn, role, text and any other columns).

    Equal turns of a conversation follow in the order of role and text; repeated rows are turns of their own. Rows without a
    conv_id belong to no conversation. An empty table has no root."""
    spark, scratch = conversations.sparkSession, Scratch(conversations.sparkSession, "trie")
    small_batches(spark)
    convs, turns = rebuilt(turns_in_order(conversations, scratch), scratch)
    prefixes = scratch.write(_prefixes(convs, turns))
    nodes = _nodes(prefixes, scratch)
    news = nodes.join(_peel(nodes, scratch), "node", "left")
    totals = _sums_before(news, "path", "depth", {"leaves_before": F.coalesce("leaves", F.lit(0)), "saved_before": F.col("own") + F.coalesce("saved", F.lit(0))})
    return totals.join(_ends(prefixes), "node", "left").select(
        "conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves_before_all") - F.col("leaves_before") + 1).alias("n_leaves"),
        (F.col("saved_before_all") - F.col("saved_before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations with each node's members, children, leaves and saved bytes.
    Null role and text are empty, a null turn comes first, rows without conv_id count nowhere; an empty table gives no rows."""
    return trie(table(spark, sf_dir, "conversations"))


OP12_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS n,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 9 AS h
  FROM turns GROUP BY conv_id
),
plan AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS k, least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) AS n_turns FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
rebuilt AS (
  SELECT p.conv_id, t.pos + 1 AS depth, t.role, t.text FROM plan p JOIN turns t ON t.conv_id = p.base AND t.pos < p.k
  UNION ALL SELECT p.conv_id, t.pos - p.h + p.k + 1, t.role, t.text FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND t.pos >= p.h
),
named AS (
  SELECT conv_id, depth, strlen(text) AS bytes, sha256(string_agg(sha256(strlen(role) || ':' || role || text), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM plan
),
above AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM named),
nodes AS (SELECT node, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own FROM above GROUP BY node),
children AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
subtrees AS (
  SELECT a.node, sum(own) AS saved_tokens, count(*) FILTER (c.n_children IS NULL) AS n_leaves
  FROM nodes n JOIN named a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN children c ON c.node = n.node GROUP BY a.node
),
ends AS (SELECT a.node, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS ends_sha256 FROM named a JOIN plan p ON p.conv_id = a.conv_id AND p.n_turns = a.depth GROUP BY a.node)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
       coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes u ON u.node = n.up LEFT JOIN children c ON c.node = n.node JOIN subtrees s ON s.node = n.node LEFT JOIN ends e ON e.node = n.node
"""
