"""The prefix trie of conversations: adaptive radix trees over ranges of byte keys, merged where ranges share a prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, key_join
from .radix import Node, Tree

#: Bytes of a turn's id.
WIDTH = 16
#: Bytes of keys in one range, about; a tree takes some ten times as much.
RANGE_BYTES = 4 << 20
#: Conversation ids in one piece of a list of ids.
PIECE = 512
EMPTY = hashlib.sha256(b"").hexdigest()

_NODES = "depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_conv_id long, open binary, up binary"


def turn_id(role: Column, text: Column) -> Column:
    """WIDTH bytes for each different (role, text): the head of a SHA-256, read as a big-endian number."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id long, turns array<struct<id, words>>): the turns of each conversation in order of turn, null first; equal ones by id."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    flat = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).isNotNull().alias("_told"), F.coalesce(F.col(turn), F.lit(0)).alias("_turn"), turn_id(F.col(role), F.col(text)).alias("id"), words.alias("words")
    )
    listed = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_told", "_turn", "id", "words"))).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("turns"))


def regrown(own: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations with new heads, (conv_id, turns): the first h turns of conversation conv_id - conv_id % family, then their own after
    their first h, where h = crc32(decimal conv_id) % most. Of a head of fewer turns all are taken, of an absent one none."""
    heads = own.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % family).join(heads, "_base", "left")
    head = F.when(F.col("_head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("_head", F.lit(1), h))
    return both.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def _ends(members: DataFrame) -> DataFrame:
    """(key, words, first, n, ends) of each different key: smallest conv_id, number, and SHA-256 of all conv_ids in order, comma-joined.

    Ids are listed in pieces of consecutive numbers; what has more than one piece is hashed piece after piece as its rows stream by.
    """
    pieces = members.groupBy("key", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(F.first("words").alias("words"), F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = durable(pieces.select("key", "piece", "words", F.col("ids")[0].alias("first"), F.size("ids").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("text")))
    whole = pieces.groupBy("key").agg(F.first("words").alias("words"), F.min("first").alias("first"), F.sum("n").alias("n"), F.count("*").alias("pieces"), F.min(F.when(F.col("piece") == F.floor(F.col("first") / PIECE), F.sha2("text", 256))).alias("one"))
    whole = durable(whole)
    several = whole.filter("pieces > 1").select("key")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                if key != at:
                    if h is not None:
                        yield pa.RecordBatch.from_pydict({"key": [at], "ends": [h.hexdigest()]})
                    at, h = key, hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
        if h is not None:
            yield pa.RecordBatch.from_pydict({"key": [at], "ends": [h.hexdigest()]})

    streamed = pieces.select("key", "piece", "text").join(several, "key", "left_semi").repartition("key").sortWithinPartitions("key", "piece").mapInArrow(hashed, "key binary, ends string")
    return whole.join(streamed, "key", "left").select("key", "words", "first", "n", F.coalesce("ends", "one").alias("ends"))


class _Range:
    """The trie nodes of one range of keys. before and after: turns that the keys on either side share with its first and last key."""

    def __init__(self, rows: list[tuple[bytes, list[int], int, int, str]], before: int, after: int):
        self.rows, self.before, self.after = rows, before, after
        tree = Tree()
        for no, row in enumerate(rows):
            tree.insert(row[0], no)
        # nodes with the bytes before and behind each, parents first
        self.order: list[tuple[Node, int, int, int]] = []
        stack: list[tuple[Node, int, int]] = [(tree.root, -1, 0)]  # type: ignore[list-item]
        while stack:
            node, above, start = stack.pop()
            end = start + len(node.prefix)
            stack += [(k, len(self.order), end + 1) for k in node.children()]
            self.order.append((node, above, start, end))

    def nodes(self) -> Iterator[tuple]:
        size, rows = len(self.order), self.rows
        n, low = [0] * size, [2**63] * size
        first, last = [len(rows)] * size, [-1] * size
        for at in range(size - 1, -1, -1):  # children first
            node, above, _, _ = self.order[at]
            if node.value >= 0:
                n[at] += rows[node.value][3]
                low[at] = min(low[at], rows[node.value][2])
                first[at], last[at] = min(first[at], node.value), max(last[at], node.value)
            if above >= 0:
                n[above] += n[at]
                low[above] = min(low[above], low[at])
                first[above], last[above] = min(first[above], first[at]), max(last[above], last[at])
        # the depths in whole turns that lie on the edge into each node, its end included
        edge = [range(-(-start // WIDTH), end // WIDTH + 1) for _, _, start, end in self.order]
        state: list[tuple] = [()] * size  # hash of the path so far, and the conv_id and name of what is above
        names: list[list[tuple]] = [[] for _ in range(size)]
        for at in range(size):
            above = self.order[at][1]
            h, up, up_name = state[above] if above >= 0 else (hashlib.sha256(), None, None)
            h, key = h.copy(), rows[first[at]][0]
            for d in edge[at]:
                name = None
                if first[at] == 0 and d <= self.before or last[at] == len(rows) - 1 and d <= self.after:  # in several ranges
                    h.update(key[max(d - 1, 0) * WIDTH : d * WIDTH])
                    name = h.copy().digest()
                names[at].append((name, up, up_name))
                up, up_name = low[at], name
            state[at] = (h, up, up_name)
        # children first again: what lies below each node
        kids, leaves, saved = [0] * size, [0] * size, [0] * size
        for at in range(size - 1, -1, -1):
            node, above, start, end = self.order[at]
            words = rows[first[at]][1]
            ends = EMPTY
            if node.value >= 0:
                ends = rows[node.value][4]
                leaves[at] += kids[at] == 0 and not (node.value == len(rows) - 1 and self.after * WIDTH >= end)
            for d in reversed(edge[at]):
                old = first[at] == 0 and d <= self.before  # counted in the range before
                name, up, up_name = names[at][d - edge[at].start]
                if d:
                    saved[at] += (n[at] - (not old)) * words[d - 1]
                yield d, low[at], n[at], kids[at], leaves[at], saved[at], ends if d * WIDTH == end else EMPTY, None if up_name is not None else up, name, up_name
                kids[at] = 0 if old else 1
            if above >= 0:
                kids[above] += kids[at]
                leaves[above] += leaves[at]
                saved[above] += saved[at]


def prefix_trie(members: DataFrame) -> DataFrame:
    """One row per different prefix of the sequences of members (conv_id, turns array<struct<id binary, words int>>):
    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), all numbers long.

    A node is named by its smallest member's conv_id and its depth in turns; the root has depth 0 and no parent. n_convs are its members,
    n_leaves the childless nodes of its subtree (itself included), saved_tokens the sum over its subtree of (n_convs - 1) times the words of
    a node's last turn, ends_sha256 the SHA-256 of the decimal conv_ids that end there, in numeric order, comma-joined.

    Keys are the turn ids one after another. Equal sequences are one key; keys are dealt into ranges of equal size, each of which one
    task puts into an adaptive radix tree. Every sum over a subtree is a sum over its keys, or over nodes that are counted where they
    appear first, so that only nodes whose keys lie in several ranges (those on the common path of two neighbours) are summed up
    again. A sequence has to fit into a task by its ids, not by its texts. conv_id must not be null or repeated. An empty table gives
    an empty result.
    """
    keyed = members.select("conv_id", F.array_join(F.transform("turns", lambda x: F.hex(x["id"])), "").alias("_hex"), F.col("turns.words").alias("words"))
    keys = durable(_ends(keyed.select("conv_id", F.unhex("_hex").alias("key"), "words")))
    spark = members.sparkSession
    total = keys.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_BYTES)
    dealt = durable(keys.repartitionByRange(ranges, "key").sortWithinPartitions("key"))
    # a number of shared turns on either side of each range
    side = Window.orderBy("part")
    bounds = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("least"), F.max("key").alias("most"))
    bounds = bounds.select("part", "least", F.lag("most").over(side).alias("before"))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column("least").to_pylist(), b.column("before").to_pylist(), strict=True):
                n = 0
                while y is not None and n < min(len(x), len(y)) and x[n : n + WIDTH] == y[n : n + WIDTH]:
                    n += WIDTH
                out.append(-1 if y is None else n // WIDTH)
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(out, pa.int32())], names=["part", "shared"])

    # one pair of numbers a range, so bounded by the number of partitions
    met = sorted((r["part"], r["shared"]) for r in bounds.mapInArrow(shared, "part int, shared int").collect())
    beside = {part: (n, met[no + 1][1] if no + 1 < len(met) else -1) for no, (part, n) in enumerate(met)}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "words", "first", "n", "ends")), strict=True)]
        if not rows:
            return
        out, names = [], [x.split()[0] for x in _NODES.split(", ")]
        schema = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in _NODES.split(", ")])
        for node in _Range(rows, *beside[TaskContext.get().partitionId()]).nodes():
            out.append(node)
            if len(out) == 20_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out], schema=schema)

    nodes = durable(dealt.mapInArrow(build, _NODES))
    merged = nodes.filter("open IS NOT NULL").groupBy("open").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce(F.max(F.when(F.col("ends_sha256") != EMPTY, F.col("ends_sha256"))), F.lit(EMPTY)).alias("ends_sha256"), F.max("parent_conv_id").alias("parent_conv_id"), F.first("up").alias("up"),
    )
    merged = durable(merged)
    columns = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent_conv_id", "up"]
    every = nodes.filter("open IS NULL").select(*columns).unionByName(merged.select(*columns))
    named = key_join(every, durable(merged.select(F.col("open").alias("up"), F.col("conv_id").alias("_parent"))), "up", "left")
    return named.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.coalesce("_parent", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )


def conversation_trie(turns: DataFrame) -> DataFrame:
    """prefix_trie of all conversations of a table (conv_id, turn, role, text), each with its head regrown.

    Null role or text counts as empty; rows with a null conv_id belong to no conversation; turns of equal number (repeated rows too) stand
    in the order of their ids; other columns are ignored; an empty table gives an empty result.
    """
    return prefix_trie(regrown(durable(sequences(turns))))
