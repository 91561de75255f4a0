"""Prefix trie of conversations: a count-min sketch of prefix digests screens out the prefixes that only one conversation has.

Every prefix of a conversation has a 128-bit digest: the sum of digests of (place, role, text), so that sums over
partitions add up and a conversation of any length is digested by many tasks. A prefix whose estimate in the sketch is one
belongs to one conversation for certain (a sketch never counts too little), and its node is put out where it stands. Only
other prefixes are shuffled and grouped by digest, which is exact whatever the sketch has let through.

Nothing is summed from node to node. The smallest member of a node stands for it, and stands for all deeper nodes on its own
path, so conversation c owns the depths from `own` on. Over the members of a node, the sum of the bytes of depths that they don't
own is what its subtree saves, the number that own the next depth is its number of children, and the number that own
their last node, where no other conversation goes on, is its number of leaves. One aggregation gives all of them.

The sketch has four rows of 2-bit counters (one, more), four to eight times as many counters in a row as there are prefixes, up
to `most` (16 MB go to each task then). With more prefixes it proves fewer of them single, and more are grouped; the result
stays the same. Members that end in a node are hashed in order of id from pieces that tasks have joined, so no list of
them is ever held.

Defined results: turns are put in order of turn (nulls first), role and MD5 of the text; a null role or text is empty; rows without
conv_id are left out; repeated rows are repeated turns; extra columns are ignored; an empty table has no node, not even a root.
Remainders of negative ids have the sign of the id, as in SQL.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import group_rank, running_sums
from .tables import cut, discard, small_batches, spread_join

#: Most counters in a row of the sketch; four rows of as many bits are broadcast.
CELLS = 1 << 25
ROWS, BLOCK = 4, 1 << 20
#: Turns at most that a conversation may take from another.
HEADS = 9
PIECE = 1 << 16
NONE_SHA = hashlib.sha256(b"").hexdigest()


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


#: Stands for the digest of the prefix without turns.
ROOT = hashlib.md5(b"root").digest()


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, said, size): turns in order from place 1, digest of role and text, bytes of the text."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    ranked = group_rank(rows, "conv_id", "turn", "role", "digest", name="place")
    return ranked.select("conv_id", "place", _digest(F.md5("role"), F.col("digest")).alias("said"), "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, said, size, n), and (conv_id, n) of every conversation, turnless ones too.

    Conversation c begins with the first h turns of conversation c - c % 5, where h = crc32(c) % 9, and goes on with its own
    turns after its first h.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = sizes.select("conv_id", "own", (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("source"))
    heads = F.least("h", F.coalesce("there", F.lit(0)))
    joined = convs.join(sizes.select(F.col("conv_id").alias("source"), F.col("own").alias("there")), "source", "left")
    plan = cut(joined.select("conv_id", "h", heads.alias("k"), (heads + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "plan")
    own = spread_join(turns, plan, "conv_id", "place").where("place > h").withColumn("place", F.col("place") + F.col("k") - F.col("h"))
    given = turns.where((F.col("place") < HEADS) & (F.col("conv_id") % 5 == 0)).withColumn("to", F.explode(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda i: F.col("conv_id") + i))).where("to - to % 5 = conv_id")
    first = given.drop("conv_id").withColumnRenamed("to", "conv_id").join(plan, "conv_id").where("place <= h")
    columns = ["conv_id", "place", "said", "size", "n"]
    return own.select(columns).unionByName(first.select(columns)), plan.select("conv_id", "n")


def chains(turns: DataFrame) -> DataFrame:
    """(conv_id, place, size, n, upto, key, parent): digests of each prefix and of the one before it, bytes up to its end."""
    e = _digest(F.col("said"), F.col("place"))
    parts = {f"e{i}": F.conv(F.substring("e", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}
    rows = turns.withColumn("e", e).withColumns(parts).drop("e", "said")
    summed = running_sums(rows, "conv_id", ["place"], **{f"s{i}": F.col(f"e{i}") for i in range(4)}, upto=F.col("size"))
    key = F.unhex(_digest(F.col("place"), *[F.col(f"s{i}") for i in range(4)]))
    parent = F.unhex(_digest(F.col("place") - 1, *[F.col(f"s{i}") - F.col(f"e{i}") for i in range(4)]))
    return summed.select("conv_id", "place", "size", "n", "upto", key.alias("key"), F.when(F.col("place") == 1, F.lit(ROOT)).otherwise(parent).alias("parent"))


def _cells(keys: pa.Array, w: int) -> np.ndarray:
    """ROWS x keys counters of 16-byte digests."""
    at = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset]
    halves = np.frombuffer(keys.buffers()[2], np.uint64, 2 * len(keys), at).reshape(-1, 2)
    return np.stack([halves[:, 0] + np.uint64(r) * (halves[:, 1] | np.uint64(1)) for r in range(ROWS)]) & np.uint64(w - 1)


def _mark(bits: np.ndarray, cells: np.ndarray) -> None:
    np.bitwise_or.at(bits, cells >> np.uint64(3), np.left_shift(np.uint8(1), (cells & np.uint64(7)).astype(np.uint8)))


def _marked(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1


def width(prefixes: int, most: int = CELLS) -> int:
    return min(most, 1 << max(16, (4 * prefixes - 1).bit_length()))


def sketch(keys: DataFrame, w: int) -> list[np.ndarray]:
    """For each row of the sketch, the counters that count more than one. keys has one column of digests."""
    block = min(w, BLOCK)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more = (np.zeros((ROWS, w // 8), np.uint8) for _ in range(2))
        for batch in batches:
            if not batch.num_rows:
                continue
            for r, cells in enumerate(_cells(batch.column(0), w)):
                cells, counts = np.unique(cells, return_counts=True)
                _mark(more[r], cells[(counts > 1) | _marked(once[r], cells)])
                _mark(once[r], cells)
        for k in range(ROWS * w // block):
            a, b = (x.reshape(-1, block // 8)[k] for x in (once, more))
            if a.any():
                yield pa.RecordBatch.from_pydict({"block": [k], "once": [zlib.compress(a, 1)], "more": [zlib.compress(b, 1)]}, pa.schema([("block", pa.int32()), ("once", pa.binary()), ("more", pa.binary())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, more = None, None, None
        for batch in batches:
            for k, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in packed)
                if k != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "more": [more.tobytes()]})
                    at, once, more = k, np.zeros_like(a), np.zeros_like(a)
                more |= b | (once & a)
                once |= a
        if at is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "more": [more.tobytes()]})

    parts = keys.mapInArrow(build, "block int, once binary, more binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, more binary")
    out = np.zeros((ROWS * w // block, block // 8), np.uint8)
    for row in merged.toLocalIterator():
        out[row.block] = np.frombuffer(row.more, np.uint8)
    return list(out.reshape(ROWS, w // 8))


def screened(rows: DataFrame, most: int = CELLS) -> DataFrame:
    """chains with shared and parent_shared: false where the sketch proves that one conversation alone has the prefix."""
    spark = rows.sparkSession
    w = width(rows.count(), most)
    sent = spark.sparkContext.broadcast(sketch(rows.select("key"), w))

    def test(keys: pa.Array) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        return np.logical_and.reduce([_marked(bits, cells) for bits, cells in zip(sent.value, _cells(keys, w), strict=True)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent = batch.column("parent")
            at_root = np.asarray(pc.equal(parent, pa.scalar(ROOT, parent.type)).to_numpy(zero_copy_only=False), bool)
            flags = {"shared": test(batch.column("key")), "parent_shared": test(parent) | at_root}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v) for v in flags.values())], [*batch.schema.names, *flags])

    return rows.mapInArrow(work, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", shared boolean, parent_shared boolean")


def ends_digest(members: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): ids in order, joined by commas."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, chars = None, None, [], 0
        kinds = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("piece", pa.string())])
        for batch in batches:
            out = []
            for k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if k != key or chars > PIECE:
                    if ids:
                        out.append((key, first, ",".join(ids)))
                    key, first, ids, chars = k, c, [], 0
                ids.append(str(c))
                chars += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((key, first, ",".join(ids)), kinds.types, strict=True)], schema=kinds)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for k, piece in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(piece.encode())
                else:
                    sha.update(f",{piece}".encode())
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(("key", "ends_sha256"), map(list, zip(*out, strict=True)), strict=True)))
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [sha.hexdigest()]})

    small_batches(members.sparkSession)
    pieces = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(join, "key binary, first long, piece string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "piece").mapInArrow(digest, "key binary, ends_sha256 string")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(turns: DataFrame, lengths: DataFrame, most: int = CELLS) -> DataFrame:
    """The nodes of turns (conv_id, place, said, size, n) of conversations (conv_id, n)."""
    written = cut(chains(turns), "chains")
    rows = cut(screened(written, most), "screened")
    discard(written)
    roots = lengths.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("size"), "n", F.lit(0).cast("long").alias("upto"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"))
    single, exact = rows.where("not shared"), rows.where("shared").drop("shared", "parent_shared").unionByName(roots)

    standing = exact.groupBy("key").agg(F.min(F.struct("conv_id", F.col("place").alias("own"), (F.col("upto") - F.col("size")).alias("before"))).alias("r"), F.max("n").alias("longest")).select("r.*", (F.col("longest") == F.col("own")).cast("long").alias("leaf"))
    by_node = standing.groupBy("conv_id").agg(F.min("own").alias("own"), F.min("before").alias("before"), F.max("leaf").alias("leaf"))
    by_single = single.groupBy("conv_id").agg(F.min("place").alias("own"), F.min(F.col("upto") - F.col("size")).alias("before"), F.max((F.col("place") == F.col("n")).cast("long")).alias("leaf"))
    by_length = lengths.select("conv_id", (F.col("n") + 1).alias("own"), F.lit(None).cast("long").alias("before"), F.lit(0).cast("long").alias("leaf"))
    whole = exact.groupBy("conv_id").agg(F.lit(None).cast("long").alias("own"), F.max("upto").alias("before"), F.lit(0).cast("long").alias("leaf"))
    owners = by_node.unionByName(by_single).unionByName(by_length).unionByName(whole).groupBy("conv_id").agg(F.min("own").alias("own"), F.min("before").alias("before"), F.max("leaf").alias("leaf"))

    owned = spread_join(exact, cut(owners, "owners"), "conv_id", "place")
    child = (F.col("own") <= F.col("place") + 1) & (F.col("place") < F.col("n"))
    saved = F.greatest(F.col("before") - (F.col("upto") - F.col("size")), F.lit(0))
    nodes = owned.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("place").alias("depth"), F.max("parent").alias("parent"), F.count("*").alias("n_convs"), F.sum(child.cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    nodes = cut(nodes.join(ends_digest(exact.where("place = n")), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE_SHA))), "nodes")

    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = F.when(F.col("place") == F.col("n"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NONE_SHA))
    alone = single.select("key", "conv_id", F.col("place").alias("depth"), "parent", one.alias("n_convs"), (F.col("place") < F.col("n")).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), ends.alias("ends_sha256"), "parent_shared")
    inner = alone.where("not parent_shared").withColumn("parent_conv_id", F.col("conv_id"))
    asked = nodes.where("depth > 0").unionByName(alone.where("parent_shared").drop("parent_shared"))
    answered = spread_join(asked, nodes.select("key", F.col("conv_id").alias("above")).withColumnRenamed("key", "of"), "parent", "key", "of", "left")
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    parts = [inner, answered.withColumn("parent_conv_id", F.coalesce("above", "conv_id")), top]
    return parts[0].select(COLUMNS).unionByName(parts[1].select(COLUMNS)).unionByName(parts[2].select(COLUMNS))


def prefix_trie(conversations: DataFrame, most: int = CELLS) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = numbered(conversations)
    lengths = cut(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "lengths")
    return trie(spread_join(turns, lengths, "conv_id", "place"), lengths, most)


def op11_prefix_trie(conversations: DataFrame) -> DataFrame:
    return trie(*rebuilt(numbered(conversations)))


OP11_SQL = """
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, s, 0 AS k, CAST(4294967295 AS BIGINT) AS v FROM ids
  UNION ALL
  SELECT c, s, k + 1, CASE WHEN w & 1 = 1 THEN xor(w >> 1, CAST(3988292384 AS BIGINT)) ELSE w >> 1 END
  FROM (SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ord(s[k // 8 + 1]) AS BIGINT)) ELSE v END AS w FROM crc WHERE k < 8 * length(s))
),
heads AS (SELECT c, xor(v, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE k = 8 * length(s)),
said AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
),
parts AS (
  SELECT h.c, 0 AS own, p, role, text FROM heads h JOIN said t ON t.c = h.c - h.c % 5 AND t.p <= h.h
  UNION ALL SELECT h.c, 1, p, role, text FROM heads h JOIN said t ON t.c = h.c AND t.p > h.h
),
turns AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d FROM parts),
member AS (
  SELECT c, d, strlen(text) AS size, string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY c ORDER BY d) AS path FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM ids
),
top AS (SELECT c, max(d) AS n FROM member GROUP BY c),
node AS (SELECT path, d, min(c) AS rep, count(*) AS n_convs, max(size) AS size, max(n) AS longest FROM member JOIN top USING (c) GROUP BY path, d),
above AS (SELECT y.path AS below, y.d AS deep, m.path, m.d, y.n_convs, y.size, y.longest FROM node y JOIN member m ON m.c = y.rep AND m.d <= y.d),
sums AS (
  SELECT path, d, sum((n_convs - 1) * size) AS saved, sum(CASE WHEN longest = deep THEN 1 ELSE 0 END) AS leaves, sum(CASE WHEN deep = d + 1 THEN 1 ELSE 0 END) AS children
  FROM above GROUP BY path, d
),
ends AS (SELECT m.path, m.d, string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) AS ids FROM member m JOIN top USING (c) WHERE m.d = top.n GROUP BY m.path, m.d)
SELECT x.rep AS conv_id, CAST(x.d AS BIGINT) AS depth, up.rep AS parent_conv_id, x.n_convs, CAST(s.children AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM node x JOIN sums s ON s.path = x.path AND s.d = x.d
LEFT JOIN ends e ON e.path = x.path AND e.d = x.d
LEFT JOIN member m ON m.c = x.rep AND m.d = x.d - 1
LEFT JOIN node up ON up.path = m.path AND up.d = m.d
"""
