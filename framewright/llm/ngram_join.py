"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, joined on prefix n-grams.

A document's set holds the 64-bit hashes of its distinct k-word shingles. Documents with equal sets are one class; only
one of each class is joined, so copies never become pairs. Shingles are ordered by a frequency sketch of the whole
corpus (rare first), and classes meet on the shingles of their prefixes:

- length filter: percent * |x| <= 100 * |y| for the larger x;
- positional filter: the overlap still possible from the common shingle on reaches the overlap needed;
- suffix filter: each set is cut into hash ranges and keeps one bit a range, the parity of its shingles there. Ranges whose
  parities differ hold a shingle of only one of the two sets, so their number bounds the overlap from above;
- verification: exact intersection of the two sets, once per pair.

Components are found in three turns, each between what is not tied yet: every class with the first class on most of its
shingles, every class with its nearest by parities, then all pairs that are left. A shingle's classes are compared as
blocks inside tasks, and only pairs that pass all filters leave a task. `class_links` gives all links instead.

Defined results: a null or wordless text has an empty set and links with nothing; fewer words than k form one shingle;
a null doc_id links with nothing and gets a null component; rows that repeat a doc_id are one node with several texts;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import repeat_filter as R
from . import textops as X
from .components import components
from ..operators.ranks import group_rank
from .tables import cut, discard, scratch, sent_if_few, spread_join

#: Counters of the frequency sketch. It only orders shingles, so collisions cost speed, never links.
SKETCH = 1 << 16
#: Hash ranges of the smallest set; larger sets have at least RANGES_EACH for each shingle, a power of two in all.
RANGES, RANGES_EACH = 2048, 4
#: Bytes of the coarse parities that go with every posting.
COARSE = 64
#: Classes of one shingle that are compared as one block; postings that one group gets, and those with whole parities.
BLOCK, TASK_ROWS, PARITY_ROWS = 1024, 50_000, 5_000
NEAREST_ROUNDS = 3
#: Class names (16 bytes, and a component) that are broadcast at most.
FEW_NAMES = 500_000
#: Pairs, and bytes of their parities, that a task holds at once.
PAIRS, PAIR_BYTES = 1 << 14, 4 << 20


def _sets(column: pa.Array, k: int, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, hashes): each row's distinct shingles in ascending order."""
    for row, end, data, offsets in X.pieces(column):
        starts, ends, rows = X.word_spans(data, offsets)
        words = X.word_hashes(data, starts, ends, lower)
        at, hashes = X.windows(words, rows, k)
        owner = rows[at]
        counts = np.bincount(rows, minlength=end - row)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            first = np.searchsorted(rows, short)
            owner = np.concatenate([owner, short])
            hashes = np.concatenate([hashes, X.mix(X.span_hash(words, first, first + counts[short]) ^ np.uint64(0x5DEECE66D))])
            order = np.argsort(owner, kind="stable")
            owner, hashes = owner[order], hashes[order]
        edges = np.searchsorted(owner, np.arange(end - row + 1))
        parts = [np.unique(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        sizes = np.array([len(p) for p in parts], np.int64)
        yield row, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(parts) if parts else hashes


def frequency_sketch(docs: DataFrame, text: str, k: int, lower: bool) -> np.ndarray:
    """How many sets hold a shingle of each of SKETCH hash buckets; summed over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, _, hashes in _sets(batch.column(0), k, lower):
                total += np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    rows = docs.select(F.col(text)).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    sketch = np.zeros(SKETCH, np.int64)
    sketch[rows["bucket"]] = rows["n"]
    return sketch


def parities(hashes: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """For each set, one bit for every hash range: is its number of shingles there odd? Ranges grow with the set."""
    sizes = np.diff(edges)
    wide = np.maximum(RANGES, 2 ** np.ceil(np.log2(np.maximum(1, sizes * RANGES_EACH)))).astype(np.int64)
    out: list[bytes] = [b""] * len(sizes)
    for ranges in np.unique(wide):
        of = np.flatnonzero(wide == ranges)
        for part in np.array_split(of, max(1, len(of) * int(ranges) // (1 << 21))):
            odd = np.zeros((len(part), ranges), bool)
            row = np.repeat(np.arange(len(part)), sizes[part])
            at = np.repeat(edges[part] - np.cumsum(sizes[part]) + sizes[part], sizes[part]) + np.arange(len(row))
            keys, n = np.unique(row * ranges + (hashes[at] & np.uint64(ranges - 1)).astype(np.int64), return_counts=True)
            odd.ravel()[keys[n % 2 == 1]] = True
            packed = np.packbits(odd, axis=1, bitorder="little")
            for i, x in zip(part, packed, strict=True):
                out[i] = x.tobytes()
    return out


def signatures(docs: DataFrame, doc_id: str, text: str, k: int, percent: int, lower: bool) -> DataFrame:
    """(doc_id, n, fp, prefix, parity, coarse) of every row: set size, 128-bit fingerprint, rare-first prefix, range parities."""
    sketch = frequency_sketch(docs, text, k, lower)
    level = docs.sparkSession.sparkContext.broadcast(np.minimum(255, 8 * np.log2(sketch + 1)).astype(np.uint64) << np.uint64(56))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, prefix, parity, coarse = [], [], [], [], []
            for _, edges, hashes in _sets(batch.column(1), k, lower):
                keys = level.value[(hashes & np.uint64(SKETCH - 1)).astype(np.int64)] | hashes >> np.uint64(8)
                other = X.mix(hashes)
                odd = parities(other, edges)
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    n.append(b - a)
                    if a == b:
                        fp.append(None), prefix.append(None), parity.append(None), coarse.append(None)
                        continue
                    fp.append(np.array([hashes[a:b].sum(), other[a:b].sum() ^ np.uint64(b - a)], np.uint64).tobytes())
                    least = -(-percent * int(b - a) // 100)
                    prefix.append(np.sort(keys[a:b])[: b - a - least + 1].tobytes())
                    parity.append(odd[i])
                    coarse.append(_folded(odd[i], COARSE).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(prefix, pa.binary()), pa.array(parity, pa.binary()), pa.array(coarse, pa.binary())], ["doc_id", "n", "fp", "prefix", "parity", "coarse"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(sign, "doc_id long, n long, fp binary, prefix binary, parity binary, coarse binary")


def _class_number(fp: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in fp), np.int64)


MET = "gram long, fp binary, n long, pos long, rep long, coarse binary"


def shared_postings(classes: DataFrame) -> DataFrame:
    """(gram, fp, n, pos, rep, coarse): postings of shingles in two prefixes or more.

    Which shingles these are is found on packed hashes, so that shingles of one class never become rows.
    """
    splits = R.splits(classes.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0)
    rows = classes.select("fp", "n", "rep", "coarse", "prefix")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = R.Blocks(splits, R.SHARED)
        for batch in batches:
            grams = [np.frombuffer(x, np.uint64) for x in batch.column(4).to_pylist()]
            if grams:
                yield from blocks.add(X.mix(np.concatenate(grams)), np.repeat(_class_number(batch.column(0).to_pylist()), [len(g) for g in grams]))
        yield from blocks.end()

    @F.arrow_udf(LongType())
    def bucket(fp: pa.Array) -> pa.Array:
        return pa.array(R.bucket_of(_class_number(fp.to_pylist()), splits))

    def spread(rows: pa.Table, found: pa.Table) -> pa.Table:
        known, fp = R.known_keys(found), rows.column("fp").combine_chunks()
        grams = [np.frombuffer(x, np.int64) for x in rows.column("prefix").to_pylist()]
        sizes = np.array([len(g) for g in grams], np.int64)
        row = np.repeat(np.arange(len(grams)), sizes)
        gram = np.concatenate(grams) if grams else row
        keep = np.flatnonzero(R.among(R.answer_keys(X.mix(gram.view(np.uint64)), _class_number(fp.to_pylist())[row]), known)) if len(row) else row
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        pick = pa.array(row[keep], pa.int64())
        return pa.table({"gram": pa.array(gram[keep], pa.int64()), "fp": fp.take(pick), "n": rows.column("n").combine_chunks().take(pick), "pos": pa.array(place[keep], pa.int64()), "rep": rows.column("rep").combine_chunks().take(pick), "coarse": rows.column("coarse").combine_chunks().take(pick)})

    replies = R.answers(rows.mapInArrow(send, R.ASK), splits, splits, R.SHARED)
    dealt = rows.withColumn("bucket", bucket("fp")).groupBy("bucket")
    return cut(dealt.cogroup(replies.groupBy("bucket")).applyInArrow(spread, MET), "postings")


def _reach(n: np.ndarray, pos: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Length and positional filter of rows x and y that meet on a shingle."""
    need = np.ceil(percent * (n[x] + n[y]) / (100.0 + percent) - 1e-9)
    return (percent * np.maximum(n[x], n[y]) <= 100 * np.minimum(n[x], n[y])) & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need)


def _numbers(fp: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """16-byte names as two numbers."""
    both = np.frombuffer(b"".join(fp.to_pylist()), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _classes_of(fp: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct class, and which class every row has."""
    x, y = _numbers(fp)
    order = np.lexsort((y, x))
    new = np.append(True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1]))
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at


class _Grams:
    """How the postings of each shingle are dealt over tasks: together, or those of a frequent one in blocks.

    The largest component of a frequent shingle has blocks of its own, which never meet each other.
    """

    def __init__(self, met: DataFrame):
        self.met = met
        counts = met.groupBy("gram").agg(F.count("*").alias("total"))
        self.frequent = cut(counts.where(F.col("total") > BLOCK), "frequent")
        self.tasks = max(1, -(-met.count() // TASK_ROWS))

    def first(self) -> DataFrame:
        """(gram, fp_, n_, pos_) of the first class of each frequent shingle."""
        rows = self.met.join(sent_if_few(self.frequent.select("gram")), "gram", "left_semi")
        return cut(rows.groupBy("gram").agg(F.min(F.struct("n", "fp", "pos")).alias("f")).select("gram", F.col("f.fp").alias("fp_"), F.col("f.n").alias("n_"), F.col("f.pos").alias("pos_")), "first")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """rows (gram, fp, n, pos, rep) with the two blocks i, j that meet, the own one, and their task."""
        some = rows.join(sent_if_few(self.frequent.select("gram")), "gram", "left_semi")
        sides = some.groupBy("gram", "rep").agg(F.count("*").alias("c")).groupBy("gram").agg(F.sum("c").alias("total"), F.max(F.struct("c", "rep")).alias("most"))
        others = F.ceil((F.col("total") - F.col("most.c")) / BLOCK)
        sides = cut(sides.select(F.col("gram").alias("_gram"), F.col("most.rep").alias("top"), others.alias("others"), F.ceil(F.col("most.c") / BLOCK).alias("tops")).where("others > 0"), "sides")
        joined = rows.join(sent_if_few(sides), F.col("gram") == F.col("_gram"), "left")
        if self.frequent.isEmpty():
            whole = rows
        else:
            # a frequent shingle of a single component meets nothing
            whole = joined.where("_gram is null").join(sent_if_few(self.frequent.select("gram")), "gram", "left_anti")
        zero = F.lit(0).cast("long")
        place = F.xxhash64("fp")
        own = F.when(F.col("rep") == F.col("top"), F.col("others") + F.pmod(place, F.col("tops"))).otherwise(F.pmod(place, F.col("others")))
        last = F.when(F.col("own") < F.col("others"), F.col("others") + F.col("tops")).otherwise(F.col("others")) - 1
        split = joined.where("_gram is not null").withColumn("own", own).withColumn("other", F.explode(F.sequence(zero, last)))
        split = split.select(*rows.columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        every = whole.select(*rows.columns, zero.alias("own"), zero.alias("i"), zero.alias("j")).union(split)
        return every.withColumn("bucket", F.pmod(F.xxhash64("gram", "i", "j"), F.lit(self.tasks)))


def with_first(grams: _Grams, percent: int) -> DataFrame:
    """(a, b, n, m): each class with the one class that comes first on most of its shingles; at most one row a class."""

    def lead(rows: pa.Table) -> pa.Table:
        gram, n, pos = (np.asarray(rows.column(c)) for c in ("gram", "n", "pos"))
        members, at = _classes_of(rows.column("fp"))
        order = np.lexsort((at, n, gram))
        starts, ends = X.runs(gram[order])
        first = np.empty(len(order), np.int64)
        first[order] = order[np.repeat(starts, ends - starts)]
        row = np.flatnonzero((at != at[first]) & _reach(n, pos, np.arange(len(n)), first, percent))
        pair, c = np.unique(at[row] * len(members) + at[first[row]], return_counts=True)
        x, y = members[pair // len(members)], members[pair % len(members)]
        fp = rows.column("fp").combine_chunks()
        return pa.table({"fp": fp.take(pa.array(x)), "n": n[x], "fp_": fp.take(pa.array(y)), "n_": n[y], "c": c})

    met, percent_ = grams.met, F.lit(percent)
    led = met
    if not grams.frequent.isEmpty():
        led = met.join(sent_if_few(grams.frequent.select("gram")), "gram", "left_anti")
    led = led.select("gram", "fp", "n", "pos").withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(grams.tasks))).groupBy("bucket").applyInArrow(lead, "fp binary, n long, fp_ binary, n_ long, c long")
    often = met.join(sent_if_few(grams.first()), "gram").where("fp <> fp_")
    need = F.ceil(percent * (F.col("n") + F.col("n_")) / F.lit(100.0 + percent) - 1e-9)
    often = often.where((F.greatest("n", "n_") * percent_ <= F.least("n", "n_") * 100) & (F.least(F.col("n") - F.col("pos"), F.col("n_") - F.col("pos_")) >= need)).select("fp", "n", "fp_", "n_", F.lit(1).cast("long").alias("c"))
    counted = led.union(often).groupBy("fp", "n", "fp_", "n_").agg(F.sum("c").alias("c"))
    best = counted.groupBy("fp", "n").agg(F.max(F.struct("c", "fp_", "n_")).alias("best")).select("fp", "n", "best.fp_", "best.n_")
    return best.select(F.least("fp", "fp_").alias("a"), F.greatest("fp", "fp_").alias("b"), F.least("n", "n_").alias("n"), F.greatest("n", "n_").alias("m")).distinct()


def _folded(parity: bytes, size: int) -> np.ndarray:
    """Parities of fewer ranges: a range of the smaller number is the sum of several of the larger."""
    return np.bitwise_xor.reduce(np.frombuffer(parity, np.uint64).reshape(-1, size // 8), 0)


def least_apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """At least so many shingles are in only one of the two sets of each pair."""
    sizes = np.array([min(len(p), len(q)) for p, q in zip(x, y, strict=True)], np.int64)
    out = np.zeros(len(sizes), np.int64)
    for size in np.unique(sizes):
        of = np.flatnonzero(sizes == size)
        for some in np.array_split(of, -(-len(of) * int(size) // PAIR_BYTES)):
            p, q = (np.stack([_folded(v[i], int(size)) for i in some]) for v in (x, y))
            out[some] = np.bitwise_count(p ^ q).sum(1, dtype=np.int64)
    return out


def _most_apart(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return n + m - 2 * np.ceil(percent * (n + m) / (100.0 + percent) - 1e-9).astype(np.int64)


def _parities(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, parity) of the wanted classes (fp)."""
    return classes.select("fp", "parity").join(sent_if_few(wanted, FEW_NAMES), "fp", "left_semi")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that pass the suffix filter."""
    pairs = cut(pairs, "met")
    parity = _parities(classes, cut(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "wanted"))
    both = spread_join(spread_join(pairs, parity.toDF("a", "pa"), "a", "b"), parity.toDF("b", "pb"), "b", "a")

    @F.arrow_udf("boolean")
    def near(n: pa.Array, m: pa.Array, p: pa.Array, q: pa.Array) -> pa.Array:
        return pa.array(least_apart(p.to_pylist(), q.to_pylist()) <= _most_apart(np.asarray(n), np.asarray(m), percent))

    return both.where(near("n", "m", "pa", "pb")).select("a", "b")


def _pairs_in_order(key: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of equal keys, PAIRS or so at once, from rows ordered by key and own: within a block (i = j), or across two."""
    starts, ends = X.runs(key)
    end = np.repeat(ends, ends - starts)
    middle = np.repeat(starts + np.add.reduceat((own == i).astype(np.int64), starts), ends - starts) if len(key) else end
    row = np.arange(len(key))
    first = np.where(i == j, row + 1, middle)
    n = np.where((i == j) | (own == i), end - first, 0)
    done = np.cumsum(n)
    a = 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + PAIRS, "right")))
        x = np.repeat(row[a:b], n[a:b])
        yield x, first[x] + np.arange(len(x)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
        a = b


def _in_blocks(rows: pa.Table) -> pa.Table:
    order = np.lexsort(tuple(np.asarray(rows.column(c)) for c in ("own", "j", "i", "gram")))
    return rows.take(pa.array(order)).combine_chunks()


def _columns(rows: pa.Table) -> tuple[np.ndarray, ...]:
    gram, i, j, own, rep, n, pos = (np.asarray(rows.column(c)) for c in ("gram", "i", "j", "own", "rep", "n", "pos"))
    key = np.cumsum(np.append(True, (gram[1:] != gram[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    return key, own, i, j, rep, n, pos


def _with_partner(rows: pa.Table, percent: int) -> pa.Table:
    """The rows that some row of another component can reach."""
    rows = _in_blocks(rows)
    key, own, i, j, rep, n, pos = _columns(rows)
    coarse = np.frombuffer(b"".join(rows.column("coarse").to_pylist()), np.uint64).reshape(-1, COARSE // 8)
    keep = np.zeros(len(n), bool)
    for x, y in _pairs_in_order(key, own, i, j):
        ok = (rep[x] != rep[y]) & _reach(n, pos, x, y, percent)
        x, y = x[ok], y[ok]
        ok = np.bitwise_count(coarse[x] ^ coarse[y]).sum(1, dtype=np.int64) <= _most_apart(n[x], n[y], percent)
        keep[x[ok]] = keep[y[ok]] = True
    return rows.filter(pa.array(keep)).drop_columns(["bucket", "coarse"])


def _compare(rows: pa.Table, percent: int, nearest: bool) -> pa.Table:
    """Pairs of different components that pass all filters (pair true), distinct in this task.

    With nearest, only the best one of each class, and the rows (pair false) that have others besides.
    """
    members, at = _classes_of(rows.column("fp"))
    parity = rows.column("parity").take(pa.array(members)).to_pylist()
    order = np.lexsort(tuple(np.asarray(rows.column(c)) for c in ("own", "j", "i", "gram")))
    rows = _in_blocks(rows.drop_columns(["parity"]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    members, at = place[members], at[order]
    key, own, i, j, rep, n, pos = _columns(rows)
    base, wide = np.stack([_folded(p, RANGES // 8) for p in parity]), np.array([len(p) for p in parity]) > RANGES // 8
    found = [(at[:0],) * 3]
    open_ = np.zeros(len(n), bool)
    for x, y in _pairs_in_order(key, own, i, j):
        ok = (rep[x] != rep[y]) & _reach(n, pos, x, y, percent)
        x, y = x[ok], y[ok]
        most, apart = _most_apart(n[x], n[y], percent), np.bitwise_count(base[at[x]] ^ base[at[y]]).sum(1, dtype=np.int64)
        ok = apart <= most
        x, y, apart, most = x[ok], y[ok], apart[ok], most[ok]
        of = np.flatnonzero(wide[at[x]] & wide[at[y]])
        if len(of):
            apart[of] = least_apart([parity[k] for k in at[x[of]]], [parity[k] for k in at[y[of]]])
            ok = apart <= most
            x, y, apart = x[ok], y[ok], apart[ok]
        low, high = np.minimum(at[x], at[y]), np.maximum(at[x], at[y])
        if nearest:
            open_[x] = open_[y] = True
        found.append(_thinned(low, high, apart, nearest))
    low, high, apart = _thinned(*(np.concatenate(v) for v in zip(*found, strict=True)), nearest)
    left = np.flatnonzero(open_)
    fp = rows.column("fp").combine_chunks()
    x = np.concatenate([members[low], left])
    more = pa.array(np.concatenate([members[high], left]), pa.int64(), mask=np.arange(len(x)) >= len(low))
    out = {"pair": np.arange(len(x)) < len(low), "other": fp.take(more), "apart": np.concatenate([apart, np.zeros(len(left), np.int64)])}
    taken = rows.take(pa.array(x))
    return pa.table({**out, **{c: taken.column(c) for c in (*KEPT, "i", "j", "own")}})


def _thinned(low: np.ndarray, high: np.ndarray, apart: np.ndarray, nearest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs; with nearest, only those that are the best one of either class."""
    order = np.lexsort((high, low))
    low, high, apart = low[order], high[order], apart[order]
    new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])) if len(low) else np.zeros(0, bool)
    low, high, apart = low[new], high[new], apart[new]
    if nearest and len(low):
        keep = np.zeros(len(low), bool)
        for side, other in ((low, high), (high, low)):
            order = np.lexsort((other, apart, side))
            keep[order[np.append(True, side[order][1:] != side[order][:-1])]] = True
        low, high, apart = low[keep], high[keep], apart[keep]
    return low, high, apart


KEPT = ("gram", "fp", "n", "pos", "rep")
BLOCKS = "gram long, fp binary, n long, pos long, rep long, own long, i long, j long"


def reachable(grams: _Grams, rows: DataFrame, percent: int) -> DataFrame:
    """Postings, dealt in blocks, that pass all filters, the last one on coarse parities, with one of another component."""
    return cut(grams.dealt(rows).groupBy("bucket").applyInArrow(lambda t: _with_partner(t, percent), BLOCKS), "reachable")


def close(rows: DataFrame, classes: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """Pairs (pair true: fp, other, apart) among dealt postings that pass the suffix filter; see _compare."""
    tasks = max(1, -(-rows.count() // PARITY_ROWS))
    wanted = cut(rows.select("fp").distinct(), "wanted")
    dealt = rows.join(_parities(classes, wanted), "fp").withColumn("bucket", F.pmod(F.xxhash64("gram", "i", "j"), F.lit(tasks)))
    return cut(dealt.groupBy("bucket").applyInArrow(lambda t: _compare(t, percent, nearest), "pair boolean, other binary, apart long, gram long, fp binary, n long, pos long, rep long, i long, j long, own long"), "close")


def _distinct_pairs(found: DataFrame) -> DataFrame:
    return found.where("pair").select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"), "apart").distinct()


def best_pairs(found: DataFrame) -> DataFrame:
    """(a, b): the nearest pair of each class."""
    pairs = _distinct_pairs(found)
    sided = pairs.select("a", "b", "apart", F.explode(F.array("a", "b")).alias("fp"))
    return sided.groupBy("fp").agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b").distinct()


def rebuilt_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, lower: bool) -> DataFrame:
    """(fp, shingles) of the wanted classes (fp), from their whole texts."""
    wanted = cut(classes.select("fp", "rep").join(sent_if_few(wanted, FEW_NAMES), "fp", "left_semi"), "wanted")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, sets = [], []
            for _, edges, hashes in _sets(batch.column(0), k, lower):
                other = X.mix(hashes)
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    fp.append(np.array([hashes[a:b].sum(), other[a:b].sum() ^ np.uint64(b - a)], np.uint64).tobytes())
                    sets.append(hashes[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), pa.array(sets, pa.binary())], ["fp", "shingles"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text")).join(sent_if_few(wanted.select("rep")), "rep", "left_semi")
    built = chosen.select("text").mapInArrow(build, "fp binary, shingles binary").join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])
    return cut(built, "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs whose sets overlap enough."""

    @F.arrow_udf("boolean")
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        found = np.zeros(len(x), bool)
        for i, (p, q) in enumerate(zip(x, y, strict=True)):
            p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([p, q]))
            same = int((both[1:] == both[:-1]).sum())
            found[i] = 100 * same >= percent * (len(p) + len(q) - same)
        return pa.array(found)

    return spread_join(spread_join(pairs, sets.toDF("a", "sa"), "a", "b"), sets.toDF("b", "sb"), "b", "a").where(linked("sa", "sb")).select("a", "b")


class _Join:
    """The classes of a corpus, their postings, and what has been verified so far."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, k: int, percent: int, lower: bool):
        self.source, self.percent = (docs, doc_id, text, k, lower), percent
        signed = cut(signatures(docs, doc_id, text, k, percent, lower), "signed")
        self.signed = cut(signed.select("doc_id", "n", "fp"), "sizes")
        self.full = self.signed.where("n > 0 and doc_id is not null")
        self.classes = cut(signed.where("n > 0 and doc_id is not null").groupBy("fp", "n").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity"), F.first("coarse").alias("coarse")), "classes")
        discard(signed)
        self.names = self.classes.select("fp", "rep")
        self.grams = _Grams(shared_postings(self.classes))
        self.sets = self.asked = None

    def links(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs that link; a pair that was asked before is not verified again."""
        if self.asked is not None:
            pairs = pairs.join(self.asked, ["a", "b"], "left_anti")
        pairs = cut(pairs, "pairs")
        docs, doc_id, text, k, lower = self.source
        sides = cut(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "sides")
        missing = sides if self.sets is None else cut(sides.join(self.sets.select("fp"), "fp", "left_anti"), "missing")
        built = rebuilt_sets(missing, self.classes, docs, doc_id, text, k, lower)
        self.sets = built if self.sets is None else self.sets.union(built)
        self.asked = pairs if self.asked is None else self.asked.union(pairs)
        own = self.sets.join(sent_if_few(sides, FEW_NAMES), "fp", "left_semi")
        return cut(verified(pairs, own, self.percent), "linked")

    def renamed(self, rows: DataFrame, tied: DataFrame) -> DataFrame:
        """rows with the component that their class has by now."""
        changed = cut(tied.toDF("_fp", "_rep").join(self.names, F.col("_fp") == F.col("fp")).where("rep <> _rep").select("_fp", "_rep"), "changed")
        return rows.join(sent_if_few(changed, FEW_NAMES), F.col("fp") == F.col("_fp"), "left").withColumn("rep", F.coalesce("_rep", "rep")).select(*rows.columns)

    def tie(self, pairs: DataFrame, tied: DataFrame, more: DataFrame | None = None) -> DataFrame:
        """tied (fp, rep), rep replaced by the component that the links among pairs give it."""
        ends = spread_join(spread_join(self.links(pairs), tied.toDF("a", "x"), "a", "b"), tied.toDF("b", "y"), "b", "a").select(F.col("x").alias("a"), F.col("y").alias("b"))
        found = components(ends if more is None else ends.union(more))
        return cut(spread_join(tied, found, "rep", "fp", right="node", how="left").select("fp", F.coalesce("component", "rep").alias("rep")), "tied")


def class_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, lower: bool = True) -> tuple[DataFrame, DataFrame]:
    """All links: (a, b), two class names, of every linked pair of different sets; and (doc_id, class), the members."""
    join = _Join(docs, doc_id, text, k, percent, lower)
    rows = reachable(join.grams, join.grams.met, percent)
    links = join.links(_distinct_pairs(close(rows, join.classes, percent)).select("a", "b"))
    return links, join.full.select("doc_id", F.col("fp").alias("class"))


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; two rows link when 100 * intersection >= percent * union."""
    join = _Join(docs, doc_id, text, k, percent, lower)
    # rows that repeat a doc_id tie their classes together
    ids = join.full.select("doc_id", "fp").distinct()
    again = ids.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    same = ids.join(again, "doc_id").join(join.names, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    tied = join.tie(likely(with_first(join.grams, percent), join.classes, percent), join.names, same)
    found = close(reachable(join.grams, join.renamed(join.grams.met, tied), percent), join.classes, percent, nearest=True)
    tied = join.tie(best_pairs(found), tied)
    # the nearest of another component again, as long as that ties some; then all pairs that are left
    for _ in range(NEAREST_ROUNDS):
        rest = join.renamed(found.where("not pair").select(*KEPT, "own", "i", "j"), tied)
        found = close(rest, join.classes, percent, nearest=True)
        if not found.where("pair").head(1):
            break
        tied = join.tie(best_pairs(found), tied)
    else:
        rest = join.renamed(found.where("not pair").select(*KEPT, "own", "i", "j"), tied)
        tied = join.tie(_distinct_pairs(close(rest, join.classes, percent)).select("a", "b"), tied)
    labels = tied.toDF("fp", "component_id")
    rest = join.signed.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return spread_join(join.full.select("doc_id", "n", "fp"), labels, "fp", "doc_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(rest)


def op4_ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    return similar_documents(docs, k=3, percent=90)


#: DuckDB SQL for the rows of op4_ngram_jaccard_join: all pairs that share a shingle, and all that they reach.
OP4_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
shingle AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 2], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, least(len(ws), 1) + 1))) AS i FROM texts)),
sized AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
both_ways AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingle a JOIN shingle b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM both_ways JOIN sized a ON a.doc_id = x JOIN sized b ON b.doc_id = y WHERE 100 * common >= 90 * (a.n + b.n - common)),
reach AS (SELECT doc_id, doc_id AS other FROM texts UNION SELECT r.doc_id, l.y FROM reach r JOIN link l ON l.x = r.other)
SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN sized USING (doc_id) GROUP BY doc_id
"""


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near-duplicates (the smallest doc_id); rows with a null doc_id stay.

    Where a doc_id stands on several rows, rows count one by one: of rows that are equal in all columns one stays, and those of different texts
    stay or go with the group of their own text; of a group's rows with the smallest doc_id, the one whose text, then whole row has
    the least MD5 stays. Neither the order nor the partitioning of the input matters.
    """
    rows, key = docs, "doc_id"
    known = docs.where("doc_id is not null")
    repeats = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not repeats.isEmpty():
        rows, key = _numbered(known), "_near_row"
    with scratch() as made:
        found = cut(similar_documents(rows, key), "found")
        made.remove(found)
    gone = cut(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone").toDF(key)
    kept = rows.join(sent_if_few(gone), key, "left_anti").select(*docs.columns)
    return kept if rows is docs else kept.unionByName(docs.where("doc_id is null"))


def _numbered(docs: DataFrame) -> DataFrame:
    """Distinct rows of docs with _near_row, their place by doc_id, MD5 of the text and MD5 of the row."""
    whole = F.md5(F.to_json(F.struct(*[F.col(c) for c in docs.columns]), {"ignoreNullFields": "false"}))
    rows = cut(docs.withColumn("_near_key", whole).dropDuplicates(["_near_key"]), "distinct")
    order = rows.select("doc_id", F.md5("text").alias("_near_text"), "_near_key", F.lit(1).alias("_near_all"))
    ranked = group_rank(order, "_near_all", "doc_id", "_near_text", "_near_key", name="_near_row").select("_near_key", "_near_row")
    return cut(rows.join(ranked, "_near_key").drop("_near_key"), "numbered")
