"""Embedding near-duplicates by spherical-cap filters.

Filter directions are products of random codes: the space, turned at random, is cut into PARTS blocks with `codes` unit
codes each, and every choice of one code per block is a direction. A vector passes all directions whose inner product with
it exceeds a threshold (decoded block by block, dropping sums that cannot reach it any more), and its best direction.
Vectors meet on common filters and are verified by cosine in double precision. The threshold is set once by simulation of
PAIRS pairs so that pairs at exactly the least cosine share a filter with probability RECALL, for any number of codes.
Unless `codes` is given, there is a direction for every VECTORS_A_DIRECTION distinct vectors (at least LEAST_CODES codes a
block; no upper limit), so that a filter's list doesn't grow with the input.

Filters that begin with the same codes are compared in one task, SPAN of them: a vector that passes several travels there
once, with the list of its filters. Within a task each filter's vectors are compared as matrices, first in single precision with a
margin, then, where any pair comes near, in double; a pair counts only at the smallest filter both pass. Filters that more than BLOCK
vectors pass are left out there: their vectors are dealt into blocks, and every two blocks are compared in a task of their
own. What leaves a task is one row per vector (its links there, the smallest vector it reaches there), never pairs. Equal vectors
are compared once and counted as often as they occur.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component, and rows with a null vec_id, link
with nothing; vectors of different lengths never link; rows that repeat a vec_id count as vectors of their own and share
their component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import cut, sent_if_few
from .textops import runs

PARTS = 2
RECALL = 0.985
PAIRS = 4000
VECTORS_A_DIRECTION = 12
LEAST_CODES = 64
BLOCK = 1024
#: Filters in a row that one task compares; with VECTORS_A_DIRECTION it bounds the vectors of a task.
SPAN = 64
#: How far a cosine in single precision may lie below the double one.
MARGIN = 1e-4
SEED = 11


class Caps:
    """Filters for vectors of one length."""

    def __init__(self, size: int, codes: int, cosine: float, recall: float = RECALL):
        rng = np.random.default_rng([SEED, size, codes])
        self.turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
        self.blocks = [b for b in np.array_split(np.arange(size), PARTS) if len(b)]
        self.codes = []
        for b in self.blocks:
            c = rng.normal(size=(codes, len(b)))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(len(self.blocks)))
        shared = []
        for n in [200] * (PAIRS // 200):
            x, y = rng.normal(size=(2, n, size))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            y -= (x * y).sum(1, keepdims=True) * x
            y = cosine * x + np.sqrt(1 - cosine**2) * y / np.maximum(1e-300, np.linalg.norm(y, axis=1, keepdims=True))
            products = zip(*self._products(x), *self._products(y), strict=True)
            shared += [self._shared(p[: len(self.blocks)], p[len(self.blocks) :]) for p in products]
        self.threshold = float(np.quantile(shared, 1 - recall))

    @staticmethod
    def _shared(x: tuple, y: tuple) -> float:
        """The highest threshold at which two vectors, given by their products, still pass a direction together."""
        best = [np.argmax(p + q) for p, q in zip(x, y, strict=True)]
        least = min(sum(p[i] for p, i in zip(v, best, strict=True)) for v in (x, y)) - 1e-12
        tops = [(p.max(), q.max()) for p, q in zip(x, y, strict=True)]
        of_x, of_y = np.zeros(1), np.zeros(1)
        for i, (p, q) in enumerate(zip(x, y, strict=True)):
            # a direction above `least` for both holds only codes that reach it with the best of all other blocks
            others = [sum(t[k] for j, t in enumerate(tops) if j != i) for k in (0, 1)]
            few = (p + others[0] >= least) & (q + others[1] >= least)
            left = [sum(t[k] for t in tops[i + 1 :]) for k in (0, 1)]
            of_x, of_y = (of_x[:, None] + p[few]).ravel(), (of_y[:, None] + q[few]).ravel()
            on = (of_x + left[0] >= least) & (of_y + left[1] >= least)
            of_x, of_y = of_x[on], of_y[on]
        return float(np.minimum(of_x, of_y).max())

    def _products(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = unit @ self.turn
        return [turned[:, b] @ c.T for b, c in zip(self.blocks, self.codes, strict=True)]

    def passed(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that each unit vector exceeds, and of its best one; ordered, distinct."""
        products = self._products(unit)
        tops = [p.max(1) for p in products]
        rows, names, sums = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for i, p in enumerate(products):
            left = sum(tops[i + 1 :], np.zeros(len(unit)))
            total = sums[:, None] + p[rows]
            at, code = np.nonzero(total + left[rows][:, None] >= self.threshold)
            rows, names, sums = rows[at], names[at] * p.shape[1] + code, total[at, code]
        best = np.zeros(len(unit), np.int64)
        for p in products:
            best = best * p.shape[1] + p.argmax(1)
        pairs = np.unique(np.concatenate([np.stack([rows, names], 1), np.stack([np.arange(len(unit)), best], 1)]), axis=0)
        return pairs[:, 0], pairs[:, 1]


def usable(column: str):
    x = F.col(column)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & good & F.exists(x, lambda v: v != 0)


def _width(codes: int) -> str:
    """Bytes of a filter's number in a list."""
    return "<u4" if codes**PARTS <= 1 << 32 else "<i8"


def _unit(raw: list[bytes], kind: np.dtype) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def decoded(vectors: DataFrame, codes: int, cosine: float, kind: np.dtype) -> DataFrame:
    """(size, rep, cls, copies, raw, filters) of each distinct vector (rep, cls, copies, vec); rep and cls name it, filters are packed."""
    sizes = [r[0] for r in vectors.select(F.size("vec").alias("n")).distinct().collect()]
    caps = vectors.sparkSession.sparkContext.broadcast({n: Caps(n, codes, cosine) for n in sizes})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = [np.array(v, kind).tobytes() for v in part.column("vec").to_pylist()]
                lengths = np.array([len(r) // kind.itemsize for r in raw])
                for n in np.unique(lengths):
                    of = np.flatnonzero(lengths == n)
                    rows, names = caps.value[n].passed(_unit([raw[i] for i in of], kind))
                    lists = [names[a:b].astype(_width(codes)).tobytes() for a, b in zip(*runs(rows), strict=True)]
                    pick = pa.array(of, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([int(n)] * len(of), pa.int64()), *(part.column(c).take(pick) for c in ("rep", "cls", "copies")), pa.array([raw[i] for i in of], pa.binary()), pa.array(lists, pa.binary())], ["size", "rep", "cls", "copies", "raw", "filters"])

    return vectors.select("rep", "cls", "copies", "vec").mapInArrow(decode, "size long, rep long, cls long, copies long, raw binary, filters binary")


def _flat(lists: pa.Array, width: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of packed lists."""
    known = [np.frombuffer(x, width) for x in lists.to_pylist()]
    return np.repeat(np.arange(len(known)), [len(x) for x in known]), np.concatenate(known or [np.zeros(0, width)]).astype(np.int64)


def filter_counts(vectors: DataFrame, width: str) -> DataFrame:
    """(size, filter, n): vectors that pass each filter, counted in each batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(0))
            owner, names = _flat(batch.column(1), width)
            for n in np.unique(sizes):
                found, times = np.unique(names[sizes[owner] == n], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([int(n)] * len(found), pa.int64()), pa.array(found, pa.int64()), pa.array(times, pa.int64())], ["size", "filter", "n"])

    return vectors.select("size", "filters").mapInArrow(count, "size long, filter long, n long").groupBy("size", "filter").agg(F.sum("n").alias("n"))


def in_groups(vectors: DataFrame, width: str) -> DataFrame:
    """(size, part, rep, cls, copies, raw, filters, active): each vector once for each SPAN of filters of which it passes some."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                owner, names = _flat(rows.column("filters"), width)
                starts, ends = runs(owner * (1 << 40) + names // SPAN)
                pick = pa.array(owner[starts], pa.int64())
                active = pa.ListArray.from_arrays(pa.array(np.append(starts, len(names)), pa.int32()), pa.array(names, pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column("size").take(pick), pa.array(names[starts] // SPAN, pa.int64()), *(rows.column(c).take(pick) for c in ("rep", "cls", "copies", "raw", "filters")), active], ["size", "part", "rep", "cls", "copies", "raw", "filters", "active"])

    return vectors.mapInArrow(deal, "size long, part long, rep long, cls long, copies long, raw binary, filters binary, active array<long>")


def memberships(vectors: DataFrame, width: str) -> DataFrame:
    """(size, filter, rep, cls): the filters of each vector."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, names = _flat(batch.column("filters"), width)
            pick = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("size").take(pick), pa.array(names, pa.int64()), batch.column("rep").take(pick), batch.column("cls").take(pick)], ["size", "filter", "rep", "cls"])

    return vectors.select("size", "rep", "cls", "filters").mapInArrow(name, "size long, filter long, rep long, cls long")


class _Vectors:
    """The vectors of one task, and the links found among them."""

    def __init__(self, rows: pa.Table, cosine: float, kind: np.dtype, width: str):
        self.ids, self.cls, self.copies = np.asarray(rows.column("rep")).astype(np.int64), rows.column("cls"), np.asarray(rows.column("copies"))
        self.unit, self.cosine = _unit(rows.column("raw").to_pylist(), kind), cosine
        self.single = self.unit.astype(np.float32)
        self.owner, self.known = _flat(rows.column("filters").combine_chunks(), width)
        self.edges = np.searchsorted(self.owner, np.arange(len(self.ids) + 1))
        self.n, self.root = np.zeros(len(self.ids), np.int64), self.ids.copy()

    def _earlier(self, rows: np.ndarray, name: int) -> tuple[np.ndarray, np.ndarray]:
        """(place among rows, filter) of the filters below name."""
        lists = [self.known[self.edges[i] : self.edges[i + 1]] for i in rows]
        at, names = np.repeat(np.arange(len(rows)), [len(x) for x in lists]), np.concatenate(lists)
        return at[names < name], names[names < name]

    def meet(self, name: int, a: np.ndarray, b: np.ndarray) -> None:
        """Links between rows a and b that pass the filter; b is a itself, or holds other rows."""
        same = a is b
        near = self.single[a] @ self.single[b].T >= self.cosine - MARGIN
        if same:
            np.fill_diagonal(near, False)
        rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(rows):
            return
        near = near[np.ix_(rows, columns)]
        x, y = a[rows], b[columns]
        linked = near & (self.unit[x] @ self.unit[y].T >= self.cosine)
        while linked.any():
            old = self.root[x].copy(), self.root[y].copy()
            none = np.iinfo(np.int64).max
            self.root[x] = np.minimum(self.root[x], np.where(linked, self.root[y][None], none).min(1))
            self.root[y] = np.minimum(self.root[y], np.where(linked, self.root[x][:, None], none).min(0))
            if (old[0] == self.root[x]).all() and (old[1] == self.root[y]).all():
                break
        (at, names), (to, others) = self._earlier(x, name), self._earlier(y, name)
        both, inverse = np.unique(np.concatenate([names, others]), return_inverse=True)
        has, had = np.zeros((len(x), max(1, len(both))), np.float32), np.zeros((len(y), max(1, len(both))), np.float32)
        has[at, inverse[: len(names)]] = 1
        had[to, inverse[len(names) :]] = 1
        counted = linked & (has @ had.T == 0)
        np.add.at(self.n, x, counted @ self.copies[y])
        if not same:
            np.add.at(self.n, y, counted.T @ self.copies[x])

    def links(self) -> pa.Table:
        keep = np.flatnonzero((self.n > 0) | (self.root != self.ids))
        return pa.table({"rep": pa.array(self.ids[keep], pa.int64()), "cls": self.cls.take(pa.array(keep, pa.int64())), "n": pa.array(self.n[keep], pa.int64()), "root": pa.array(self.root[keep], pa.int64())})


LINKS = "rep long, cls long, n long, root long"


def compared_groups(groups: DataFrame, cosine: float, kind: np.dtype, width: str) -> DataFrame:
    """(rep, cls, n, root) of links at the filters in active."""

    def compare(rows: pa.Table) -> pa.Table:
        found, active = _Vectors(rows, cosine, kind, width), rows.column("active").combine_chunks()
        owner = np.repeat(np.arange(len(active)), np.asarray(active.value_lengths()))
        names = np.asarray(active.flatten())
        order = np.lexsort((owner, names))
        for start, end in zip(*runs(names[order]), strict=True):
            if end - start > 1:
                own = owner[order[start:end]]
                found.meet(int(names[order[start]]), own, own)
        return found.links()

    return groups.groupBy("size", "part").applyInArrow(compare, LINKS)


def compared_blocks(rows: DataFrame, cosine: float, kind: np.dtype, width: str) -> DataFrame:
    """(rep, cls, n, root) of links at the filters of rows (size, filter, blocks, rep, cls, copies, raw, filters), two blocks a task."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("rep", "cls"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(rows: pa.Table) -> pa.Table:
        found, own = _Vectors(rows, cosine, kind, width), np.asarray(rows.column("own"))
        i, j, name = (rows.column(c)[0].as_py() for c in ("i", "j", "filter"))
        a = np.flatnonzero(own == i)
        found.meet(name, a, a if i == j else np.flatnonzero(own == j))
        return found.links()

    return pairs.groupBy("size", "filter", "i", "j").applyInArrow(compare, LINKS)


def filter_links(vectors: DataFrame, codes: int, cosine: float, kind: np.dtype) -> DataFrame:
    """(rep, cls, n, root): what each task has found of a vector's links."""
    width = _width(codes)
    known = cut(decoded(vectors, codes, cosine, kind), "decoded")
    hot = cut(filter_counts(known, width).where(F.col("n") > BLOCK).select("size", "filter", F.ceil(F.col("n") / BLOCK).alias("blocks")), "hot")
    if hot.isEmpty():
        return cut(compared_groups(in_groups(known, width), cosine, kind, width), "links")
    passed = cut(memberships(known, width).join(sent_if_few(hot), ["size", "filter"], "left"), "passed")
    whole = known.select("rep", "cls", "copies", "raw", "filters")
    rest = passed.where("blocks is null").groupBy("size", F.expr(f"filter div {SPAN}").alias("part"), "rep", "cls").agg(F.array_sort(F.collect_list("filter")).alias("active"))
    groups = rest.join(whole, ["rep", "cls"]).select("size", "part", "rep", "cls", "copies", "raw", "filters", "active")
    often = passed.where("blocks is not null").join(whole, ["rep", "cls"])
    return cut(compared_groups(groups, cosine, kind, width).union(compared_blocks(often, cosine, kind, width)), "links")


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9, codes: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    kind = np.dtype("<f4") if "float" in dict(vectors.dtypes)[embedding] else np.dtype("<f8")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec")).withColumn("good", F.coalesce(usable("vec") & F.col("vec_id").isNotNull(), F.lit(False)))
    good = rows.where("good").select("vec_id", "vec")
    classes = cut(good.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select("rep", F.xxhash64("vec").alias("cls"), "copies", "vec"), "vectors")
    codes = codes or max(LEAST_CODES, int(np.ceil((classes.count() / VECTORS_A_DIRECTION) ** (1 / PARTS))))
    found = filter_links(classes, codes, cosine, kind)
    label = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep", "cls").agg(F.sum("n").alias("n"))
    settled = classes.join(counts, ["rep", "cls"], "left").join(label, F.col("rep") == F.col("node"), "left")
    settled = cut(settled.select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "settled")
    linked = good.join(settled, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_cap_filters(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors)
