"""Benchmark decontamination by greedy string tiling.

Words are maximal runs without ASCII spaces and punctuation, A-Z lower-cased. Documents and benchmark items meet on shared
seeds of SEED words, or of all its words for an item with fewer. Of each pair that meets, the longest match of unmarked words is marked again and again (runs of
equal Karp-Rabin seed hashes on one diagonal, cut where words are already marked) until no match of SEED words is left.
Tiles may lie in any order, so reordered passages are caught. A pair is contaminated when tiles cover at least
`coverage` of the item's words.

Defined results: an item of fewer than SEED words is found verbatim only, even one of a single word; items and documents without
words (null and empty texts too) match nothing; an empty benchmark flags nothing; rows that repeat an item or document are
judged each on its own (equal item texts are looked for once); extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X

SEED = 5
COVERAGE = 0.5
#: Words of the benchmark that are sent to executors at once (about 40 bytes each); a larger one comes in slices.
SLICE_WORDS = 2_000_000
_PLAIN = X._LOWER.copy()
_PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each word, hash of each word)."""
    for row, end, data, offsets in X.pieces(column):
        plain = _PLAIN[data]
        starts, ends, rows = X.word_spans(plain, offsets)
        yield row, end, rows, X.word_hashes(plain, starts, ends)


class Index:
    """Seeds of some benchmark items: for each seed length, sorted hashes, and the item and word position of each."""

    def __init__(self, ids: list, texts: pa.Array, seed: int):
        self.ids, self.sizes = ids, np.zeros(len(ids), np.int64)
        made: dict[int, list] = {}
        for row, end, rows, words in words_of(texts):
            sizes = self.sizes[row:end] = np.bincount(rows, minlength=end - row)
            for k in np.unique(np.minimum(sizes[sizes > 0], seed)).tolist():
                at, h = X.windows(words, rows, k)
                fits = (np.minimum(sizes, seed) == k)[rows[at]]
                at, h = at[fits], h[fits]
                made.setdefault(k, []).append((h, rows[at] + row, at - np.searchsorted(rows, rows[at])))
        self.seeds = {k: Seeds(k, *map(np.concatenate, zip(*parts, strict=True))) for k, parts in made.items()}


class Seeds:
    """Hashes of k consecutive words of items."""

    def __init__(self, k: int, hashes: np.ndarray, items: np.ndarray, places: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.k, self.hashes, self.items, self.places = k, hashes[order], items[order], places[order]

    def hits(self, windows: np.ndarray) -> np.ndarray:
        """Which window hashes are seeds."""
        if not len(self.hashes):
            return np.zeros(len(windows), bool)
        at = np.searchsorted(self.hashes, windows)
        at[at == len(self.hashes)] = 0
        return self.hashes[at] == windows

    def tiles(self, places: np.ndarray, windows: np.ndarray, sizes: np.ndarray, coverage: float) -> list[tuple[int, int, int]]:
        """(item, words covered, tiles) of the items that one document covers enough, from its seed hits."""
        first, last = np.searchsorted(self.hashes, windows), np.searchsorted(self.hashes, windows, "right")
        n = last - first
        entry = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc, item, place = np.repeat(places, n), self.items[entry], self.places[entry]
        order = np.lexsort((place, doc - place, item))
        doc, item, place = doc[order], item[order], place[order]
        fresh = np.ones(len(item), bool)
        fresh[1:] = (item[1:] != item[:-1]) | (doc[1:] - place[1:] != doc[:-1] - place[:-1]) | (place[1:] != place[:-1] + 1)
        start = np.flatnonzero(fresh)
        length = np.diff(np.append(start, len(item))) + self.k - 1
        found = []
        edges = np.flatnonzero(np.append(True, item[start][1:] != item[start][:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(start)), strict=True):
            which = int(item[start[a]])
            covered, used = greedy_tiles(doc[start[a:b]], place[start[a:b]], length[a:b], self.k)
            if covered >= coverage * sizes[which]:
                found.append((which, covered, used))
        return found


def greedy_tiles(doc: np.ndarray, place: np.ndarray, length: np.ndarray, least: int) -> tuple[int, int]:
    """(words covered, tiles) when the longest match of unmarked words is marked until none of `least` words is left."""
    waiting = [(-int(n), int(d), int(p)) for d, p, n in zip(doc, place, length, strict=True)]
    heapq.heapify(waiting)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    tiles = 0
    while waiting:
        n, d, p = heapq.heappop(waiting)
        free = [i for i in range(-n) if d + i not in in_doc and p + i not in in_item]
        if len(free) == -n:
            in_doc.update(range(d, d - n))
            in_item.update(range(p, p - n))
            tiles += 1
            continue
        run = 0
        for i, x in enumerate(free):
            run += 1
            if i + 1 == len(free) or free[i + 1] != x + 1:
                if run >= least:
                    heapq.heappush(waiting, (-run, d + x - run + 1, p + x - run + 1))
                run = 0
    return len(in_item), tiles


def judge(texts: pa.Array, index: Index, coverage: float) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(row, contaminated items) of the rows that have any; a row comes again for seeds of another length."""
    for row, _, rows, words in words_of(texts):
        for k, seeds in index.seeds.items():
            at, hashes = X.windows(words, rows, k)
            hit = np.flatnonzero(seeds.hits(hashes))
            if not len(hit):
                continue
            owner = rows[at[hit]]
            base = np.searchsorted(rows, owner)
            edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(owner)), strict=True):
                if found := seeds.tiles(at[hit[a:b]] - base[a:b], hashes[hit[a:b]], index.sizes, coverage):
                    yield row + int(owner[a]), found


def item_texts(benchmark: DataFrame, text: str) -> DataFrame:
    """(key, text) of the distinct item texts."""
    return benchmark.where(F.col(text).isNotNull()).groupBy(F.md5(text).alias("key")).agg(F.first(text).alias("text"))


def indexes(benchmark: DataFrame, text: str, seed: int) -> Iterator[Index]:
    """The seeds of the distinct item texts in slices of about SLICE_WORDS words; ids are keys of the texts."""
    items = item_texts(benchmark, text)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // (6 * SLICE_WORDS)))
    for i in range(slices):
        rows = items.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == i).toArrow()
        yield Index(rows.column("key").to_pylist(), rows.column("text").combine_chunks(), seed)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, n_tiles, coverage): every contaminated pair of document and item."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {dict(narrow.dtypes)['doc_id']}, key string, n_words long, n_covered long, n_tiles long, coverage double"
    out = None
    for index in indexes(benchmark, item_text, seed):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                found = [(row, *x) for row, items in judge(batch.column(1), index, coverage) for x in items]
                sizes = [int(index.sizes[x[1]]) for x in found]
                columns = [batch.column(0).take(pa.array([x[0] for x in found], pa.int64())), pa.array([index.ids[x[1]] for x in found], pa.string()), pa.array(sizes, pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64()), pa.array([x[2] / n for x, n in zip(found, sizes, strict=True)], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_words", "n_covered", "n_tiles", "coverage"])

        part = narrow.mapInArrow(find, schema)
        out = part if out is None else out.union(part)
    named = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.md5(item_text).alias("key"))
    return out.join(named, "key").select("doc_id", "item_id", "n_words", "n_covered", "n_tiles", "coverage")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """docs without those that hold a benchmark item; judged in place, with no shuffle."""
    kept = docs
    for index in indexes(benchmark, "text", seed):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        kept = kept.where(_clean(sent, coverage)("text"))
    return kept


def _clean(sent, coverage: float):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        good = np.ones(len(texts), bool)
        for row, _ in judge(texts, sent.value, coverage):
            good[row] = False
        return pa.array(good)

    return clean


def op6_benchmark_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)
