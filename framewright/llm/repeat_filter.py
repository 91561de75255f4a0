"""Which hashes of a corpus repeat: packed hash lists, dealt by hash, answered to the rows that asked.

Blocks of text send each hash once: repeats inside a block are settled there, so even a hash of every document reaches
its task once per block. A list costs 7 bytes a hash; its lowest bits choose the part, so 56 bits and the part tell
hashes apart (64 bits from 256 parts on). Answers are 8-byte keys of row id and hash, dealt by row id.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .textops import mix, runs

#: Bytes of text that one part of hashes, or one bucket of rows, stands for; and hashes of one block.
SPLIT_BYTES = 2 << 20
BLOCK = 250_000
ASK = "part long, blob binary"
ANSWER = "bucket long, blob binary"
EARLIER, REPEATED, SHARED = "earlier", "repeated", "shared"
_ASKED, _KNOWN, _ANSWERED = 0, 1, 2


def splits(total_bytes: int) -> int:
    """Parts for so much text: a power of two, as parts are the lowest bits of hashes."""
    return 1 << max(0, int(np.ceil(np.log2(max(1, total_bytes) / SPLIT_BYTES))))


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(77)) % np.uint64(buckets)).astype(np.int64)


def bucket(column: str, buckets: int):
    """The bucket of a row id, as a column; rows without an id go to all buckets evenly."""

    @F.arrow_udf(LongType())
    def dealt(ids: pa.Array) -> pa.Array:
        where = bucket_of(np.asarray(ids.fill_null(0)).astype(np.int64), buckets)
        return pa.array(np.where(np.asarray(ids.is_null()), np.arange(len(ids)) % buckets, where))

    return dealt(F.col(column).cast("long"))


def answer_keys(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One key for a hash and the row that asked for it."""
    return mix((hashes >> np.uint64(8)) ^ mix(ids.astype(np.int64).view(np.uint64)))


def _pack(kind: int, hashes: np.ndarray, ids: np.ndarray) -> bytes:
    steps = np.diff(ids, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return struct.pack("<BI", kind, len(hashes)) + hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes() + steps.tobytes()


def _unpack(blob: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Kind, hashes without their lowest byte, ids."""
    kind, n = struct.unpack_from("<BI", blob)
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :7] = np.frombuffer(blob, np.uint8, 7 * n, 5).reshape(n, 7)
    ids = np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * n, 5 + 7 * n).reshape(8, n).T).view("<i8").ravel())
    return kind, raw.view("<u8").ravel().astype(np.uint64), ids


def ask(hashes: np.ndarray, ids: np.ndarray, parts: int, rule: str, turn: int) -> pa.RecordBatch:
    """One block's rows for `answers`.

    rule EARLIER: is there the hash in a row of a smaller id? rule REPEATED: does the hash come twice or more?
    rule SHARED: does the hash come with two ids or more?
    """
    order = np.lexsort((ids, hashes))
    h, d = hashes[order], ids[order]
    if rule == SHARED and len(h):
        once = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
        h, d = h[once], d[once]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    if rule == EARLIER:
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        sets = [(_ASKED, first), (_ANSWERED, ~first & ~again & (d > d[np.flatnonzero(first)][np.cumsum(first) - 1]))] if len(h) else []
    else:
        single = first & np.append(first[1:], True)
        sets = [(_ASKED, single), (_KNOWN, first & ~single), (_ANSWERED, ~single)]
    where, blobs = [], []
    for kind, chosen in sets:
        x, y = h[chosen], d[chosen]
        part = (x & np.uint64(parts - 1)).astype(np.int64)
        if kind == _ANSWERED:  # needs no hash's own task: dealt evenly
            part = (part + turn + bucket_of(y, parts)) % parts
        order = np.lexsort((y, part))
        x, y, part = x[order], y[order], part[order]
        for a, b in zip(*runs(part), strict=True):
            where.append(int(part[a]))
            blobs.append(_pack(kind, x[a:b], y[a:b]))
    return pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(blobs, pa.binary())], ["part", "blob"])


class Blocks:
    """Gathers hashes and ids until a block is full."""

    def __init__(self, parts: int, rule: str):
        self.parts, self.rule, self.kept, self.n, self.turn = parts, rule, [], 0, 0

    def add(self, hashes: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.kept.append((hashes, ids))
        self.n += len(hashes)
        if self.n >= BLOCK:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            self.turn += 1
            hashes, ids = (np.concatenate(x) for x in zip(*self.kept, strict=True))
            self.kept, self.n = [], 0
            yield ask(hashes, ids, self.parts, self.rule, self.turn)


def answers(asked: DataFrame, parts: int, buckets: int, rule: str) -> DataFrame:
    """(bucket, blob): the answer keys of all hashes that repeat as the rule says, packed by bucket of the asking row."""

    def settle(rows: pa.Table) -> pa.Table:
        kinds, hashes, ids = [], [], []
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for blob in rows.column("blob").to_pylist():
            kind, h, d = _unpack(blob)
            if kind == _ANSWERED:
                keys.append(answer_keys(h << np.uint64(8), d)), owners.append(d)
            else:
                kinds.append(np.full(len(h), kind, np.int8)), hashes.append(h), ids.append(d)
        if hashes:
            k, h, d = map(np.concatenate, (kinds, hashes, ids))
            order = np.lexsort((d, h))
            k, h, d = k[order], h[order], d[order]
            if rule == SHARED:  # the same id again, from another block
                once = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (k[1:] != k[:-1]))
                k, h, d = k[once], h[once], d[once]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            run = np.cumsum(first) - 1
            start = np.flatnonzero(first)
            hit = d > d[start][run] if rule == EARLIER else (k == _ASKED) & ((np.diff(np.append(start, len(h)))[run] > 1) | (np.bincount(run, k == _KNOWN)[run] > 0))
            keys.append(answer_keys(h[hit] << np.uint64(8), d[hit])), owners.append(d[hit])
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        to = bucket_of(owners, buckets)
        order = np.argsort(to, kind="stable")
        keys, to = keys[order], to[order]
        starts, ends = runs(to)
        blobs = [np.sort(keys[a:b]).tobytes() for a, b in zip(starts, ends, strict=True)]
        return pa.table({"bucket": pa.array(to[starts], pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return asked.groupBy("part").applyInArrow(settle, ANSWER)


def known_keys(replies: pa.Table) -> np.ndarray:
    """All answer keys of one bucket, ascending."""
    blobs = replies.column("blob").to_pylist()
    return np.sort(np.frombuffer(b"".join(blobs), np.uint64)) if blobs else np.zeros(0, np.uint64)


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return known[at] == keys
