"""Removal of byte strings that repeat anywhere in the corpus.

A byte goes when a string of `width` bytes that covers it also starts anywhere else, in the same document or another; strings
are judged on the input.

Strings find each other by anchors: the GRAM bytes of smallest hash within a string are its anchor, so equal strings have
equal anchors at equal places, and about one byte in 70 is an anchor. Consecutive strings of one anchor form a stretch.
Round one deals stretches by anchor: a stretch that repeats as a whole is settled, one whose anchor has no other
stretch is alone, and only stretches whose anchor comes with different surroundings (ends of passages, edits) go on.
Round two counts the hashes of single strings of these. In both, a block of text first settles what repeats inside it and sends
each anchor or hash once, so one that a third of all documents hold reaches its task once per block.

Defined results: null and empty texts have no bytes; texts under `width` bytes lose nothing; rows with a null doc_id neither remove
nor lose bytes; rows that repeat a doc_id are documents of their own (equal ones remove each other); extra columns are
ignored. Spans that leave half a code point are cut as bytes; the kept text is bytes too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeat_filter as R
from . import textops as X
from .tables import cut

WIDTH = 200
GRAM = 64
WHOLE, FIRST, PARTLY = 1, 2, 3
_MIXED = np.uint64(0)


class Stretches:
    """The stretches of one piece of rows: anchor hash, content hash, first and last string start, row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
        self.width, self.n = width, len(data)
        none = np.zeros(0, np.int64)
        self.first = self.last = self.rows = none
        self.anchor = self.content = np.zeros(0, np.uint64)
        if self.n < width:
            return
        self.values = X.byte_values(data)
        at = np.arange(self.n - gram + 1)
        grams = X.span_hash(self.values, at, at + gram)
        keys = grams >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64)
        span = width - gram + 1
        # smallest key of every `span` neighbours: from prefix and suffix minima of blocks of that length
        padded = np.full(-(-len(keys) // span) * span, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(keys)] = keys
        blocks = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        starts = self.n - width + 1
        least = np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts])
        sizes = np.diff(offsets)
        begin = np.repeat(offsets[:-1], np.maximum(0, sizes - width + 1))
        valid = begin + np.arange(len(begin)) - np.repeat(np.cumsum(np.maximum(0, sizes - width + 1)) - np.maximum(0, sizes - width + 1), np.maximum(0, sizes - width + 1))
        place = (least[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        a, b = X.runs(place)
        self.first, self.last, where = valid[a], valid[b - 1], place[a]
        self.anchor = grams[where] | np.uint64(1)
        self.rows = np.searchsorted(offsets, self.first, "right") - 1
        shape = ((where - self.first) << 20 | (self.last - self.first)).astype(np.uint64)
        self.content = X.mix(X.span_hash(self.values, self.first, self.last + width) ^ X.mix(shape)) | np.uint64(1)

    def strings(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, stretch) of every string of the chosen stretches."""
        n = self.last[chosen] - self.first[chosen] + 1
        stretch = np.repeat(chosen, n)
        return self.first[stretch] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), stretch

    def string_hashes(self, starts: np.ndarray) -> np.ndarray:
        return X.span_hash(self.values, starts, starts + self.width)


def _keys(anchor: np.ndarray, content: np.ndarray, ids: np.ndarray, kind: int) -> np.ndarray:
    return X.mix(X.mix(content ^ X.mix(anchor)) ^ X.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(kind << 56)))


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join([np.uint32(len(columns[0])).tobytes(), *[c.astype("<u8").tobytes() for c in columns[:-1]], np.diff(columns[-1], prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    ids = np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * n, 4 + 16 * n).reshape(8, n).T).view("<i8").ravel())
    return np.frombuffer(blob, "<u8", n, 4), np.frombuffer(blob, "<u8", n, 4 + 8 * n), ids


def _ask(anchor: np.ndarray, content: np.ndarray, ids: np.ndarray, parts: int, turn: int) -> pa.RecordBatch:
    """Rows (part, kind, blob) of one block: kind 0 asks, kind 1 asks no more but says that a stretch repeats, others answer."""
    order = np.lexsort((ids, content, anchor))
    g, f, d = anchor[order], content[order], ids[order]
    new_g = np.append(True, g[1:] != g[:-1])
    new_f = new_g | np.append(True, f[1:] != f[:-1])
    count = np.diff(np.append(np.flatnonzero(new_f), len(g)))[np.cumsum(new_f) - 1]
    in_g = np.cumsum(new_g) - 1
    mixed = np.bincount(in_g, new_f)[in_g] > 1
    sets = [
        (0, new_f & ~mixed & (count == 1)),
        (1, new_f & ~mixed & (count > 1)),
        (2, new_g & mixed),
        (10 + WHOLE, (count > 1) & ~(new_f & ~mixed)),
        (10 + FIRST, new_f & mixed & (count > 1)),
        (10 + PARTLY, mixed & (count == 1)),
    ]
    where, kinds, blobs = [], [], []
    for kind, chosen in sets:
        x, y, z = g[chosen], f[chosen], d[chosen]
        part = (x >> np.uint64(1)) & np.uint64(parts - 1)
        if kind >= 10:
            part = (part + np.uint64(turn) + R.bucket_of(z, parts).astype(np.uint64)) % np.uint64(parts)
        order = np.lexsort((z, part))
        x, y, z, part = x[order], y[order], z[order], part[order]
        for a, b in zip(*X.runs(part), strict=True):
            where.append(int(part[a])), kinds.append(kind), blobs.append(_pack(x[a:b], y[a:b], z[a:b]))
    return pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(kinds, pa.int64()), pa.array(blobs, pa.binary())], ["part", "kind", "blob"])


def _settle(rows: pa.Table, buckets: int) -> pa.Table:
    """Answer keys of one part of anchors, packed by bucket."""
    keys, owners, asked = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
    for kind, blob in zip(rows.column("kind").to_pylist(), rows.column("blob").to_pylist(), strict=True):
        g, f, d = _unpack(blob)
        if kind >= 10:
            keys.append(_keys(g, f, d, kind - 10)), owners.append(d)
        else:
            asked.append((g, f if kind < 2 else np.full(len(f), _MIXED), d, np.full(len(g), kind)))
    if asked:
        g, f, d, kind = (np.concatenate(x) for x in zip(*asked, strict=True))
        order = np.lexsort((d, f, g))
        g, f, d, kind = g[order], f[order], d[order], kind[order]
        new_g = np.append(True, g[1:] != g[:-1])
        new_f = new_g | np.append(True, f[1:] != f[:-1])
        in_f, in_g = np.cumsum(new_f) - 1, np.cumsum(new_g) - 1
        many = (np.bincount(in_f)[in_f] > 1) | (np.bincount(in_f, kind == 1)[in_f] > 0)
        mixed = (np.bincount(in_g, new_f)[in_g] > 1) | (np.bincount(in_g, kind == 2)[in_g] > 0)
        own = kind < 2
        for k, chosen in ((WHOLE, own & many), (FIRST, own & many & new_f & mixed), (PARTLY, own & ~many & mixed)):
            keys.append(_keys(g[chosen], f[chosen], d[chosen], k)), owners.append(d[chosen])
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    to = R.bucket_of(owners, buckets)
    order = np.argsort(to, kind="stable")
    keys, to = keys[order], to[order]
    starts, ends = X.runs(to)
    return pa.table({"bucket": pa.array(to[starts], pa.int64()), "blob": pa.array([keys[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())})


def _pieces(rows: pa.Table, width: int, gram: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, Stretches]]:
    """(first row, end row, bytes, offsets, id of each stretch's row, stretches); rows without an id have no stretches."""
    ids = rows.column("doc_id").combine_chunks()
    owner, null = np.asarray(ids.fill_null(0)).astype(np.int64), np.asarray(ids.is_null())
    text = rows.column("text").combine_chunks()
    for row, end, data, offsets in X.pieces(text):
        s = Stretches(data, offsets, width, gram)
        named = ~null[row + s.rows]
        for name in ("first", "last", "rows", "anchor", "content"):
            setattr(s, name, getattr(s, name)[named])
        yield row, end, data, offsets, owner[row + s.rows], s


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every row: removed byte spans [start, end), kept bytes.

    With digest, kept_sha256 stands for kept.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    splits = R.splits(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n, turn = [], 0, 0
        for batch in batches:
            for _, _, _, _, ids, s in _pieces(pa.Table.from_batches([batch]), width, gram):
                kept.append((s.anchor, s.content, ids))
                n += len(ids)
                if n >= R.BLOCK // 4:
                    turn += 1
                    yield _ask(*map(np.concatenate, zip(*kept, strict=True)), splits, turn)
                    kept, n = [], 0
        if n:
            yield _ask(*map(np.concatenate, zip(*kept, strict=True)), splits, turn + 1)

    asked = rows.where("doc_id is not null").mapInArrow(send, "part long, kind long, blob binary")
    first = cut(asked.groupBy("part").applyInArrow(lambda t: _settle(t, splits), R.ANSWER), "stretches")
    dealt = rows.withColumn("bucket", R.bucket("doc_id", splits))

    # few strings are asked for: a bucket's go to fewer parts, so that lists stay long
    parts = max(1, splits // 8)

    def ask_strings(rows: pa.Table, found: pa.Table) -> pa.Table:
        known, out, turn = R.known_keys(found), [], 0
        for _, _, _, _, ids, s in _pieces(rows, width, gram):
            partly = R.among(_keys(s.anchor, s.content, ids, PARTLY), known)
            lead = R.among(_keys(s.anchor, s.content, ids, FIRST), known)
            starts, stretch = s.strings(np.flatnonzero(partly | lead))
            if len(starts):
                # a whole stretch's strings are sent twice: known to repeat
                again, hashes, owner = lead[stretch], s.string_hashes(starts), ids[stretch]
                out.append((np.concatenate([hashes, hashes[again]]), np.concatenate([owner, owner[again]])))
                turn = int(owner[0]) % parts
        if not out:
            return pa.table({"part": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        return pa.Table.from_batches([R.ask(*map(np.concatenate, zip(*out, strict=True)), parts, R.REPEATED, turn)])

    strings = dealt.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(ask_strings, R.ASK)
    replies = first.union(R.answers(strings, parts, splits, R.REPEATED))
    name = "kept_sha256" if digest else "kept"

    def judge(rows: pa.Table, found: pa.Table) -> pa.Table:
        known = R.known_keys(found)
        n_bytes, n_removed, spans, kept = [], [], [], []
        for row, end, data, offsets, ids, s in _pieces(rows, width, gram):
            whole = R.among(_keys(s.anchor, s.content, ids, WHOLE), known) | R.among(_keys(s.anchor, s.content, ids, FIRST), known)
            partly = np.flatnonzero(R.among(_keys(s.anchor, s.content, ids, PARTLY), known))
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, s.first[whole], 1)
            np.add.at(change, s.last[whole] + width, -1)
            if len(partly):
                starts, stretch = s.strings(partly)
                starts = starts[R.among(R.answer_keys(s.string_hashes(starts), ids[stretch]), known)]
                np.add.at(change, starts, 1)
                np.add.at(change, starts + width, -1)
            gone = np.cumsum(change[:-1]) > 0
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                lost, own = gone[a:b], data[a:b]
                turns = np.flatnonzero(np.diff(np.concatenate([[0], lost.view(np.int8), [0]])))
                left = (own[~lost] if len(turns) else own).tobytes()
                n_bytes.append(int(b - a)), n_removed.append(int(lost.sum()))
                spans.append([{"start": int(x), "end": int(y)} for x, y in turns.reshape(-1, 2)])
                kept.append(hashlib.sha256(left).hexdigest() if digest else left)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": rows.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, kind), name: pa.array(kept, pa.string() if digest else pa.binary())})

    schema = f"doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, {name} {'string' if digest else 'binary'}"
    return dealt.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(judge, schema)


def op5_byte_repeats(docs: DataFrame) -> DataFrame:
    return without_repeats(docs, digest=True).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: DuckDB SQL for the rows of op5_byte_repeats: every string of 200 bytes by its MD5, counted.
OP5_SQL = """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
pos AS (SELECT doc_id, b, unnest(range(1, greatest(octet_length(b) - 198, 1))) AS i FROM t),
s AS (SELECT doc_id, i, md5(array_slice(b, i, i + 199)) AS k FROM pos),
twice AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s SEMI JOIN twice USING (k)),
run AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
span AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM run GROUP BY doc_id, r),
edge AS (SELECT doc_id, a, z, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM span),
part AS (
  SELECT doc_id, a AS p, array_slice(b, before, a - 1) AS kept, z - a AS gone FROM edge JOIN t USING (doc_id)
  UNION ALL SELECT doc_id, z, array_slice(b, z, octet_length(b)), 0 FROM edge JOIN t USING (doc_id) WHERE next IS NULL
)
SELECT t.doc_id, octet_length(t.b) AS n_bytes, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed, count(*) FILTER (gone > 0) AS n_spans,
  sha256(unhex(coalesce(string_agg(hex(kept), '' ORDER BY p), hex(any_value(t.b))))) AS kept_sha256
FROM t LEFT JOIN part USING (doc_id) GROUP BY t.doc_id, octet_length(t.b)
"""
