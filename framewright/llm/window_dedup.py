"""Substring dedup by fixed windows: Rabin-Karp hashes of every `width` words, counted in Spark.

A window is removed when its words also start in a document with a smaller id; removed windows of a document merge
into maximal intervals. Windows are judged on the input, whatever else is removed.

Defined results: a null text has no words; a document without removed words keeps all; fewer than `width` words have no
window; rows with a null doc_id neither remove nor lose words; rows that repeat a doc_id never remove each other's
words; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeat_filter as R
from . import textops as X

WIDTH = 13


def word_windows(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each word, first word of each window, hash of each window)."""
    for row, end, data, offsets in X.pieces(texts):
        starts, ends, rows = X.word_spans(data, offsets)
        at, hashes = X.windows(X.word_hashes(data, starts, ends), rows, width)
        yield row, end, rows, at, hashes


def repeated_windows(docs: DataFrame, doc_id: str, text: str, width: int) -> tuple[DataFrame, DataFrame]:
    """docs with their bucket, and the answers of each bucket."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    splits = R.splits(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = R.Blocks(splits, R.EARLIER)
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for row, _, rows, at, hashes in word_windows(batch.column(1), width):
                yield from blocks.add(hashes, ids[row + rows[at]])
        yield from blocks.end()

    asked = rows.where("doc_id is not null").mapInArrow(send, R.ASK)
    return rows.withColumn("bucket", R.bucket("doc_id", splits)), R.answers(asked, splits, splits, R.EARLIER)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, intervals, kept) of every row: intervals of removed words [start, end), kept text.

    With digest, kept_sha256 stands for kept.
    """
    dealt, replies = repeated_windows(docs, doc_id, text, width)
    kept_name = "kept_sha256" if digest else "kept"

    def judge(rows: pa.Table, found: pa.Table) -> pa.Table:
        known, ids = R.known_keys(found), rows.column("doc_id").combine_chunks()
        texts = rows.column("text").combine_chunks()
        owner, null = np.asarray(ids.fill_null(0)).astype(np.int64), np.asarray(ids.is_null())
        n_words, n_removed, intervals, kept = [], [], [], []
        for row, end, words, at, hashes in word_windows(texts, width):
            of = row + words[at]
            hit = R.among(R.answer_keys(hashes, owner[of]), known) & ~null[of]
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, at[hit], 1)
            np.add.at(change, at[hit] + width, -1)
            gone = np.cumsum(change[:-1]) > 0
            edges = np.searchsorted(words, np.arange(end - row + 1))
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                own = (texts[row + i].as_py() or "").encode().split()
                lost = gone[a:b]
                turns = np.flatnonzero(np.diff(np.concatenate([[0], lost, [0]])))
                text_kept = b" ".join(compress(own, ~lost) if len(turns) else own)
                n_words.append(len(own)), n_removed.append(int(lost.sum()))
                intervals.append([{"start": int(s), "end": int(e)} for s, e in turns.reshape(-1, 2)])
                kept.append(hashlib.sha256(text_kept).hexdigest() if digest else text_kept.decode())
        spans = pa.array(intervals, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table({"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "intervals": spans, kept_name: pa.array(kept, pa.string())})

    schema = f"doc_id long, n_words long, n_removed long, intervals array<struct<start:long,end:long>>, {kept_name} string"
    return dealt.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(judge, schema)


def op8_window_dedup(docs: DataFrame) -> DataFrame:
    return without_repeats(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: DuckDB SQL for the rows of op8_window_dedup.
OP8_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
place AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM texts),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS k FROM place WHERE i + 12 <= len(ws)),
least_doc AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM win JOIN least_doc USING (k), range(13) r(j) WHERE m < doc_id),
judged AS (SELECT p.doc_id, p.i, p.ws[p.i] AS word, g.i IS NOT NULL AS lost FROM place p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i),
kept AS (SELECT doc_id, count(*) FILTER (lost) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT lost) AS kept FROM judged GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (doc_id)
"""
