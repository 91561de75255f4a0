"""Language ID by rank-order profiles: out-of-place distance between a text's and each language's most frequent n-grams.

N-grams are 1 to 3 code points of lower-cased words padded with one blank on either side; characters that are
not letters only separate words. Profiles hold the PROFILE most frequent n-grams of a language (ties by n-gram), counted
over all training rows; a text is ranked by all its n-grams and its PROFILE most frequent ones are compared.

Defined results: a null or letterless text gives `und` and score 0; rows without a language do not train; without any
training row every text is `und`; repeated rows count as often as they occur; ties of distance go to the language first
in code point order. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import small_batches
from .textops import give_back

PROFILE = 300
UNKNOWN = "und"
#: One profile row is 24 bytes; the table of profiles is sent to every executor only up to this many rows.
MAX_PROFILE_ROWS = 3_000_000
_CHUNK = 1 << 18
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > _CHUNK:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield start, texts[start:]


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram code) of every n-gram; a code packs up to three code points of 21 bits, a blank being 0."""
    lowered = [(t or "").lower() for t in texts]
    units = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    rows = np.concatenate([[0], rows])
    units[~_is_letter()[units]] = 0
    solid = units != 0
    one = np.flatnonzero(solid)
    two = np.flatnonzero(solid[:-1] | solid[1:])
    three = np.flatnonzero(solid[1:-1])
    codes = np.concatenate([units[one], (units[two] << 21 | units[two + 1]) | 1 << 62, (units[three] << 42 | units[three + 1] << 21 | units[three + 2])])
    return np.concatenate([rows[one], np.where(solid[two], rows[two], rows[two + 1]), rows[three + 1]]), codes


def _counted(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, code) with counts, ordered by row, then code."""
    vocabulary, ids = _dense(codes)
    keys = np.sort(rows.astype(np.int64) * len(vocabulary) + ids) if len(vocabulary) else rows.astype(np.int64)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return keys // max(1, len(vocabulary)), vocabulary[keys % max(1, len(vocabulary))] if len(vocabulary) else codes, counts


def _dense(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(codes)
    vocabulary = ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered
    return vocabulary, np.searchsorted(vocabulary, codes)


def gram_counts(training: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all rows of training; counted within each batch before the shuffle."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).dictionary_encode()
            langs, at = names.dictionary.to_pylist(), np.asarray(names.indices)
            texts = batch.column(0).to_pylist()
            found = []
            for start, part in _chunks(texts):
                rows, codes = _grams(part)
                found.append(_counted(at[start : start + len(part)][rows], codes))
            if found:
                r, c, n = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in r], pa.string()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])
        give_back()

    small_batches(training.sparkSession)
    counted = training.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null").mapInArrow(counts, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(training: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, gram, place): each language's most frequent n-grams, place from 0."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return gram_counts(training, text, lang).withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < size).select("lang", "gram", "place")


def identify(docs: DataFrame, profiles: DataFrame, text: str = "text", size: int = PROFILE, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two columns more, lang_pred and score (1 at distance 0, 0 where no n-gram is in the profile).

    Columns of docs with these names are replaced; `into` gives others.
    """
    learned = profiles.limit(MAX_PROFILE_ROWS + 1).toPandas()
    if len(learned) > MAX_PROFILE_ROWS:
        raise ValueError(f"more than {MAX_PROFILE_ROWS} profile rows: too many languages for one table")
    langs = sorted(learned["lang"].unique())
    vocabulary = np.unique(learned["gram"].to_numpy(np.int64))
    places = np.full((len(langs), len(vocabulary) + 1), size, np.int64)
    for i, name in enumerate(langs):
        own = learned[learned["lang"] == name]
        places[i, np.searchsorted(vocabulary, own["gram"].to_numpy(np.int64))] = own["place"]
    sent = docs.sparkSession.sparkContext.broadcast((langs, vocabulary, places))

    def judge(part: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, vocabulary, places = sent.value
        rows, codes, counts = _counted(*_grams(part))
        has = np.bincount(rows, minlength=len(part)) > 0
        order = np.lexsort((-counts, rows)) if len(rows) else rows
        rows, codes = rows[order], codes[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < size
        rows, codes, rank = rows[keep], codes[keep], rank[keep]
        at = np.searchsorted(vocabulary, codes)
        known = at < len(vocabulary)
        known[known] = vocabulary[at[known]] == codes[known]
        at = np.where(known, at, len(vocabulary))
        if not langs:
            return [UNKNOWN] * len(part), np.zeros(len(part))
        far = np.stack([np.bincount(rows, np.where(places[i][at] < size, np.abs(places[i][at] - rank), size), len(part)) for i in range(len(langs))])
        best = far.argmin(0)
        n = np.maximum(1, np.bincount(rows, minlength=len(part)))
        score = np.where(has, 1 - far.min(0) / (size * n), 0.0)
        return [langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.clip(score, 0, 1)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):
        import pandas as pd

        values = [t if isinstance(t, str) else None for t in texts]
        done = [judge(part) for _, part in _chunks(values)]
        return pd.DataFrame({"lang_pred": [x for d in done for x in d[0]], "score": np.concatenate([d[1] for d in done]) if done else np.zeros(0)})

    own = [F.col(c) for c in docs.columns if c not in into]
    found = docs.select(F.struct(*own).alias("doc"), predict(F.col(text)).alias("found"))
    return found.select("doc.*", F.col("found.lang_pred").alias(into[0]), F.col("found.score").alias(into[1]))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of ids that never trains."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def op7_language_id(docs: DataFrame) -> DataFrame:
    profiles = learn_profiles(docs.where(~held_out()).select("text", "lang"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def keep_known_language(docs: DataFrame) -> DataFrame:
    """docs without those whose language cannot be told (no letters, or no n-gram in common with any profile)."""
    profiles = learn_profiles(docs.where(~held_out()).select("text", "lang"))
    fresh = tuple(next(n for i in count() if (n := f"{c}{i}") not in docs.columns) for c in ("lang", "score"))
    found = identify(docs, profiles, into=fresh)
    return found.where((F.col(fresh[0]) != UNKNOWN) & (F.col(fresh[1]) > 0)).select(*docs.columns)
