"""Token ids in binary shards, with a minimal perfect hash index from document keys to shard offsets.

Documents are dealt by ranges of their key and sorted, and every task writes one shard: a 24-byte header, then the raw
little-endian ids of its documents, one after another. The index is dealt into buckets by key hash. A bucket holds levels
of bitmaps (a key that alone has its bit on a level stops there), so the number of bits before a key's own is its slot; at
the slot lie a 32-bit fingerprint, shard, offset and length. A look-up hashes, counts bits and compares the fingerprint:
its time does not depend on the number of documents.

Defined results: a null text is empty and holds only the end id; rows with a null key come first; rows that repeat a key
are kept as occurrence 0, 1, ... of the key, in the order of their texts (of the first LEADING characters where the key goes
over several shards, as a frequent one does); an empty table gives no shards; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, shared_dir
from .textops import give_back, mix, pieces

MAGIC = b"IDSHARD1"
HEADER = "<8sIIQ"  # magic, bytes of an id, 0, ids
SHARD_BYTES = 32 << 20
BUCKET_KEYS = 1000
#: Distinct parts of texts, and distinct tokenizer words, whose ids a worker remembers; beyond that it starts afresh.
REMEMBERED, REMEMBERED_WORDS = 400_000, 400_000
#: Bytes of text that are encoded at once.
PIECE = 4 << 20
#: Characters of a text that deal rows of one key over shards.
LEADING = 32
#: Fixed value: the tokenizer's own cut of a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 2
#: Blanks beyond ASCII; texts that hold any go to the tokenizer as a whole.
_FAR_BLANKS = "[\u0085\u00a0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_encoders: dict = {}


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer.

    The tokenizer cuts a text before every single blank between two other characters, and ids of a part between cuts do
    not depend on what surrounds it. Arrow finds the distinct parts of a piece of texts, each new one goes to the
    tokenizer once (further cut into the tokenizer's words, where all characters are Latin), and numpy lays the
    remembered ids out in the order of the texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        shape = json.loads(self.tokenizer.to_str())
        first = shape.get("pre_tokenizer") or {}
        #: Other tokenizers than byte-level BPE get whole texts.
        self.by_words = shape["model"]["type"] == "BPE" and not shape.get("normalizer") and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
        special = "|".join(re.escape(t["content"]) for t in shape["added_tokens"])
        self.special = re.compile(special) if special else None
        #: A part of letters only is one of the tokenizer's words, where no special token may lie in it.
        self.letters_only = not any(t["content"].replace(" ", "").isalpha() for t in shape["added_tokens"])
        self.model, self.cut = self.tokenizer.model, regex.compile(WORDS).findall
        # byte-level BPE writes printable bytes as themselves and numbers the others from 256 on
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(256 + i) for i, b in enumerate(others)}
        self.words: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _remember(self, parts: list[str], ids: list[bytes]) -> None:
        flat, n = np.frombuffer(b"".join(ids), self.kind), len(self.known)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), self.kind)])
        while n + len(parts) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.starts, self.sizes))
        sizes = np.array([len(x) // self.kind.itemsize for x in ids], np.int64)
        self.starts[n : n + len(parts)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + len(parts)] = sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.update(zip(parts, range(n, n + len(parts)), strict=True))

    def _whole(self, texts: list[str]) -> Iterator[bytes]:
        for a in range(0, len(texts), 5000):
            for e in self.tokenizer.encode_batch_fast(texts[a : a + 5000], add_special_tokens=False):
                yield np.array(e.ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()
        letters = word.replace(" ", self.letters[32]) if plain else word.encode().decode("latin-1").translate(self.letters)
        ids = array(self.kind.char, [t.id for t in self.model.tokenize(letters)])
        if sys.byteorder != "little":
            ids.byteswap()
        ids = self.words[word] = ids.tobytes()
        return ids

    def _learn(self, parts: list[str]) -> None:
        words, cut, special, plain, ids, strange = self.words, self.cut, self.special, [], [], []
        for x in parts:
            # a part without its blank first may be the start of a text: words are the same
            if not x or not (x.isascii() or max(x) < "\u0250"):
                strange.append(x)
            elif self.letters_only and (x[1:] if x[0] == " " else x).isalpha():
                plain.append(x)
                ids.append(words.get(x) or self._word(x))
            elif special and special.search(x):
                strange.append(x)
            else:
                plain.append(x)
                ids.append(b"".join([words.get(w) or self._word(w) for w in cut(x)]))
        self._remember(plain, ids)
        self._remember(strange, list(self._whole(strange)))

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where the ids of each part are remembered."""
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(names) > REMEMBERED:
            self._forget()
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        places = list(map(self.known.get, names))
        new = [i for i, at in enumerate(places) if at is None]
        self._learn([names[i] for i in new])
        for i in new:
            places[i] = self.known[names[i]]
        return np.array(places, np.int64)[np.asarray(coded.indices)]

    def _laid_out(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts, one after another, and their numbers."""
        n = self.sizes[places]
        return self.ids[np.repeat(self.starts[places] - np.cumsum(n) + n, n) + np.arange(n.sum())], n

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each text), each text with end_id last, for some consecutive texts at once."""
        texts = texts.fill_null("")
        for row, end, data, offsets in pieces(texts, PIECE):
            rows = end - row
            whole = np.asarray(pc.match_substring_regex(texts.slice(row, rows), _FAR_BLANKS)) if self.by_words else np.ones(rows, bool)
            if whole.any():
                # rare: the other texts by parts, these as a whole
                blobs = [np.zeros(0, self.kind)] * rows
                for i in np.flatnonzero(~whole):
                    ids, _ = self._by_parts(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                    blobs[i] = ids
                at = np.flatnonzero(whole)
                for i, ids in zip(at, self._whole(texts.slice(row, rows).take(pa.array(at)).to_pylist()), strict=True):
                    blobs[i] = np.frombuffer(ids, self.kind)
                sizes = np.array([len(x) for x in blobs], np.int64)
                ids = np.concatenate(blobs)
            else:
                ids, sizes = self._by_parts(data, offsets)
            yield np.insert(ids, np.cumsum(sizes), np.array(end_id, self.kind)), sizes + 1

    def _by_parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        solid, cut = ~_BLANK[data], np.zeros(len(data) + 1, bool)
        cut[1 : len(data) - 1] = (data[1:-1] == 32) & solid[:-2] & solid[2:] if len(data) > 2 else False
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        parts = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        ids, n = self._laid_out(self._places(parts)) if len(parts) else (np.zeros(0, self.kind), np.zeros(0, np.int64))
        before = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(edges, offsets)]
        return ids, np.diff(before)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def key_hash(keys: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) ^ mix(occurrences.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


class PerfectHash:
    """A minimal perfect hash of 64-bit key hashes: levels of bitmaps, and the keys set before each level."""

    LEVELS = 40

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.before = [np.concatenate([[0], np.cumsum(x)]) for x in levels]
        self.base = np.concatenate([[0], np.cumsum([x.sum() for x in levels])]).astype(np.int64)

    @staticmethod
    def place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes + np.uint64((level + 1) * 0xD1B54A32D192ED03 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray, load: float = 1.6) -> PerfectHash:
        levels, rest = [], hashes
        while len(rest) and len(levels) < cls.LEVELS:
            size = max(8, int(load * len(rest)))
            at = cls.place(rest, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels, np.sort(rest))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash; a hash that was never put in may get any slot, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for i, bits in enumerate(self.levels):
            at = self.place(hashes[open_], i, len(bits))
            here = bits[at]
            out[open_[here]] = self.base[i] + self.before[i][at[here]]
            open_ = open_[~here]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, hashes[open_]), len(self.rest) - 1)
            hit = self.rest[at] == hashes[open_]
            out[open_[hit]] = self.base[-1] + at[hit]
        return out

    def dump(self) -> bytes:
        head = struct.pack("<II", len(self.levels), len(self.rest)) + b"".join(struct.pack("<Q", len(x)) for x in self.levels)
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels) + self.rest.astype("<u8").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        n, rest = struct.unpack_from("<II", raw)
        sizes = struct.unpack_from(f"<{n}Q", raw, 8)
        at, levels = 8 + 8 * n, []
        for size in sizes:
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(levels, np.frombuffer(raw, "<u8", rest, at))


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write docs' ids under folder; (shard_no, shard, key, occurrence, first, n_tokens) of every document.

    A shard's name holds the writing attempt, and rows name the shard they were written to: a repeated task never
    touches another's file, and files of lost tasks are named by no row.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    placed = rows.withColumn("leading", F.substring("text", 1, LEADING)).withColumn("row", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(max(1, -(-total // shard_bytes)), "key", "leading", "row").select("key", "text").sortWithinPartitions("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, coder = TaskContext.get().partitionId(), encoder(tokenizer)
        store, path = _files(folder)
        store.create_dir(path, recursive=True)
        name = f"shard-{number:06d}-{uuid.uuid4().hex}.ids"
        keys, sizes, out = [], [], None
        for batch in batches:
            keys += batch.column(0).to_pylist()
            for ids, n in coder.encode(batch.column(1), end_id):
                out = out or store.open_output_stream(f"{path}/{name}.body")
                out.write(ids.tobytes())
                sizes += n.tolist()
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{path}/{name}.head") as head:
            head.write(struct.pack(HEADER, MAGIC, coder.kind.itemsize, 0, sum(sizes)))
        occurrence = np.zeros(len(keys), np.int64)
        for i in range(1, len(keys)):
            occurrence[i] = occurrence[i - 1] + 1 if keys[i] == keys[i - 1] else 0
        n = np.array(sizes, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([number] * len(n), pa.int64()), pa.array([name] * len(n)), pa.array(keys, pa.int64()), pa.array(occurrence), pa.array(np.cumsum(n) - n), pa.array(n)], ["shard_no", "shard", "key", "occurrence", "first", "n_tokens"])
        give_back()

    manifest = cut(dealt.mapInArrow(write, "shard_no long, shard string, key long, occurrence long, first long, n_tokens long"), "manifest")
    return _counted_on(manifest)


def _counted_on(manifest: DataFrame) -> DataFrame:
    """manifest with occurrences that go on where a key goes on in the next shard; a window sees one row a shard."""
    named = F.struct(F.col("key").isNotNull(), "key")
    ends = manifest.groupBy("shard_no").agg(F.min(named).alias("low"), F.max(named).alias("high"))
    on = cut(ends.withColumn("last", F.lag("high").over(Window.orderBy("shard_no"))).where("low = last").select(F.col("low.key").alias("key")).distinct(), "goes_on")
    if on.isEmpty():
        return manifest
    on = F.broadcast(on)  # at most a key a shard
    some = manifest.join(on, manifest["key"].eqNullSafe(on["key"]), "left_semi").groupBy("key", "shard_no").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("shard_no").rowsBetween(Window.unboundedPreceding, -1))
    before = F.broadcast(cut(some.select(F.col("key").alias("_key"), F.col("shard_no").alias("_shard_no"), before.alias("_before")), "before"))
    joined = manifest.join(before, manifest["key"].eqNullSafe(before["_key"]) & (F.col("shard_no") == F.col("_shard_no")), "left")
    return cut(joined.select(*[(F.col("occurrence") + F.coalesce("_before", F.lit(0))).alias(c) if c == "occurrence" else F.col(c) for c in manifest.columns]), "manifest")


def _with_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("key", F.lit(0)), "occurrence", F.col("key").isNull()), F.lit(buckets)))


def _hashes(rows: pd.DataFrame) -> np.ndarray:
    null = rows["key"].isna().to_numpy()
    return key_hash(rows["key"].fillna(0).to_numpy(np.int64), np.where(null, -1 - rows["occurrence"], rows["occurrence"]))


def build_index(manifest: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """(bucket, hash, fingerprints, shards, names, firsts, sizes) and the number of buckets."""
    buckets = max(1, -(-manifest.count() // bucket_keys))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        hashes = _hashes(rows)
        table = PerfectHash.build(hashes)
        order = np.empty(len(rows), np.int64)
        order[table.slots(hashes)] = np.arange(len(rows))
        rows, hashes = rows.iloc[order], hashes[order]
        names, at = np.unique(rows["shard"].to_numpy(str), return_inverse=True)
        return pd.DataFrame({"bucket": [int(rows["bucket"].iloc[0])], "hash": [table.dump()], "fingerprints": [(mix(hashes) >> np.uint64(32)).astype("<u4").tobytes()], "shards": [at.astype("<u4").tobytes()], "names": [list(names)], "firsts": [rows["first"].to_numpy("<i8").tobytes()], "sizes": [rows["n_tokens"].to_numpy("<i8").tobytes()]})

    dealt = _with_bucket(manifest, buckets).groupBy("bucket")
    return cut(dealt.applyInPandas(build, "bucket long, hash binary, fingerprints binary, shards binary, names array<string>, firsts binary, sizes binary"), "index"), buckets


def look_up(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """(key, occurrence, shard, first, n_tokens) of the keys (key, occurrence) that the index holds."""

    def find(_, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if not len(entry) or not len(rows):
            return pd.DataFrame({"key": [], "occurrence": [], "shard": [], "first": [], "n_tokens": []})
        e, hashes = entry.iloc[0], _hashes(rows)
        slot = PerfectHash.load(e["hash"]).slots(hashes)
        marks = np.frombuffer(e["fingerprints"], "<u4")
        good = slot >= 0
        good[good] = marks[slot[good]] == (mix(hashes[good]) >> np.uint64(32)).astype(np.uint32)
        slot, rows = slot[good], rows[good]
        return pd.DataFrame({"key": rows["key"], "occurrence": rows["occurrence"], "shard": np.array(e["names"], object)[np.frombuffer(e["shards"], "<u4")[slot]], "first": np.frombuffer(e["firsts"], "<i8")[slot], "n_tokens": np.frombuffer(e["sizes"], "<i8")[slot]})

    asked = _with_bucket(keys.select("key", "occurrence"), buckets)
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, "key long, occurrence long, shard string, first long, n_tokens long")


def read_ids(entries: DataFrame, folder: str) -> DataFrame:
    """entries with ids_crc32: each document's ids read back from its shard."""

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        store, path = _files(folder)
        name = rows["shard"].iloc[0]
        with store.open_input_stream(f"{path}/{name}.head") as head:
            magic, width, _, _ = struct.unpack(HEADER, head.read())
        if magic != MAGIC:
            raise ValueError(f"{name} is no shard of ids")
        rows = rows.sort_values("first")
        sums = []
        with store.open_input_file(f"{path}/{name}.body") as body:
            for first, n in zip(rows["first"], rows["n_tokens"], strict=True):
                body.seek(int(first) * width)
                ids = np.frombuffer(body.read(int(n) * width), f"<u{width}")
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
        return rows.assign(ids_crc32=sums)[["key", "occurrence", "shard", "first", "n_tokens", "ids_crc32"]]

    return entries.groupBy("shard").applyInPandas(read, "key long, occurrence long, shard string, first long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write docs as shards with an index, look every key up and read it back.

    Returns (doc_id, start, n_tokens, ids_crc32, occurrence, shard); start counts the ids of all documents before it.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = folder or f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    manifest = write_shards(docs, folder, tokenizer, key, text, end_id)
    index, buckets = build_index(manifest)
    read = read_ids(look_up(manifest.select("key", "occurrence"), index, buckets), folder)
    shards = manifest.groupBy("shard", "shard_no").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = cut(shards.select("shard", before.alias("before")), "begins")
    return read.join(begins, "shard").select(F.col("key").alias("doc_id"), (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "occurrence", "shard")


def op2_token_store(docs: DataFrame) -> DataFrame:
    return token_store(docs)
