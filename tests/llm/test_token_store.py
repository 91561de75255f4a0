import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from framewright.llm import token_store as T
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, T.END_ID]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 '\n\t.é  ᠎中's<|endoftext>", max_size=40))
def test_parts_encode_as_the_whole(text):
    coder = T.encoder(PATH)
    (got, sizes), = coder.encode(pa.array([text, None, text + " ", "x y"]), T.END_ID)
    want = [ids(t) for t in (text, "", text + " ", "x y")]
    assert got.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 50, 3000):
        hashes = T.mix(np.arange(n, dtype=np.uint64) + np.uint64(99))
        table = T.PerfectHash.load(T.PerfectHash.build(hashes).dump())
        assert sorted(table.slots(hashes)) == list(range(n))


def test_round_trip(documents):
    got = T.op2_token_store(documents.repartition(3)).collect()
    start, want = 0, {}
    for r in sorted(documents.collect(), key=lambda r: r.doc_id):
        x = np.array(ids(r.text), "<u4")
        want[r.doc_id] = (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_unknown_keys_are_not_found(documents, spark, tmp_path):
    manifest = T.write_shards(documents, f"file://{tmp_path}", PATH)
    index, buckets = T.build_index(manifest)
    asked = spark.createDataFrame([(3, 0), (3, 1), (10**9, 0), (None, 0)], "key long, occurrence long")
    assert [(r.key, r.occurrence) for r in T.look_up(asked, index, buckets).collect()] == [(3, 0)]


def test_odd_rows(odd):
    rows = sorted(T.op2_token_store(odd).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3, 4, 5, 6, 7]
    assert [r.n_tokens for r in rows[1:3]] == [1, 1] and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert T.op2_token_store(odd.limit(0)).count() == 0


def test_one_key_over_several_shards(spark, tmp_path):
    rows = [(7, f"text {i % 50}") for i in range(2000)] + [(None, "none")] * 500 + [(i, "one more") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = T.write_shards(docs, f"file://{tmp_path}/ids", PATH, shard_bytes=2000).collect()
    assert len({r.shard for r in manifest if r.key == 7}) > 2
    for key, n in ((7, 2001), (None, 500)):
        assert sorted(r.occurrence for r in manifest if r.key == key) == list(range(n))
    got = T.token_store(docs, folder=f"file://{tmp_path}/more").collect()
    assert len(got) == len(rows) and sum(r.n_tokens for r in got) == sum(len(ids(t)) for _, t in rows)
