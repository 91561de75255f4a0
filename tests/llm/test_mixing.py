import heapq

from framewright.llm import mixing as M
from pyspark.sql import functions as F

from .conftest import words


def brute_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, total, target = set(names), share * sum(sizes.values()), {}
    while left:
        level = total / sum(weight[s] for s in left)
        over = {s for s in left if most * sizes[s] <= level * weight[s]}
        if not over:
            return target | {s: level * weight[s] for s in left}
        for s in over:
            target[s] = float(most * sizes[s])
            total -= target[s]
        left -= over
    return target


def test_targets_and_taken(documents):
    docs = documents.withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    rows = M.op3_source_mixing(docs).join(docs.select("doc_id", "text", "source"), "doc_id").collect()
    sizes, taken = {}, {}
    for r in rows:
        assert r.size == len(words(r.text)) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = brute_targets(sizes, M.WEIGHTS, M.SHARE, M.MOST)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 2
    again = {r.doc_id: r.taken for r in M.op3_source_mixing(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_quotas_are_highest_quotients(spark):
    targets = [("a", 10_000, 5.0, 9000.0), ("b", 900, 2.0, 1234.5), ("c", 300, 1.0, 600.0), (None, 50, 5.0, 100.0), ("d", 0, 2.0, 0.0)]
    got = {}
    for r in M.shard_quotas(spark.createDataFrame(targets, "source string, source_size long, weight double, target double"), shards=5, block=16, least_blocks=4).collect():
        got[r.shard, r.source] = r.blocks
        block = r.block
    heap = [(-t, s is None, s or "", 0, t) for s, _, _, t in targets if t]
    heapq.heapify(heap)
    total, seats = sum(t[3] for t in targets), dict.fromkeys((t[0] for t in targets), 0)
    for k in range(1, 6):
        while sum(seats.values()) < int(total * k / 5 / block + 1e-9):
            _, null, s, n, t = heapq.heappop(heap)
            seats[None if null else s] += 1
            heapq.heappush(heap, (-t / (2 * n + 3), null, s, n + 1, t))
        assert {s: got[k, s] for s in seats} == seats


def test_texts_hold_the_words_taken(documents):
    plan = {r.doc_id: r.taken for r in M.mixed(documents).collect()}
    out = {}
    mix = M.mixed_texts(documents)
    assert mix.columns == documents.columns
    for r in mix.collect():
        out[r.doc_id] = out.get(r.doc_id, 0) + len(words(r.text))
    assert out == {d: n for d, n in plan.items() if n}


def test_odd_rows(odd):
    rows = M.op3_source_mixing(odd).collect()
    assert len(rows) == 9 and {(r.doc_id, r.taken) for r in rows if not r.size} == {(1, 0), (2, 0)}
    assert M.mixed_texts(odd).columns == odd.columns
    assert M.mixed_texts(odd).where("doc_id is null").count() >= 1
    assert M.op3_source_mixing(odd.limit(0)).count() == 0


def test_shards_get_their_quotas(documents):
    """Every shard's words of a source are its quota of blocks, and a document's shares are the words taken of it."""
    rows = M.mixed(documents).collect()
    sized = documents.select("source", M.n_words("text").alias("size"))
    quotas, block = {}, None
    for r in M.shard_quotas(M.source_targets(sized)).collect():
        quotas[r.source, r.shard], block = r.blocks, r.block
    got, total = {}, {}
    for r in rows:
        total[r.source] = r.source_size
        assert sum(p.words for p in r.dealt) == r.taken and all(0 <= p.first and p.first + p.words <= r.size and 1 <= p.shard <= M.SHARDS for p in r.dealt)
        for p in r.dealt:
            got[r.source, p.shard] = got.get((r.source, p.shard), 0) + p.words
        spans = [(p.copy, p.first, p.first + p.words) for p in r.dealt]
        assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(sorted(spans), sorted(spans)[1:], strict=False))
    for (source, k), blocks in quotas.items():
        ends = [min(quotas.get((source, i), 0) * block, M.MOST * total[source]) for i in (k - 1, k)]
        assert got.get((source, k), 0) == ends[1] - ends[0], (source, k)
    assert len({k for _, k in got}) == M.SHARDS
    parts = {r.doc_id: r.shards for r in M.op3_source_mixing(documents).collect()}
    assert all(sum(int(x.split(":")[1]) for x in parts[r.doc_id].split(",") if x) == r.taken for r in rows)
