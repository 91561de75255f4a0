import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from framewright.llm import prefix_trie as T

from .conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, place string, depth string"


def rows_of(df):
    return sorted((tuple(r) for r in df.select(T.COLUMNS).collect()), key=repr)


def nodes_of(convs):
    """The contract over {conv_id: [(role, text)]} in plain Python."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in own if len(convs[c]) == len(path))
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        parent = min(members[path[:-1]]) if path else None
        children = sum(len(p) == len(path) + 1 for p in below)
        out.append((min(own), len(path), parent, len(own), children, leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def read(table):
    convs = defaultdict(list)
    for c, turn, role, text in table:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    return {c: [(x[2], x[4]) for x in sorted(own)] for c, own in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def random_table(seed):
    rng = random.Random(seed)
    table = []
    for c in range(3, 160):
        if c % 10 != 5 or rng.random() < 0.5:
            for turn in range(rng.choice([1, 2, 4, 9, 12])):
                table.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é" * 50, None, ""]) if turn < 6 else f"{rng.randrange(3)}", "x", "y"))
    return [*table, (None, 0, "user", "a", "x", "y"), table[0], table[0]]


def test_whole_table_against_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = rows_of(T.op11_prefix_trie(table))
    assert got == sorted(con.execute(f"select {', '.join(T.COLUMNS)} from ({T.OP11_SQL})").fetchall(), key=repr)
    assert got == nodes_of(rebuilt(read([tuple(r) for r in table.collect()]))) and any(r[3] > 1 and r[1] > 1 for r in got)


def test_random_conversations(spark):
    table = random_table(1)
    df = spark.createDataFrame(table, SCHEMA).repartition(7)
    convs = read([r[:4] for r in table])
    assert rows_of(T.op11_prefix_trie(df)) == nodes_of(rebuilt(convs))
    want = nodes_of(convs)
    assert rows_of(T.prefix_trie(df)) == want
    assert rows_of(T.prefix_trie(df, most=64)) == want
    assert T.op11_prefix_trie(df.limit(0)).count() == 0


def test_sketch_never_counts_too_little(spark):
    table = [(c, t, "user", f"{c // 2 if t < 3 else c} {t}", "x", "y") for c in range(400) for t in range(6)]
    turns = T.numbered(spark.createDataFrame(table, SCHEMA))
    lengths = turns.groupBy("conv_id").count().withColumnRenamed("count", "n")
    rows = T.screened(T.cut(T.chains(turns.join(lengths, "conv_id")), "chains"))
    found = [(r.place, r.shared) for r in rows.collect()]
    assert all(shared for place, shared in found if place <= 3)
    assert sum(not shared for place, shared in found if place > 3) > 1100
    assert T.width(0) == 1 << 16 and T.width(1 << 20) == 1 << 22 and T.width(1 << 40) == T.CELLS


def test_a_long_conversation_and_its_copy(spark):
    """Digests of one conversation come from many partitions; a third of all rows are in it."""
    table = [(c, t, "user", f"word {t}" * (1 if t else 10_000), "x", "y") for c in (10, 11) for t in range(900)] + [(c, 0, "user", "hello", "x", "y") for c in range(20, 900)]
    got = rows_of(T.prefix_trie(spark.createDataFrame(table, SCHEMA).repartition(5)))
    root = next(r for r in got if r[1] == 0)
    assert len(got) == 902 and root[3:7] == (882, 2, 2, 879 * 5 + sum(len(f"word {t}" * (1 if t else 10_000)) for t in range(900)))
    assert next(r for r in got if r[0] == 20)[3] == 880
