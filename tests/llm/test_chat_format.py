import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.llm import chat_format as C

from .conftest import SF

KINDS = "prompt string, completion string, system string, instruction string, input string, output string, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    df = C.op13_chat_format(spark.read.parquet(f"{SF}/conversations.parquet"))
    want = con.execute(f"select {', '.join(df.columns)} from ({C.OP13_SQL})").fetchall()
    assert rows(df) == sorted(want, key=repr) and len(want) > 20


def test_no_python(spark):
    plan = C.op13_chat_format(spark.read.parquet(f"{SF}/conversations.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "BroadcastNestedLoop", "Cartesian"))


def test_odd_conversations(spark):
    long = "<|im_end|> é\\" * 20_000
    data = [
        (1, None, None, None, "x"),
        (1, 0, "assistant", "<|im_sep|>", "x"),
        (2, 1, "assistant", "b", "x"),
        (2, 0, "user", "a\n", "x"),
        (3, 0, "ro\n<|le", "<\\|<\\\\|<<|", "x"),
        (4, 0, "system", long, "x"),
        (4, 1, "user", "", "x"),
        (4, 2, "assistant", long, "x"),
        (5, 0, "system", "s", "x"),
        (5, 1, "assistant", "<|a", "x"),
        (5, 1, "assistant", "<|a", "x"),
        (5, 1, "assistant", None, "x"),
        (6, 0, "assistant", "", "x"),
        (None, 0, "user", "who", "x"),
        (-1, 0, "user", "mine", "x"),
    ]
    got = rows(C.op13_chat_format(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")))
    want = []
    for conv in {d[0] for d in data} | {"probe"}:
        own = [(0, "user", C.PROBE), (1, "assistant", C.PROBE)] if conv == "probe" else sorted(((-1 if d[1] is None else d[1], d[2] or "", hashlib.md5((d[3] or "").encode()).hexdigest(), d[3] or "") for d in data if d[0] == conv))
        learned = "".join(x[-1] for x in own if x[1] == "assistant")
        chars = sum(32 + sum(len(y) + sum(y.count("<" + "\\" * k + "|") for k in range(4)) for y in (x[1], x[-1])) for x in own)
        want.append((-1 if conv == "probe" else conv, len(own), sha("".join(f"{x[1]}\n{x[-1]}\n" for x in own)), len(learned), sha(learned), chars))
    assert got == sorted(want, key=repr)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in C.op13_chat_format(empty).collect()] == [-1]


def test_layouts(spark):
    data = [
        (1, ("p", "c", None, None, None, None, None, None)),
        (2, (None, None, None, "do", "this", "done", None, None)),
        (3, (None, None, "be kind", "do", None, "", None, None)),
        (4, (None, None, None, None, None, None, [("user", "a"), (None, None)], None)),
        (5, (None, None, None, None, None, None, None, [("human", "a"), ("gpt", "b"), ("tool", "c")])),
        (6, (None, None, None, None, None, None, [], None)),
        (7, ("p", None, None, None, None, "o", None, None)),
        (8, None),
    ]
    got = {r.k: (r.layout, r.turns and [tuple(t) for t in r.turns], r.paths) for r in C.canonical_turns(spark.createDataFrame(data, f"k int, record struct<{KINDS.replace(' ', ':').replace(',:', ',')}>")).collect()}
    assert got[1][:2] == ("prompt", [("user", "p"), ("assistant", "c")])
    assert got[2][:2] == ("instruction", [("user", "do\n\nthis"), ("assistant", "done")])
    assert got[3][:2] == ("instruction", [("system", "be kind"), ("user", "do"), ("assistant", "")])
    assert got[4][:2] == ("messages", [("user", "a"), ("", "")])
    assert got[5][:2] == ("share", [("user", "a"), ("assistant", "b"), ("tool", "c")])
    assert got[6][:2] == ("messages", [])
    assert got[7] == (None, None, "output\nprompt") and got[8] == (None, None, "")


def test_every_layout_is_used(spark):
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    found = {r.layout for r in C.canonical_turns(C.layouts_of(conversations)).select("layout").distinct().collect()}
    assert found <= {m.name for m in C.MAPPINGS} and len(found) >= 3


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(alphabet="<|\\a>im_end\n", max_size=25), min_size=1, max_size=20))
def test_escape_round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escape(F.col("t")).alias("e")).select("t", "e", C.unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r.u == r.t and "<|" not in r.e
