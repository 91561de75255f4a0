"""Chat formatting: the fingerprint of a record's nested field paths selects the mapping that turns it into canonical turns.

A record is a struct that may hold several layouts side by side, as `spark.read.json` infers it from mixed files: fields that
a record does not use are null. The paths that it does use, sorted and hashed, are its fingerprint; every declared mapping
lists the fingerprints of its required and optional paths, and the one that matches says where roles and texts stand. All of it
is column expressions on one row; nothing is parsed and nothing leaves the JVM.

The template is `<|im_start|>role<|im_sep|>text<|im_end|>` for each turn. In roles and texts, `<|` with any backslashes between
gets one more of them, so no control string is left inside and taking one away again gives the text back.

Defined results: null roles and texts inside a layout count as empty; a null record, or one whose paths fit no mapping, keeps
its row with its paths, a null layout and no turns; records are neither merged nor dropped; rows that tie in turn are put in order
of role and MD5 of the text; rows with a null conv_id are one conversation. A conversation becomes one string, so it may hold
2 GB at most, whatever the number of its turns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions.binding import bind

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED = ("assistant",)
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    Either `each` names an array of structs with fields `role` and `text`, with other names for roles in `names`; or `turns`
    lists (role, paths): the texts at these paths, joined by blank lines, make one turn, left out where all are missing.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: str = ""
    role: str = "role"
    text: str = "content"
    names: tuple[tuple[str, str], ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def fingerprints(self) -> Iterable[tuple[str, ...]]:
        for k in range(len(self.optional) + 1):
            for more in combinations(self.optional, k):
                yield tuple(sorted(self.required + more))


MAPPINGS = (
    Mapping("messages", ("messages[]",), ("messages[].role", "messages[].content"), each="messages"),
    Mapping("share", ("conversations[]",), ("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value", names=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt", ("prompt", "completion"), ("system",), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
)


def nested_paths(kind: DataType, path: str = "") -> list[tuple[str, Callable[[Column], Column]]]:
    """(path, test whether a value of this type holds it) of every field below; a list counts as a path of its own."""
    if isinstance(kind, StructType):
        inner = [(f.name, p, test) for f in kind.fields for p, test in nested_paths(f.dataType, f"{path}.{f.name}" if path else f.name)]
        return [(p, _of_field(name, test)) for name, p, test in inner]
    if isinstance(kind, ArrayType):
        inner = nested_paths(kind.elementType, f"{path}[]") if isinstance(kind.elementType, StructType | ArrayType) else []
        return [(f"{path}[]", Column.isNotNull)] + [(p, _of_any(test)) for p, test in inner]
    return [(path, Column.isNotNull)]


def _of_field(name: str, test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda value: test(value.getField(name))


def _of_any(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda value: F.coalesce(F.exists(value, lambda x: test(x)), F.lit(False))


def paths_of(kind: DataType, record: Column) -> Column:
    """The paths that a record holds, sorted, one on a line."""
    held = sorted(nested_paths(kind), key=lambda x: x[0])
    return F.array_join(F.array(*[F.when(test(record), F.lit(path)) for path, test in held]).cast("array<string>"), "\n")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _canonical(mapping: Mapping, record: Column, has: set[str]) -> Column:
    if mapping.each:
        renamed = lambda role: F.coalesce(*[F.when(role == a, F.lit(b)) for a, b in mapping.names], role)

        def field(x: Column, name: str) -> Column:
            return _text(x.getField(name)) if f"{mapping.each}[].{name}" in has else F.lit("")

        return F.transform(record.getField(mapping.each), lambda x: F.struct(renamed(field(x, mapping.role)).alias("role"), field(x, mapping.text).alias("text"))).cast(TURNS)
    made = []
    for role, paths in mapping.turns:
        texts = [record.getField(p).cast("string") for p in paths if p in has]
        if texts:
            made.append(F.when(F.coalesce(*texts).isNotNull(), F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *texts).alias("text"))))
    return F.filter(F.array(*made), lambda x: x.isNotNull()).cast(TURNS)


def canonical_turns(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with paths, layout (the mapping's name, or null) and turns; the record's own column is dropped."""
    kind = records.schema[record].dataType
    has = {p for p, _ in nested_paths(kind)}
    known = {}
    for m in mappings:
        for paths in m.fingerprints():
            if known.setdefault(paths, m) is not m:
                raise ValueError(f"{m.name} and {known[paths].name} have a layout in common: {paths}")
    at = records.withColumn("paths", paths_of(kind, F.col(record))).withColumn("_print", fingerprint(F.col("paths")))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in mappings:
        prints = [fingerprint(F.lit("\n".join(p))) for p, of in known.items() if of is m and set(p) <= has]
        if prints:
            fits = F.col("_print").isin(*prints)
            layout, turns = F.when(fits, F.lit(m.name)).otherwise(layout), F.when(fits, _canonical(m, F.col(record), has)).otherwise(turns)
    return at.withColumn("layout", layout).withColumn("turns", turns).drop("_print", record)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def format_turns(records: DataFrame, turns: str = "turns", learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """records with formatted, and loss: for each turn the characters [start, end) that are learned, none where start = end."""
    marks = len(START) + len(SEP)
    cut = F.transform(turns, lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), t["role"].isin(*learned).alias("learned")))
    rows = records.withColumn("_cut", cut)
    formatted = F.array_join(F.transform("_cut", lambda t: F.concat(F.lit(START), t["role"], F.lit(SEP), t["text"], F.lit(END))), "")
    sizes = F.transform("_cut", lambda t: F.struct((F.length(t["role"]) + marks).cast("long").alias("head"), F.length(t["text"]).cast("long").alias("body"), t["learned"].alias("learned")))
    starts = _starts(F.transform("_sizes", lambda s: s["head"] + s["body"] + len(END)))
    loss = F.zip_with("_sizes", "_starts", lambda s, at: F.struct((at + s["head"]).alias("start"), (at + s["head"] + F.when(s["learned"], s["body"]).otherwise(F.lit(0))).alias("end")))
    return rows.withColumn("formatted", formatted).withColumn("_sizes", sizes).withColumn("_starts", starts).withColumn("loss", loss).drop("_cut", "_sizes", "_starts")


def _starts(lengths: Column) -> Column:
    """Where each of consecutive pieces begins."""
    sums = F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, F.lit(-1)) + n)))
    return bind(sums, lambda s: F.slice(s, F.lit(1), F.size(s) - 1))


def read_turns(formatted: Column, loss: Column) -> Column:
    """The turns of a formatted string as (role, text, learned): what stands under the loss mask, unescaped."""
    parts = F.transform(F.filter(F.split(formatted, r"\Q" + END + r"\E", -1), lambda x: x != ""), lambda x: F.split(F.substring(x, F.lit(len(START) + 1), F.length(x)), r"\Q" + SEP + r"\E", -1))
    marks = len(START) + len(SEP)

    def read(cut: Column) -> Column:
        starts = _starts(F.transform(cut, lambda p: (F.length(p[0]) + F.length(p[1]) + marks + len(END)).cast("long")))
        placed = F.arrays_zip(cut.alias("p"), starts.alias("at"), loss.alias("mask"))
        return F.transform(placed, lambda x: _read_one(x["p"], x["at"], x["mask"], marks))

    return bind(parts, read)


def _read_one(part: Column, at: Column, mask: Column, marks: int) -> Column:
    text_at = at + F.length(part[0]) + marks
    learned = F.substring(part[1], (mask["start"] - text_at + 1).cast("int"), (mask["end"] - mask["start"]).cast("int"))
    return F.struct(unescape(part[0]).alias("role"), unescape(part[1]).alias("text"), unescape(learned).alias("learned"))


def format_chats(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Heterogeneous records to (other columns, paths, layout, formatted, loss)."""
    return format_turns(canonical_turns(records, record, mappings)).drop("turns")


def layouts_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, record) of a table of turns, in the layout that suits each conversation's roles.

    A user's turn with its answer is a prompt with its completion; with a system's turn before them, an instruction; other
    conversations of these three roles that begin with a system's turn are shared conversations; all others are messages.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.select("conv_id", F.struct(F.col("turn"), role.alias("role"), F.md5(text).alias("digest"), text.alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    pair, triple = F.array(*map(F.lit, ("user", "assistant"))), F.array(*map(F.lit, ("system", "user", "assistant")))
    usual = F.forall(F.col("roles"), lambda x: x.isin("system", "user", "assistant"))
    which = F.when(F.col("roles") == pair, 1).when(F.col("roles") == triple, 2).when(usual & (F.col("roles")[0] == "system"), 3).otherwise(4)
    names = lambda x: F.when(x == "user", "human").when(x == "assistant", "gpt").otherwise(x)
    kind = F.col("kind")
    at = lambda k, i: F.when(kind == k, F.get("t", F.lit(i))["text"])
    record = F.struct(
        at(1, 0).alias("prompt"),
        at(1, 1).alias("completion"),
        at(2, 0).alias("system"),
        at(2, 1).alias("instruction"),
        F.lit(None).cast("string").alias("input"),
        at(2, 2).alias("output"),
        F.when(kind == 3, F.transform("t", lambda x: F.struct(names(x["role"]).alias("from"), x["text"].alias("value")))).alias("conversations"),
        F.when(kind == 4, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("messages"),
    )
    return turns.withColumn("roles", roles).withColumn("kind", which).select("conv_id", record.alias("record"))


#: What conversation -1 says in both turns.
PROBE = f"{END}{START}assistant ok"


def op13_chat_format(conversations: DataFrame) -> DataFrame:
    """Digests of every conversation, and of conversation -1 that speaks in control strings, read back from the output."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = rows.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    done = format_chats(layouts_of(rows).unionByName(layouts_of(probe)))
    back = done.withColumn("turns", read_turns(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = back.withColumn("learned", F.array_join(F.transform("turns", lambda t: t["learned"]), ""))
    return learned.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP13_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, 0 AS probe FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{PROBE}', 1 FROM range(2) r(i)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START) + len(SEP) + len(END)} + length(regexp_replace(role, '<(\\\\*)\\|', '<\\1\\\\|', 'g')) + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g'))) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id, probe
"""
