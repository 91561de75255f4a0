"""Repair of conversation structure by Viterbi with survivor coalescence.

A conversation is put right when its role initials are `(s?(ua)+)?`. Keeping a row costs nothing, giving it the role of user or
assistant 2, deleting it 3 (which blank and repeated rows need), inserting an empty turn of user or assistant 2; a truncated
row that stays adds 1. Of the cheapest edits the ASCII-least string of initials (D, I, K, R) is taken.

The four states (nothing yet, system, user, assistant last) each keep one survivor in a tree of backpointers that count what hangs on them.
Once all survivors share an ancestor, the edits up to it are emitted and forgotten, so a conversation streams through with
the rows since that ancestor in memory. Survivors of equal cost are compared over their whole unresolved edits: two that
have eaten the same rows differ at some edit, or one has insertions more, and either stays so when both grow, so it is enough
to carry the order of each two along. `nothing` and `system` are given up when `assistant` is so much cheaper
that no ending can make up for it.

A repeated row is one whose role and text stand earlier in its conversation. The first place of each text is found by an
aggregation that combines before the shuffle, and travels as a row of its own beside the texts, so no task keeps the texts of a
conversation. Rows of one conversation meet in one task, one after another, because each edit depends on those before.

Defined results: rows are put in order of turn (nulls first), role and MD5 of the text; a null role or text is a space, so it is no
legal role, and blank; a null conv_id is a conversation of its own; repeated rows of the table are repeated turns; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import small_batches

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
REROLED = {NOTHING: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\v\f\r"
TO_USER, TO_ASSISTANT = ("I", "user", ""), ("I", "assistant", "")
#: What may be inserted from each state, with the state it leads to.
INSERTS = {
    NOTHING: ((USER, (TO_USER,)), (ASSISTANT, (TO_USER, TO_ASSISTANT))),
    SYSTEM: ((USER, (TO_USER,)), (ASSISTANT, (TO_USER, TO_ASSISTANT))),
    USER: ((ASSISTANT, (TO_ASSISTANT,)),),
    ASSISTANT: ((USER, (TO_USER,)),),
}


class Node:
    """An edit (initial, role, text) after those of its parent."""

    __slots__ = ("edit", "parent", "kids", "held")

    def __init__(self, edit: tuple | None, parent: Node | None):
        self.edit, self.parent, self.kids, self.held = edit, parent, [], 0
        if parent is not None:
            parent.kids.append(self)


def _order(x: str, y: str) -> int | tuple[str, str]:
    """-1 or 1 if x or y is less whatever follows both; else what each has beyond the other."""
    if x.startswith(y) or y.startswith(x):
        return x[len(y) :], y[len(x) :]
    return -1 if x < y else 1


class Repair:
    """The cheapest edits of one conversation, row after row. Edits are given back as soon as they are certain."""

    def __init__(self) -> None:
        self.root = Node(None, None)
        self.root.held = 1
        self.costs, self.nodes = {NOTHING: 0}, {NOTHING: self.root}
        self.orders: dict = {}

    def _compare(self, x: tuple, y: tuple) -> int | tuple[str, str]:
        """Order of two candidates (cost, state they grow from, new edits, their initials)."""
        known = ("", "") if x[1] == y[1] else self.orders[x[1], y[1]]
        return _order(known[0] + x[3], known[1] + y[3]) if isinstance(known, tuple) else known

    def _better(self, x: tuple, y: tuple | None) -> tuple:
        if y is None or x[0] != y[0]:
            return x if y is None or x[0] < y[0] else y
        return x if self._compare(x, y) == -1 else y

    def _inserted(self) -> dict[int, tuple]:
        """The best candidate of each state when insertions may come next."""
        best: dict[int, tuple] = {s: (c, s, (), "") for s, c in self.costs.items()}
        for s, c in self.costs.items():
            for to, edits in INSERTS[s]:
                best[to] = self._better((c + 2 * len(edits), s, edits, "I" * len(edits)), best.get(to))
        if ASSISTANT in best:
            least = best[ASSISTANT][0]
            if NOTHING in best and best[NOTHING][0] > least + 3:
                del best[NOTHING]
            if SYSTEM in best and best[SYSTEM][0] > least:
                del best[SYSTEM]
        return best

    def add(self, role: str, text: str, delete: bool, truncated: bool) -> list[tuple]:
        """Take the next row; the edits that are certain now."""
        found: dict[int, tuple] = {}
        initial = role[:1]
        for s, (cost, origin, edits, letters) in self._inserted().items():
            found[s] = self._better((cost + 3, origin, (*edits, ("D", None, None)), letters + "D"), found.get(s))
            if delete:
                continue
            cost += truncated
            if (to := STEPS.get((initial, s))) is not None:
                found[to] = self._better((cost, origin, (*edits, ("K", role, text)), letters + "K"), found.get(to))
            new, to = REROLED[s]
            found[to] = self._better((cost + 2, origin, (*edits, ("R", new, text)), letters + "R"), found.get(to))
        self._grow(found)
        return self._certain()

    def _grow(self, found: dict[int, tuple]) -> None:
        orders = {(s, t): self._compare(x, y) for s, x in found.items() for t, y in found.items() if s != t}
        before, nodes = self.nodes, {}
        for s, (_, origin, edits, _) in found.items():
            node = before[origin]
            for edit in edits:
                node = Node(edit, node)
            node.held += 1
            nodes[s] = node
        for node in before.values():
            node.held -= 1
            while node is not self.root and not node.held and not node.kids:
                node.parent.kids.remove(node)
                node = node.parent
        self.costs, self.nodes, self.orders = {s: x[0] for s, x in found.items()}, nodes, orders

    def _certain(self) -> list[tuple]:
        out = []
        while len(self.root.kids) == 1 and not self.root.held:
            self.root = self.root.kids[0]
            self.root.parent = None
            out.append(self.root.edit)
        return out

    def end(self) -> tuple[int, list[tuple]]:
        """The whole cost, and the edits that were not certain before."""
        best, last = self._inserted(), None
        for s in (NOTHING, ASSISTANT):
            if s in best:
                last = self._better(best[s], last)
        self._grow({0: last})
        return last[0], self._certain()


class Conversation:
    """Faults, edits and digest of one conversation as its rows pass by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.repair = conv_id, Repair()
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None
        self.letters: list[str] = []
        self.sha, self.some, self.place = hashlib.sha256(), False, 0

    def add(self, turn: int | None, role: str, text: str, first: bool) -> list[tuple]:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        solid = text.rstrip(BLANKS)
        blank, cut = not solid, bool(solid) and solid[-1] not in ".!?"
        self.blank += blank
        self.duplicate += not blank and not first
        self.truncated += not blank and first and cut
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        return self.repair.add(role, text, blank or not first, cut)

    def note(self, edits: list[tuple]) -> None:
        for letter, role, text in edits:
            self.letters.append(letter)
            if letter != "D":
                self.sha.update(f"\n{role}:{text}".encode() if self.some else f"{role}:{text}".encode())
                self.some = True

    def summary(self, cost: int) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.letters), self.sha.hexdigest())

    def placed(self, edits: list[tuple]) -> list[tuple]:
        self.place += len(edits)
        return [(self.conv_id, self.place - len(edits) + i, *e) for i, e in enumerate(edits)]


SUMMARY = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
EDITS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
BATCH = 2_000
#: Characters of texts after which a batch of edits goes out, however few they are.
BATCH_CHARS = 1 << 20


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a conversation one after another, each text's first occurrence right after a row that says so."""
    digest = F.md5("text")
    firsts = rows.where("text is not null").groupBy("conv_id", "role", digest.alias("_digest")).agg(F.min(F.struct("turn", *order)).alias("_at"))
    firsts = firsts.select("conv_id", "_at.*", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = firsts.unionByName(rows.select("conv_id", "turn", *order, F.lit(1).alias("kind"), "role", "text"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "turn", *order, "kind").select("conv_id", "turn", "kind", "role", "text")


def _walk(rows: DataFrame, order: list[str], schema: pa.Schema) -> DataFrame:
    """One row per conversation, or per edit. Rows with a null text only say that the conversation is there."""
    small_batches(rows.sparkSession)
    whole = schema is SUMMARY

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, out, chars = None, False, [], 0

        def take(edits: list[tuple]) -> None:
            nonlocal chars
            if whole:
                at.note(edits)
            else:
                out.extend(at.placed(edits))
                chars += sum(len(e[2] or "") for e in edits)

        def close() -> None:
            nonlocal chars
            if at is not None:
                cost, edits = at.repair.end()
                take(edits)
                if whole:
                    out.append(at.summary(cost))
                    chars += len(out[-1][7])

        for batch in batches:
            for conv_id, turn, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or conv_id != at.conv_id:
                    close()
                    at, first = Conversation(conv_id), False
                if kind == 0:
                    first = True
                elif text is not None:
                    take(at.add(turn, role, text, first))
                    first = False
                if len(out) >= BATCH or chars > BATCH_CHARS:
                    yield _batch(out, schema)
                    out, chars = [], 0
        close()
        if out:
            yield _batch(out, schema)

    kinds = {pa.int64(): "long", pa.string(): "string"}
    return _in_order(rows, order).mapInArrow(work, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def _plain(conversations: DataFrame) -> tuple[DataFrame, list[str]]:
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), role.alias("_role"), F.md5(text).alias("_text"))
    return rows, ["_role", "_text"]


def repair_report(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
    return _walk(*_plain(conversations), SUMMARY)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): every edit in order; role and text are null for deleted rows."""
    return _walk(*_plain(conversations), EDITS)


def damaged(conversations: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with seeded faults, and what puts rows of one turn in order. A dropped row stays with a null text."""
    rows, order = _plain(conversations)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code = F.col("_code")

    def changed() -> tuple[Column, Column]:
        text = F.when(code == 1, "").when(code == 2, F.translate("text", ".!?", "")).when(code != 0, F.col("text"))
        return F.when(code == 4, "user").otherwise(F.col("role")), text

    role, text = changed()
    copies = F.sequence(F.lit(1), F.when(code == 3, 2).otherwise(1))
    done = rows.withColumn("_code", F.crc32(key) % 20).withColumn("_copy", F.explode(copies)).withColumn("role", role).withColumn("text", text).drop("_code")
    return done, [*order, "_copy"]


def op12_conversation_repair(conversations: DataFrame) -> DataFrame:
    return _walk(*damaged(conversations), SUMMARY)
