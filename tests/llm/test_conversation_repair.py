import hashlib
import random
import re
import zlib
from itertools import groupby

from framewright.llm import conversation_repair as R

from .conftest import SF

ROLES = ["user", "assistant", "system", "tool", " ", "sage", "u", ""]
SCHEMA = "conv_id long, turn long, role string, text string, audit string"


def cheapest(rows):
    """Least (cost, initials, roles) over all edits, by exhausting them from the last row back. rows: (initial, must delete, cut)."""
    memo = {}

    def go(i, state, inserted):
        if (i, state, inserted) in memo:
            return memo[i, state, inserted]
        out = []
        if i == len(rows):
            if state in ("", "a"):
                out.append((0, "", ()))
        else:
            c, must, cut = rows[i]
            x = go(i + 1, state, 0)
            out.append((x[0] + 3, "D" + x[1], x[2]) if x else None)
            if not must:
                for letter, role, cost in [("K", c, 0), ("R", "u", 2), ("R", "a", 2)]:
                    if (state, role) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        x = go(i + 1, role, 0)
                        out.append((x[0] + cost + cut, letter + x[1], ((letter, role), *x[2])) if x else None)
        if inserted < 3:
            for role in "ua":
                if (state, role) in {("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    x = go(i, role, inserted + 1)
                    out.append((x[0] + 2, "I" + x[1], (("I", role), *x[2])) if x else None)
        memo[i, state, inserted] = min((x for x in out if x), default=None)
        return memo[i, state, inserted]

    return go(0, "", 0)


def brute(table):
    """The contract over (conv_id, turn, role, text) rows in plain Python."""
    alive = {}
    ordered = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], hashlib.md5((" " if r[3] is None else r[3]).encode()).hexdigest()))
    for (conv, turn), same in groupby(ordered, key=lambda r: r[:2]):
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        rows = [[turn, " " if r[2] is None else r[2], " " if r[3] is None else r[3]] for r in same]
        keep = alive.setdefault(conv, [])
        for row in rows:
            if code == 1:
                row[2] = ""
            if code == 2:
                row[2] = re.sub("[.!?]", "", row[2])
            if code == 4:
                row[1] = "user"
        if code == 3:
            rows = [r for _, g in groupby(rows) for r in list(g) * 2]
        if code != 0:
            keep.extend(rows)
    out = []
    for conv, rows in alive.items():
        turns, seen, judged = [r[0] for r in rows if r[0] is not None], set(), []
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            cut = bool(solid) and solid[-1] not in ".!?"
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if cut else None
            if fault:
                counts[fault] += 1
            seen.add((role, text))
            judged.append((role[:1], fault in ("blank", "duplicate"), cut))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit, edits = cheapest(judged)
        made, i = [], 0
        steps = iter(edits)
        for letter in audit:
            if letter == "D":
                i += 1
                continue
            _, role = next(steps)
            name = {"u": "user", "a": "assistant", "s": "system"}[role]
            made.append(f"{rows[i][1] if letter == 'K' else name}:{'' if letter == 'I' else rows[i][2]}")
            i += letter != "I"
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table(spark):
    for sf in (SF, SF.replace("0.001", "0.01")):
        table = spark.read.parquet(f"{sf}/conversations.parquet")
        want = brute([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
        assert rows_of(R.op12_conversation_repair(table)) == want and sum(r[6] for r in want) > 50


def test_random_conversations(spark):
    rng = random.Random(5)
    table = []
    for conv in range(400):
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice(["yes.", "no", "  ", "why?", f"t{turn}.", f"t{turn}", None, " a! \n"])
            table.append((conv, rng.choice([None, turn, turn, turn // 2, turn * 2]), rng.choice([*ROLES, None, "user", "assistant"]), text, "x"))
    table += [(None, 0, "user", "a.", "x"), (None, 1, "tool", "b.", "x"), table[0], table[0]]
    assert rows_of(R.op12_conversation_repair(spark.createDataFrame(table, SCHEMA))) == brute([r[:4] for r in table])


def test_states_against_exhaustion():
    rng = random.Random(11)
    for _ in range(4000):
        rows = [(rng.choice("suatx"), rng.random() < 0.3, rng.random() < 0.3) for _ in range(rng.randrange(0, 12))]
        repair, edits = R.Repair(), []
        for i, (c, must, cut) in enumerate(rows):
            edits += repair.add({"s": "system", "u": "user", "a": "assistant"}.get(c, c), str(i), must, cut)
        cost, rest = repair.end()
        want = cheapest(rows)
        assert (cost, "".join(e[0] for e in edits + rest)) == want[:2], rows


def test_memory_is_bounded():
    """Rows that leave no doubt are let go; a long run in doubt costs the same for each row."""
    repair, most = R.Repair(), 0
    for i in range(20_000):
        repair.add("user" if i % 7 else "tool", "x" * 10, i % 5 == 0, i % 3 == 0)
        most, todo = max(most, 0), [repair.root]
        n = 0
        while todo:
            n += 1
            todo += todo.pop().kids
        most = max(most, n)
        assert n < 200
    doubt, held = R.Repair(), 0
    for _ in range(30_000):
        held += len(doubt.add("tool", "t", False, False))
    cost, rest = doubt.end()
    assert cost == 60_000 and held + len(rest) == 30_000


def test_turns_and_odd_rows(spark):
    table = [(1, 0, "user", "hello.", "x"), (1, 1, "user", "again.", "x"), (1, 2, "user", "again.", "x"), (1, 3, "assistant", "é" * 300_000, "x"), (2, 0, "assistant", None, "x")]
    df = spark.createDataFrame(table, SCHEMA)
    got = [tuple(r)[:4] + (len(r.text) if r.text is not None else None,) for r in R.repaired_turns(df).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "K", "user", 6), (1, 1, "I", "assistant", 0), (1, 2, "K", "user", 6), (1, 3, "D", None, None), (1, 4, "K", "assistant", 300_000), (2, 0, "D", None, None)]
    report = {r.conv_id: r for r in R.repair_report(df).collect()}
    assert report[1].audit == "".join(g[2] for g in got if g[0] == 1) and report[1].duplicate == 1 and report[1].truncated == 1
    assert report[2].audit == "D" and report[2].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert R.op12_conversation_repair(df.limit(0)).count() == 0
