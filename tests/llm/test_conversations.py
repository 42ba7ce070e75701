"""Conversation repair against a search over all edits, on damaged and odd conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trackmill.llm import conversations, registry

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
PATTERN = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = re.sub("[\x20\x09-\x0d]+", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def damage(rows):
    """Rows of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def cheapest(rows):
    """Cost, audit and turns of the best edits: shortest paths over (rows used, role initials so far) as far as the pattern sees."""
    found = faults(rows)
    # state: (rows used, last initial) -> best (cost, audit, turns)
    done = {(0, ""): (0, "", ())}
    frontier = dict(done)
    for used in range(len(rows) + 1):
        here = {k: v for k, v in frontier.items() if k[0] == used}
        for _ in range(3):  # insertions before the next row
            for (_, last), (cost, audit, turns) in list(here.items()):
                role = "assistant" if last == "u" else "user"
                key, value = (used, role[0]), (cost + 3, audit + "I", turns + (f"{role}:",))
                if key not in here or value[:2] < here[key][:2]:
                    here[key] = value
        frontier.update(here)
        if used == len(rows):
            break
        (role, text), fault = rows[used], found[used]
        for (_, last), (cost, audit, turns) in here.items():
            moves = [("D", 4, None, last)]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                wanted = "assistant" if last == "u" else "user"
                initial = role[:1]
                if initial == wanted[0] or (initial == "s" and last == ""):
                    moves.append(("K", more, f"{role}:{text}", initial))
                moves.append(("R", 3 + more, f"{wanted}:{text}", wanted[0]))
            for letter, price, turn, now in moves:
                key = (used + 1, now)
                value = (cost + price, audit + letter, turns + ((turn,) if turn is not None else ()))
                if key not in frontier or value[:2] < frontier[key][:2]:
                    frontier[key] = value
    return min((frontier[k] for k in ((len(rows), ""), (len(rows), "a")) if k in frontier), key=lambda v: v[:2])


def everything(rows, most):
    """All edit strings of at most ``most`` letters, tried one by one."""
    found = faults(rows)
    best = None

    def go(at, cost, audit, turns, initials):
        nonlocal best
        if at == len(rows) and PATTERN.fullmatch(initials):
            best = min(best or (cost, audit, turns), (cost, audit, turns))
        if len(audit) == most or not re.match("s?(ua)*u?$", initials):
            return
        for role in ("user", "assistant"):
            go(at, cost + 3, audit + "I", turns + (f"{role}:",), initials + role[0])
        if at < len(rows):
            (role, text), fault = rows[at], found[at]
            go(at + 1, cost + 4, audit + "D", turns, initials)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                go(at + 1, cost + more, audit + "K", turns + (f"{role}:{text}",), initials + role[:1])
                for new in ("user", "assistant"):
                    go(at + 1, cost + 3 + more, audit + "R", turns + (f"{new}:{text}",), initials + new[0])

    go(0, 0, "", (), "")
    return best


def expected(conv, rows):
    after = damage(rows)
    turns = [t for t, _, _ in after if t is not None]
    pairs = [(r, t) for _, r, t in after]
    found = faults(pairs)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    cost, audit, repaired = cheapest(pairs)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
    return (conv, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest)


def by_conversation(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(tuple(row))
    return groups


def key(row):
    return tuple((x is None, x) for x in row)


def check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA) if isinstance(rows, list) else rows
    got = conversations.conversations_to_audits(frame)
    assert tuple(got.columns) == NAMES
    want = [expected(conv, group) for conv, group in by_conversation(frame.select("conv_id", "turn", "role", "text").collect()).items()]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def random_rows(seed, conversations_, longest, texts=("Yes.", "No", "", " \n", "Well!", "so?")):
    pick = random.Random(seed)
    rows = []
    for conv in range(conversations_):
        for turn in range(pick.randrange(longest + 1)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, turn * pick.choice([1, 1, 2]), role, pick.choice([*texts, None, f"Turn {turn}."])))
    return rows


def test_plain_search_equals_trying_everything():
    pick = random.Random(5)
    for _ in range(150):
        rows = [(pick.choice(["user", "assistant", "system", "x"]), pick.choice(["a.", "b", "", "a."])) for _ in range(pick.randrange(4))]
        assert cheapest(rows) == everything(rows, 2 * len(rows) + 2)


def test_random_conversations(spark):
    check(spark, random_rows(1, 400, 9))


def test_sample_table(spark):
    check(spark, spark.read.parquet(f"{FOLDER}/conversations.parquet"))


def test_query_reads_the_whole_table(spark):
    table = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    found = registry.QUERIES["op12_conversation_repair"](spark, FOLDER)
    assert found.count() == table.select("conv_id").distinct().count()


def test_state_crosses_batches(spark):
    """A long conversation over many Arrow batches; the partition holds others before and after it."""
    pick = random.Random(3)
    rows = [(7, t, pick.choice(["user", "assistant"]), pick.choice(["Same.", f"Text {t}.", f"cut {t}"])) for t in range(5000)]
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "37")
    try:
        check(spark, rows + random_rows(2, 60, 6))
    finally:
        spark.conf.set(setting, before)


def test_odd_rows(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, all rows gone, long texts and clashing columns."""
    gone = [t for t in range(200) if zlib.crc32(f"900:{t}".encode()) % 20 == 0][:3]
    rows = [(900, t, "user", "All gone.") for t in gone]
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (None, 1, "assistant", "x")]
    rows += [(5, None, "user", "No turn."), (5, None, "assistant", None), (6, 2, "user", "b."), (6, 2, "assistant", "a."), (6, 2, None, "c")]
    rows += [(8, 0, "user", "long " * 400_000 + "."), (8, 1, "assistant", "é" * 100_000), (9, -4, "system", "S."), (9, 4, "user", "\x85")]
    check(spark, rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("kind", "copy", "plan", "gone_", "audit", "conversation", "position"):
        frame = frame.withColumn(name, F.lit(name))
    check(spark, frame)


def test_text_ids(spark):
    rows = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes.")], "conv_id string, turn int, role string, text string")
    assert conversations.audits(rows).first()["audit"] == "KK"


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.conversations_to_audits(empty).collect() == []
    assert conversations.repaired_turns(empty).collect() == []


def test_repaired_turns(spark):
    rows = random_rows(11, 80, 8)
    frame = spark.createDataFrame([(c, t, r or "user", x or "Q.") for c, t, r, x in rows], SCHEMA)
    turns = defaultdict(list)
    for row in conversations.repaired_turns(frame).orderBy("conv_id", "position").collect():
        turns[row.conv_id].append((row.role, row.text))
    for row in conversations.audits(frame).collect():
        found = turns[row.conv_id]
        assert PATTERN.fullmatch("".join(r[0] for r, _ in found))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in found).encode()).hexdigest() == row.repaired_sha256


@pytest.mark.parametrize("seed", range(3))
def test_decisions_are_least(seed):
    """The dynamic program alone against the plain search, on long random conversations."""
    pick = random.Random(seed)
    for _ in range(100):
        pairs = [(pick.choice(["user", "assistant", "system", "x"]), pick.choice([f"t{i}.", f"t{i}", "", "t0."])) for i in range(pick.randrange(14))]
        costs, plans, kinds = conversations.END, [], []
        for (role, _), fault in zip(pairs, faults(pairs)):
            initial = "sua".find(role[0]) if role[0] in "sua" else 3
            kinds.append(conversations.FAULTS.index(fault or "none") * 4 + initial)
        for kind in reversed(kinds):
            costs, plan = conversations.step(costs, kind)
            plans.append(plan)
        rows = [conversations.Row("c", i, False, *pair, kind, plan) for i, (pair, kind, plan) in enumerate(zip(pairs, kinds, reversed(plans)))]
        audit = "".join(e.letter for _, edits in conversations.walk(iter(rows)) for e in edits)
        assert audit == cheapest(pairs)[1]
