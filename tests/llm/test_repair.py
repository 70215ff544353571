"""Repair of conversations against a search of all edits, and blocks against whole conversations."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import repair as R

WHITE = " \t\n\x0b\x0c\r"
GRAMMAR = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, audit and text of the cheapest repair, by a search over all edits in order of cost and audit."""
    rows = ordered(rows)
    fault = faults(rows)
    heap, done = [(0, "", 0, "", "")], set()
    while heap:
        cost, audit, i, state, text = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, text
        if (i, state) in done:
            continue
        done.add((i, state))
        follow = GRAMMAR[state]
        for role in ("user", "assistant"):
            if role[0] in follow:
                heapq.heappush(heap, (cost + 2, audit + "I", i, role[0], f"{text}\n{role}:" if audit.strip("D") else f"{role}:"))
        if i < len(rows):
            _, role, body = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, text))
            if fault[i] not in ("blank", "duplicate"):
                ways = [("K", role, 0)] * (role[:1] in follow) + [("R", r, 2) for r in ("user", "assistant") if r[0] in follow]
                for edit, name, more in ways:
                    line = f"{name}:{body}"
                    heapq.heappush(heap, (cost + more + (fault[i] == "truncated"), audit + edit, i + 1, name[0], f"{text}\n{line}" if audit.strip("D") else line))


def expected(rows):
    rows = ordered(rows)
    fault = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, text = cheapest(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def some_rows(rng, most):
    roles, texts = ["user", "assistant", "system", "user", "assistant", " ", "tool", ""], ["a.", "b", "c!", " ", "", "d?", "é. \n", "f", "g "]
    return [(rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(1, most))]


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(8)
    return {c: some_rows(rng, 12 if c % 4 else 30) for c in range(150)}


def collected(df):
    return {r["conv_id"]: tuple(r)[1:9] for r in df.collect()}


def frame(spark, found):
    return spark.createDataFrame([(c, *r) for c, rows in found.items() for r in rows], "conv_id long, turn long, role string, text string")


def test_repairs_against_a_search(spark, conversations):
    want = {c: expected(rows) for c, rows in conversations.items()}
    turns = frame(spark, conversations).withColumns({"key": F.lit(1), "block": F.lit("x"), "rows": F.lit(2), "cost": F.lit(0)})
    assert collected(R.repair_conversations(turns.repartition(6))) == want
    texts = R.repair_conversations(turns, with_text=True).collect()
    assert all(hashlib.sha256(r.repaired.encode()).hexdigest() == r.repaired_sha256 for r in texts)


def test_blocks_give_the_same(spark, conversations, monkeypatch):
    want = {c: expected(rows) for c, rows in conversations.items()}
    want[None] = want.pop(3)
    turns = frame(spark, conversations).withColumn("conv_id", F.when(F.col("conv_id") != 3, F.col("conv_id")))
    for rows, size in ((3, 1 << 20), (7, 1 << 20), (1000, 4)):
        monkeypatch.setattr(R, "BLOCK_ROWS", rows)
        monkeypatch.setattr(R, "BLOCK_BYTES", size)
        assert collected(R.repair_conversations(turns)) == want


def test_a_long_conversation(spark):
    rows = [(t, ("user", "assistant")[(t + t // 50) % 2], f"{t}." if t % 9 else "twice.") for t in range(3000)]
    got = collected(R.repair_conversations(frame(spark, {1: rows, 2: rows[:3]})))
    block = R.Block([(*r, False) for r in rows])
    price = block.prices(R._AT_END, True)
    audit, _ = block.trace(0, price, True)
    assert got[1][5:7] == (price[0][0], audit) and len(audit.replace("I", "")) == 3000
    assert got[1][7] == hashlib.sha256("\n".join(block.repaired(0, audit)).encode()).hexdigest()


def test_damage_and_empty_conversations(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a. b! c?", "x", None, ""])) for c in range(60) for t in range(rng.randrange(1, 5))]
    rows += [(None, None, None, None), (None, 3, "user", "q."), *rows[:4]]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "lost."))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    want = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        want[c] += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: expected(r) if r else nothing for c, r in want.items()}
    got = R.op13_repair(spark, f"file://{tmp_path}")
    assert want[gone] == nothing and collected(got) == want
    assert R.repair_conversations(got.select("conv_id", F.lit(1).alias("turn"), F.lit("a").alias("role"), F.lit("b").alias("text")).limit(0)).count() == 0


def test_tables_are_swept(spark):
    from saltmarsh.llm import common

    since = common.mark()
    kept, gone = (common.saved(spark.range(5), n) for n in ("kept-here", "gone"))
    common.sweep(spark, since, "kept-here")
    assert kept.count() == 5 and common.mark() == since + 1
    with pytest.raises(Exception):
        gone.count()
    common.sweep(spark, since)


def test_groups_grow_with_the_square_root_of_the_text():
    from saltmarsh.llm import near_dedup

    assert near_dedup.dealing(0) == (1, 1) and near_dedup.dealing(10**9) == (239, 80)
    for volume in (10**12, 10**14):
        groups, ranges = near_dedup.dealing(volume)
        assert volume / 6 / groups / ranges >= 0.9 * near_dedup.ASKED_AT_ONCE and volume / groups <= 150e6
