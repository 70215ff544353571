"""Cheapest repair of conversations by the auction algorithm for shortest paths.

A conversation's rows and the states of the roles' grammar ``(s?(ua)+)?`` make a lattice: node (i, state) is "i rows done".  An edit
is an arc with an integer cost: Keep, Rerole, Delete go to the next row's nodes, Insert to another node of the same row.  Every node
has a price, at first a lower bound of what is left to pay.  The path begins at an origin and grows along an arc whose cost is the
difference of its ends' prices; where there is none, the end's price rises to the least that an arc asks for, and the path loses that node.
Origins are taken from the last row back, and prices stay from one to the next, so a path ends as soon as it meets a node that
an earlier one settled: a few steps a node.  Settled prices are exact, so the arcs without slack are those of cheapest paths, and the
least audit follows by taking, node by node, the tight arc of the least initial: from no node do two arcs of one initial lead on.

Conversations of more than BLOCK_ROWS rows, or of much text, are cut into blocks by their turns.  Each block prices its ways from every
state in to every state out, the blocks of a conversation make a lattice of the same kind, and with the prices at its end known
each block is traced from every state.  Only the last step, which hashes the repaired text in order, passes a conversation
through one task, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, saved, table

INF = float("inf")
#: Costs of the edits, and what a truncated row costs beside, unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A conversation of more rows, or of more bytes of text, is worked on in blocks; the most blocks that its turns are cut into.
BLOCK_ROWS, BLOCK_BYTES, MOST_BLOCKS = 512, 1 << 22, 1024

#: States of the grammar: nothing yet, after s, after u, after a.  What a role's initial leads to, and where a conversation may end.
_NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
_MADE = ["user", "user", "assistant", "user"]
_AT_END = [0, INF, INF, 0]
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\x0b\x0c\r"

_Arc = tuple[str, int, bool, int]  # initial, cost, whether it stays on the row, state that it leads to


def settle(arcs: list[list[_Arc]], after: list[float], dead: tuple[int, ...] = ()) -> list[float]:
    """Prices of a row's nodes by the auction from each as an origin; ``after`` are the settled prices of the next row's nodes.

    arcs[s] leave node s.  Nodes in ``dead`` lead nowhere.  Costs are not negative, and no circle of arcs costs nothing.
    """
    price = [INF if s in dead else min(after) for s in range(len(arcs))]  # no arc asks for less, so no slack is negative
    settled = [s in dead for s in range(len(arcs))]
    for origin in range(len(arcs)):
        path = [origin]
        while not settled[origin]:
            end = path[-1]
            least, stays, to = min(((cost + (price[to] if stays else after[to]), stays, to) for _, cost, stays, to in arcs[end]), default=(INF, False, 0))
            if price[end] < least:
                price[end] = least
                if len(path) > 1:
                    path.pop()
            elif stays and least < INF and not settled[to]:
                path.append(to)
            else:  # it meets the next row, or a node that is settled: the path's prices are exact
                for s in path:
                    settled[s] = True
    return price


class Block:
    """Some rows (turn, role, text, later) of a conversation in order; ``later``: role and text were seen in an earlier block."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        self.blank = self.duplicate = self.truncated = 0
        seen: set[tuple[str, str]] = set()
        self.arcs: list[list[list[_Arc]]] = []
        for _, role, text, later in rows:
            body = text.rstrip(_SPACE)
            again, more = later or (role, text) in seen, 0
            seen.add((role, text))
            if not body:
                self.blank += 1
            elif again:
                self.duplicate += 1
            elif body[-1] not in ".!?":
                self.truncated += 1
                more = TRUNCATED
            self.arcs.append(self._leaving(role[:1], not body or again, more))
        turns = {r[0] for r in rows if r[0] is not None}
        self.turns, self.least, self.most = len(turns), min(turns, default=None), max(turns, default=None)
        starts = [r[1][:1] for r in rows]
        self.illegal = sum(a + b not in _LEGAL for a, b in zip(starts, starts[1:]))
        self.first, self.last = starts[0], starts[-1]

    @staticmethod
    def _leaving(initial: str, must_go: bool, more: int) -> list[list[_Arc]]:
        """Arcs of a row's nodes, by initial."""
        out = []
        for s, follow in enumerate(_NEXT):
            made = follow[_MADE[s][0]]
            arcs = [("D", DELETE, False, s), ("I", INSERT, True, made)]
            if not must_go:
                if initial in follow:
                    arcs.append(("K", more, False, follow[initial]))
                arcs.append(("R", REROLE + more, False, made))
            out.append(arcs)
        return out

    def prices(self, leave: list[float], closes: bool) -> list[list[float]]:
        """Prices of the nodes before each row, and of those behind the last, when leaving in a state costs ``leave``.

        closes: the conversation ends here, and rows may be inserted behind the last.
        """
        # After an s, u or a there is no way back to nothing, nor to s after u or a: no circle of insertions may wait for one.
        dead = () if min(leave[2:]) < INF else (2, 3)
        stay = [[("I", INSERT, True, follow[_MADE[s][0]])] * closes + [("", 0, False, s)] for s, follow in enumerate(_NEXT)]
        out = [settle(stay, leave, dead)]
        for arcs in reversed(self.arcs):
            out.append(settle(arcs, out[-1], dead))
        return out[::-1]

    def matrix(self) -> list[int | None]:
        """What it costs to pass the block from state s to state e, at 4 * s + e; null where there is no way."""
        by_exit = [self.prices([0 if e == x else INF for x in range(4)], False)[0] for e in range(4)]
        return [None if by_exit[e][s] == INF else int(by_exit[e][s]) for s in range(4) for e in range(4)]

    def trace(self, state: int, price: list[list[float]], closes: bool) -> tuple[str, int]:
        """The least audit from a state along arcs without slack, and the state in which it leaves."""
        audit: list[str] = []
        for i, arcs in enumerate(self.arcs):
            stays = True
            while stays:
                here = price[i][state]
                name, stays, state = next((n, st, to) for n, cost, st, to in arcs[state] if cost + (price[i][to] if st else price[i + 1][to]) == here)
                audit.append(name)
        while closes and price[-1][state] != _AT_END[state]:
            audit.append("I")
            state = _NEXT[state][_MADE[state][0]]
        return "".join(audit), state

    def repaired(self, state: int, audit: str) -> Iterator[str]:
        """The rows ``role:text`` that an audit from a state leaves."""
        at = 0
        for edit in audit:
            if edit == "I":
                yield f"{_MADE[state]}:"
                state = _NEXT[state][_MADE[state][0]]
                continue
            _, role, text, _ = self.rows[at]
            at += 1
            if edit != "D":
                role = role if edit == "K" else _MADE[state]
                yield f"{role}:{text}"
                state = _NEXT[state][role[0]]


class Summary:
    """What is said of a conversation, gathered block by block in order."""

    NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def __init__(self):
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.least = self.most = self.last = None
        self.audit: list[str] = []
        self.digest, self.any = hashlib.sha256(), False

    def add(self, block: Block, state: int, audit: str) -> None:
        for name in ("turns", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(block, name))
        if block.turns:
            self.least = block.least if self.least is None else self.least
            self.most = block.most
        self.illegal += self.last is not None and self.last + block.first not in _LEGAL
        self.last = block.last
        self.audit.append(audit)
        for line in block.repaired(state, audit):
            self.digest.update((("\n" if self.any else "") + line).encode())
            self.any = True

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def _result(keys: pa.Array, rows: list[tuple], more: tuple[str, pa.Array] | None = None) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)]
    return pa.RecordBatch.from_arrays([keys, *columns, *([more[1]] if more else [])], names=["key", *_NAMES, *([more[0]] if more else [])])


def _rows(cell: pa.Scalar) -> list[tuple]:
    return [(r["turn"], r["role"], r["text"], r.get("later", False)) for r in cell.as_py()]


def _whole(part: pa.RecordBatch) -> pa.RecordBatch:
    """Conversations of one block each: (key, rows)."""
    out, texts = [], []
    for cell in part.column(1):
        block, found = Block(_rows(cell)), Summary()
        price = block.prices(_AT_END, True)
        audit, _ = block.trace(0, price, True)
        found.cost = int(price[0][0])
        found.add(block, 0, audit)
        out.append(found.row())
        texts.append("\n".join(block.repaired(0, audit)))
    return _result(part.column(0), out, ("repaired", pa.array(texts, pa.string())))


def _matrices(part: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([Block(_rows(c)).matrix() for c in part.column(2)], pa.list_(pa.int64()))], names=["key", "block", "matrix"])


def _leaving_prices(part: pa.RecordBatch) -> pa.RecordBatch:
    """Of conversations (key, blocks with their matrices): (key, block, leave, closes), the prices at each block's end."""
    owner, number, leave, closes = [], [], [], []
    behind = settle([[("I", INSERT, True, follow[_MADE[s][0]]), ("", 0, False, s)] for s, follow in enumerate(_NEXT)], _AT_END)
    for i, cell in enumerate(part.column(1)):
        price = behind
        blocks = sorted(cell.as_py(), key=lambda b: b["block"])
        for b in reversed(blocks):
            last = b is blocks[-1]
            owner.append(i)
            number.append(b["block"])
            leave.append([None if x == INF else int(x) for x in (_AT_END if last else price)])
            closes.append(last)
            price = settle([[("", int(c), False, e) for e, c in enumerate(b["matrix"][4 * s : 4 * s + 4]) if c is not None] for s in range(4)], price)
    return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int64()), pa.array(leave, pa.list_(pa.int64())), pa.array(closes)], names=["key", "block", "leave", "closes"])


def _traces(part: pa.RecordBatch) -> pa.RecordBatch:
    """Of blocks (key, block, rows, leave, closes): audits and states at the end for each state at the beginning, and the price of the first."""
    audits, exits, costs = [], [], []
    for cell, leave, closes in zip(part.column(2), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
        block = Block(_rows(cell))
        price = block.prices([INF if x is None else x for x in leave], closes)
        found = [block.trace(s, price, closes) for s in range(4)]
        audits.append([a for a, _ in found])
        exits.append([e for _, e in found])
        costs.append(int(price[0][0]))
    return pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int64())), pa.array(costs, pa.int64())], names=["key", "block", "rows", "audits", "exits", "cost"])


def _chained(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its traced blocks in order; holds a block at a time."""
    key: pa.Array | None = None
    found, state = Summary(), 0
    for part in parts:
        for i in range(part.num_rows):
            one = part.slice(i, 1)
            if key is not None and one.column(0)[0].as_py() != key[0].as_py():
                yield _result(key, [found.row()])
                key = None
            if key is None:
                key, found, state = one.column(0), Summary(), 0
                found.cost = one.column(5)[0].as_py()
            audit = one.column(3)[0][state].as_py()
            found.add(Block(_rows(one.column(2)[0])), state, audit)
            state = one.column(4)[0][state].as_py()
    if key is not None:
        yield _result(key, [found.row()])


def _in_blocks(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, what _OUT names) of large conversations: turns (key, turn, role, text), sizes (key, n, bytes) of them."""
    kind = turns.schema["key"].dataType.simpleString()
    same = turns["key"].eqNullSafe(sizes["key"])
    large = turns.join(sizes, same).select(turns["key"], "turn", "role", "text", F.xxhash64("role", "text").alias("h"), F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).alias("parts"))
    large = saved(large, "large-conversations")
    marks = F.array(*[F.lit(i / MOST_BLOCKS) for i in range(1, MOST_BLOCKS)])
    cuts = large.groupBy("key").agg(F.percentile_approx("turn", marks, F.lit(20 * MOST_BLOCKS)).alias("marks"), F.max("parts").alias("parts"))
    step = F.greatest(F.lit(1), F.floor(MOST_BLOCKS / F.col("parts"))).cast("int")
    cuts = cuts.select("key", F.array_distinct(F.filter("marks", lambda _, i: i % step == 0)).alias("cuts"))
    # The first turn of each role and text in a conversation; nulls come before all turns.
    firsts = large.groupBy("key", "role", "text", "h").agg(F.bool_or(F.col("turn").isNull()).alias("none"), F.min("turn").alias("first"))
    a, b = large.alias("a"), firsts.alias("b")
    known = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.text") == F.col("b.text")))
    later = F.when(F.col("none"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    marked = known.select("a.key", "turn", "a.role", "a.text", later.alias("later"))
    placed = marked.join(cuts, marked["key"].eqNullSafe(cuts["key"])).select(marked["key"], F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("turn"))), F.lit(0)).cast("long").alias("block"), F.struct("turn", "role", "text", "later").alias("row"))
    blocks = saved(placed.groupBy("key", "block").agg(F.collect_list("row").alias("rows")), "conversation-blocks")
    matrices = blocks.mapInArrow(batches(_matrices, 16), f"key {kind}, block long, matrix array<bigint>")
    prices = matrices.groupBy("key").agg(F.collect_list(F.struct("block", "matrix")).alias("blocks")).mapInArrow(batches(_leaving_prices, 16), f"key {kind}, block long, leave array<bigint>, closes boolean")
    priced = blocks.join(prices, blocks["key"].eqNullSafe(prices["key"]) & (blocks["block"] == prices["block"])).select(blocks["key"], blocks["block"], "rows", "leave", "closes")
    traced = priced.mapInArrow(batches(_traces, 16), f"key {kind}, block long, rows {blocks.schema['rows'].dataType.simpleString()}, audits array<string>, exits array<bigint>, cost long")
    return traced.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_chained, f"key {kind}, {_OUT}")


def repair_conversations(turns: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    turns: conv_id, turn, role, text; rows are taken by turn, nulls first, ties by role and text.  Null role or text is one space.  Rows of a null conv_id
    are one conversation.  Rows repeated in whole follow one another, so all but the first are duplicates.  Other columns are left
    out; an empty table gives an empty one.  with_text: ``repaired``, the text itself, null for conversations worked on in blocks.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("role") + F.octet_length("text")).alias("bytes")).where((F.col("n") > BLOCK_ROWS) | (F.col("bytes") > BLOCK_BYTES))
    kind = rows.schema["key"].dataType.simpleString()
    large = saved(sizes, "large-sizes")
    small = rows
    if found := not large.isEmpty():
        small = rows.join(large.select(F.col("key").alias("other")), F.col("key").eqNullSafe(F.col("other")), "left_anti")
    out = small.groupBy("key").agg(F.collect_list(F.struct("turn", "role", "text")).alias("rows")).mapInArrow(batches(_whole, 256), f"key {kind}, {_OUT}, repaired string")
    if found:
        out = out.unionByName(_in_blocks(rows, large).withColumn("repaired", F.lit(None).cast("string")))
    return out.select(F.col("key").alias("conv_id"), *_NAMES, *(["repaired"] if with_text else []))


def damage(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) damaged by crc32 of ``conv_id:turn`` modulo 20; nulls of the key, role and text are one space.

    0: the row goes; 1: its text is empty; 2: without sentence marks; 3: twice; 4: its role is user.  Other columns are left out.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    role = F.when(kind == 4, "user").otherwise(plain("role"))
    copies: Column = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("copy"), copies.alias("copies"))
    return rows.where("copy <= copies").select("conv_id", "turn", "role", "text")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation; one of which no row is left has zeros and nothing to repair."""
    turns = table(spark, sf_dir, "conversations")
    every = turns.select("conv_id").distinct()
    found = repair_conversations(damage(turns))
    joined = every.join(found, every["conv_id"].eqNullSafe(found["conv_id"]), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(every["conv_id"], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in Summary.NAMES], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _sql_step(s: int) -> str:
    """The cheapest (cost, audit) in state s behind a row, before insertions: by Delete, Keep or Rerole from the states before it."""
    ways = [f"{{'c': p.n{s}.c + 3, 'a': p.n{s}.a || 'D'}}"]
    for before, follow in enumerate(_NEXT):
        for initial, to in follow.items():
            if to == s:
                ways.append(f"CASE WHEN NOT r.gone AND r.initial = '{initial}' THEN {{'c': p.n{before}.c + r.more, 'a': p.n{before}.a || 'K'}} END")
                if initial != "s":
                    ways.append(f"CASE WHEN NOT r.gone THEN {{'c': p.n{before}.c + 2 + r.more, 'a': p.n{before}.a || 'R'}} END")
    return f"least({', '.join(ways)})"


def _sql_insert(source: str) -> str:
    """Nodes of a row with up to two insertions: from nothing, s or a to u, from u to a."""
    grow = lambda x: f"{{'c': {x}.c + 2, 'a': {x}.a || 'I'}}"
    user = f"least(n2, {grow('n0')}, {grow('n1')}, {grow('n3')})"
    once = f"SELECT * REPLACE ({user} AS n2) FROM ({source})"
    twice = f"SELECT * REPLACE (least(n3, {grow('n2')}) AS n3) FROM ({once})"
    return f"SELECT * REPLACE (least(n2, {grow('n3')}) AS n2) FROM ({twice})"


OP13_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), bits(k, h, i) AS (
  SELECT DISTINCT k, 4294967295::BIGINT, 0 FROM raw
  UNION ALL
  SELECT k, list_reduce(list_prepend(xor(h, ascii(k[i + 1])), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), i + 1 FROM bits WHERE i < length(k)
), kinds AS (SELECT k, xor(h, 4294967295) % 20 AS kind FROM bits WHERE i = length(k)
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw JOIN kinds USING (k), range(2) AS t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, substr(role, 1, 1) AS initial FROM ordered
), rows AS (
  SELECT *, last = '' AS blank, last <> '' AND again AS dup, last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS cut FROM placed
), r AS (SELECT conv_id, i, role, text, initial, blank OR dup AS gone, cut::BIGINT AS more FROM rows
), start AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS n0, NULL::STRUCT(c BIGINT, a VARCHAR) AS n1, NULL::STRUCT(c BIGINT, a VARCHAR) AS n2, NULL::STRUCT(c BIGINT, a VARCHAR) AS n3 FROM rows
), paths AS (
  {_sql_insert("SELECT * FROM start")}
  UNION ALL
  {_sql_insert(f"SELECT p.conv_id, r.i, {', '.join(f'{_sql_step(s)} AS n{s}' for s in range(4))} FROM paths p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1")}
), ends AS (
  SELECT conv_id, least(n0, n3) AS e FROM paths QUALIFY i = max(i) OVER (PARTITION BY conv_id)
), counts AS (
  SELECT conv_id, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM rows GROUP BY conv_id
), pairs AS (
  SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM rows) WHERE p NOT IN ('su', 'ua', 'au') GROUP BY conv_id
), edits AS (
  SELECT conv_id, p, e.a[p] AS edit, length(regexp_replace(e.a[1:p], 'I', '', 'g')) AS i, length(regexp_replace(e.a[1:p - 1], 'D', '', 'g')) AS kept FROM ends, range(1, length(e.a) + 1) AS t(p)
), lines AS (
  SELECT ed.conv_id, p, edit, kept, role, text, first(edit = 'K' AND initial = 's') OVER (PARTITION BY ed.conv_id ORDER BY edit = 'D', p) AS system
  FROM edits ed LEFT JOIN r ON edit <> 'I' AND r.conv_id IS NOT DISTINCT FROM ed.conv_id AND r.i = ed.i WHERE edit <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (kept + system::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS t FROM lines GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN pairs ON pairs.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM o.conv_id
"""
