"""Conversation repair: cheapest edits to a legal order of roles, by Four-Russians tables over blocks of rows.

A repaired conversation's role initials are ``(s?(ua)+)?``. What a row allows depends on its fault and its role
alone, so rows are symbols of a small alphabet. The least costs of all that follows a place, from each state of the
automaton, are a vector; less its least entry it is one of a few vectors. For every block of BLOCK symbols and
every such vector a table holds the vector before the block and what its least entry grows by, so conversations
are worked off a block at a time, from their end. Traces go the other way: a second table expands a block to the
vectors inside it, and at each row the least letter (D, I, K, R) whose cost keeps the optimum is taken, so
ties fall to the least audit in ASCII order.

Rows are ordered by ranges of (conv_id, turn), so a conversation may span tasks: it's cut into segments of at most
SEGMENT rows, each of which maps every vector at its end to one at its start. Maps are composed from the last
segment to the first, then each segment is traced from every state. Only the last step, which hashes the repaired
text, streams a conversation through one task, row by row, as a digest must be; texts are shuffled there alone.

Nulls in role or text are one space, in the checksum's conv_id and turn too. Rows without a conv_id are one conversation.
Rows of one turn are ordered by role, then md5 of text. A role that is empty or has another initial than s, u or a can't
be kept as it is. No rows after damage: zeros, an empty audit and the hash of an empty string. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from citeloom.llm.shared import bound_batches, stored

BLOCK, SEGMENT = 3, 4096
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after a system row, after a user row, after an assistant row.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that an inserted or changed row has in each state, and the state that follows.
GIVEN, THEN = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
ROLES = "sua"
#: Symbol 0 must be deleted; 1 + 2 * role + truncated otherwise, where role 3 is any other.
SYMBOLS = 9
#: Inserted rows that make a conversation end well.
TAIL = (0, 2, 1, 0)
SPACES = "' \\t\\n\\u000B\\f\\r'"


def _options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after it) of what may become of a row, in ASCII order of letters."""
    out = [("D", DELETE, state)]
    if symbol:
        role, more = ROLES[(symbol - 1) // 2 : (symbol - 1) // 2 + 1], (symbol - 1) % 2 * TRUNCATED
        if role in NEXT[state]:
            out.append(("K", more, NEXT[state][role]))
        out.append(("R", REROLE + more, THEN[state]))
    return out


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs from each state before a row, from those after it."""
    row = [min(cost + after[to] for _, cost, to in _options(symbol, state)) for state in range(4)]
    least = list(row)
    for _ in range(4):
        least = [min(row[state], INSERT + least[THEN[state]]) for state in range(4)]
    return tuple(least)


class Tables(NamedTuple):
    vectors: np.ndarray  # (vectors, 4), each with 0 as its least entry; the first is that of a conversation's end
    one: np.ndarray  # (SYMBOLS, vectors): the vector before a symbol
    one_more: np.ndarray  # and what its least entry grows by
    block: np.ndarray  # (SYMBOLS ** BLOCK, vectors): the same for blocks
    block_more: np.ndarray
    inside: np.ndarray  # (SYMBOLS ** BLOCK, vectors, BLOCK): the vectors after each symbol of a block
    choice: list  # [symbol][vector after it][state]: (letters, state after them)


@cache
def tables() -> Tables:
    vectors = [tuple(INSERT * n for n in TAIL)]
    number, one, more = {vectors[0]: 0}, [[] for _ in range(SYMBOLS)], [[] for _ in range(SYMBOLS)]
    for vector in vectors:  # grows while it is read
        for symbol in range(SYMBOLS):
            before = _before(symbol, vector)
            least = min(before)
            before = tuple(x - least for x in before)
            if before not in number:
                number[before] = len(vectors)
                vectors.append(before)
            one[symbol].append(number[before])
            more[symbol].append(least)
    one, more = np.array(one, np.int16), np.array(more, np.int64)
    block, block_more = np.zeros((SYMBOLS**BLOCK, len(vectors)), np.int16), np.zeros((SYMBOLS**BLOCK, len(vectors)), np.int64)
    inside = np.zeros((SYMBOLS**BLOCK, len(vectors), BLOCK), np.int16)
    for k, symbols in enumerate(product(range(SYMBOLS), repeat=BLOCK)):
        at = np.arange(len(vectors))
        for place in reversed(range(BLOCK)):
            inside[k, :, place] = at
            block_more[k] += more[symbols[place], at]
            at = one[symbols[place], at]
        block[k] = at

    def chosen(symbol: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
        before, letters = _before(symbol, after), ""
        while True:
            insert = [("I", INSERT + before[THEN[state]], THEN[state])]
            row = [(letter, cost + after[to], to) for letter, cost, to in _options(symbol, state)]
            letter, _, to = min(x for x in insert + row if x[1] == before[state])
            letters, state = letters + letter, to
            if letter != "I":
                return letters, state

    choice = [[[chosen(symbol, vector, state) for state in range(4)] for vector in vectors] for symbol in range(SYMBOLS)]
    return Tables(np.array(vectors), one, more, block, block_more, inside, choice)


def _cut(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first symbols that fill no block, and the numbers of the blocks that follow."""
    over = len(symbols) % BLOCK
    blocks = symbols[over:].reshape(-1, BLOCK).astype(np.int64)
    return symbols[:over], blocks @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)


def segment_map(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector at a segment's end: the one at its start, and what the least entry grows by."""
    t = tables()
    over, blocks = _cut(symbols)
    at, more = np.arange(len(t.vectors)), np.zeros(len(t.vectors), np.int64)
    for k in blocks[::-1]:
        more += t.block_more[k, at]
        at = t.block[k, at]
    for s in over[::-1]:
        more += t.one_more[s, at]
        at = t.one[s, at]
    return at, more


def trace(symbols: np.ndarray, after: int) -> tuple[list[str], list[int]]:
    """For each state at a segment's start: the letters of the cheapest edits, and the state after them."""
    t = tables()
    over, blocks = _cut(symbols)
    follows, at, place = np.zeros(len(symbols), np.int64), after, len(symbols)
    for k in blocks[::-1]:
        follows[place - BLOCK : place] = t.inside[k, at]
        at, place = t.block[k, at], place - BLOCK
    for s in over[::-1]:
        place -= 1
        follows[place], at = at, t.one[s, at]
    steps = [t.choice[s][v] for s, v in zip(symbols.tolist(), follows.tolist())]
    letters, ends = [], []
    for state in range(4):
        out = []
        for step in steps:
            some, state = step[state]
            out.append(some)
        letters.append("".join(out))
        ends.append(state)
    return letters, ends


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after damage. Dropped ones stay with 0 copies and no text."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"))
    rows = rows.withColumn("k", F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20)))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).when(F.col("k") > 0, F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("copies"))


_LIGHT = "conv_id long, pos long, turn long, role string, digest binary, n int, symbols binary, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, at binary, more binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: a row for each run of at most SEGMENT rows of a conversation."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        get = lambda c: np.asarray(batch.column(c))
        known = np.asarray(batch.column("conv_id").is_valid())
        conv = np.asarray(batch.column("conv_id").fill_null(0))
        has, turn = np.asarray(batch.column("turn").is_valid()), np.asarray(batch.column("turn").fill_null(0))
        initial = np.array(batch.column("initial").to_pylist(), object)
        fault = get("fault")  # 0 none, 1 blank, 2 duplicate, 3 truncated
        role = np.array([ROLES.find(x) if x else 3 for x in initial])
        role[role < 0] = 3
        symbol = np.where((fault == 1) | (fault == 2), 0, 1 + 2 * role + (fault == 3)).astype(np.uint8)
        legal = np.array([a + b in ("su", "ua", "au") for a, b in zip(initial[:-1], initial[1:])], bool)
        new = np.append(True, (conv[1:] != conv[:-1]) | (known[1:] != known[:-1]))
        fresh = has & (new | np.append(True, (turn[1:] != turn[:-1]) | ~has[:-1]))
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, n))
        begins = np.concatenate([np.arange(s, s + m, SEGMENT) for s, m in zip(starts, size)])
        ends = np.append(begins[1:], n)
        out = {c: [] for c in ("symbols", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "at", "more")}
        for s, e in zip(begins, ends):
            at, more = segment_map(symbol[s:e])
            there = np.flatnonzero(has[s:e]) + s
            # A turn that goes on from a segment before is counted again; who joins segments takes it off.
            turns = int(fresh[s:e].sum()) + int(has[s] and not fresh[s])
            for c, v in zip(out, (symbol[s:e].tobytes(), *(int((fault[s:e] == k).sum()) for k in (1, 2, 3)), int((~legal[s : e - 1]).sum()), initial[s], initial[e - 1], int(turn[there[0]]) if len(there) else None, int(turn[there[-1]]) if len(there) else None, turns, at.astype(np.int16).tobytes(), more.tobytes())):
                out[c].append(v)
        take = pa.array(begins)
        columns = [batch.column(c).take(take) for c in ("conv_id", "pos", "turn", "role", "digest")] + [pa.array((ends - begins).astype(np.int32))]
        types = {"symbols": pa.binary(), "at": pa.binary(), "more": pa.binary(), "first": pa.string(), "last": pa.string()}
        columns += [pa.array(v, types.get(c, pa.int64())) for c, v in out.items()]
        yield pa.record_batch(columns, names=["conv_id", "pos", "turn", "role", "digest", "n", *out])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maps of a conversation's segments, the last first: the vector after each, and the least cost from its start on."""
    now, vectors = object(), tables().vectors
    at = total = 0
    for batch in batches:
        after, cost = [], []
        for conv, ids, more in zip(batch.column("conv_id").to_pylist(), batch.column("at").to_pylist(), batch.column("more").to_pylist()):
            if conv != now:
                now, at, total = conv, 0, 0
            after.append(at)
            total += int(np.frombuffer(more, np.int64)[at])
            at = int(np.frombuffer(ids, np.int16)[at])
            cost.append(total + int(vectors[at, 0]))
        yield pa.record_batch({"pos": batch.column("pos"), "after": pa.array(after, pa.int32()), "cost": pa.array(cost, pa.int64())})


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [trace(np.frombuffer(s, np.uint8), a) for s, a in zip(batch.column("symbols").to_pylist(), batch.column("after").to_pylist())]
        batch = batch.drop_columns(["symbols", "after"])
        yield batch.append_column("edits", pa.array([x for x, _ in found], pa.list_(pa.string()))).append_column("ends", pa.array([x for _, x in found], pa.list_(pa.int32())))


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """What is known of a conversation while its segments and rows go by in order."""

    def __init__(self, conv: int | None):
        self.conv, self.planned, self.state, self.cost, self.turns = conv, 0, 0, None, 0
        self.low = self.high = self.last = None
        self.counts, self.audit, self.waiting, self.hash, self.lines = dict.fromkeys(_COUNTS, 0), [], [], hashlib.sha256(), 0

    def segment(self, x: dict) -> None:
        if self.cost is None:
            self.cost = x["cost"]
        elif self.last + x["first"] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last = x["last"]
        for c in _COUNTS:
            self.counts[c] += x[c]
        if x["low"] is not None:
            self.turns += x["turns"] - (x["low"] == self.high)
            self.low, self.high = x["low"] if self.low is None else self.low, x["high"]
        letters = x["edits"][self.planned]
        self.planned = x["ends"][self.planned]
        self.audit.append(letters)
        self.waiting = [*self.waiting[::-1], *letters][::-1]  # the next letter is the last

    def line(self, text: str) -> None:
        self.hash.update(("\n" + text if self.lines else text).encode())
        self.lines += 1

    def given(self, text: str) -> None:
        self.line(f"{GIVEN[self.state]}:{text}")
        self.state = THEN[self.state]

    def row(self, role: str, text: str) -> None:
        while (letter := self.waiting.pop()) == "I":
            self.given("")
        if letter == "R":
            self.given(text)
        elif letter == "K":
            self.line(f"{role}:{text}")
            self.state = NEXT[self.state][role[0]]

    def told(self) -> tuple:
        self.audit.append("I" * TAIL[self.planned])
        for _ in range(TAIL[self.state]):
            self.given("")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.counts.values(), self.cost or 0, "".join(self.audit), self.hash.hexdigest())


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments and rows of whole conversations, in order, a segment before its rows: one row a conversation."""
    now: _Conversation | None = None
    names = [x.split()[0] for x in _RESULT.split(", ")]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.string() if k >= 7 else pa.int64()) for k, c in enumerate(zip(*rows))], names=names)

    for batch in batches:
        done = []
        convs, copies, edits = batch.column("conv_id").to_pylist(), batch.column("copies").to_pylist(), batch.column("segment")
        roles, texts = batch.column("role"), batch.column("text")
        for k, conv in enumerate(convs):
            if now is None or conv != now.conv:
                if now is not None:
                    done.append(now.told())
                now = _Conversation(conv)
            if copies[k] is None:
                now.segment(edits[k].as_py())
            elif copies[k]:
                role, text = roles[k].as_py(), texts[k].as_py()
                for _ in range(copies[k]):
                    now.row(role, text)
        if done:
            yield told(done)
    if now is not None:
        yield told([now.told()])


def repair(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    bound_batches(conversations.sparkSession)
    rows = damaged(conversations).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    key = ["conv_id", "turn", "role", "digest"]
    bare = F.expr(f"rtrim({SPACES}, text)")
    light = rows.where("copies > 0").select(*key, F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.explode(F.expr("sequence(1, copies)")).alias("copy"), F.monotonically_increasing_id().alias("id"))
    # Equal rows are told apart by a number, so that ranges can split them too.
    order = [*key, "id", "copy"]
    ordered = light.repartitionByRange(*order).sortWithinPartitions(*order).select(*key, "initial", "blank", "cut", F.monotonically_increasing_id().alias("pos"))
    ordered = stored(ordered)
    earliest = ordered.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), 1).when(F.col("new").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    marked = ordered.join(earliest.hint("merge"), "pos", "left").select(*key, "pos", "initial", fault.alias("fault"))
    segments = stored(marked.repartitionByRange("pos").sortWithinPartitions("pos").mapInArrow(_segments, _LIGHT))

    maps = segments.select("conv_id", "pos", "at", "more").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("pos"))
    after = maps.mapInArrow(_composed, "pos long, after int, cost long")
    told = "conv_id long, pos long, turn long, role string, digest binary, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, cost long, edits array<string>, ends array<int>"
    names = [x.split()[0] for x in told.split(", ")][:-2]
    traced = segments.join(after.hint("merge"), "pos").select(*names, "symbols", "after").mapInArrow(_traced, told)

    inner = ["cost", *_COUNTS, "first", "last", "low", "high", "turns", "edits", "ends"]
    plans = traced.select(*key, F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("copies"), "pos", F.struct(*inner).alias("segment"))
    shape = plans.schema["segment"].dataType
    texts = rows.select(*key, "text", "copies", F.lit(None).cast("long").alias("pos"), F.lit(None).cast(shape).alias("segment"))
    each = plans.union(texts).repartition("conv_id").sortWithinPartitions(*key, F.col("copies").asc_nulls_first(), "pos")
    return each.select("conv_id", "role", "text", "copies", "segment").mapInArrow(_rendered, _RESULT)


def oracle_sql(crc32) -> str:
    """DuckDB SQL of the same by other means: the cheapest (cost, audit, rows) of each state, row after row."""
    space = r"[^\x20\x09-\x0D]"
    least = lambda *x: f"list_min(list_filter([{', '.join(x)}], lambda s: s IS NOT NULL))"

    def after(state: str, letter: str, cost: str, line: str, of: str = "p") -> str:
        lines = f"{of}.{state}.o" if line == "" else f"list_append({of}.{state}.o, {line})"
        return f"CASE WHEN {of}.{state} IS NOT NULL THEN {{'c': {of}.{state}.c + {cost}, 'x': {of}.{state}.x || '{letter}', 'o': {lines}}} END"

    kept, cut = "r.role || ':' || r.text", "r.cut"
    when = lambda test, x: f"CASE WHEN {test} THEN {x} END"
    alive = "NOT r.gone"
    # Rows: E, S, U, A from what can lead there.
    to_u = [when(f"{alive} AND r.initial = 'u'", after(s, "K", cut, kept)) for s in "esa"] + [when(alive, after(s, "R", f"2 + {cut}", "'user:' || r.text")) for s in "esa"]
    to_a = [when(f"{alive} AND r.initial = 'a'", after("u", "K", cut, kept)), when(alive, after("u", "R", f"2 + {cut}", "'assistant:' || r.text"))]
    new = {"e": [after("e", "D", "3", "")], "s": [after("s", "D", "3", ""), when(f"{alive} AND r.initial = 's'", after("e", "K", cut, kept))], "u": [after("u", "D", "3", ""), *to_u], "a": [after("a", "D", "3", ""), *to_a]}
    row = ", ".join(f"{least(*v)} AS {k}" for k, v in new.items())
    def inserted(of: str) -> str:
        ins = lambda s, line: after(s, "I", "2", f"'{line}:'", of)
        return f"{of}.e AS e, {of}.s AS s, {least(f'{of}.u', ins('e', 'user'), ins('s', 'user'), ins('a', 'user'))} AS u, {least(f'{of}.a', ins('u', 'assistant'))} AS a"
    keep = "conv_id, i, n"
    insertions = f"SELECT q.conv_id, q.i, q.n, {inserted('q')} FROM (SELECT q.conv_id, q.i, q.n, {inserted('q')} FROM (SELECT q.conv_id, q.i, q.n, {inserted('q')} FROM (SELECT p.conv_id, p.i + 1 AS i, p.n, {row} FROM walk p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1) q) q) q"
    none = "CAST(NULL AS STRUCT(c BIGINT, x VARCHAR, o VARCHAR[]))"
    begin = f"SELECT q.conv_id, q.i, q.n, {inserted('q')} FROM (SELECT q.conv_id, q.i, q.n, {inserted('q')} FROM (SELECT conv_id, 0 AS i, n, CAST({{'c': 0, 'x': '', 'o': []}} AS STRUCT(c BIGINT, x VARCHAR, o VARCHAR[])) AS e, {none} AS s, {none} AS u, {none} AS a FROM sizes) q) q"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return f"""WITH RECURSIVE told AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(key)} % 20 AS k FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM told WHERE k > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM hurt),
faults AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '{space}') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
rows AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM faults),
sizes AS (SELECT conv_id, count(*) AS n FROM rows GROUP BY conv_id),
walk AS ({begin} UNION ALL {insertions}),
ends AS (SELECT conv_id, {least('e', 'a')} AS best FROM walk WHERE i = n),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.x, '') AS audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM d.conv_id""".replace("\\\\x", "\\x")
