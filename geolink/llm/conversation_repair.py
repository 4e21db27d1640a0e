"""Operator 12: cheapest repair of conversation structure by a lazily determinised weighted automaton.

A conversation's role initials shall read ``(s?(ua)+)?``.  Edits: keep a row (0), give it
the role user or assistant (3), delete it (4; the only edit of blank and repeated
rows), insert a row without text (3); a truncated row that stays adds 3.

The edits make a weighted automaton of four states (nothing yet, after system, after
user, after assistant) that reads rows from the last to the first; the vector of costs of
ending well from each state, less its minimum, is a state of the determinised automaton.
Such states are made when first met and kept in a transition table, so a scan is one
lookup a row and gives the cost.  The trace then goes back over the scanned rows, first to last, and
follows the tight arc with the smallest letter, which gives the least audit of those that cost least.

A conversation may be of any length.  Rows are ordered by ranges of (conversation, turn,
digest), not by conversation, and packed into blocks of at most ``ROWS`` rows and ``CHARS``
characters, each with its 4 x 4 matrix of costs from state to state.  A pass over the
matrices alone, last block first, tells every block the costs behind it; a last pass reads
blocks in order, traces each and feeds the digest.  Both are streams that hold one block at a
time; only the audit string grows with a conversation.  Which rows are repeated is told by
first occurrences, aggregated in Spark and merged into the order as rows of their own.

Defined results
    null role, text         read as one space
    null turn               comes first; a null conversation id is a conversation of its own
    rows of one turn        in the order of the SHA-256 of role and text; repeats adjacent
    repeated rows           every one after the first is a duplicate
    copies 0                the row is gone, its conversation stays in the result
    no rows left            zeros, an empty audit, the digest of an empty string
    turns too far apart for a long   ``gaps`` is the largest long
    empty table             no rows
    extra columns           ignored
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolink.llm.common import SPACES, Scratch, table
from geolink.llm.sharding import _step

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: A block's rows and characters at most (one row of more characters is a block).
ROWS, CHARS = 1_024, 1 << 20
INF = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted row, or one with a role given, leads; where a kept row does, by initial.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ENDS = (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The symbol of a row that must go; others are the initial (o for any other), in upper case if truncated.
GONE = "x"


class Automaton:
    """The determinised automaton, as far as it has been met."""

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.vectors: list[tuple] = []
        self.table: dict[tuple[int, str], tuple[int, int]] = {}
        self.arcs: dict[tuple[int, str, int], tuple[str, int, int]] = {}
        self.tails: dict[int, str] = {}
        self.end = self.state(self._closed([0 if q in ENDS else INF for q in range(4)]))[0]

    def state(self, costs) -> tuple[int, int]:
        """The number of the costs' state, and what was taken off them."""
        low = min(costs)
        vector = tuple(min(c - low, INF) for c in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.ids[vector], low

    @staticmethod
    def _closed(costs) -> list[int]:
        """With insertions first: two at most are worth while, as they alternate."""
        return [min(c, INSERT + costs[NEXT[q]], 2 * INSERT + costs[NEXT[NEXT[q]]]) for q, c in enumerate(costs)]

    @staticmethod
    def edits(symbol: str, q: int) -> list[tuple[str, int, int]]:
        """(letter, cost, next state) of the edits that use up a row, by letter."""
        out = [("D", DELETE, q)]
        if symbol != GONE:
            cut = CUT if symbol.isupper() else 0
            if (to := KEPT.get(symbol.lower(), {}).get(q)) is not None:
                out.append(("K", KEEP + cut, to))
            out.append(("R", REROLE + cut, NEXT[q]))
        return out

    def step(self, after: int, symbol: str) -> tuple[int, int]:
        """The state before a row and the weight, from the state behind it."""
        if (key := (after, symbol)) not in self.table:
            v = self.vectors[after]
            self.table[key] = self.state(self._closed([min(cost + v[to] for _, cost, to in self.edits(symbol, q)) for q in range(4)]))
        return self.table[key]

    def scan(self, symbols: str, after: int) -> tuple[list[int], int]:
        """States around every row, first to last, and the sum of weights."""
        states, total = [after], 0
        for s in reversed(symbols):
            after, weight = self.step(after, s)
            states.append(after)
            total += weight
        return states[::-1], total

    def arc(self, after: int, symbol: str, q: int) -> tuple[str, int, int]:
        """Letters up to the edit of a row, the state it is done in and the one it leads to."""
        if (key := (after, symbol, q)) not in self.arcs:
            before, weight = self.step(after, symbol)
            v, behind, letters, at = self.vectors[before], self.vectors[after], "", q
            while True:
                tight = [(e, at if e != "I" else None, to) for e, cost, to in self.edits(symbol, at) if cost + behind[to] == v[at] + weight]
                if INSERT + v[NEXT[at]] == v[at]:
                    tight.append(("I", None, NEXT[at]))
                letter, done, to = min(tight, key=lambda t: t[0])
                letters += letter
                if letter != "I":
                    self.arcs[key] = letters, done, to
                    break
                at = to
        return self.arcs[key]

    def tail(self, q: int) -> str:
        """Insertions after the last row."""
        if q not in self.tails:
            v, at, letters = self.vectors[self.end], q, ""
            while at not in ENDS or v[at]:
                letters, at = letters + "I", NEXT[at]
            self.tails[q] = letters
        return self.tails[q]

    def matrix(self, symbols: str) -> list[int]:
        """Costs from each state before the rows to each behind them, row by row; INF where there is no way."""
        columns = []
        for to in range(4):
            after, _ = self.state([0 if q == to else INF for q in range(4)])
            states, total = self.scan(symbols, after)
            columns.append([c + total if c < INF // 2 else INF for c in self.vectors[states[0]]])
        return [columns[to][q] for q in range(4) for to in range(4)]


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults by the CRC-32 of ``conv_id:turn``: ``conv_id, turn, role, text, copies``."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(name("role"))
    copies = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    return rows.withColumn("_kind", kind).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


_COLUMNS = ["conv", "turn", "digest", "is_row", "role", "text", "n", "blank", "cut"]
_BLOCK = (
    "part int, number bigint, symbols string, roles array<string>, texts array<string>, matrix array<bigint>, lowest bigint, highest bigint, turns bigint, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role string, last_role string"
)


class _Block:
    def __init__(self, conv):
        self.conv, self.symbols, self.roles, self.texts, self.chars = conv, [], [], [], 0
        self.turn_first, self.turn_last, self.turns, self.blank, self.duplicate, self.truncated, self.illegal = None, None, 0, 0, 0, 0, 0
        self.first = self.last = None

    def add(self, turn, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        if turn is not None and (self.turn_last is None or turn != self.turn_last):
            self.turn_first = turn if self.turn_first is None else self.turn_first
            self.turn_last, self.turns = turn, self.turns + 1
        if fault in ("blank", "duplicate"):
            setattr(self, fault, getattr(self, fault) + 1)
            self.symbols.append(GONE)
            return
        symbol = initial if initial in KEPT else "o"
        if fault:
            self.truncated += 1
            symbol = symbol.upper()
        self.symbols.append(symbol)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)


LEGAL = ("su", "ua", "au")


def _pack(batches, most: int = ROWS):
    """Ordered rows and first occurrences in, blocks out."""
    part, machine, number, block, first, made = TaskContext.get().partitionId(), Automaton(), 0, None, None, []

    def done():
        nonlocal number
        symbols = "".join(block.symbols)
        made.append((
            block.conv, part, number, symbols, block.roles, block.texts, machine.matrix(symbols), block.turn_first, block.turn_last, block.turns,
            block.blank, block.duplicate, block.truncated, block.illegal, block.first, block.last,
        ))
        number += 1
        return block.chars

    held, schema = 0, None
    for batch in batches:
        schema = schema or pa.schema([("conv_id", batch.schema.field("conv").type), *_arrow(_BLOCK)])
        for conv, turn, digest, is_row, role, text, n, blank, cut in zip(*(batch.column(c).to_pylist() for c in _COLUMNS), strict=True):
            if block is None or block.conv != conv:
                if block is not None:
                    held += done()
                block, first = _Block(conv), None
            if not is_row:
                first = (turn, digest)
                continue
            for copy in range(n):
                if len(block.symbols) >= most or block.chars >= CHARS:
                    held += done()
                    block = _Block(conv)
                fault = "blank" if blank else "duplicate" if copy or first != (turn, digest) else "truncated" if cut else ""
                block.add(turn, role, text, fault)
            if held >= CHARS or len(made) >= 4_096:
                yield _batch(made, schema)
                held, made = 0, []
    if block is not None:
        done()
    if made:
        yield _batch(made, schema)


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}


def _arrow(ddl: str) -> list:
    return [(name, _TYPES[kind]) for name, kind in (f.split(" ") for f in ddl.split(", "))]


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _behind(batches):
    """Blocks' matrices, last block of a conversation first: the costs behind each block, and what was taken off them."""
    machine, conv, after, off, new = Automaton(), None, 0, 0, True
    for batch in batches:
        out = []
        for c, part, number, m in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "part", "number", "matrix")), strict=True):
            if new or c != conv:
                conv, after, off, new = c, machine.end, 0, False
            v = machine.vectors[after]
            out.append((c, part, number, list(v), off))
            after, low = machine.state([min(m[4 * q + to] + v[to] for to in range(4)) for q in range(4)])
            off += low
        yield _batch(out, pa.schema([batch.schema.field("conv_id"), ("part", pa.int32()), ("number", pa.int64()), ("costs", pa.list_(pa.int64())), ("taken", pa.int64())]))


class _Conversation:
    """What is known of a conversation while its blocks go by."""

    def __init__(self, conv):
        self.conv, self.state, self.lines, self.audit, self.cost = conv, START, 0, [], None
        self.hash = hashlib.sha256()
        self.low = self.high = self.role = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1


_READ = ("conv_id", "part", "number", "costs", "taken", *(f.split(" ")[0] for f in _BLOCK.split(", ")[2:]))
_SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_EDIT = "step bigint, edit string, role string, text string"


def _traced(batches, summary: bool):
    """Blocks in order, each after the costs behind it: one row a conversation, or one an edit."""
    machine, now, behind, made, schema, held, step = Automaton(), None, None, [], None, 0, 0

    def close():
        for _ in machine.tail(now.state):
            now.audit.append("I")
            edit("I", NAMES[NEXT[now.state]], "")
            now.state = NEXT[now.state]
        if summary:
            gaps = min(now.high - now.low + 1 - now.turns, 2**63 - 1) if now.turns else 0
            made.append((now.conv, gaps, now.blank, now.duplicate, now.truncated, now.illegal, now.cost, "".join(now.audit), now.hash.hexdigest()))

    def edit(letter, role, text):
        nonlocal step, held
        if letter != "D":
            now.line(role, text)
        if not summary:
            made.append((now.conv, step, letter, role, text))
            step, held = step + 1, held + len(text or "")

    for batch in batches:
        schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), *_arrow(_SUMMARY if summary else _EDIT)])
        for conv, _, _, costs, taken, symbols, roles, texts, _, low, high, turns, blank, duplicate, truncated, illegal, first, last in zip(*(batch.column(c).to_pylist() for c in _READ), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    close()
                now, step = _Conversation(conv), 0
            if costs is not None:
                behind = machine.state(costs)[0], taken
                continue
            states, weight = machine.scan(symbols, behind[0])
            if now.cost is None:
                now.cost = behind[1] + weight + machine.vectors[states[0]][START]
            nth = 0
            for i, s in enumerate(symbols):
                letters, done, to = machine.arc(states[i + 1], s, now.state)
                for _ in letters[:-1]:
                    edit("I", NAMES[NEXT[now.state]], "")
                    now.state = NEXT[now.state]
                letter = letters[-1]
                role, text = (roles[nth], texts[nth]) if s != GONE else (None, None)
                nth += s != GONE
                edit(letter, NAMES[NEXT[done]] if letter == "R" else role, text)
                now.audit.append(letters)
                now.state = to
            if turns:
                now.turns += turns - (now.high is not None and now.high == low)
                now.low, now.high = low if now.low is None else now.low, high
            if first is not None:
                now.illegal += illegal + (now.role is not None and now.role + first not in LEGAL)
                now.role = last
            now.blank, now.duplicate, now.truncated = now.blank + blank, now.duplicate + duplicate, now.truncated + truncated
            if held >= CHARS or len(made) >= 4_096:
                yield _batch(made, schema)
                made, held = [], 0
    if now is not None:
        close()
    if made:
        yield _batch(made, schema)


class Repair:
    """Repaired conversations, as rows of edits or one summary each, from the written blocks."""

    def __init__(self, blocks: DataFrame, behind: DataFrame):
        both = blocks.unionByName(behind, allowMissingColumns=True)
        self.id = blocks.schema["conv_id"].dataType.simpleString()
        self.rows = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number", F.col("costs").isNull()).select(*_READ)

    def summary(self) -> DataFrame:
        """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
        return self.rows.mapInArrow(lambda batches: _traced(batches, True), f"conv_id {self.id}, {_SUMMARY}")

    def edits(self) -> DataFrame:
        """``conv_id, step, edit, role, text``: one row an edit; those that are not D make the repaired conversation."""
        return self.rows.mapInArrow(lambda batches: _traced(batches, False), f"conv_id {self.id}, {_EDIT}")


def repair(rows: DataFrame, scratch: Scratch, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, block_rows: int = ROWS) -> Repair:
    """Repair every conversation at the least cost.  ``copies_col`` says how often a row counts."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.col(copies_col).cast("bigint") if copies_col else F.lit(1).cast("bigint")
    rows = rows.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), value(role_col).alias("role"), value(text_col).alias("text"), n.alias("n"))
    # rows that are gone stand for their conversation only
    none = F.col("n") == 0
    rows = rows.select("conv", F.when(~none, F.col("turn")).alias("turn"), *[F.when(none, "").otherwise(F.col(c)).alias(c) for c in ("role", "text")], "n")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = rows.withColumn("digest", digest)
    firsts = rows.where("n > 0").groupBy("conv", "digest").agg(F.min(F.struct("turn")).alias("at"))
    firsts = firsts.select("conv", "at.turn", "digest", F.lit(False).alias("is_row"))
    # equal rows meet as partial sums, so no task reads them one by one
    counted = rows.groupBy("conv", "turn", "digest", "role", "text").agg(F.sum("n").alias("n"))
    bare = _bare(F.col("text"))
    counted = counted.withColumns({"is_row": F.lit(True), "blank": bare == "", "cut": ~F.substring(bare, -1, 1).isin(".", "!", "?")})
    both = counted.unionByName(firsts, allowMissingColumns=True).select(*_COLUMNS)
    order = ["conv", "turn", "digest"]
    ordered = both.repartitionByRange(*order).sortWithinPartitions(*order, "is_row")
    kind = rows.schema["conv"].dataType.simpleString()
    blocks = scratch.keep(ordered.mapInArrow(lambda batches: _pack(batches, block_rows), f"conv_id {kind}, {_BLOCK}"), "blocks")
    back = blocks.select("conv_id", "part", "number", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("number"))
    return Repair(blocks, back.mapInArrow(_behind, f"conv_id {kind}, part int, number bigint, costs array<bigint>, taken bigint"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repair(damage(table(spark, sf_dir, "conversations")), Scratch(spark, "op12"), copies_col="copies").summary()


#: Costs and audits forward, row by row: for every state the cheapest edits so far, the least audit of those.
SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda z: ('0x' || z)::BIGINT)), lambda c, z: HIGH)) % 20 AS kind
  FROM conversations
), f AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM k
), ids AS (
  SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), o AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(strlen(role)::VARCHAR || ':' || role || text), copy) AS i
  FROM f JOIN ids ON f.conv_id IS NOT DISTINCT FROM ids.conv_id
), r AS MATERIALIZED (
  SELECT c, i, turn, role, text, left(role, 1) AS a, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS b,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM o
), stats AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (b IS NOT NULL AND b || a NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY c
), ins(q, t, cost, audit, lines) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:']),
    (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])
), ed(e, q, t, a, base) AS (
  VALUES ('D', 0, 0, NULL, 4), ('D', 1, 1, NULL, 4), ('D', 2, 2, NULL, 4), ('D', 3, 3, NULL, 4), ('K', 0, 1, 's', 0), ('K', 0, 2, 'u', 0), ('K', 1, 2, 'u', 0), ('K', 3, 2, 'u', 0), ('K', 2, 3, 'a', 0),
    ('R', 0, 2, NULL, 3), ('R', 1, 2, NULL, 3), ('R', 3, 2, NULL, 3), ('R', 2, 3, NULL, 3)
), dp AS (
  SELECT c, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM ids
  UNION ALL
  SELECT c, i, q, (w).cost, (w).audit, (w).lines FROM (
    SELECT dp.c, r.i, ed.t AS q, min({
      'cost': dp.cost + ins.cost + ed.base + CASE WHEN ed.e <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END, 'audit': dp.audit || ins.audit || ed.e,
      'lines': dp.lines || ins.lines || CASE ed.e WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [CASE ed.t WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || r.text] END}) AS w
    FROM dp JOIN r ON dp.c = r.c AND r.i = dp.i + 1 JOIN ins ON ins.q = dp.q JOIN ed ON ed.q = ins.t
    WHERE (ed.a IS NULL OR ed.a = r.a) AND (ed.e = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
    GROUP BY dp.c, r.i, ed.t
  )
), best AS (
  SELECT dp.c, min({'cost': dp.cost + ins.cost, 'audit': dp.audit || ins.audit, 'lines': dp.lines || ins.lines}) AS w
  FROM dp LEFT JOIN stats USING (c) JOIN ins ON ins.q = dp.q
  WHERE dp.i = coalesce(stats.n, 0) AND ins.t IN (0, 3) GROUP BY dp.c
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  (w).cost::BIGINT AS cost, (w).audit AS audit, sha256(array_to_string((w).lines, chr(10))) AS repaired_sha256
FROM ids JOIN best USING (c) LEFT JOIN stats USING (c)
""".replace("HIGH", _step(_step("c", "z % 16"), "z // 16"))
