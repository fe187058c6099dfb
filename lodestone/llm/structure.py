"""Conversation structure repair by error-correcting Earley parsing (operator 13).

A right conversation is empty, or at most one system turn and then pairs of user and assistant turns. The role grammar below
has productions for right turns and weighted ones for edits: a turn may be deleted, given another role, or inserted. Chart
items keep the least (cost, audit), the audit being the edits' letters so far; the completed chart's item is the repair.

Items that span the same rows at the same cost have audits of which none starts another (a longer one would hold inserts
that cost more), so the least audit of a whole is made of least audits of its parts. The grammar recurs on the left only, so a column has
a bounded number of items, and a column needs the one before it and the first. Items that cost over SLACK more than the best one
are dropped: the best one reaches whatever they reach for SLACK at most (two inserts and a deleted system turn). Labels hold
costs beyond the least one and audits cut down to the letters at which they part, so columns are few distinct ones, each parsed
once in a worker. Whole audits are linked letters beside the chart; what all of them start with is settled and leaves it.

A conversation's rows come to one task by one shuffle, in order, and stream through it: the chart holds its undecided end
only, and seen turns are told by a window over the same partitioning, which sorts on disk where it must.

Edge cases: null roles and texts become one space; turns with no number come first, ties go by role, then text; repeated rows
are duplicates of the first; rows without a conversation's id belong to none and are left out; an empty table gives an empty
table; other columns are not looked at. Texts of any length are hashed and passed on as bytes.
"""

from __future__ import annotations

import hashlib
import os
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Non-terminals with an upper-case initial; `s`, `u`, `a` keep a turn with that initial of its role.
GRAMMAR = (
    ("Talk", ("Start",)),
    ("Talk", ("Pairs",)),
    ("Start", ()),
    ("Start", ("Start", "delete")),
    ("Head", ("Start", "s")),
    ("Head", ("Head", "delete")),
    ("Asked", ("Start", "User")),
    ("Asked", ("Head", "User")),
    ("Asked", ("Pairs", "User")),
    ("Asked", ("Asked", "delete")),
    ("Pairs", ("Asked", "Assistant")),
    ("Pairs", ("Pairs", "delete")),
    ("User", ("u",)),
    ("User", ("rerole",)),
    ("User", ("insert",)),
    ("Assistant", ("a",)),
    ("Assistant", ("rerole",)),
    ("Assistant", ("insert",)),
)
RULES: dict[str, list[int]] = defaultdict(list)
for _k, (_left, _) in enumerate(GRAMMAR):
    RULES[_left].append(_k)

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SLACK = 2 * INSERT + DELETE
#: Where an item began: at the first column, at the column before this one, or here.
FIRST, BEFORE, HERE = 0, 1, 2
TURNS = ("User", "Assistant")
ROLES = {"u": b"user", "a": b"assistant"}

Item = tuple[int, int, int]  # production, dot, where it began
Label = tuple[int, str]  # cost, audit


class ChartColumn:
    """One column of the chart: the least label of each item, and the items that wait for a non-terminal."""

    def __init__(self, seeds: list[tuple[Item, Label]], before: ChartColumn | None, first: ChartColumn | None):
        self.best: dict[Item, Label] = {}
        self.waiting: dict[str, list[Item]] = defaultdict(list)
        self.next: dict[tuple, tuple[int, list, bool, ChartColumn]] = {}
        done: dict[str, Label] = {}
        first = first or self
        todo = list(seeds)
        while todo:
            item, label = todo.pop()
            if self.best.get(item, label) < label or (item in self.best and self.best[item] == label):
                continue
            new = item not in self.best
            self.best[item] = label
            rule, dot, began = item
            left, right = GRAMMAR[rule]
            if dot == len(right):
                source = {FIRST: first, BEFORE: before, HERE: self}[began]
                if began == HERE:
                    done[left] = min(label, done.get(left, label))
                if source is not self:
                    parents = [(p, source.best[p]) for p in source.waiting[left]]
                else:
                    parents = [(p, self.best[p]) for p in self.waiting[left]]
                todo += [_advanced(p, self is source, own, label) for p, own in parents]
            elif right[dot][0].isupper():
                if new:
                    self.waiting[right[dot]].append(item)
                    began = HERE if right[dot] in TURNS else FIRST
                    todo += [((k, 0, began), (0, "")) for k in RULES[right[dot]]]
                if right[dot] in done:
                    todo.append(_advanced(item, True, label, done[right[dot]]))
                if right[dot] not in TURNS:  # a non-terminal of the first column that is complete already
                    todo += [_advanced(item, True, label, v) for (k, d, b), v in list(self.best.items()) if b == FIRST and GRAMMAR[k][0] == right[dot] and d == len(GRAMMAR[k][1])]
            elif right[dot] == "insert":
                todo.append(((rule, dot + 1, began), (label[0] + INSERT, label[1] + "I")))

    def settle(self) -> tuple[int, list[tuple[str, str, str]], bool]:
        """Drop items without a chance, take the least cost out of the labels, shorten the audits.

        Returns that cost, for each audit (its short form, short form in the column before, letters that came to it), and
        whether all audits start with the same letter, which is then settled.
        """
        tops = {i: v for i, v in self.best.items() if i[2] == FIRST and i[1]}
        least = min(v[0] for v in tops.values())
        tops = {i: v for i, v in tops.items() if v[0] <= least + SLACK}
        short = shortened({v[1] for v in tops.values()})
        self.best = {i: v for i, v in self.best.items() if i[2] != FIRST} | {i: (v[0] - least, short[v[1]]) for i, v in tops.items()}
        self.waiting = defaultdict(list, {s: [i for i in items if i in self.best] for s, items in self.waiting.items()})
        moves = []
        for audit, new in short.items():
            row = audit.rstrip("I")  # a column adds one row's letter and then inserts
            moves.append((new, row[:-1], audit[len(row) - 1 :]))
        return least, moves, len({x[:1] for x in short}) == 1

    def key(self) -> tuple:
        return tuple(sorted((i, v) for i, v in self.best.items()))

    def whole(self) -> Label:
        """Cost and audit of the completed chart."""
        return min(v for (k, dot, began), v in self.best.items() if GRAMMAR[k][0] == "Talk" and dot and began == FIRST)


def shortened(audits: set[str]) -> dict[str, str]:
    """Short forms that compare like the audits, now and with anything behind them.

    Only the letters at which audits part decide. Where one audit starts another, what the other has more is left as it is.
    """
    if "" in audits:
        return {x: x for x in audits}
    out = {}
    start = len(os.path.commonprefix(list(audits)))
    if any(len(x) == start for x in audits):
        return {x: x[start:] for x in audits}
    for letter in {x[start] for x in audits}:
        own = {x[start + 1 :]: x for x in audits if x[start] == letter}
        out |= {own[tail]: letter + form for tail, form in shortened(set(own)).items()}
    return out


class Audit:
    """Letters of an audit behind those of another one."""

    __slots__ = ("before", "letters", "depth")

    def __init__(self, before: Audit | None, letters: str):
        self.before, self.letters, self.depth = before, letters, before.depth + 1 if before else 0


def parted(audits: set[Audit]) -> Audit:
    """The last audit that all of these have in them."""
    while len(audits) > 1:
        last = max(audits, key=lambda x: x.depth)
        audits.remove(last)
        audits.add(last.before)
    return audits.pop()


def _advanced(parent: Item, same: bool, own: Label, child: Label) -> tuple[Item, Label]:
    began = BEFORE if parent[2] == HERE and not same else parent[2]
    return (parent[0], parent[1] + 1, began), (own[0] + child[0], own[1] + child[1])


class Parser:
    """Columns by what they hold, so that each distinct step of the chart is made once."""

    MOST = 20_000  # distinct columns that are remembered

    def __init__(self):
        self.first = ChartColumn([((k, 0, FIRST), (0, "")) for k in RULES["Talk"]], None, None)
        self.known: dict[tuple, ChartColumn] = {}

    def audits(self) -> dict[str, Audit]:
        """The audits of the first column by their short forms."""
        none = Audit(None, "")
        return {v[1]: Audit(none, v[1]) for i, v in self.first.best.items() if i[2] == FIRST and i[1]}

    def step(self, column: ChartColumn, initial: str, must_go: bool, truncated: bool) -> tuple[int, list, bool, ChartColumn]:
        """(cost, how the audits go on, whether they start alike, next column) for one more turn."""
        key = (initial, must_go, truncated)
        found = column.next.get(key)
        return found or self._parsed(column, key)

    def _parsed(self, column: ChartColumn, key: tuple) -> tuple[int, list, bool, ChartColumn]:
        initial, must_go, truncated = key
        stays = TRUNCATED if truncated else 0
        edits = {"delete": (DELETE, "D")} if must_go else {"delete": (DELETE, "D"), "rerole": (REROLE + stays, "R"), initial: (stays, "K")}
        seeds = []
        for (rule, dot, began), label in column.best.items():
            right = GRAMMAR[rule][1]
            if dot < len(right) and right[dot] in edits:
                cost, letter = edits[right[dot]]
                seeds.append(((rule, dot + 1, BEFORE if began == HERE else began), (label[0] + cost, label[1] + letter)))
        made = ChartColumn(seeds, column, self.first)
        settled = made.settle()
        if len(self.known) > self.MOST:
            self.known.clear()
        made = self.known.setdefault(made.key(), made)
        column.next[key] = *settled, made
        return column.next[key]


class Replay:
    """Applies settled letters to the turns that wait for them and hands the repaired turns on."""

    def __init__(self, put: Callable):
        self.put, self.queue, self.expects = put, deque(), "u"

    def apply(self, letters: str) -> None:
        for letter in letters:
            if letter == "D":
                self.queue.popleft()
                continue
            turn, role, text = (None, b"", b"") if letter == "I" else self.queue.popleft()
            if letter != "K":
                role = ROLES[self.expects]
            if letter != "K" or role[:1] != b"s":  # a kept system turn comes first, before a user's
                self.expects = "a" if self.expects == "u" else "u"
            self.put(letter, turn, role, text)


class Conversation:
    """The running state of one conversation: counts, chart, waiting turns."""

    def __init__(self, parser: Parser, name: int, put: Callable):
        self.name, self.parser, self.column = name, parser, parser.first
        self.replay = Replay(put)
        self.least = self.most = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audits = parser.audits()
        self.base = next(iter(self.audits.values())).before
        self.audit: list[str] = []

    def add(self, turn: int | None, role: bytes, text: bytes, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.turns = turn, self.turns + 1
        truncated = truncated and not blank and not duplicate
        duplicate = duplicate and not blank
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in (b"su", b"ua", b"au")
        self.before = initial
        self.replay.queue.append((turn, role, text))
        kept = initial.decode("latin-1") if initial in (b"s", b"u", b"a") else "-"
        cost, moves, alike, self.column = self.parser.step(self.column, kept, blank or duplicate, truncated)
        self.cost += cost
        self.audits = {new: Audit(self.audits[old], letters) for new, old, letters in moves}
        if alike:
            self._settle(parted(set(self.audits.values())))

    def _settle(self, to: Audit) -> None:
        """What leads to this audit is decided."""
        found, now = [], to
        while now is not None and now is not self.base:
            found.append(now.letters)
            now = now.before
        letters = "".join(reversed(found))
        self.audit.append(letters)
        self.replay.apply(letters)
        to.before, self.base = None, to

    def close(self) -> dict:
        cost, short = self.column.whole()
        self.cost += cost
        self._settle(self.audits[short])
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {
            "conv_id": self.name, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "cost": self.cost, "audit": "".join(self.audit),
        }


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURN = "conv_id long, place long, edit string, turn long, role string, text string"


def ordered(df: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    """Conversations whole and in order within partitions, each row with its faults; one shuffle."""
    rows = df.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), (F.coalesce(gone, F.lit(False)) if gone else F.lit(False)).alias("gone"),
        F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"),
    ).where("conv_id IS NOT NULL")
    blank_out = lambda c: F.when(F.col("gone"), F.lit("")).otherwise(F.col(c)).alias(c)
    rows = rows.select("conv_id", "turn", "gone", blank_out("role"), blank_out("text"))
    end = F.expr(r"rtrim('\u0009\u000A\u000B\u000C\u000D ', text)")
    rows = rows.withColumn("end", F.substring(end, -1, 1)).select(
        "*", (F.col("end") == "").alias("blank"), (~F.col("end").isin("", ".", "!", "?")).alias("truncated"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("same")
    )
    nth = F.row_number().over(W.partitionBy("conv_id", "gone", "same").orderBy(F.asc_nulls_first("turn")))
    seen = rows.repartition("conv_id").select("conv_id", "turn", "gone", "role", "text", "blank", "truncated", nth.alias("nth"))
    return seen.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "nth").select(
        "conv_id", "turn", "gone", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "blank", (F.col("nth") > 1).alias("duplicate"), "truncated"
    )


def _stream(batches: Iterator[pa.RecordBatch], start: Callable, finish: Callable, flush: Callable) -> Iterator[pa.RecordBatch]:
    parser, now = Parser(), None
    for batch in common.slices(batches, "text"):
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "gone", "turn", "role", "text", "blank", "duplicate", "truncated")]
        for name, gone, *row in zip(*columns, strict=True):
            if now is None or now.name != name:
                if now is not None:
                    finish(now.close())
                now = Conversation(parser, name, start(name))
            if not gone:
                now.add(*row)
        yield flush()
    if now is not None:
        finish(now.close())
        yield flush()


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(",")]


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 0), edit (K, R or I), turn (inserted: null), role, text."""
    common.ship(df.sparkSession)

    def run(batches):
        out: list[tuple] = []

        def start(name):
            place = [0]

            def put(letter, number, who, words):
                out.append((name, place[0], letter, number, who.decode(), words.decode()))
                place[0] += 1

            return put

        def flush():
            rows = out[:]
            out.clear()
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], _names(TURN))

        yield from _stream(batches, start, lambda report: None, flush)

    return ordered(df, conv, turn, role, text, gone).mapInArrow(run, TURN)


def reports(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """One row for each conversation: faults by kind, cost and audit of the repair, repaired_sha256 of its `role:text` lines."""
    common.ship(df.sparkSession)
    schema = REPORT + ", repaired_sha256 string"

    def run(batches):
        out: list[dict] = []
        digest: list = []

        def start(name):
            sha, parts = hashlib.sha256(), [0]
            digest[:] = [sha]

            def put(letter, number, who, words):
                sha.update((b"\n" if parts[0] else b"") + who + b":" + words)
                parts[0] = 1

            return put

        def finish(report):
            out.append(report | {"repaired_sha256": digest[0].hexdigest()})

        def flush():
            rows = out[:]
            out.clear()
            names = _names(schema)
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in names], names)

        yield from _stream(batches, start, finish, flush)

    return ordered(df, conv, turn, role, text, gone).mapInArrow(run, schema)


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with the faults of the query: a fifth of the rows is damaged by crc32 of `conv_id:turn`; `_gone` marks dropped ones."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = df.select("conv_id", "turn", "role", "text", kind.alias("_kind")).select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), "_kind"
    )
    return rows.select("conv_id", "turn", "role", "text", (F.col("_kind") == 0).alias("_gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def op13_structure_repair(spark, sf_dir: str) -> DataFrame:
    found = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return reports(found, gone="_gone")


#: crc32 of an ASCII string in SQL, bit by bit; fixed value: the reversed polynomial 0xEDB88320.
CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)), "
    "lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"
)


def oracle() -> str:
    """The same by dynamic programming over a conversation's rows: the least (cost, audit, text) of each of four states.

    States: o before any turn, h after a system turn, a after a user's, p after an assistant's.
    """
    crc = CRC32.format("concat(conv_id, ':', coalesce(turn::VARCHAR, ' '))")
    none = "{'cost': 1000000000::BIGINT, 'audit': '', 'words': ''}"
    add = lambda state, cost, letter, words: (
        f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'words': CASE WHEN {state}.words = '' THEN {words} ELSE {state}.words || chr(10) || {words} END}}"
    )
    gone = lambda state: f"{{'cost': {state}.cost + 3, 'audit': {state}.audit || 'D', 'words': {state}.words}}"
    least = lambda *of: f"list_sort([{', '.join(of)}])[1]"
    kept = lambda state, letter: f"CASE WHEN r.one = '{letter}' AND NOT r.bad THEN {add(state, 'r.cut', 'K', chr(39) + chr(39) + ' || r.said')} ELSE {none} END"
    moved = lambda state, role: f"CASE WHEN NOT r.bad THEN {add(state, '2 + r.cut', 'R', chr(39) + role + ':' + chr(39) + ' || r.text')} ELSE {none} END"
    own = ("s.o", "s.h", "s.a", "s.p")
    user = lambda *states: [f(s, x) for s in states for f, x in ((kept, "u"), (moved, "user"))]
    reply = [kept("s.a", "a"), moved("s.a", "assistant")]
    return f"""
    WITH RECURSIVE kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations WHERE conv_id IS NOT NULL),
    hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
               rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS ended FROM hurt),
    marked AS (SELECT *, ended = '' AS blank, ended <> '' AND nth > 1 AS duplicate, ended <> '' AND nth = 1 AND right(ended, 1) NOT IN ('.', '!', '?') AS truncated,
               lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS two FROM placed),
    lines AS (SELECT conv_id, k, left(role, 1) AS one, role || ':' || text AS said, text, blank OR duplicate AS bad, truncated::BIGINT AS cut FROM marked),
    raw AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, {{'cost': 0::BIGINT, 'audit': '', 'words': ''}} AS o, {none} AS h, {{'cost': 2::BIGINT, 'audit': 'I', 'words': 'user:'}} AS a,
            {{'cost': 4::BIGINT, 'audit': 'II', 'words': 'user:' || chr(10) || 'assistant:'}} AS p FROM kinds),
    steps AS (
      SELECT * FROM raw
      UNION ALL
      SELECT conv_id, k, o, h, a, {least('p', add('a', 2, 'I', "'assistant:'"))} AS p FROM (
        SELECT conv_id, k, o, h, {least('a', *[add(x, 2, 'I', "'user:'") for x in 'ohp'])} AS a, p FROM (
          SELECT s.conv_id, r.k, {gone('s.o')} AS o, {least(kept('s.o', 's'), gone('s.h'))} AS h,
                 {least(*user('s.o', 's.h', 's.p'), gone('s.a'))} AS a, {least(*reply, gone('s.p'))} AS p
          FROM steps s JOIN lines r ON r.conv_id = s.conv_id AND r.k = s.k + 1))),
    done AS (SELECT conv_id, {least('o', 'p')} AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS back FROM steps) WHERE back = 1),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
               count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
               count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
    SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(best.words) AS repaired_sha256
    FROM done d LEFT JOIN counts c USING (conv_id)
    """
