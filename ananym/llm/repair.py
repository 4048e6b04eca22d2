"""Cheapest repair of damaged conversations by depth-first branch-and-bound.

Rows are sorted over the whole table, so that a long conversation lies in several partitions. Each task reads its rows in order and solves a
short conversation at once. Of others, and of those at the edges of a partition, it solves pieces: the best edits from every state
of the role pattern to every other. Pieces are then put together along the conversation, which is exact because what follows a state
does not depend on what led there. Last, the repaired rows are hashed in order.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ananym.llm.common import prepare_session, written

# How far the pattern (s?(ua)+)? has come: nothing yet, after s, after u, after a. It may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (START, ASSISTANT)
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What an inserted or changed row becomes in each state.
WANTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
LEGAL = {"su", "ua", "au"}
ROLES = {"s", "u", "a"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

SPACE = " \t\n\v\f\r"
# Rows of a piece, and what a task holds of one conversation to hash it at once.
PIECE_ROWS = 32
WHOLE_ROWS = 4096
WHOLE_CHARS = 4 << 20


# --- search ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """One row to decide on, or ``forced`` rows one after another that must go."""

    initial: str = ""
    truncated: bool = False
    forced: int = 0


Best = tuple[int, str]


def suffix_bounds(steps: list[Step]) -> list[int]:
    """For each place, a cost that no repair of the steps from there on can go below.

    Forced rows are deleted; a truncated row costs 3, a row whose role fits nowhere 3, one with both 4, as then deleting is
    cheapest. Two rows to decide on, with nothing but forced rows between them, whose roles can't stand together need an edit
    beyond these: 3 if neither is truncated, else at least 1. Pairs that share no row add up.
    """
    least = [0] * (len(steps) + 1)
    after: int | None = None  # the next row to decide on
    between = 0  # cost of the forced rows before it
    for i in range(len(steps) - 1, -1, -1):
        step = steps[i]
        if step.forced:
            between += DELETE * step.forced
            least[i] = least[i + 1] + DELETE * step.forced
            continue
        kept = TRUNCATED if step.truncated else 0
        least[i] = least[i + 1] + min(kept + (0 if step.initial in ROLES else REROLE), DELETE)
        if after is not None:
            other = steps[after]
            if step.initial in ROLES and other.initial in ROLES and step.initial + other.initial not in LEGAL:
                both = kept + (TRUNCATED if other.truncated else 0)
                extra = DELETE - TRUNCATED if both else min(REROLE, INSERT, DELETE)
                least[i] = max(least[i], both + extra + between + least[after + 1])
        after, between = i, 0
    return least


def cheapest(steps: list[Step], entry: int = START, ends: Iterable[int] = ENDS) -> Best | None:
    """The cheapest edits (ties: ASCII-least) that lead from ``entry`` through all steps to one of ``ends``; None if there are none.

    Depth first with an explicit stack. A prefix is given up when its cost and the bound of the rest exceed the best repair found,
    or equal it while its edits already stand later in ASCII order; and when a prefix that is no worse has reached the same
    place and state. Edits of equal cost for the same rows are never one the start of the other, so their order stays under any common rest.
    """
    ends, bounds = set(ends), suffix_bounds(steps)
    best: Best | None = None
    reached: dict[tuple[int, int], Best] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, edits = stack.pop()
        if best and (cost + bounds[i], edits) > (best[0], best[1][: len(edits)]):
            continue
        known = reached.get((i, state))
        if known is not None and known <= (cost, edits):
            continue
        reached[i, state] = (cost, edits)
        step = steps[i] if i < len(steps) else None
        if step is None and state in ends and (best is None or (cost, edits) < best):
            best = (cost, edits)
        if step is not None and step.forced:
            # Inserting before a row that goes is the same as after it, where the edits stand earlier in ASCII order.
            stack.append((i + 1, state, cost + DELETE * step.forced, edits + "D" * step.forced))
            continue
        wanted = FOLLOWS[state, WANTED[state][0]]
        branches = [(i, wanted, cost + INSERT, edits + "I")]
        if step is not None:
            extra = TRUNCATED if step.truncated else 0
            branches += [(i + 1, state, cost + DELETE, edits + "D"), (i + 1, wanted, cost + REROLE + extra, edits + "R")]
            if (state, step.initial) in FOLLOWS:
                branches.append((i + 1, FOLLOWS[state, step.initial], cost + extra, edits + "K"))
        # The most promising branch is taken first.
        stack += sorted(branches, key=lambda b: (b[2] + bounds[b[0]], b[3]), reverse=True)
    return best


Table = dict[tuple[int, int], Best]


def transfers(steps: list[Step]) -> Table:
    """The best edits of a piece from every state to every state that can be reached."""
    found = {(a, b): cheapest(steps, a, [b]) for a in STATES for b in STATES}
    return {way: best for way, best in found.items() if best}


def joined(first: Table, second: Table) -> Table:
    out: Table = {}
    for (a, m), (cost, edits) in first.items():
        for b in STATES:
            if (m, b) in second:
                more, rest = second[m, b]
                if (a, b) not in out or (cost + more, edits + rest) < out[a, b]:
                    out[a, b] = (cost + more, edits + rest)
    return out


class Chain:
    """Pieces in order, joined in pairs of like size, so that edits are not copied once for each piece."""

    def __init__(self):
        self.parts: list[tuple[int, Table]] = []

    def add(self, table: Table) -> None:
        size = 1
        while self.parts and self.parts[-1][0] <= size:
            before, first = self.parts.pop()
            size, table = size + before, joined(first, table)
        self.parts.append((size, table))

    def table(self) -> Table:
        out = {(s, s): (0, "") for s in STATES}
        for _, part in reversed(self.parts):
            out = joined(part, out)
        return out


def best_repair(table: Table) -> Best:
    return min(table[START, end] for end in ENDS if (START, end) in table)


# --- rows of a conversation -----------------------------------------------------------------------


@dataclass
class Row:
    turn: int | None
    role: str
    text: str
    copies: int
    first: bool  # no earlier row has this role and text

    @property
    def initial(self) -> str:
        return self.role[:1]

    def faults(self) -> tuple[int, int, int]:
        """Blank, duplicate and truncated copies."""
        bare = self.text.rstrip(SPACE)
        if not bare:
            return self.copies, 0, 0
        if not self.first:
            return 0, self.copies, 0
        return 0, self.copies - 1, int(bare[-1] not in ".!?")

    def steps(self) -> list[Step]:
        blank, duplicate, truncated = self.faults()
        free = [] if blank or not self.first else [Step(self.initial, bool(truncated))]
        return free + ([Step(forced=blank + duplicate)] if blank + duplicate else [])


@dataclass
class Part:
    """What is known of consecutive rows of one conversation."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first_initial: str | None = None  # None without rows
    last_initial: str | None = None
    chain: Chain = field(default_factory=Chain)
    open: list[Step] = field(default_factory=list)

    def add(self, row: Row) -> None:
        if not row.copies:
            return
        blank, duplicate, truncated = row.faults()
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self._beside(row.initial, row.initial, row.copies - 1, row.turn, row.turn, int(row.turn is not None))
        self.open += row.steps()
        if len(self.open) >= PIECE_ROWS:
            self.close()

    def _beside(self, first: str, last: str, illegal: int, first_turn: int | None, last_turn: int | None, turns: int) -> None:
        if self.last_initial is not None:
            illegal += self.last_initial + first not in LEGAL
        self.illegal += illegal
        self.first_initial = first if self.first_initial is None else self.first_initial
        self.last_initial = last
        self.turns += turns - (first_turn is not None and first_turn == self.last_turn)
        self.first_turn = first_turn if self.first_turn is None else self.first_turn
        self.last_turn = last_turn if last_turn is not None else self.last_turn

    def close(self) -> None:
        if self.open:
            self.chain.add(transfers(self.open))
            self.open = []

    def append(self, later: dict) -> None:
        """Take in a later part of the conversation as it was stored."""
        if later["first_initial"] is not None:
            for name in ("blank", "duplicate", "truncated"):
                setattr(self, name, getattr(self, name) + later[name])
            self._beside(*(later[n] for n in ("first_initial", "last_initial", "illegal", "first_turn", "last_turn", "turns")))
        ways = itertools.product(STATES, STATES)
        self.chain.add({way: (cost, edits) for way, cost, edits in zip(ways, later["costs"], later["edits"]) if cost is not None})

    def best(self) -> Best:
        if not self.chain.parts:
            return cheapest(self.open) or (0, "")
        self.close()
        return best_repair(self.chain.table())

    def result(self) -> dict:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        cost, edits = self.best()
        found = {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}
        return found | {"cost": cost, "audit": edits}

    def stored(self) -> dict:
        self.close()
        table = self.chain.table()
        ways = [table.get(way, (None, None)) for way in itertools.product(STATES, STATES)]
        names = ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_initial", "last_initial")
        return {n: getattr(self, n) for n in names} | {"costs": [c for c, _ in ways], "edits": [e for _, e in ways]}


class Rebuilt:
    """The hash of the repaired rows, fed with the rows in order."""

    def __init__(self, edits: str):
        self.edits, self.at, self.state, self.hash, self.empty = edits, 0, START, hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else '\n'}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.state, self.empty = FOLLOWS[self.state, role[0]], False

    def _inserted(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self._put(WANTED[self.state], "")
            self.at += 1

    def add(self, row: Row) -> None:
        if not row.copies:
            return
        self._inserted()
        edit = self.edits[self.at]
        if edit != "D":
            self._put(row.role if edit == "K" else WANTED[self.state], row.text)
        self.at += row.copies  # further copies always go, directly after

    def digest(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


# --- over Arrow batches ---------------------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _conversations(rows: Iterator[dict]) -> Iterator[tuple[object, Iterator[dict]]]:
    return itertools.groupby(rows, key=lambda r: r["conv_id"])


def _as_row(r: dict) -> Row:
    return Row(r["turn"], r["role"], r["text"], r["copies"], r["first"])


def _emitted(found: Iterator[dict], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    while chunk := list(itertools.islice(found, most)):
        yield pa.RecordBatch.from_pylist(chunk, schema)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Per conversation of a sorted partition its result, or of the first, the last and long ones the part that is here."""
    place = TaskContext.get().partitionId()
    groups = _conversations(_rows(batches))
    nth, following = 0, next(groups, None)
    while following is not None:
        key, own = following
        part, held, chars = Part(), [], 0
        for row in map(_as_row, own):
            part.add(row)
            chars += len(row.text)
            if held is not None:
                held.append(row)
                if len(held) > WHOLE_ROWS or chars > WHOLE_CHARS:
                    held = None
        following = next(groups, None)
        if held is None or not nth or following is None:
            yield {"conv_id": key, "place": place, **part.stored()}
        else:
            result = part.result()
            rebuilt = Rebuilt(result["audit"])
            for row in held:
                rebuilt.add(row)
            yield {"conv_id": key, **result, "repaired_sha256": rebuilt.digest()}
        nth += 1


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for key, parts in _conversations(_rows(batches)):
        whole = Part()
        for part in parts:
            whole.append(part)
        yield {"conv_id": key, **whole.result()}


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Conversations of which the first row holds the result, and the others their rows in order."""
    for key, rows in _conversations(_rows(batches)):
        known = next(rows)["known"]
        rebuilt = Rebuilt(known["audit"])
        for row in rows:
            rebuilt.add(_as_row(row))
        yield {"conv_id": key, **known, "repaired_sha256": rebuilt.digest()}


def _mapped(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def batches(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emitted(run(arriving), arrow)

    return df.mapInArrow(batches, schema)


# --- operator -------------------------------------------------------------------------------------


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def counted_rows(rows: DataFrame, damage: bool) -> DataFrame:
    """(conv_id, turn, role, text, copies): equal rows as one, so that a row that is there often stands in a task once.

    With ``damage`` rows change by the crc32 of ``conv_id:turn``, modulo 20: 0 drops the row (it stays without copies), 1 empties
    its text, 2 removes ``.!?``, 3 repeats it, 4 makes its role ``user``. Nulls in text and role, and in the hashed text,
    count as one space.
    """
    kind = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn"))) % 20 if damage else F.lit(19)
    text = F.when(kind <= 1, "").when(kind == 2, F.translate(_spaced("text"), ".!?", "")).otherwise(_spaced("text"))
    role = F.when(kind == 0, "").when(kind == 4, "user").otherwise(_spaced("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    shaped = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
    return shaped.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def _with_firsts(rows: DataFrame) -> DataFrame:
    """Add ``first``: whether no earlier turn of the conversation has this role and text. Only repeated rows are joined."""
    digest = F.sha2("text", 256).alias("digest")
    keyed = rows.where("copies > 0").select("conv_id", "role", digest, "turn")
    own = ["conv_id", "role", "digest"]
    earliest = keyed.groupBy(*own).agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("least"))
    repeated = earliest.where("n > 1").withColumnsRenamed({c: f"e_{c}" for c in own})
    alike = F.col("conv_id").eqNullSafe(F.col("e_conv_id")) & (F.col("role") == F.col("e_role")) & (F.col("digest") == F.col("e_digest"))
    later = keyed.join(repeated, alike).where(F.struct(F.col("turn").isNotNull(), "turn") > F.col("least"))
    later = later.select(*[F.col(c).alias(f"l_{c}") for c in [*own, "turn"]], F.lit(True).alias("later"))
    same = F.col("conv_id").eqNullSafe(F.col("l_conv_id")) & F.col("turn").eqNullSafe(F.col("l_turn"))
    same &= (F.col("role") == F.col("l_role")) & (F.sha2("text", 256) == F.col("l_digest"))
    return rows.join(later, same, "left").select(*rows.columns, F.col("later").isNull().alias("first"))


def repair(rows: DataFrame, damage: bool = True) -> DataFrame:
    """Faults and the cheapest repair of every conversation in ``rows(conv_id, turn, role, text)``.

    Rows are taken by turn (nulls first), then role and text. Blank rows and later copies of an earlier role and text must be deleted (4);
    keeping a row costs 0, changing its role to user or assistant 3, inserting an empty user or assistant row 3, and each
    truncated row that stays 3 more. The first letters of the roles that are left must read ``(s?(ua)+)?``.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (the edits' initials, the ASCII-least of the cheapest) and
    repaired_sha256. Null conv_ids make one conversation. Null texts and roles are one space, so the one is blank and the other,
    as an empty role, fits nowhere. Repeated rows are duplicates. A conversation that lost all rows has zeros, an empty audit and the
    hash of nothing; an empty table gives no rows. Other columns are ignored. With ``damage=False`` the rows are taken as they are.

    No task holds a conversation's rows, but its audit, one letter for each row, is one value; and as SHA-256 reads its
    input in order, one task streams through the rows of a conversation that is too long for one piece.
    """
    prepare_session(rows.sparkSession)
    ready = written(_with_firsts(written(counted_rows(rows, damage), "repair-rows")), "repair-flagged")
    key = T.StructField("conv_id", ready.schema["conv_id"].dataType)
    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
    faults = long("blank", "duplicate", "truncated", "illegal")
    known = [*long("gaps"), *faults, *long("cost"), *text("audit")]
    result = T.StructType([key, *known, *text("repaired_sha256")])
    pieces = [*long("place", "turns", "first_turn", "last_turn"), *text("first_initial", "last_initial")]
    pieces += [T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("edits", T.ArrayType(T.StringType()))]
    order = ["conv_id", "turn", "role", "text"]
    in_order = ready.repartitionByRange(*order).sortWithinPartitions(*order)
    solved = written(_mapped(in_order, _solved, T.StructType([*result, *pieces])), "repair-solved")
    parts = solved.where(F.col("costs").isNotNull()).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    together = written(_mapped(parts, _put_together, T.StructType([key, *known])), "repair-together")
    names = [f.name for f in known]
    heads = together.select("conv_id", F.struct(*names).alias("known"))
    open_ids = together.select(F.col("conv_id").alias("open_id"))
    open_rows = ready.join(open_ids, F.col("conv_id").eqNullSafe(F.col("open_id")), "left_semi")
    both = heads.unionByName(open_rows, allowMissingColumns=True).repartition("conv_id")
    hashed = _mapped(both.sortWithinPartitions("conv_id", F.col("known").isNull(), "turn", "role", "text"), _hashed, result)
    return solved.where(F.col("costs").isNull()).select(*[f.name for f in result]).unionByName(hashed)
