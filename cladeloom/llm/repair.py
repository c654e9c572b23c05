"""Damage reports and cheapest repairs of conversations by weighted interval parsing.

A repaired conversation's role initials read `(s?(ua)+)?`. The repair grammar is in Chomsky normal form: its
nonterminals are pairs (p, q) of states of that language, a row of a kind derives (p, q) directly by the edits Keep,
Rerole or Delete, and (p, q) -> (p, r) (r, q) joins two neighbouring spans. Inserted turns derive pairs from nothing;
the cell of every row is closed under them on both sides. A cell holds the least (cost, audit) per nonterminal, audits
compared as ASCII. Two audits of one cell and cost never begin one another (they would differ by paid insertions), so
the least audit of a span is put together from least audits of its parts. As nonterminals are state pairs, every split
of a span gives the same cell; bottom-up by span length, one split into two halves is therefore enough, and n rows
need n joins instead of n**3.

Rows of a conversation are ordered by turn (nulls first), then role, then the MD5 of the text. Equal rows are counted
before they are ordered, and the narrow table (no texts) is range-partitioned, so one conversation holding most rows
is parsed in blocks by many tasks. Block cells and texts then meet per conversation in one ordered stream that
resolves the audit and hashes the repaired lines one by one: a task holds the audit of one conversation (which is
part of the result) and one row, never the texts of a group. A hash of all lines is sequential by definition.

Nulls in role and text read as one space; a null turn sorts first and does not count for gaps; null conv_ids are one
conversation; an empty role has no legal initial. Without rows: zeros, an empty audit, the hash of nothing.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: Rows of a conversation that a task parses into one block.
BLOCK_ROWS = 4096
#: Short spans whose cells are remembered by a worker.
MEMORY_ROWS, MEMORY_SPANS = 16, 200_000

# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ACCEPTED = (START, ASSISTANT)
# Kinds of rows: the initial (x: none of s, u, a) in lower case; upper case if truncated; a digit if it must go.
INITIALS = "suax"
MUST_GO = "0123"
LEGAL = {"su", "ua", "au"}
FAULTS = ("blank", "duplicate", "truncated")
#: The characters of a blank text.
SPACES = " \t\n\x0b\x0c\r"

Cell = dict[tuple[int, int], tuple[int, str]]


def join_cells(left: Cell, right: Cell) -> Cell:
    """(p, q) -> (p, r) (r, q): the least (cost, audit) of each."""
    out: Cell = {}
    for (p, r), (c1, a1) in left.items():
        for (r2, q), (c2, a2) in right.items():
            if r != r2:
                continue
            best = out.get((p, q))
            if best is None or c1 + c2 < best[0] or c1 + c2 == best[0] and a1 + a2 < best[1]:
                out[p, q] = c1 + c2, a1 + a2
    return out


def _insertions() -> Cell:
    """Closure of inserted turns: what the empty span derives."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    one = {(p, q): (INSERT_COST, INSERT) for role in "ua" for p, q in STEP[role].items()}
    while True:
        grown = dict(cell)
        for key, value in join_cells(cell, one).items():
            if key not in grown or value < grown[key]:
                grown[key] = value
        if grown == cell:
            return cell
        cell = grown


EMPTY = _insertions()


def _leaf(kind: str) -> Cell:
    edits: Cell = {(p, p): (DELETE_COST, DELETE) for p in range(4)}

    def offer(p: int, q: int, cost: int, letter: str) -> None:
        if (p, q) not in edits or (cost, letter) < edits[p, q]:
            edits[p, q] = cost, letter

    if kind not in MUST_GO:
        extra = TRUNCATED_COST if kind.isupper() else 0
        for p, q in STEP.get(kind.lower(), {}).items():
            offer(p, q, extra, KEEP)
        for role in "ua":
            for p, q in STEP[role].items():
                offer(p, q, REROLE_COST + extra, REROLE)
    return join_cells(join_cells(EMPTY, edits), EMPTY)


LEAVES = {kind: _leaf(kind) for kind in INITIALS + INITIALS.upper() + MUST_GO}
_spans: dict[str, Cell] = {}


def join_all(cells: list[Cell]) -> Cell:
    """Cells of neighbouring spans joined bottom-up, spans of each length before longer ones."""
    while len(cells) > 1:
        cells = [join_cells(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else EMPTY


def parse(kinds: str) -> Cell:
    """Cell of a span of rows, given by their kinds."""
    parts = []
    for at in range(0, len(kinds), MEMORY_ROWS):
        span = kinds[at:at + MEMORY_ROWS]
        if span not in _spans:
            if len(_spans) >= MEMORY_SPANS:
                _spans.clear()
            _spans[span] = join_all([LEAVES[k] for k in span])
        parts.append(_spans[span])
    return join_all(parts)


def cheapest(cell: Cell) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return min(cell[START, q] for q in ACCEPTED if (START, q) in cell)


def initial_of(kind: str) -> str:
    return INITIALS[int(kind)] if kind in MUST_GO else kind.lower()


class Replay:
    """Applies an audit to rows in order, giving the repaired turns."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _turn(self, text: str) -> tuple[str, str]:
        initial = "a" if self.state == USER else "u"
        self.state = STEP[initial][self.state]
        return "assistant" if initial == "a" else "user", text

    def inserted(self) -> Iterator[tuple[str, str]]:
        """Turns inserted at this place."""
        while self.audit[self.at:self.at + 1] == INSERT:
            self.at += 1
            yield self._turn("")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """Turns that stand for the next row."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = STEP[role[0]][self.state]
            yield role, text
        elif edit == REROLE:
            yield self._turn(text)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of all rows: what the checksum of `conv_id:turn` does to each; 0 copies if dropped."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), d.alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def kinds(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, copies, kind, rest, blank, duplicate, truncated): equal rows counted together, the kind
    of the first copy and of the others, and the faults of all copies. Dropped rows leave one entry without copies."""
    alive = F.col("copies") > 0
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    flat = rows.select("conv_id", *[F.when(alive, F.col(c)).alias(c) for c in ("turn", "role")], F.when(alive, F.md5(F.col("text").cast("binary"))).alias("digest"), "copies",
                       (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    n = flat.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.max("blank").alias("_blank"), F.max("cut").alias("_cut"))
    # a text seen at an earlier turn (null turns come first); counted first, so no hot text is gathered
    first = n.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("_has"), "turn")).alias("_first"))
    k = first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "_first")
    n = n.join(k, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("role").eqNullSafe(F.col("_r")) & F.col("digest").eqNullSafe(F.col("_d"))).drop("_c", "_r", "_d")
    repeated = ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    found = F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1))
    place = F.when((F.col("role") == "") | (found == 0), len(INITIALS)).otherwise(found)
    goes = F.col("_blank") | repeated
    pick = lambda signs: F.substring(F.lit(signs), place, F.lit(1))
    some = F.col("copies") > 0
    later = F.col("copies") - 1
    return n.select("conv_id", "turn", "role", "digest", "copies",
                    F.when(some, F.when(goes, pick(MUST_GO)).when(F.col("_cut"), pick(INITIALS.upper())).otherwise(pick(INITIALS))).alias("kind"), F.when(some, pick(MUST_GO)).alias("rest"),
                    F.when(F.col("_blank"), F.col("copies")).otherwise(0).alias("blank"),
                    F.when(F.col("_blank") | ~some, 0).when(repeated, F.col("copies")).otherwise(later).alias("duplicate"),
                    (some & ~goes & F.col("_cut")).cast("long").alias("truncated"))


def block_fields(rows: DataFrame) -> StructType:
    """Fields of a block of rows: where it stands, its counts, and its cell (pairs of states, costs, audits)."""
    turn = rows.schema["turn"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in ("turns", *FAULTS, "illegal"))
    fields = f"part long, seq long, turn_min {turn}, turn_max {turn}, {counts}, head string, tail string, pairs array<int>, costs array<long>, audits array<string>"
    return StructType([rows.schema["conv_id"], *StructType.fromDDL(fields).fields])


def blocks(ordered: DataFrame, schema: StructType) -> DataFrame:
    """Cells and counts of consecutive rows of one conversation within a partition, at most `BLOCK_ROWS` entries each."""
    names, types = [f.name for f in schema], to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        now: dict | None = None
        out: list[dict] = []

        def close() -> dict:
            spelled = "".join(now.pop("signs"))
            cell = parse(spelled)
            roles = "".join(initial_of(k) for k in (spelled[0], spelled[-1])) if spelled else ""
            illegal, previous = 0, ""
            for k in spelled:
                x = initial_of(k)
                illegal += bool(previous) and previous + x not in LEGAL
                previous = x
            return {**now, "illegal": illegal, "head": roles[:1], "tail": roles[1:],
                    "pairs": [4 * p + q for p, q in cell], "costs": [c for c, _ in cell.values()], "audits": [a for _, a in cell.values()]}

        for batch in batches:
            for r in batch.to_pylist():
                if now is not None and (now["conv_id"] != r["conv_id"] or len(now["signs"]) >= BLOCK_ROWS):
                    out.append(close())
                    now = None
                if now is None:
                    now = {"conv_id": r["conv_id"], "part": part, "seq": seq, "signs": [], "turn_min": None, "turn_max": None, "turns": 0, **dict.fromkeys(FAULTS, 0)}
                    seq += 1
                if r["copies"]:
                    now["signs"].append(r["kind"] + r["rest"] * (r["copies"] - 1))
                    if r["turn"] is not None:
                        now["turns"] += r["turn"] != now["turn_max"]
                        now["turn_min"] = r["turn"] if now["turn_min"] is None else now["turn_min"]
                        now["turn_max"] = r["turn"]
                    for c in FAULTS:
                        now[c] += r[c]
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, types)
                out = []
        if now is not None:
            out.append(close())
        if out:
            yield pa.RecordBatch.from_pylist(out, types)

    return ordered.mapInArrow(run, schema)


class Conversation:
    """What the blocks of one conversation, in order, say about it."""

    def __init__(self, conv_id):
        self.conv_id, self.cells, self.turn_min, self.turn_max, self.turns, self.tail = conv_id, [], None, None, 0, ""
        self.counts = dict.fromkeys((*FAULTS, "illegal"), 0)

    def add(self, block: dict) -> None:
        for c in self.counts:
            self.counts[c] += block[c]
        if block["head"]:
            self.counts["illegal"] += bool(self.tail) and self.tail + block["head"] not in LEGAL
            self.tail = block["tail"]
        if block["turns"]:
            self.turns += block["turns"] - (block["turn_min"] == self.turn_max)
            self.turn_min = block["turn_min"] if self.turn_min is None else self.turn_min
            self.turn_max = block["turn_max"]
        self.cells.append({divmod(k, 4): (c, a) for k, c, a in zip(block["pairs"], block["costs"], block["audits"])})

    def report(self) -> dict:
        cost, audit = cheapest(join_all(self.cells))
        gaps = self.turn_max - self.turn_min + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": cost, "audit": audit}


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, role string, text string"


def repair(rows: DataFrame, turns: bool = False) -> DataFrame:
    """Cheapest repair of every conversation of (conv_id, turn, role, text, copies), as `damage` gives them.

    One report per conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256),
    or with `turns` the repaired turns themselves (conv_id, place from 1, role, text).
    """
    order = ["conv_id", "turn", "role", "digest"]
    ordered = kinds(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    cells = blocks(ordered, block_fields(rows))
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    left = cells.select("conv_id", "part", "seq", null(rows, "turn"), null(rows, "role"), F.lit(None).cast("string").alias("digest"), null(rows, "text"), null(rows, "copies"),
                        F.struct(*cells.columns[3:]).alias("block"))
    right = rows.where("copies > 0").select("conv_id", F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("seq"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"),
                                            "text", "copies", F.lit(None).cast(left.schema["block"].dataType).alias("block"))
    # a conversation's blocks come first, then its texts in the order of the blocks
    stream = left.unionByName(right).repartition("conv_id").sortWithinPartitions("conv_id", F.col("part").asc_nulls_last(), "seq", "turn", "role", "digest")
    schema = StructType([rows.schema["conv_id"], *StructType.fromDDL(TURNS if turns else REPORT).fields])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        out: list[dict] = []
        replay = digest = report = None
        lines = 0

        def emit(pairs: Iterator[tuple[str, str]]) -> None:
            nonlocal lines
            for role, text in pairs:
                lines += 1
                if turns:
                    out.append({"conv_id": now.conv_id, "place": lines, "role": role, "text": text})
                else:
                    digest.update(("\n" if lines > 1 else "").encode() + f"{role}:{text}".encode())

        def begin() -> None:
            nonlocal replay, digest, report, lines
            report, digest, lines = now.report(), hashlib.sha256(), 0
            replay = Replay(report["audit"])

        def close() -> None:
            if replay is None:
                begin()
            emit(replay.inserted())
            if not turns:
                out.append({**report, "repaired_sha256": digest.hexdigest()})

        for batch in batches:
            for r in batch.to_pylist():
                if now is not None and now.conv_id != r["conv_id"]:
                    close()
                    now = None
                if now is None:
                    now, replay = Conversation(r["conv_id"]), None
                if r["block"] is not None:
                    now.add(r["block"])
                    continue
                if replay is None:
                    begin()
                for _ in range(r["copies"]):
                    emit(replay.row(r["role"], r["text"]))
            if out:
                yield pa.RecordBatch.from_pylist(out, types)
                out = []
        if now is not None:
            close()
            yield pa.RecordBatch.from_pylist(out, types)

    return stream.mapInArrow(run, schema)
