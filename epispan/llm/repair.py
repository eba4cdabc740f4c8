"""Repair of conversation structure by weighted CYK interval parsing.

The roles of a sound conversation read ``(s?(ua)+)?``: nothing, or an optional system turn and then pairs of user and assistant. Each
row is kept, given another role, or deleted, and rows may be inserted anywhere; every edit has a cost. The cheapest repair is wanted
and, among equally cheap ones, the one whose edits read ASCII-least.

Grammar in Chomsky normal form: a nonterminal ``X[p, q]`` derives what leads from place p to place q of the pattern, ``X[p, q] ->
X[p, r] X[r, q]`` are its binary rules and the edits of one row its terminal rules. The cell of a span holds, per nonterminal, the least
(cost, audit). The insertion closure, applied around every row, holds the cheapest chains of insertions between two places.

A nonterminal names both its ends, so each split of a span yields the same cell (the tests hold this against all splits). One split
per span is enough, spans double in length from one level to the next, and any run of neighbouring rows is a span: rows are
sorted by conversation and turn over all partitions, every partition parses the part of a conversation that it holds, and the parts
are combined in order. A conversation of any length thus spreads over partitions like the rest, and no group is collected.
Two audits of one cell that cost the same differ before either ends, so the least audit of a span starts with the least of its parts.

Duplicates are found by digests that are counted before they are shuffled. The repaired rows come from the sorted rows and the audit
of their conversation in one streaming pass; only this pass moves texts.

Defined results: null text and null role count as one space; null ids and null turns are values like others (of the pattern's
``conv_id:turn`` a null is one space), null turns come first. Rows of one turn are ordered by a digest of role and text, so equal rows are
neighbours. An empty text is blank; a role counts by its first character, an empty role by none. An empty table gives no rows; a
conversation of which no row is left has zeros, an empty audit and the hash of the empty string. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispan.llm.common import WHITE, Batches, record
from epispan.session import cut

#: Fixed values of the contract: edits, their costs and what an undeleted truncated row costs on top.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
ROLES = {"s": "system", "u": "user", "a": "assistant"}
SOUND_PAIRS = ("su", "ua", "au")

#: Places of the pattern: nothing read, then after a system, a user and an assistant turn. The first and the last may end it.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (NOTHING, ASSISTANT)
PLACES = range(4)
#: Insertions and new roles are of these kinds.
MADE = "ua"

Cell = dict[tuple[int, int], tuple[int, str]]

#: What the grammar needs to know of a row, its kind: initial of the role, if any, and faults.
GONE, CUT_OFF = 1, 2
SPAN_DDL = "conv_id bigint, part int, first string, last string, illegal bigint, cell map<string,struct<cost:bigint,audit:string>>"
SPAN = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int32()),
        ("first", pa.string()),
        ("last", pa.string()),
        ("illegal", pa.int64()),
        ("cell", pa.map_(pa.string(), pa.struct([("cost", pa.int64()), ("audit", pa.string())]))),
    ]
)
EDIT_DDL = "conv_id bigint, position bigint, edit string, role string, text string"
EDITS = pa.schema(
    [("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
)
HASH_DDL = "conv_id bigint, repaired_sha256 string"
HASHES = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def insertions() -> Cell:
    """The insertion closure: cheapest chains of insertions from place to place, none included."""
    closure: Cell = {(p, p): (0, "") for p in PLACES}
    for _ in PLACES:  # a chain visits no place twice
        for (p, q), (cost, audit) in list(closure.items()):
            for letter in MADE:
                r = MOVES.get((q, letter))
                if r is not None:
                    offer = (cost + INSERT_COST, audit + INSERT)
                    closure[p, r] = min(closure.get((p, r), offer), offer)
    return closure


CLOSURE = insertions()


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans, by the binary rules."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in PLACES:
            other = right.get((r, q))
            if other is not None:
                total = cost + other[0]
                best = out.get((p, q))
                if best is None or total <= best[0]:
                    offer = (total, audit + other[1])
                    out[p, q] = offer if best is None else min(best, offer)
    return out


@lru_cache(maxsize=4096)
def row_cell(initial: str, faults: int) -> Cell:
    """Cell of the span of one row: its edits, with insertions on either side."""
    edits: Cell = {(p, p): (DELETE_COST, DELETE) for p in PLACES}
    if not faults & GONE:
        extra = TRUNCATED_COST if faults & CUT_OFF else 0
        for (p, letter), q in MOVES.items():
            if letter == initial:
                edits[p, q] = min(edits.get((p, q), (extra, KEEP)), (extra, KEEP))
            if letter in MADE:
                offer = (extra + REROLE_COST, REROLE)
                edits[p, q] = min(edits.get((p, q), offer), offer)
    return combined(combined(CLOSURE, edits), CLOSURE)


def parsed(cells: list[Cell]) -> Cell:
    """Cell of the whole span, bottom-up: spans double in length from level to level."""
    while len(cells) > 1:
        pairs = [combined(a, b) for a, b in zip(cells[::2], cells[1::2])]  # noqa: B905 - an odd last cell has no partner
        cells = pairs + cells[len(cells) // 2 * 2 :]
    return cells[0]


def best(cell: Cell) -> tuple[int, str]:
    """Least (cost, audit) of the start symbol."""
    return min(cell[NOTHING, q] for q in ENDS if (NOTHING, q) in cell)


def spaced(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults by a hash of id and turn: ``(conv_id, turn, role, text, copies)``."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        spaced("role").alias("role"),
        spaced("text").alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("fault"),
    ).where("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.lit(2)).otherwise(F.lit(1)).cast("bigint")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def digested(rows: DataFrame) -> DataFrame:
    """Rows with ``digest``, which tells different pairs of role and text apart and orders rows of one turn."""
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def kinds(rows: DataFrame) -> DataFrame:
    """What the parser reads: a row per conversation, turn and digest, with how often it occurs."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    return (
        digested(rows)
        .select(
            "conv_id",
            "turn",
            "digest",
            F.substring("role", 1, 1).alias("initial"),
            F.when(last == "", F.lit("blank")).when(~last.isin(".", "!", "?"), F.lit("truncated")).alias("look"),
            "copies",
        )
        .groupBy("conv_id", "turn", "digest", "initial", "look")
        .agg(F.sum("copies").alias("copies"))
    )


def with_repeats(rows: DataFrame) -> DataFrame:
    """``later``: whether role and text were seen at an earlier turn of the conversation. Only digests that repeat are joined."""
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = (
        rows.groupBy("conv_id", "digest")
        .agg(F.min(turn).alias("seen"), F.count(F.lit(1)).alias("turns"))
        .where("turns > 1")
        .select(F.col("conv_id").alias("of_id"), F.col("digest").alias("of_digest"), "seen")
    )
    joined = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest")), "left")
    later = F.coalesce(~F.col("seen").eqNullSafe(turn), F.lit(False)) & F.col("seen").isNotNull()
    return joined.select(*rows.columns, later.alias("later"))


def counted(rows: DataFrame) -> DataFrame:
    """Per conversation ``gaps, blank, duplicate, truncated``."""
    again = F.col("copies") - F.when(F.col("later"), 0).otherwise(1)
    whole = F.coalesce(F.col("look") != "blank", F.lit(True))
    per_turn = rows.groupBy("conv_id", "turn").agg(
        F.sum(F.when(~whole, F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(whole, again).otherwise(0)).alias("duplicate"),
        F.sum(F.when((F.col("look") == "truncated") & ~F.col("later"), 1).otherwise(0)).alias("truncated"),
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint")
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated")]
    return per_turn.groupBy("conv_id").agg(gaps.alias("gaps"), *sums)


class Span:
    """The rows of one conversation that one partition holds, in order."""

    #: Rows whose cells are combined at once.
    CHUNK = 4096

    def __init__(self, conv_id: int | None, first: str):
        self.conv_id, self.first, self.last = conv_id, first, None
        self.illegal, self.cells, self.done = 0, [], []

    def add(self, initial: str, faults: int) -> None:
        if self.last is not None and self.last + initial not in SOUND_PAIRS:
            self.illegal += 1
        self.last = initial
        self.cells.append(row_cell(initial, faults))
        if len(self.cells) >= self.CHUNK:
            self.done.append(parsed(self.cells))
            self.cells = []

    def row(self, part: int) -> tuple:
        cell = parsed(self.done + self.cells)
        named = [(f"{p}{q}", {"cost": cost, "audit": audit}) for (p, q), (cost, audit) in cell.items()]
        return self.conv_id, part, self.first, self.last, self.illegal, named


def faults_of(look: str | None, later: bool) -> int:
    return (GONE if later or look == "blank" else 0) | (CUT_OFF if look == "truncated" else 0)


def spans(rows: DataFrame) -> DataFrame:
    """Cells of the spans that partitions of the sorted rows hold, one per conversation and partition."""

    def work(batches: Batches) -> Batches:
        part, span, out = TaskContext.get().partitionId(), None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "initial", "look", "copies", "later")]
            for conv_id, initial, look, copies, later in zip(*columns, strict=True):
                if span is None or span.conv_id != conv_id:
                    if span is not None:
                        out.append(span.row(part))
                    span = Span(conv_id, initial)
                span.add(initial, faults_of(look, later))
                for _ in range(copies - 1):  # further copies are duplicates
                    span.add(initial, faults_of(look, True))
            if out:
                yield record(SPAN, *map(list, zip(*out, strict=True)))
                out = []
        if span is not None:
            yield record(SPAN, *([x] for x in span.row(part)))

    keys = [F.col("conv_id"), F.col("turn"), F.col("digest")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.select("conv_id", "initial", "look", "copies", "later").mapInArrow(work, SPAN_DDL)


AUDIT_DDL = "conv_id bigint, illegal bigint, cost bigint, audit string"
AUDITS = pa.schema([("conv_id", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])


def audits(parts: DataFrame) -> DataFrame:
    """Spans of one conversation combined in order: ``(conv_id, illegal, cost, audit)``."""

    def work(batches: Batches) -> Batches:
        now, cell, illegal, last = None, None, 0, None
        out = []

        def close():
            if cell is not None:
                out.append((now[0], illegal, *best(cell)))

        for batch in batches:
            for row in batch.to_pylist():
                own = {(int(name[0]), int(name[1])): (value["cost"], value["audit"]) for name, value in row["cell"]}
                if cell is None or now[0] != row["conv_id"]:
                    close()
                    now, cell, illegal = (row["conv_id"],), own, row["illegal"]
                else:
                    illegal += row["illegal"] + (last + row["first"] not in SOUND_PAIRS)
                    # only what starts the pattern is of use once the start of the conversation is known
                    cell = combined({k: v for k, v in cell.items() if k[0] == NOTHING}, own)
                last = row["last"]
            if out:
                yield record(AUDITS, *map(list, zip(*out, strict=True)))
                out.clear()
        close()
        if out:
            yield record(AUDITS, *map(list, zip(*out, strict=True)))

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(work, AUDIT_DDL)


def final_roles(audit: str) -> Iterator[str]:
    """Roles of the repaired rows: the pattern is fixed by their number, which is odd only with a system turn in front."""
    rows = len(audit) - audit.count(DELETE)
    if rows % 2:
        yield ROLES["s"]
    for _ in range(rows // 2):
        yield ROLES["u"]
        yield ROLES["a"]


def edited(batches: Batches) -> Iterator[tuple]:
    """``(conv_id, edit, role, text)`` in order; the audit of a conversation comes before its rows.

    ``edit`` is None in the row that opens a conversation.
    """
    conv_id, audit, at, roles = None, "", 0, iter(())

    def inserted():
        nonlocal at
        while audit[at : at + 1] == INSERT:
            at += 1
            yield conv_id, INSERT, next(roles), ""

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "copies")), strict=True):
            if row[1] is not None:
                yield from inserted()
                conv_id, audit = row[:2]
                at, roles = 0, final_roles(audit)
                yield conv_id, None, None, None
                continue
            for _ in range(row[4]):
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == DELETE:
                    yield conv_id, edit, row[2], row[3]
                else:
                    role = next(roles)
                    yield conv_id, edit, row[2] if edit == KEEP else role, row[3]
    yield from inserted()


def in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Audits and rows, conversation by conversation, in the order of the parser."""
    texts = digested(rows).select("conv_id", "turn", "digest", F.lit(None).cast("string").alias("audit"), "role", "text", "copies")
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("role", "string"), ("text", "string"), ("copies", "bigint"))]
    heads = found.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("binary").alias("digest"), "audit", *empty)
    order = [F.col("conv_id"), F.col("audit").isNull(), F.col("turn"), F.col("digest")]
    both = heads.union(texts).repartition("conv_id").sortWithinPartitions(*order)
    return both.select("conv_id", "audit", "role", "text", "copies")


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every row of the repaired conversations with its edit, deleted rows included (their ``position`` is null)."""

    def work(batches: Batches) -> Batches:
        out, size, position = [], 0, 0
        for conv_id, edit, role, text in edited(batches):
            if edit is None:
                position = 0
                continue
            position += edit != DELETE
            out.append((conv_id, None if edit == DELETE else position, edit, role, text))
            size += len(text) + 64
            if size > 1 << 20:
                yield record(EDITS, *map(list, zip(*out, strict=True)))
                out, size = [], 0
        if out:
            yield record(EDITS, *map(list, zip(*out, strict=True)))

    return in_order(rows, found).mapInArrow(work, EDIT_DDL)


def repaired_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """SHA-256 of the repaired ``role:text`` rows of every conversation, joined by line feeds."""

    def work(batches: Batches) -> Batches:
        out, digest, opened, started = [], None, None, False
        for conv_id, edit, role, text in edited(batches):
            if edit is None:
                if digest is not None:
                    out.append((opened, digest.hexdigest()))
                digest, opened, started = hashlib.sha256(), conv_id, False
                if len(out) >= 4096:
                    yield record(HASHES, *map(list, zip(*out, strict=True)))
                    out = []
            elif edit != DELETE:
                digest.update((("\n" if started else "") + role + ":" + text).encode())
                started = True
        if digest is not None:
            out.append((opened, digest.hexdigest()))
        if out:
            yield record(HASHES, *map(list, zip(*out, strict=True)))

    return in_order(rows, found).mapInArrow(work, HASH_DDL)


def by_id(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join by conversation; a null id equals a null id."""
    other = right.withColumnRenamed("conv_id", "other_id")
    return left.join(other, F.col("conv_id").eqNullSafe(F.col("other_id")), "left").drop("other_id")


def parse(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` per conversation of ``rows (conv_id, turn, role, text, copies)``."""
    known = cut(with_repeats(cut(kinds(rows), "conversation-kinds")), "conversation-rows")
    return by_id(counted(known), audits(spans(known)))


def repair(conversations: DataFrame) -> DataFrame:
    """Counts, cost, audit and digest of the repaired rows for every conversation id of the undamaged table."""
    rows = damaged(conversations)
    found = cut(parse(rows), "audits")
    ids = conversations.select(F.col("conv_id").cast("bigint")).distinct()
    joined = by_id(by_id(ids, found), repaired_hashes(rows, found))
    sums = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id",
        *sums,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
