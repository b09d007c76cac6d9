"""Repair of conversation structure: the cheapest edits that make roles alternate, found on a lightest-derivation agenda.

A conversation is cut into blocks of bounded size. In a block, the item (k, q) says that k rows are handled and the roles kept so far leave
the grammar in state q; deductions keep, rerole, delete or insert a row. Weights are pairs (cost, audit); every deduction is a superior
function, so an item is final when it is popped. Blocks are chained by deductions over two items, (p, q) of one block and (q, r) of the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.llm.sides import sized
from firmlens.session import materialise

#: Contract values. States of `(s?(ua)+)?`: 0 start, 1 after s, 2 after u, 3 after a; 0 and 3 accept.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
BLOCK_BITS = 10  # a block holds at most 1,024 rows of a conversation

Weight = tuple[int, str]


def agenda(roles: str, faults: str, start: int, ends: tuple[int, ...] | None) -> dict[int, Weight]:
    """Lightest (cost, audit) of the items (all rows, q) reached from (no row, ``start``); the first of ``ends`` only, if given.

    ``roles`` has one initial a row (a blank where there is none to keep), ``faults`` one letter: b and d must be deleted, t costs one more unless deleted.

    The agenda orders by (cost, rows handled, audit). A deduction raises the cost or the number of rows, so weights only grow. Audits of one item
    that cost the same are never prefixes of each other, since letters fix costs and further letters would cost more; appending a letter therefore
    keeps their order, and the first pop of an item is its ASCII-least cheapest derivation.
    """
    n, done, goals = len(roles), set(), {}
    queue: list[tuple[int, int, str, int]] = [(0, 0, "", start)]
    while queue:
        cost, k, audit, q = heappop(queue)
        if (k, q) in done:
            continue
        done.add((k, q))
        if k == n and (ends is None or q in ends):
            goals[q] = (cost, audit)
            if ends is not None:
                break
        for symbol in "ua":
            to = STEP.get((q, symbol))
            if to is None:
                continue
            if (k, to) not in done:
                heappush(queue, (cost + INSERT, k, audit + "I", to))
            if k < n and faults[k] not in "bd" and (k + 1, to) not in done:
                heappush(queue, (cost + REROLE + TRUNCATED * (faults[k] == "t"), k + 1, audit + "R", to))
        if k == n:
            continue
        if (k + 1, q) not in done:
            heappush(queue, (cost + DELETE, k + 1, audit + "D", q))
        to = STEP.get((q, roles[k]))
        if to is not None and faults[k] not in "bd" and (k + 1, to) not in done:
            heappush(queue, (cost + TRUNCATED * (faults[k] == "t"), k + 1, audit + "K", to))
    return goals


class Chain:
    """Lightest derivations of the blocks seen so far from the grammar's start, one for each state they may end in."""

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, str, tuple[int, ...]]] = {0: (0, "", ())}

    def extend(self, block: dict[int, dict[int, Weight]]) -> None:
        out: dict[int, tuple[int, str, tuple[int, ...]]] = {}
        for q, (cost, audit, cuts) in self.best.items():
            for r, (more, letters) in block[q].items():
                new = (cost + more, audit + letters, (*cuts, len(audit) + len(letters)))
                if r not in out or new[:2] < out[r][:2]:
                    out[r] = new
        self.best = out

    def goal(self) -> tuple[int, str, tuple[int, ...]]:
        return min((self.best[q] for q in FINAL if q in self.best), key=lambda w: w[:2])


def steps(roles: str, audit: str, state: int) -> Iterator[tuple[str, int | None, str | None]]:
    """(edit, row handled, initial of the row that results) for each letter of an audit, which fixes them all."""
    row = 0
    for letter in audit:
        symbol = None
        if letter == "K":
            symbol = roles[row]
        elif letter in "RI":
            symbol = "a" if state == 2 else "u"
        yield letter, None if letter == "I" else row, symbol
        row += letter != "I"
        state = STEP[state, symbol] if symbol else state


def _blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def faulty(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, pos, block, fault): rows in order, with the first fault of each: b blank, d duplicate, t truncated, else a dash.

    The order is by turn (nulls first), then role and text. ``pos`` grows in that order within a conversation; ``block`` numbers runs of at most
    1,024 rows of a partition of the sort. The sorted rows are written once, so that all later steps see the same blocks. A row is a duplicate if its role and text
    were seen earlier in the conversation; the earliest places of texts held more than once are joined back, broadcast below a checked number of rows.
    """
    one = F.lit(" ")
    rows = convs.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), one).alias("role"), F.coalesce(F.col(text_col).cast("string"), one).alias("text"),
    )
    # The row number splits equal rows over the tasks of the sort; their order makes no difference.
    placed = rows.withColumn("_tie", F.monotonically_increasing_id()).orderBy(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "_tie").drop("_tie")
    placed = materialise(placed.withColumn("pos", F.monotonically_increasing_id()), "turns").withColumn("block", F.shiftright("pos", BLOCK_BITS))
    same = F.unhex(F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text").cast("binary"), 256))
    first = placed.where(~_blank(F.col("text"))).groupBy(F.col("conv_id").alias("_c"), same.alias("_s")).agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    found = placed.withColumn("_same", same).join(sized(first, "copies"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_same") == F.col("_s")), "left")
    fault = F.when(_blank(F.col("text")), "b").when(F.col("pos") > F.col("_first"), "d").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "t").otherwise("-")
    return found.select("conv_id", "turn", "role", "text", "pos", "block", fault.alias("fault"))


def _codes(rows: DataFrame) -> DataFrame:
    """(conv_id, block, first, roles, faults, heads): one row a block, a letter a message; ``heads`` counts the conversation's blocks."""
    head = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))
    packed = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", head.alias("h"), F.col("fault").alias("f")))).alias("m"))
    return packed.select(
        "conv_id", "block", F.col("m")[0]["pos"].alias("first"),
        F.array_join(F.transform("m", lambda x: x["h"]), "").alias("roles"), F.array_join(F.transform("m", lambda x: x["f"]), "").alias("faults"),
    )


def _weigh_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``spans`` to blocks of conversations that have several: start, end, cost and audit of every item, as text."""
    for batch in batches:
        spans = []
        for roles, faults in zip(batch.column("roles").to_pylist(), batch.column("faults").to_pylist()):
            spans.append([f"{q}{r}{c} {a}" for q in range(4) for r, (c, a) in agenda(roles, faults, q, None).items()])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.list_(pa.string()))], [*batch.schema.names, "spans"])


def _chain(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in the order of their conversation -> one row a block (its part of the audit) and, on the first, the conversation's sums."""
    names = ["conv_id", "block", "first", "roles", "state", "audit", "whole", "cost", "blank", "duplicate", "truncated", "illegal"]
    kinds = [kind, pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5]
    held: list[tuple] = []

    def close() -> list[tuple]:
        roles, faults = "".join(x[3] for x in held), "".join(x[4] for x in held)
        if len(held) == 1:
            (cost, audit), = agenda(roles, faults, 0, FINAL).values()
            cuts: tuple[int, ...] = (len(audit),)
        else:
            chain = Chain()
            for x in held:
                block: dict[int, dict[int, Weight]] = {q: {} for q in range(4)}
                for span in x[5]:
                    c, _, a = span[2:].partition(" ")
                    block[int(span[0])][int(span[1])] = (int(c), a)
                chain.extend(block)
            cost, audit, cuts = chain.goal()
        illegal = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:]))
        sums = (cost, faults.count("b"), faults.count("d"), faults.count("t"), illegal)
        out, at, state = [], 0, 0
        for k, (x, end) in enumerate(zip(held, cuts)):
            part = audit[at:end]
            out.append((x[0], x[1], x[2], x[3], state, part, *((audit, *sums) if k == 0 else (None,) * 6)))
            for _, _, symbol in steps(x[3], part, state):
                state = STEP[state, symbol] if symbol else state
            at = end
        return out

    for batch in batches:
        rows = []
        for x in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "first", "roles", "faults", "spans"))):
            if held and held[-1][0] != x[0]:
                rows += close()
                held = []
            held.append(x)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
    rows = close() if held else []
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _spell(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row an edit: the row it handles (null: none), its place, and the role that results (null: that of the row, or none)."""
    names = ["conv_id", "block", "step", "pos", "edit", "new_role"]
    kinds = [kind, pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for conv, block, first, roles, state, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "first", "roles", "state", "audit"))):
            for k, (edit, row, symbol) in enumerate(steps(roles, audit, state)):
                rows.append((conv, block, k, None if row is None else first + row, edit, ROLES[symbol] if edit in "RI" else None))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def plan(rows: DataFrame) -> DataFrame:
    """Blocks of ``rows`` (see :func:`faulty`) with their parts of the cheapest edits; the first block of a conversation also has its sums.

    Only letters are handled here: two a message. What a conversation of any length brings into one task is a letter for each of its
    messages, which is the audit that the result consists of, and 16 items for every 1,024 of them; all agendas run block by block elsewhere.
    """
    codes = _codes(rows)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema.fields)
    kind = pa.int64() if dict(codes.dtypes)["conv_id"] == "bigint" else pa.string()
    codes = materialise(codes, "codes")
    many = sized(codes.groupBy(F.col("conv_id").alias("_c")).count().where("count > 1").drop("count"), "long")
    long = codes.join(many, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi").repartition("block").mapInArrow(_weigh_blocks, f"{fields}, spans array<string>")
    short = codes.join(many, F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti").withColumn("spans", F.lit(None).cast("array<string>"))
    ordered = short.unionByName(long).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    out = f"conv_id {dict(codes.dtypes)['conv_id']}, block long, first long, roles string, state int, audit string, whole string, cost long, blank long, duplicate long, truncated long, illegal long"
    return materialise(ordered.mapInArrow(lambda batches: _chain(kind, batches), out), "repairs")


def edits(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, block, step, edit, turn, role, text): the repaired messages in order of (block, step), and the deleted ones with edit D."""
    name = dict(planned.dtypes)["conv_id"]
    kind = pa.int64() if name == "bigint" else pa.string()
    spelled = planned.select("conv_id", "block", "first", "roles", "state", "audit").mapInArrow(lambda b: _spell(kind, b), f"conv_id {name}, block long, step int, pos long, edit string, new_role string")
    texts = rows.select("pos", "turn", "role", "text")
    joined = spelled.join(texts, "pos", "left")
    return joined.select("conv_id", "block", "step", "edit", "turn", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def repair(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conversations, messages): sums and audit of every conversation, and its edits with texts.

    Edits are Keep (free), Rerole to user or assistant (2), Delete (3, required of blank and duplicate rows) and Insert of an empty user or
    assistant message (2); a truncated row that stays adds 1. The roles that result start with initials `(s?(ua)+)?`. Among the cheapest edits those with the ASCII-least audit are taken.

    Null roles and texts are read as one space, so such a text is blank and such a role must be replaced or deleted; so must an empty role. Rows
    without a conversation form one. Null turns come first; rows of one turn are ordered by role and text. Repeated rows are duplicates. An empty table
    gives empty tables; other columns are ignored. Conversation ids are longs or strings.
    """
    rows = materialise(faulty(convs, conv_col, turn_col, role_col, text_col), "faults")
    turns = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    gaps = turns.groupBy(F.col("conv_id").alias("_c")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), F.sum("n").alias("n_rows"))
    planned = plan(rows)
    told = planned.where("whole IS NOT NULL").select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", F.col("whole").alias("audit"))
    return told.join(gaps, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c"), edits(rows, planned)


def damage(convs: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults planted by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it the user's."""
    one = F.lit(" ")
    dice = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one)).cast("binary")) % 20
    rows = convs.select("conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"), dice.alias("_dice")).where("_dice <> 0")
    text = F.when(F.col("_dice") == 1, "").when(F.col("_dice") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_dice") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_dice") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumns({"text": text, "role": role}).withColumn("_copy", F.explode(copies)).drop("_dice", "_copy")


def _hash(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest, begun, out = None, None, False, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if digest is None or conv != now:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest, begun = conv, hashlib.sha256(), False
            digest.update(((b"\n" if begun else b"") + f"{role}:{text}".encode()))
            begun = True
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], pa.string())], ["conv_id", "sha"])
        out = []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], ["conv_id", "sha"])


def digests(messages: DataFrame) -> DataFrame:
    """(conv_id, sha): SHA-256 of the newline-joined ``role:text`` of what stays, streamed in order and never held whole; a digest of one stream has to be one task's work."""
    name = dict(messages.dtypes)["conv_id"]
    kind = pa.int64() if name == "bigint" else pa.string()
    stay = messages.where("edit <> 'D'").repartition("conv_id").sortWithinPartitions("conv_id", "block", "step").select("conv_id", "role", "text")
    return stay.mapInArrow(lambda b: _hash(kind, b), f"conv_id {name}, sha string")


def repaired_report(convs: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row per original conversation, with zeros, an empty audit and the digest of nothing where no row is left."""
    told, messages = repair(damaged)
    found = told.join(digests(messages).withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    ids = convs.select(F.col("conv_id").alias("_id")).distinct()
    joined = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "n_rows")]
    return joined.select(F.col("_id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
