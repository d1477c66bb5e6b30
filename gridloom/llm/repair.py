"""Repair of conversation structure by Knuth's lightest-derivation agenda.

Every row keeps its place, is given another role, or is deleted; empty turns may be put in anywhere; the roles that come out must read
``(system)? (user assistant)+`` by their initials, or be none at all. The cheapest edits are looked for, of equally cheap ones those whose
letters (K keep, R re-role, D delete, I insert) come first in ASCII order.

Items are (rows read, role written last). A rule takes an item and an axiom, one edit of the next row or an insertion, to the item behind
it, and adds up their (cost, audit): a superior function, as costs add and letters are appended. It keeps order, too: of two audits of one
item at one cost neither is the other's beginning, as what is longer holds an insertion more. So the agenda's least item is final.

1. Rows are laid out by a range sort over (conv_id, turn with nulls first, role, text), so no conversation is one task's, and cut into
   segments of at most ``SEGMENT`` rows. A row is a duplicate if an aggregation finds its role and text earlier in its conversation.
2. In each segment the agenda derives spans: the lightest way from each role before it to each role behind it.
3. A conversation's spans are joined end to end by the same rule; of what is carried along only where the audits differ is compared.
4. Segments apply their part of the audit to their rows. A conversation's hash reads its rows in order, one at a time.

Null role or text is one space. Rows without conv_id are one conversation. Rows of one turn are ordered by role and text; repeated rows are
duplicates. Very long texts are only passed along. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import settle

SEGMENT_BITS = 8
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: What has been written last: nothing, a system, a user or an assistant turn; and the role that may follow.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)
GOALS = (NOTHING, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
Weight = tuple[int, str]


def superior(left: Weight, right: Weight) -> Weight:
    return left[0] + right[0], left[1] + right[1]


def axioms(initial: str, fault: str) -> list[tuple[Weight, str]]:
    """The edits of a row: their weight, and the kind of step they allow."""
    found = [((DELETE, "D"), "over")]
    if fault not in ("B", "D"):
        more = TRUNCATED if fault == "T" else 0
        found += [((KEEP + more, "K"), initial), ((REROLE + more, "R"), "any")]
    return found


def step(state: int, kind: str) -> int | None:
    """The state behind an edit."""
    if kind == "over":
        return state
    if kind == "any":
        return FOLLOWS[state]
    if kind == "s":
        return SYSTEM if state == NOTHING else None
    return FOLLOWS[state] if kind == ("a" if state == USER else "u") else None


def lightest(rows: list[tuple[str, str]], begin: int, ends: tuple[int, ...], first_only: bool) -> dict[int, Weight]:
    """The lightest derivation from ``begin`` over all ``rows`` (initial, fault) to each of ``ends``, or to the lightest of them."""
    edits = [axioms(*row) for row in rows]
    put = ((INSERT, "I"), "any")
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, begin)]
    final: set[tuple[int, int]] = set()
    found: dict[int, Weight] = {}
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == len(rows) and state in ends:
            found[state] = (cost, audit)
            if first_only or len(found) == len(ends):
                break
        for further, rules in ((0, (put,)), (1, edits[i] if i < len(rows) else ())):
            for weight, kind in rules:
                to = step(state, kind)
                if to is not None and (i + further, to) not in final:
                    heapq.heappush(agenda, (*superior((cost, audit), weight), i + further, to))
    return found


def laid_out(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at, seg, initial, fault) of the rows in order; fault is B, T or empty, duplicates are not known yet."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    ahead = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn")]
    # range bounds are sampled keys: beginnings of texts do
    rows = rows.repartitionByRange(*ahead, F.substring("role", 1, 64), F.substring("text", 1, 64)).sortWithinPartitions(*ahead, "role", "text")
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(trimmed == "", "B").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "T").otherwise("")
    rows = rows.withColumns({"at": F.monotonically_increasing_id(), "initial": F.substring("role", 1, 1), "fault": fault, "same": F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))})
    return settle(rows.withColumn("seg", F.shiftright("at", SEGMENT_BITS)), "repair-rows")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each segment from its rows in order. A segment that isn't the first of its numbers begins its conversation, one that isn't
    the last ends it: only one start or end is needed then."""
    held: list[tuple] = []

    def done(rows: list[tuple]) -> pa.RecordBatch:
        """All segments of one number."""
        cuts = [k for k in range(len(rows)) if k == 0 or rows[k][0] != rows[k - 1][0]] + [len(rows)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            own = [(r[3], r[4]) for r in rows[a:b]]
            opens, closes = a > 0, b < len(rows)
            spans = []
            for begin in (NOTHING,) if opens else range(4):
                for end, (cost, audit) in lightest(own, begin, GOALS if closes else tuple(range(4)), closes).items():
                    spans.append({"begin": begin, "end": end, "cost": cost, "audit": audit})
            out.append((rows[a][0], rows[a][1], rows[a][2], "".join(f or "-" for _, f in own), spans))
        names = ["conv_id", "seg", "at", "faults", "spans"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seg", "at", "initial", "fault"))):
            if held and held[-1][1] != row[1]:
                yield done(held)
                held = []
            held.append(row)
    if held:
        yield done(held)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, seg, at, faults, audit, state): each segment's part of its conversation's lightest derivation."""
    names = ["conv_id", "seg", "at", "faults", "audit", "state"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
    held: list[tuple] = []  # of this conversation: (key columns, best last step to each state)
    best: dict[int, Weight] = {}

    def done() -> list[tuple]:
        state = min((s for s in GOALS if s in best), key=lambda s: best[s])
        out = []
        for key, steps in reversed(held):
            begin, audit = steps[state]
            out.append((*key, audit, begin))
            state = begin
        return out

    for batch in batches:
        rows = []
        for *key, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seg", "at", "faults", "spans"))):
            if held and held[-1][0][0] != key[0]:
                rows += done()
                held = []
            if not held:
                best = {NOTHING: (0, "")}
            ways: dict[int, tuple[Weight, int, str]] = {}
            for s in spans:
                if s["begin"] in best:
                    way = (superior(best[s["begin"]], (s["cost"], s["audit"])), s["begin"], s["audit"])
                    ways[s["end"]] = min(way, ways.get(s["end"], way))
            shared = len(os.path.commonprefix([w[0][1] for w in ways.values()]))
            best = {end: (w[0][0], w[0][1][shared:]) for end, w in ways.items()}
            held.append((tuple(key), {end: w[1:] for end, w in ways.items()}))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done()), kinds)], names)


EDITS = "conv_id bigint, seg bigint, step bigint, edit string, fault string, cost bigint, turn bigint, was string, role string, text string"


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``EDITS`` from the rows of segments, each behind a row that has its audit."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [c.split()[0] for c in EDITS.split(", ")]
    key, audit, faults, state, at, read = (None, None), "", "", NOTHING, 0, 0

    def puts(rows: list[tuple]) -> None:
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            state = FOLLOWS[state]
            rows.append((*key, at, "I", None, INSERT, None, None, ROLES[state], ""))
            at += 1

    for batch in batches:
        rows: list[tuple] = []
        for conv, seg, head, some_audit, some_faults, begin, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seg", "head", "audit", "faults", "state", "turn", "role", "text"))):
            if head:
                key, audit, faults, state, at, read = (conv, seg), some_audit, some_faults, begin, 0, 0
                puts(rows)
                continue
            edit, fault = audit[at], faults[read]
            more = TRUNCATED if fault == "T" and edit != "D" else 0
            if edit == "R":
                state = FOLLOWS[state]
            elif edit == "K":
                state = step(state, role[:1])
            new = ROLES[state] if edit == "R" else role
            rows.append((*key, at, edit, fault.strip("-") or None, {"K": KEEP, "R": REROLE, "D": DELETE}[edit] + more, turn, role, new, text))
            at, read = at + 1, read + 1
            puts(rows)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def edits(turns: DataFrame) -> DataFrame:
    """Each edit of each conversation of (conv_id, turn, role, text), as ``EDITS``: in the order of (seg, step); fault B, D or T for blank,
    duplicate and truncated rows, was the row's role before. Rows with edit D are the deleted ones."""
    rows = laid_out(turns)
    # every row's first occurrence by place; a segment's own repetitions are summed before they are shuffled
    firsts = rows.filter("fault <> 'B'").groupBy("conv_id", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    facts = rows.select("conv_id", "seg", "at", "initial", "fault").join(firsts, "at", "left")
    facts = facts.withColumn("fault", F.when((F.col("fault") != "B") & F.col("first").isNull(), "D").otherwise(F.col("fault"))).drop("first")
    spans = facts.repartition("seg").sortWithinPartitions("seg", "at").mapInArrow(_spans, "conv_id bigint, seg bigint, at bigint, faults string, spans array<struct<begin:int,end:int,cost:bigint,audit:string>>")
    parts = spans.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_joined, "conv_id bigint, seg bigint, at bigint, faults string, audit string, state int")
    heads = parts.withColumns({"head": F.lit(True), "turn": F.lit(None).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    body = rows.select("conv_id", "seg", "at", "turn", "role", "text").withColumns({"head": F.lit(False), "audit": F.lit(None).cast("string"), "faults": F.lit(None).cast("string"), "state": F.lit(None).cast("int")})
    return heads.unionByName(body).repartition("seg").sortWithinPartitions("seg", "at", F.desc("head")).mapInArrow(_applied, EDITS)


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, seg, step, role, text) of the repaired conversations, in the order of (seg, step)."""
    return edits(turns).filter("edit <> 'D'").select("conv_id", "seg", "step", "role", "text")


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    key, some = None, False
    count: dict[str, int] = {}
    audit: list[str] = []
    sha, low, high, turns, last, any_text = hashlib.sha256(), None, None, 0, None, False

    def done() -> tuple:
        gaps = 0 if low is None else high - low + 1 - turns
        return (key, gaps, *(count.get(c, 0) for c in ("B", "D", "T", "illegal", "cost")), "".join(audit), sha.hexdigest())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for c, n in zip(zip(*rows), names)], names)

    for batch in batches:
        rows = []
        for conv, edit, fault, cost, turn, was, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "fault", "cost", "turn", "was", "role", "text"))):
            if not some or conv != key:
                if some:
                    rows.append(done())
                key, some, count, audit = conv, True, {}, []
                sha, low, high, turns, last, any_text = hashlib.sha256(), None, None, 0, None, False
            if edit is None:
                continue
            audit.append(edit)
            count["cost"] = count.get("cost", 0) + cost
            if fault:
                count[fault] = count.get(fault, 0) + 1
            if edit != "I":
                if last is not None and last + was[:1] not in ("su", "ua", "au"):
                    count["illegal"] = count.get("illegal", 0) + 1
                last = was[:1]
                if turn is not None:
                    low, turns, high = turn if low is None else low, turns + (turn != high), turn
            if edit != "D":
                sha.update(f"{chr(10) if any_text else ''}{role}:{text}".encode())
                any_text = True
        if rows:
            yield out(rows)
    if some:
        yield out([done()])


REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def reports(turns: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """``REPORT`` for each conversation of ``turns``, and for each of ``conv_ids`` (conv_id), zeros where it has no rows."""
    found = edits(turns)
    ids = (turns if conv_ids is None else conv_ids).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    kinds = dict(c.split() for c in EDITS.split(", "))
    marks = ids.select("conv_id", *[(F.lit(-1) if c in ("seg", "step") else F.lit(None)).cast(kinds[c]).alias(c) for c in found.columns[1:]])
    return found.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "seg", "step").mapInArrow(_reports, REPORT)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes its ``[.!?]``, 3
    repeats it, 4 makes it the user's. Nulls are one space."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1]).cast("binary")) % 20
    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), kind.alias("kind"),
    ).filter("kind <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def digest(conversations: DataFrame) -> DataFrame:
    return reports(damage(conversations), conversations)
