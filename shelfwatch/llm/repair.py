"""Repair of damaged conversations by generalised LR parsing over the role grammar.

The grammar of roles, by initials, is C -> nothing | B | s B; B -> T | B T; T -> u a. A parse reads the rows of a conversation in order of
their turns and may, for each row, keep it, give it another role or delete it, and insert turns without text anywhere; every
edit has a weight. The stacks of all parses form a graph: a node is a state above the node it was pushed on. After every row the
nodes with equal tops are merged: the one with the smallest (cost, audit) stays, an audit being the initials of the edits so
far. That is exact, because what may follow depends on the top alone, and because of two audits of equal cost over the same
rows neither begins with the other, so a later edit never turns their order.

Rows are range-sorted by (conversation, turn), so a conversation of any length is spread over ranges, and cut into segments of a few
hundred rows. Nearly all conversations are one segment and are repaired where they are. A conversation of more segments, or at the
edge of a range, is repaired in parts: each segment gives, for every top it may be entered with, the tops it may be left with and
their least (cost, audit); those maps are composed in order, and the audit is handed back to the segments. The SHA-256 of a
long conversation is told by one task that reads its repaired segments in order, a few at a time.

Defined cases: a null role, text, or part of the damage key counts as one space, so such a text is blank and such a role fits nothing
unless rerolled; a null conv_id is a conversation, a null turn comes first. Rows with equal turns are ordered by role, a hash of the text and
the text; equal rows are duplicates of the first of them. Only the first character of a role matters to the grammar; an empty role fits nothing. A
conversation of which damage leaves no row has zeros, an empty audit and the hash of nothing, and so an empty table has no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.llm.common import table, worker_store
from shelfwatch.session import cut_lineage

START, SYSTEM, USER, BODY = range(4)
TOPS = (START, SYSTEM, USER, BODY)
ACCEPTING = (START, BODY)
#: What a symbol pushes on a top; `a` on USER completes a turn pair and is a reduction.
PUSHED = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (BODY, "u"): USER}
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
#: A segment ends at so many rows or characters, whichever comes first.
SEGMENT_ROWS, SEGMENT_CHARS = 256, 32_000
SOLID = re.compile(r"[^\x20\x09-\x0D]")
ENDS = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
OPEN, MUST_GO, TRUNCATED = ".", "x", "t"
RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


# --- the parse ---------------------------------------------------------------------------------------------

class Node(NamedTuple):
    """A node of the graph-structured stack."""

    cost: int
    audit: str
    state: int
    below: Node | None


def push(node: Node, symbol: str, cost: int, edit: str) -> Node | None:
    """The node after `symbol`, with every reduction that it completes; None where the grammar has no such symbol."""
    if symbol == "a":
        if node.state != USER:
            return None
        base = node.below  # T -> u a
        if base.state == BODY:  # B -> B T
            base = base.below
        return Node(node.cost + cost, node.audit + edit, BODY, base)
    state = PUSHED.get((node.state, symbol))
    return None if state is None else Node(node.cost + cost, node.audit + edit, state, node)


def merge(tops: dict[int, Node], node: Node | None) -> bool:
    """Puts the node among the tops if it is the best with its state."""
    if node is None:
        return False
    known = tops.get(node.state)
    if known is not None and known[:2] <= node[:2]:
        return False
    tops[node.state] = node
    return True


def with_inserts(tops: dict[int, Node]) -> dict[int, Node]:
    waiting = list(tops.values())
    while waiting:
        node = waiting.pop()
        for symbol in "ua":
            made = push(node, symbol, INSERT, "I")
            if merge(tops, made):
                waiting.append(made)
    return tops


def after_row(tops: dict[int, Node], initial: str, fault: str) -> dict[int, Node]:
    """The merged tops after every edit of one row."""
    made: dict[int, Node] = {}
    for node in tops.values():
        merge(made, Node(node.cost + DELETE, node.audit + "D", node.state, node.below))
        if fault != MUST_GO:
            extra = CUT_OFF if fault == TRUNCATED else 0
            merge(made, push(node, initial, extra, "K"))
            for symbol in "ua":
                merge(made, push(node, symbol, REROLE + extra, "R"))
    return made


def entered(state: int) -> Node:
    """A stack with this top."""
    start = Node(0, "", START, None)
    return start if state == START else Node(0, "", state, start)


def parse(entry: int, symbols: str) -> dict[int, tuple[int, str]]:
    """The tops after rows, entered with a top, each with its least (cost, audit). A row is two characters: role initial and fault."""
    tops = with_inserts({entry: entered(entry)})
    for i in range(0, len(symbols), 2):
        tops = with_inserts(after_row(tops, symbols[i], symbols[i + 1]))
    return {state: (node.cost, node.audit) for state, node in tops.items()}


def leave(entry: int, symbols: str) -> dict[int, tuple[int, str]]:
    """`parse`, looked up where a worker has parsed the same few symbols before."""
    if len(symbols) > 64:
        return parse(entry, symbols)
    known = worker_store().setdefault("parses", {})
    if (entry, symbols) not in known:
        if len(known) >= 50_000:
            known.clear()
        known[entry, symbols] = parse(entry, symbols)
    return known[entry, symbols]


def best_end(tops: dict[int, tuple[int, str]]) -> tuple[int, str]:
    return min(tops[state] for state in ACCEPTING if state in tops)


def repaired(audit: str, entry: int, roles: list, texts: list) -> list[str]:
    """The lines that an audit makes of rows. Which role an edit gives is settled by the top it meets."""
    lines, state, at = [], entry, 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else (roles[at], texts[at])
        at += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == USER else "user"
        state = BODY if state == USER else SYSTEM if role[:1] == "s" else USER
        lines.append(f"{role}:{text}")
    return lines


def last_state(audit: str, entry: int, symbols: str) -> int:
    state, at = entry, 0
    for edit in audit:
        initial = "" if edit == "I" else symbols[2 * at]
        at += edit != "I"
        if edit != "D":
            state = BODY if state == USER else SYSTEM if edit == "K" and initial == "s" else USER
    return state


# --- damage and segments -----------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows after damage, n of each; n is 0 for a dropped row, whose text goes."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fate"),
    )
    fate = F.col("fate")
    return rows.select(
        "conv_id", F.when(fate != 0, F.col("turn")).alias("turn"),
        F.when(fate == 0, "").when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fate.isin(0, 1), "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def plain_repeats(rows: DataFrame) -> DataFrame:
    """`rows` with equal rows of a batch counted as one, so that one row told very often is no load for a task."""

    def run(batches):
        for batch in batches:
            some = pa.Table.from_batches([batch.append_column("gone", pa.compute.equal(batch.column("n"), 0))])
            counted = some.group_by(["conv_id", "turn", "role", "text", "gone"]).aggregate([("n", "sum")])
            yield from counted.rename_columns([*counted.column_names[:-1], "n"]).select(["conv_id", "turn", "role", "text", "n"]).combine_chunks().to_batches()

    return rows.mapInArrow(run, rows.schema)


SEGMENT = (
    "conv_id long, part int, seg long, whole boolean, first_turn long, last_turn long, n_turns long, symbols string, roles array<string>, "
    "texts array<string>, blank long, duplicate long, truncated long, illegal long"
)


class Segment:
    """Rows of one conversation in order, with what was found on them."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols, self.roles, self.texts, self.seen, self.chars = conv_id, [], [], [], set(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first_turn = self.last_turn = None

    def add(self, turn, role: str, text: str) -> None:
        initial = role[:1] or " "
        if not SOLID.search(text):
            fault, self.blank = MUST_GO, self.blank + 1
        elif (role, text) in self.seen:
            fault, self.duplicate = MUST_GO, self.duplicate + 1
        elif not ENDS.search(text):
            fault, self.truncated = TRUNCATED, self.truncated + 1
        else:
            fault = OPEN
        if self.symbols and self.symbols[-1][0] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None:
            self.n_turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if fault == MUST_GO:
            text = None
        else:
            self.seen.add((role, text))
            self.chars += len(text)
        self.symbols.append(initial + fault)
        self.roles.append(role)
        self.texts.append(text)

    def full(self) -> bool:
        return len(self.symbols) >= SEGMENT_ROWS or self.chars >= SEGMENT_CHARS

    def row(self, part: int, seg: int, whole: bool) -> tuple:
        return (
            self.conv_id, part, seg, whole, self.first_turn, self.last_turn, self.n_turns, "".join(self.symbols), self.roles, self.texts,
            self.blank, self.duplicate, self.truncated, self.illegal,
        )


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()),
             "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def batches_of(rows, ddl: str, most: int = 500):
    """Record batches of tuples."""
    schema, held = arrow_schema(ddl), []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def rows_of(batches, step: int = 500):
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, step).columns))


def segments(conversations: DataFrame) -> DataFrame:
    """The rows after damage, in order, cut into segments. `whole` marks a segment that is surely all of its conversation."""
    spark = conversations.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = plain_repeats(damaged(conversations)).withColumn("h", F.xxhash64("text"))
    order = ["conv_id", "turn", "role", "h"]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("conv_id", "turn", "role", "text", "n")

    def cut(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: list[Segment] = []  # the segments of the conversation that is read; only the last one is not full
        first_run = True

        def finished(at_edge):
            nonlocal number
            whole = len(held) == 1 and not at_edge
            for s in held:
                yield s.row(part, number, whole)
                number += 1

        for conv_id, turn, role, text, n in rows_of(batches):
            if not held or held[-1].conv_id != conv_id:
                if held:
                    yield from finished(first_run)
                    first_run = False
                held = [Segment(conv_id)]
            for _ in range(n):
                if held[-1].full():
                    if len(held) > 1:  # the first is held back to know whether it is the only one
                        yield held.pop(0).row(part, number, False)
                        number += 1
                    held.append(Segment(conv_id))
                held[-1].add(turn, role, text)
        if held:
            yield from finished(True)

    return cut_lineage(ranged.mapInArrow(lambda batches: batches_of(cut(batches), SEGMENT), SEGMENT))


# --- conversations of one segment --------------------------------------------------------------------------

def repair_whole(whole: DataFrame) -> DataFrame:
    def run(batches):
        for conv_id, _, _, _, first, last, n_turns, symbols, roles, texts, blank, duplicate, truncated, illegal in rows_of(batches):
            cost, audit = best_end(leave(START, symbols))
            lines = repaired(audit, START, roles, texts)
            gaps = 0 if first is None else last - first + 1 - n_turns
            yield conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()

    return whole.select(*arrow_schema(SEGMENT).names).mapInArrow(lambda batches: batches_of(run(batches), RESULT), RESULT)


# --- conversations of several segments ---------------------------------------------------------------------

MAP = "conv_id long, part int, seg long, first_turn long, last_turn long, n_turns long, symbols string, blank long, duplicate long, truncated long, " \
      "illegal long, entries array<int>, exits array<int>, costs array<long>, audits array<string>"
SLICE = "conv_id long, part int, seg long, entry int, audit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def first_places(several: DataFrame) -> DataFrame:
    """(part, seg, firsts): the rows of each segment that are the first with their role and text in the conversation."""

    def told(batches):
        for conv_id, part, seg, symbols, roles, texts in rows_of(batches, 50):
            for i, text in enumerate(texts):
                if symbols[2 * i + 1] != MUST_GO:
                    yield conv_id, hashlib.md5(f"{len(roles[i])}:{roles[i]}{text}".encode()).digest(), (part << 42) + (seg << 10) + i

    schema = "conv_id long, digest binary, place long"
    places = several.select("conv_id", "part", "seg", "symbols", "roles", "texts").mapInArrow(lambda b: batches_of(told(b), schema, 5000), schema)
    firsts = places.groupBy("conv_id", "digest").agg(F.min("place").alias("place"))
    place = F.col("place")
    split = firsts.select(F.shiftright(place, 42).cast("int").alias("part"), F.shiftright(place, 10).bitwiseAND(F.lit((1 << 32) - 1)).alias("seg"),
                          place.bitwiseAND(F.lit(1023)).cast("int").alias("i"))
    return split.groupBy("part", "seg").agg(F.collect_list("i").alias("firsts"))


def segment_maps(several: DataFrame, firsts: DataFrame) -> DataFrame:
    """What each segment makes of every top, once its rows that were seen in earlier segments are known."""

    def run(batches):
        for conv_id, part, seg, first, last, n_turns, symbols, blank, duplicate, truncated, illegal, known in rows_of(batches, 50):
            known, marked = set(known or ()), []
            for i in range(0, len(symbols), 2):
                fault = symbols[i + 1]
                if fault != MUST_GO and i // 2 not in known:
                    duplicate, truncated, fault = duplicate + 1, truncated - (fault == TRUNCATED), MUST_GO
                marked.append(symbols[i] + fault)
            symbols = "".join(marked)
            ways = [(entry, state, *way) for entry in TOPS for state, way in leave(entry, symbols).items()]
            yield conv_id, part, seg, first, last, n_turns, symbols, blank, duplicate, truncated, illegal, *map(list, zip(*ways))

    light = several.select("conv_id", "part", "seg", "first_turn", "last_turn", "n_turns", "symbols", "blank", "duplicate", "truncated", "illegal")
    joined = light.join(firsts, ["part", "seg"], "left").select(*light.columns, "firsts")
    return cut_lineage(joined.mapInArrow(lambda batches: batches_of(run(batches), MAP), MAP))


class Link(NamedTuple):
    """A segment's part of an audit, and the parts before it."""

    before: Link | None
    audit: str


def audit_less(a: Link, b: Link) -> bool:
    """Whether the audit of one chain comes before that of another; both have one part per segment and may share the first ones."""
    one, other = [], []
    while a is not b:
        one.append(a.audit)
        other.append(b.audit)
        a, b = a.before, b.before
    return "".join(reversed(one)) < "".join(reversed(other))


def compose(maps: DataFrame) -> DataFrame:
    """The segments with their part of the audit, the top they are entered with, and the counts of the whole conversation."""

    def close(conv_id, seen, tops, totals):
        best = None
        for state in ACCEPTING:
            if state in tops and (best is None or tops[state][0] < best[0] or tops[state][0] == best[0] and audit_less(tops[state][1], best[1])):
                best = tops[state]
        audits, link = [], best[1]
        while link.before is not None:
            audits.append(link.audit)
            link = link.before
        entry = START
        first, last, n_turns, _, *counts = totals
        gaps = 0 if first is None else last - first + 1 - n_turns
        for (part, seg, symbols), audit in zip(seen, reversed(audits)):
            yield conv_id, part, seg, entry, audit, gaps, *counts, best[0]
            entry = last_state(audit, entry, symbols)

    def run(batches):
        current, seen, tops, totals = None, [], {}, None
        for conv_id, part, seg, first, last, n_turns, symbols, blank, duplicate, truncated, illegal, *ways in rows_of(batches, 100):
            if not seen or conv_id != current:
                if seen:
                    yield from close(current, seen, tops, totals)
                current, seen, tops, totals = conv_id, [], {START: (0, Link(None, ""))}, [None, None, 0, "", 0, 0, 0, 0]
            made: dict[int, tuple[int, Link]] = {}
            for entry, state, cost, audit in zip(*ways):
                if entry not in tops:
                    continue
                cost, link = tops[entry][0] + cost, Link(tops[entry][1], audit)
                known = made.get(state)
                if known is None or cost < known[0] or cost == known[0] and audit_less(link, known[1]):
                    made[state] = (cost, link)
            tops = made
            seen.append((part, seg, symbols))
            if first is not None:
                totals[2] += n_turns - (totals[1] == first)
                totals[0] = first if totals[0] is None else totals[0]
                totals[1] = last
            if symbols:
                illegal += totals[3] != "" and totals[3] + symbols[0] not in ("su", "ua", "au")
                totals[3] = symbols[-2]
            totals[4:] = [t + n for t, n in zip(totals[4:], (blank, duplicate, truncated, illegal))]
        if seen:
            yield from close(current, seen, tops, totals)

    ordered = maps.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    return cut_lineage(ordered.mapInArrow(lambda batches: batches_of(run(batches), SLICE), SLICE))


def repair_several(several: DataFrame) -> DataFrame:
    slices = compose(segment_maps(several, first_places(several)))
    schema = f"{SLICE}, body binary"

    def bodies(batches):
        for *kept, roles, texts in rows_of(batches, 50):
            yield *kept, "\n".join(repaired(kept[4], kept[3], roles, texts)).encode()

    joined = slices.join(several.select("part", "seg", "roles", "texts"), ["part", "seg"]).select(*slices.columns, "roles", "texts")
    made = joined.mapInArrow(lambda batches: batches_of(bodies(batches), schema, 50), schema)

    def tell(batches):
        current, counts, audit, digest, begun = None, None, [], None, False
        for conv_id, _, _, _, part_of_audit, *new_counts, body in rows_of(batches, 50):
            if digest is None or conv_id != current:
                if digest is not None:
                    yield current, *counts, "".join(audit), digest.hexdigest()
                current, counts, audit, digest, begun = conv_id, new_counts, [], hashlib.sha256(), False
            audit.append(part_of_audit)
            if body:
                digest.update(b"\n" + body if begun else body)
                begun = True
        if digest is not None:
            yield current, *counts, "".join(audit), digest.hexdigest()

    ordered = made.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    return ordered.mapInArrow(lambda batches: batches_of(tell(batches), RESULT), RESULT)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: the faults of its rows after damage, the cheapest repair and the hash of the repaired text."""
    cut = segments(conversations)
    return repair_whole(cut.where("whole")).unionByName(repair_several(cut.where("not whole")))


def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_conversations(table(spark, folder, "conversations"))
