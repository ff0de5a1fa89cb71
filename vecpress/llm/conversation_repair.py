"""Structure repair of conversations by dynamic programming shared along a trie.

A conversation becomes a signature, one symbol for each row: whether the row must go (blank, or a
repeat of an earlier row), else the initial of its role and whether its text is cut short. The
cheapest repair depends on the signature alone. Signatures are sorted and walked as the paths of a
prefix trie: a layer of the programme (least cost and first edit from each state to the end) is
computed once for each node, so conversations that share a prefix share its layers, and each
terminal node emits its answer. A layer looks at the rows behind it, so signatures are inserted
from their last row to their first; ties then fall to the ASCII-least edits by comparing single
edits, as the edits that leave a state differ in their letter.

States of the role grammar (s?(ua)+)?: nothing yet, after s, after u, after a. Each state but the
first two admits one role, so the letters of the edits fix the repaired rows.

Three passes, each a sort that spills: rows without their texts become signatures by streaming
over (conversation, turn); signatures are range-sorted with their conversations, so that a
signature of a third of all conversations is spread; edits meet the rows again in one more stream,
an edit row sorted before its conversation's rows, where the repaired text goes into a hash as it
passes. A conversation's rows are never held: one byte a row is, for its signature, and eight for
telling repeats.

Defined cases: a null role or text is one space, and so is a null in the key that decides on
damage; a null conv_id is a conversation of its own. Rows that share a turn go by role, then by
the MD5 of the text; null turns come first. A role whose first letter is none of s, u and a can be
reroled or deleted, not kept. A conversation that loses all rows has zeros, an empty audit and the
hash of nothing; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from vecpress.llm.common import SPACES, materialize, shuffle_partitions

#: Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ENDS = ".!?"
#: State after a role's initial, by the state before it: start, after s, after u, after a.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What a row may be reroled to or inserted as in each state, and the state after it.
GIVEN = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
ACCEPT = (True, False, False, True)
ROLES = {"u": "user", "a": "assistant"}
_NEVER = 1 << 60
#: Rows that a pass hands on at a time.
_OUT = 4096


def symbol(initial: str, fault: str) -> str:
    """A row's letter in a signature: d if it must go; else its initial (x: any other), in upper
    case if its text is cut short."""
    if fault in ("b", "d"):
        return "d"
    kind = initial if initial in ("s", "u", "a") else "x"
    return kind.upper() if fault == "t" else kind


def layer(row: str | None, after: list[tuple[int, str, int]] | None) -> list[tuple[int, str, int]]:
    """(cost, edit, next state) of each state before `row`; row None: after the last one."""
    found = []
    for state in range(4):
        if row is None:
            options = [(0, "", state)] if ACCEPT[state] else []
        else:
            options = [(after[state][0] + DELETE, "D", state)]
            if row != "d":
                more = TRUNCATED if row.isupper() else 0
                kept = STEP[state].get(row.lower())
                if kept is not None:
                    options.append((after[kept][0] + KEEP + more, "K", kept))
                options.append((after[GIVEN[state][1]][0] + REROLE + more, "R", GIVEN[state][1]))
        found.append(min(options, default=(_NEVER, "", state)))
    # insertions stay before the same row; they only help while they lower a cost or a letter
    moved = True
    while moved:
        moved = False
        for state in range(4):
            option = (found[GIVEN[state][1]][0] + INSERT, "I", GIVEN[state][1])
            if option[:2] < found[state][:2]:
                found[state], moved = option, True
    return found


class SharedRepairs:
    """Answers for signatures that come in order of their reversed letters: the path of the last
    one through the trie is kept, with a layer for each of its nodes."""

    def __init__(self):
        self.path, self.layers, self.computed = "", [layer(None, None)], 0

    def answer(self, backward: str) -> tuple[int, str]:
        """Least cost and edits, for the signature whose reversal is `backward`."""
        same, most = 0, min(len(self.path), len(backward))
        while same < most and self.path[same] == backward[same]:
            same += 1
        del self.layers[same + 1 :]
        for row in backward[same:]:
            self.layers.append(layer(row, self.layers[-1]))
        self.computed += len(backward) - same
        self.path = backward
        at, state, edits = len(backward), 0, []
        cost = self.layers[at][0][0]
        while edit := self.layers[at][state][1]:
            edits.append(edit)
            at, state = at - (edit != "I"), self.layers[at][state][2]
        return cost, "".join(edits)


def repair(signature: str) -> tuple[int, str]:
    return SharedRepairs().answer(signature[::-1])


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the crc32 of `conv_id:turn` decides."""
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    role, text = _text("role"), _text("text")
    cut = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ENDS, "")).otherwise(text)
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"), cut.alias("text"), times.alias("times"))
    return out.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times", "again")


def _sorted(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted batches as tuples."""
    for whole in batches:
        for i in range(0, whole.num_rows, _OUT):
            yield from zip(*(c.to_pylist() for c in whole.slice(i, _OUT).columns), strict=True)


def _emit(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, n, distinct turns and their ends as gaps, blank, duplicate, truncated, illegal,
    backward) of each conversation with rows; backward: its signature from the last row."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(bare == "", "b").when(F.instr(F.lit(ENDS), F.right(bare, F.lit(1))) > 0, "").otherwise("t")
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    slim = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", digest.alias("digest"), fault.alias("fault"))
    schema = StructType([rows.schema["conv_id"], *(StructField(n, LongType()) for n in ("n", "gaps", "blank", "duplicate", "truncated", "illegal")), StructField("backward", StringType())])
    arrow = _arrow(schema)

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, started = None, False

        def closed() -> tuple:
            gaps = last - first + 1 - turns if turns else 0
            return (now, len(letters), gaps, faults["b"], faults["d"], faults["t"], illegal, "".join(reversed(letters)))

        for conv, turn, role, digest, fault in _groups(batches):
            if not started or conv != now:
                if started:
                    yield closed()
                now, started, seen, letters = conv, True, set(), []
                faults, illegal, turns, first, last, before = {"b": 0, "d": 0, "t": 0, "": 0}, 0, 0, None, None, None
            if turn is not None and turn != last:
                turns, first, last = turns + 1, turn if first is None else first, turn
            if fault != "b":
                own = hashlib.blake2b(digest + role.encode(), digest_size=8).digest()
                if own in seen:
                    fault = "d"
                seen.add(own)
            faults[fault] += 1
            initial = role[:1]
            illegal += before is not None and before + initial not in ("su", "ua", "au")
            before = initial
            letters.append(symbol(initial, fault))
        if started:
            yield closed()

    return _sorted(slim, "turn", "role", "digest").mapInArrow(lambda batches: _emit(conversations(batches), arrow), schema)


def repairs(found: DataFrame) -> DataFrame:
    """conv_id, cost and audit of `signatures`, by the trie walk over their sorted order."""
    schema = StructType([found.schema["conv_id"], StructField("cost", LongType()), StructField("audit", StringType())])
    arrow = _arrow(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie, last, answer = SharedRepairs(), None, None
        for conv, backward in _groups(batches):
            if backward != last:
                last, answer = backward, trie.answer(backward)
            yield (conv, *answer)

    keys = found.select("conv_id", "backward")
    ranged = keys.repartitionByRange(shuffle_partitions(found.sparkSession), "backward", F.xxhash64("conv_id")).sortWithinPartitions("backward")
    return ranged.mapInArrow(lambda batches: _emit(walk(batches), arrow), schema)


def apply(rows: DataFrame, edits: DataFrame, with_rows: bool = False) -> DataFrame:
    """Applies edits (conv_id, audit) to rows (conv_id, turn, role, text). Returns (conv_id,
    repaired_sha256), or with_rows the repaired rows themselves: (conv_id, place, role, text)."""
    of_edits = edits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"))
    own = rows.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    fields = [StructField("place", IntegerType()), StructField("role", StringType()), StructField("text", StringType())] if with_rows else [StructField("sha", BinaryType())]
    schema = StructType([rows.schema["conv_id"], *fields])
    arrow = _arrow(schema)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conv_id, role, text) of what stays, and (conv_id, None, None) where one ends."""
        now, rest, state, started = None, iter(""), 0, False

        def inserted() -> Iterator[tuple]:
            """The insertions before the next edit of a row; that edit is then in `edit`."""
            nonlocal state, edit
            while (edit := next(rest, "")) == "I":
                initial, state = GIVEN[state]
                yield (now, ROLES[initial], "")

        edit = ""
        for conv, kind, _, role, text, _ in _groups(batches):
            if kind == 0:
                if started:
                    yield from inserted()
                    yield (now, None, None)
                now, rest, state, started = conv, iter(text), 0, True
                continue
            yield from inserted()
            if edit == "K":
                state = STEP[state][role[:1]]
                yield (now, role, text)
            elif edit == "R":
                initial, state = GIVEN[state]
                yield (now, ROLES[initial], text)
        if started:
            yield from inserted()
            yield (now, None, None)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place, total = 0, hashlib.sha256()
        for conv, role, text in repaired(batches):
            if role is None:
                if not with_rows:
                    yield (conv, total.digest())
                place, total = 0, hashlib.sha256()
                continue
            if with_rows:
                yield (conv, place, role, text)
            else:
                total.update(f"\n{role}:{text}".encode() if place else f"{role}:{text}".encode())
            place += 1

    sent = _sorted(of_edits.union(own), "kind", "turn", "role", "digest")
    return sent.mapInArrow(lambda batches: _emit(out(batches), arrow), schema)


def digest(conversations: DataFrame) -> DataFrame:
    """The columns of the query op12, and n_rows: rows after damage."""
    rows = damaged(conversations)
    found = materialize(signatures(rows), "signatures")
    edits = materialize(repairs(found), "repairs")
    hashes = apply(rows, edits).select("conv_id", F.lower(F.hex("sha")).alias("repaired_sha256"))
    # one row a conversation from each pass meets in one aggregate, where nulls are keys too
    columns = {c: t for c, t in [*found.drop("conv_id", "backward").dtypes, *edits.drop("conv_id").dtypes, *hashes.drop("conv_id").dtypes]}

    def wide(part: DataFrame) -> DataFrame:
        return part.select("conv_id", *(F.col(c) if c in part.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))

    parts = wide(conversations.select("conv_id")).union(wide(found)).union(wide(edits)).union(wide(hashes))
    out = parts.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in columns))
    counts = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"), F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"))
