import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from vecpress.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, n_rows int, digest string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def plain_repair(rows, faults):
    """Cheapest edits, ties to the least string, and the repaired rows: whole edit strings from the last row back."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    given = {"": "u", "s": "u", "a": "u", "u": "a"}
    never = (10**9, "")
    after = {}
    for i in range(len(rows), -1, -1):
        own = {}
        for state in given:
            options = [never]
            if i == len(rows):
                options += [(0, "")] if state in ("", "a") else []
            else:
                options.append((after[state][0] + 3, "D" + after[state][1]))
                if faults[i] not in ("blank", "duplicate"):
                    more = faults[i] == "truncated"
                    if (state, rows[i][2][:1]) in step:
                        cost, edits = after[step[state, rows[i][2][:1]]]
                        options.append((cost + more, "K" + edits))
                    cost, edits = after[given[state]]
                    options.append((cost + 2 + more, "R" + edits))
            own[state] = min(options)
        # up to three insertions before this row; a fourth comes back to where it was
        for _ in range(3):
            own = {s: min(own[s], (own[given[s]][0] + 2, "I" + own[given[s]][1])) for s in given}
        after = own
    cost, edits = after[""]
    out, i, state = [], 0, ""
    for e in edits:
        name = {"u": "user", "a": "assistant"}[given[state]]
        if e == "I":
            out.append(f"{name}:")
        if e == "R":
            out.append(f"{name}:{rows[i][3]}")
        if e == "K":
            out.append(f"{rows[i][2]}:{rows[i][3]}")
            state = step[state, rows[i][2][:1]]
        elif e != "D":
            state = given[state]
        i += e != "I"
    return cost, edits, out


def plain_digest(rows):
    """Rows of one conversation before damage."""
    rows = sorted(plain_damage(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
    faults = plain_faults(rows)
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, edits, out = plain_repair(rows, faults)
    sha = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, sha)


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(spark, rows, partitions=3):
    frame = spark.createDataFrame([(*r, 1, "own") for r in rows], SCHEMA).repartition(partitions)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.digest(frame).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert got == {c: plain_digest(g) for c, g in groups.items()}


def test_least_repairs_of_all_short_signatures():
    letters = {"d": ("user", "blank"), "s": ("system", ""), "u": ("user", ""), "a": ("assistant", ""), "x": ("tool", ""), "U": ("user", "truncated"), "A": ("assistant", "truncated")}
    trie, asked = repair.SharedRepairs(), 0
    for backward in sorted("".join(p) for n in range(5) for p in product(letters, repeat=n)):
        rows, faults = [(0, 0, letters[x][0], "t") for x in backward[::-1]], [letters[x][1] for x in backward[::-1]]
        assert trie.answer(backward) == plain_repair(rows, faults)[:2]
        asked += len(backward)
    assert trie.computed < asked / 3  # layers are shared


def test_query_equals_plain_version(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    check(spark, [tuple(r) for r in rows])


@pytest.mark.parametrize("seed", range(3))
def test_hard_cases(spark, seed):
    """Nulls everywhere, shared turns, repeated rows, odd roles and white space, a long conversation."""
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "cut", "", " \t\n", None, "nbsp ", "é?", "x. \r\n", "..."]
    roles = ["user", "assistant", "system", "tool", "", None, "admin", "usher"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(40)] for _ in range(rng.randint(1, 9))]
    rows += [(99, t, rng.choice(roles[:3]), f"turn {t}" + rng.choice(["", ".", "!"])) for t in range(700)]
    rows += rng.choices(rows, k=30)
    check(spark, rows)


def test_all_rows_dropped_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check(spark, [(gone, 0, "user", "Hello.")])
    assert repair.digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 2, "user", "C.")], "conv_id long, turn long, role string, text string")
    edits = spark.createDataFrame([(1, repair.repair("auu")[1])], "conv_id long, audit string")
    got = [tuple(r) for r in repair.apply(rows, edits, with_rows=True).orderBy("place").collect()]
    want = plain_repair([(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 2, "user", "C.")], ["", "", ""])
    assert [f"{r[2]}:{r[3]}" for r in got] == want[2] and edits.head()["audit"] == want[1]
