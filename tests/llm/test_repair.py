"""Conversation repair against plain versions: a walk over edits row by row, and a parse over all splits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from epispan.llm import repair
from epispan.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
DDL = "conv_id bigint, turn bigint, role string, text string, audit string, copies int, digest string"
WHITE = " \t\n\x0b\x0c\r"
SOUND = re.compile("(s?(ua)+)?")
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain_damage(rows):
    """Damaged rows per conversation, in order."""
    out = {}
    for conv_id, turn, role, text in rows:
        own = out.setdefault(conv_id, [])
        role, text = (" " if x is None else x for x in (role, text))
        name = "{}:{}".format(*(" " if x is None else x for x in (conv_id, turn)))
        fault = zlib.crc32(name.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        own += [(turn, role, text)] * (2 if fault == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, key(*r[1:])))
    return out


def plain_repair(rows):
    """All result columns of one conversation's damaged rows; the cheapest edits by a walk that keeps the best of every state."""
    seen, looks = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        looks.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    states = {"": (0, "", ())}  # by the last initial; none at the start

    def offer(into, state, value):
        into[state] = min(into.get(state, value), value)

    def inserted(states):
        out = dict(states)
        for _ in range(4):
            for last, (cost, audit, made) in list(out.items()):
                for letter in NEXT[last]:
                    if letter != "s":
                        offer(out, letter, (cost + 3, audit + "I", (*made, (letter, None))))
        return out

    states = inserted(states)
    for place, ((_, role, _), look) in enumerate(zip(rows, looks, strict=True)):
        after = {}
        for last, (cost, audit, made) in states.items():
            offer(after, last, (cost + 4, audit + "D", made))
            if look in ("", "truncated"):
                extra = 3 if look else 0
                for letter in NEXT[last]:
                    if role[:1] == letter:
                        offer(after, letter, (cost + extra, audit + "K", (*made, (None, place))))
                    if letter != "s":
                        offer(after, letter, (cost + extra + 3, audit + "R", (*made, (letter, place))))
        states = inserted(after)
    cost, audit, made = min(states[s] for s in ("", "a") if s in states)
    named = {"u": "user", "a": "assistant", None: None}
    lines = [(named[letter] or rows[at][1]) + ":" + ("" if at is None else rows[at][2]) for letter, at in made]
    assert SOUND.fullmatch("".join(x[0] for x in lines))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    counts = [looks.count(x) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(rows):
    return {i: plain_repair(own) for i, own in plain_damage(rows).items()}


def found(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 9, "d") for r in rows], DDL).repartition(5)


def fixture():
    draw = random.Random(4)
    texts = ["Fine.", "Fine?", "cut off", "cut off, \n", "", " \t\n", None, "ü!", "日本。", "a.b", "x" * 5000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "userland", "User"]
    rows = []
    for conv_id in range(400):
        turn = 0
        for _ in range(draw.randint(1, 9)):
            turn += draw.choice((1, 1, 1, 1, 2, 5))
            rows.append((conv_id, turn, draw.choice(roles), draw.choice(texts)))
    rows += [(1000, t, ("user", "assistant")[t % 2], f"Turn {t % 700}.") for t in range(3000)]  # longer than a partition
    rows += [(1001, 3, "user", "The same.")] * 50  # equal rows
    rows += [(1002, None, "user", "No turn."), (1002, None, "assistant", "None here."), (1002, 4, "user", "Four.")]
    rows += [(None, t, "user", "No id.") for t in range(3)] + [(1003, None, None, None)]
    return rows


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_repair"](spark, SF_DIR)) == plain(rows)


def test_edge_cases_and_conversations_over_partitions(spark, monkeypatch):
    rows = fixture()
    want = plain(rows)
    assert found(repair.repair(frame(spark, rows))) == want
    assert any(w[-2] == "" for w in want.values())  # some conversation lost all rows


def test_repaired_rows(spark):
    rows = frame(spark, fixture())
    damaged = repair.damaged(rows)
    audits = repair.parse(damaged)
    edits = {}
    for r in repair.repaired_rows(damaged, audits).orderBy("conv_id", "position").collect():
        if r.position is not None:
            edits.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
            assert r.position == len(edits[r.conv_id])
    for r in repair.repair(rows).collect():
        assert hashlib.sha256("\n".join(edits.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_empty_table(spark):
    assert repair.repair(frame(spark, [])).collect() == []


def all_splits(cells):
    """The full chart: every span from every split."""
    chart = {(k, k + 1): cell for k, cell in enumerate(cells)}
    for length in range(2, len(cells) + 1):
        for i in range(len(cells) - length + 1):
            offers = [repair.combined(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)]
            assert all(o == offers[0] for o in offers)  # whichever way a span is split
            chart[i, i + length] = offers[0]
    return chart[0, len(cells)]


@pytest.mark.parametrize("seed", range(20))
def test_spans_do_not_depend_on_their_split(seed):
    draw = random.Random(seed)
    cells = [repair.row_cell(draw.choice(["s", "u", "a", "t", ""]), draw.randrange(4)) for _ in range(draw.randint(1, 9))]
    assert repair.parsed(cells) == all_splits(cells)
