"""Conversation repair against the definition."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from wattframe.llm.audit_paths import FINAL, Turns, costs_to_end, least_paths
from wattframe.llm.conversations import damaged, repair, summary

WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, messages) by trying every edit in every state of the pattern, least audit first."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(states):
        for _ in range(3):
            for (state, (cost, audit, said)), role in itertools.product(list(states.items()), ("user", "assistant")):
                to = step.get((state, role[0]))
                if to is not None:
                    states[to] = min(states.get(to, (10**9, "", ())), (cost + 3, audit + "I", (*said, role + ":")))
        return states

    states = inserted({0: (0, "", ())})
    for fault, role, text in turns:
        after = {}
        for state, (cost, audit, said) in states.items():
            ways = [(state, (cost + 4, audit + "D", said))]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role and (state, role[0]) in step:
                    ways.append((step[state, role[0]], (cost + more, audit + "K", (*said, f"{role}:{text}"))))
                for new in ("user", "assistant"):
                    if (state, new[0]) in step:
                        ways.append((step[state, new[0]], (cost + more + 3, audit + "R", (*said, f"{new}:{text}"))))
            for to, way in ways:
                after[to] = min(after.get(to, (10**9, "", ())), way)
        states = inserted(after)
    return min(states[s] for s in (0, 3) if s in states)


def brute(rows):
    kept, found = damage(rows), {}
    for conv in {r[0] for r in rows}:
        turns = sorted(kept[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        met, faults = set(), []
        for _, role, text in turns:
            said = text.strip(WHITE)
            faults.append("blank" if not said else "duplicate" if (role, text) in met else "truncated" if said[-1] not in ".!?" else "")
            met.add((role, text))
        known = [t for t, *_ in turns if t is not None]
        cost, audit, said = cheapest([(f, r, t) for f, (_, r, t) in zip(faults, turns)])
        found[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns)),
            cost,
            audit,
            hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return found


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def result(spark, rows, segment_turns=1024):
    conversations = frame(spark, rows)
    got = summary(conversations, damaged(conversations), segment_turns).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got}


def odd_rows(n_conversations, seed, most=12):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "User", "tool", "", None, "u", "sys", "été"]
    texts = ["Yes.", "no", "", None, " \t", "Why?", "é…", "Stop!  ", "a.b", "\x1c", "Yes."]
    return [
        (conv, rng.choice([None, rng.randint(0, 14), rng.randint(0, 14)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.")
        for conv in range(n_conversations)
        for _ in range(rng.randint(1, most))
    ] + [(None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (None, None, None, None)]


def test_repair_is_the_cheapest_with_the_least_audit(spark, small):
    given = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = odd_rows(400, 1) + [(10_000 + c, *r) for c, *r in given]
    rows += [(20_000, t, r, "Fine.") for t, r in enumerate(["system", "user", "assistant"] * 20)]
    assert result(spark, rows) == brute(rows)


def test_conversations_in_many_segments(spark):
    rng = random.Random(7)
    long = [
        (conv, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["Yes.", f"{turn}.", f"{turn}", ""]))
        for conv, n in ((5, 700), (6, 90), (7, 33))
        for turn in range(n)
    ]
    same = [(8, 3, "user", "Again.")] * 200 + [(8, None, "assistant", "x")] * 50
    rows = long + same + odd_rows(40, 3) + [(-1, t, "system", "Hello.") for t in range(9)]
    assert result(spark, rows, 7) == brute(rows)
    segments = repair(damaged(frame(spark, rows)), 7)
    sizes = [r.n for r in segments.groupBy("conv_id").count().withColumnRenamed("count", "n").where("conv_id = 5").collect()]
    assert sizes[0] > 20


def test_large_texts_end_a_segment(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t} " + "x" * 1_500_000 + ".") for t in range(10)]
    assert result(spark, rows) == brute(rows)
    assert repair(damaged(frame(spark, rows))).count() > 1


def test_nothing_and_all_rows_lost(spark):
    empty = frame(spark, [])
    assert summary(empty, damaged(empty)).count() == 0
    lost = next((c, t) for c in range(100) for t in range(100) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert result(spark, [(*lost, "user", "Hi.")]) == {lost[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_other_columns_do_not_matter(spark):
    rows = odd_rows(30, 5)
    plain = frame(spark, rows)
    wide = plain.selectExpr("*", "'x' AS part", "1 AS seq", "turn AS copies", "role AS audit", "text AS digest", "conv_id AS own")
    assert sorted(map(str, summary(wide, damaged(wide)).collect())) == sorted(map(str, summary(plain, damaged(plain)).collect()))


@pytest.mark.parametrize("seed", range(5))
def test_paths_of_random_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 9, 60)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    role, gone, cut = rng.integers(0, 4, starts[-1]), rng.random(starts[-1]) < 0.2, rng.random(starts[-1]) < 0.2
    turns = Turns(role, gone, np.where(cut, 3, 0), starts)
    costs = costs_to_end(turns, np.broadcast_to(FINAL, (60, 1, 4)).copy())[:, 0]
    paths = least_paths(turns, costs, np.zeros(60, np.int64), np.ones(60, bool))
    for i in range(60):
        own = range(starts[i], starts[i + 1])
        names = ["system", "user", "assistant", "tool"]
        given = [("blank" if gone[j] else "truncated" if cut[j] else "", names[role[j]], "x") for j in own]
        cost, audit, _ = cheapest(given)
        letters = "".join("DIKR"[x] for x in paths.letter[paths.starts[i] : paths.starts[i + 1]])
        assert (paths.cost[i], letters) == (cost, audit)
