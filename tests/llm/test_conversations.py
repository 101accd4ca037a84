"""Conversation repair against a search over whole edit sequences, in one piece and in many."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tracelake.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, fault string, audit long, conv string, pieces string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, repaired) by growing every edit sequence, the cheapest first; turns are (role, text, fault)."""
    import heapq

    fits = re.compile(r"(s?(ua)+)?")
    partial = re.compile(r"(s?(ua)*u?)?")
    heap, best = [(0, "", 0, ())], None
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        made = "".join(r[0][:1] for r in roles)
        if at == len(turns) and fits.fullmatch(made) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, roles)
        more = [(2, "I", 0, (name, "")) for name in ("user", "assistant")]
        if at < len(turns):
            role, text, fault = turns[at]
            more.append((3, "D", 1, None))
            if fault not in ("blank", "duplicate"):
                cut = int(fault == "truncated")
                more += [(cut, "K", 1, (role, text))] + [(cut + 2, "R", 1, (name, text)) for name in ("user", "assistant")]
        for price, letter, step, new in more:
            grown = roles + ((new,) if new else ())
            if partial.fullmatch("".join(r[0][:1] for r in grown)) and all(len(r[0]) for r in grown) and cost + price <= 3 * len(turns):
                heapq.heappush(heap, (cost + price, audit + letter, at + step, grown))
    return best[0], best[1], "\n".join(f"{r}:{t}" for r, t in best[2])


def slow_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            turns.append((role, text, fault))
            if fault:
                counts[fault] += 1
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, text = cheapest(turns)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def some_rows():
    rng, rows = random.Random(5), []
    for conv in [*range(60), None]:
        for turn in rng.sample([*range(9), None, None], rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, turn, role, rng.choice(["Yes.", "No!", "cut off", "", " \t\n", None, "Grüße. \n", "a.b", "?"])))
    return rows + [(100, None, "user", "Hi."), (100, None, "user", "Hi."), (101, 5, "system", "Be kind."), (102, 0, "system", "A."), (102, 1, "assistant", "B.")]


@pytest.mark.parametrize("piece_turns", [512, 2, 1])
def test_against_all_edit_sequences(spark, piece_turns):
    rows = some_rows()
    table = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)
    out = conversations.damaged_and_repaired(table, piece_turns).collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out}
    assert len(out) == len(got) and got == slow_repair(rows)
    assert all(hashlib.sha256("\n".join(r.repaired).encode()).hexdigest() == r.repaired_sha256 for r in out)


def test_a_long_conversation_and_none(spark):
    rows = spark.range(3000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), "id", F.lit(".")).alias("text"))
    row = conversations.damaged_and_repaired(rows).first()
    plain = damage([(7, i, "assistant" if i % 2 else "user", f"turn {i}.") for i in range(3000)])
    assert row.audit.count("K") + row.audit.count("D") + row.audit.count("R") == len(plain)
    # Costs alone, place by place; no row is a system's.
    cost, seen = {"": 0, "u": 9**9, "a": 9**9}, set()
    for _, _, role, text in plain:
        gone = not text or (role, text) in seen
        seen.add((role, text))
        at = {"": cost[""], "u": min(cost["u"], cost[""] + 2, cost["a"] + 2), "a": min(cost["a"], cost[""] + 4, cost["u"] + 2)}
        stay = lambda c, r: c + 9**9 * gone + (text[-1:] != ".") + 2 * (role[0] != r)  # noqa: B023, E731
        cost = {"": at[""] + 3, "u": min(at["u"] + 3, stay(min(at[""], at["a"]), "u")), "a": min(at["a"] + 3, stay(at["u"], "a"))}
    assert row.cost == min(cost[""], cost["a"], cost["u"] + 2)
    assert re.fullmatch("(ua)*", "".join(x[0] for x in row.repaired))
    assert conversations.damaged_and_repaired(rows.limit(0)).count() == 0
