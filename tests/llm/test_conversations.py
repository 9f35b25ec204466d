import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fathomlab.llm import conversation_repair
from fathomlab.llm.conversation_repair import damage, repair_all, repair_report, repaired_rows

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile("(s?(ua)+)?")


def spoil(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if kind == 3 else 1)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, lines) by layers with whole strings: by the last role so far, the cheapest edits of all rows
    passed; up to three insertions before each row and at the end."""
    layer = {"": (0, "", ())}

    def after(place, initial):
        if initial == "s":
            return "s" if place == "" else None
        if initial == "u":
            return "u" if place in ("", "s", "a") else None
        return "a" if initial == "a" and place == "u" else None

    def closed(layer):
        out = dict(layer)
        for _ in range(3):
            for place, (cost, audit, lines) in list(out.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    to = after(place, initial)
                    if to:
                        new = (cost + 2, audit + "I", lines + ((role, ""),))
                        if to not in out or new[:2] < out[to][:2]:
                            out[to] = new
        return out

    for (_, _, role, text), fault in zip(rows, found):
        new = {}

        def offer(place, state):
            if place is not None and (place not in new or state[:2] < new[place][:2]):
                new[place] = state

        for place, (cost, audit, lines) in closed(layer).items():
            offer(place, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 1 if fault == "truncated" else 0
            offer(after(place, role[:1]), (cost + more, audit + "K", lines + ((role, text),)))
            for initial, to in (("u", "user"), ("a", "assistant")):
                offer(after(place, initial), (cost + more + 2, audit + "R", lines + ((to, text),)))
        layer = new
    return min(v for p, v in closed(layer).items() if p in ("", "a"))


def exhaustive(rows, found):
    """All sequences of edits with up to two insertions in each gap, for very short conversations."""
    choices = []
    for fault in found:
        choices.append(["D"] if fault in ("blank", "duplicate") else ["K", "D", "Ru", "Ra"])
    best = None
    for edits in itertools.product(*choices):
        for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            roles, audit, cost = "", "", 0
            for k, gap in enumerate(gaps):
                roles, audit, cost = roles + gap, audit + "I" * len(gap), cost + 2 * len(gap)
                if k < len(edits):
                    e = edits[k]
                    audit += e[0]
                    cost += {"K": 0, "D": 3, "R": 2}[e[0]] + (found[k] == "truncated" and e != "D")
                    roles += {"K": rows[k][2][:1] or "?", "D": "", "R": e[1:]}[e[0]]
            if PATTERN.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def by_hand(rows, original):
    out = {}
    for conv in {r[0] for r in original}:
        mine = ordered([r for r in rows if r[0] == conv])
        found = faults(mine)
        cost, audit, lines = cheapest(mine, found)
        turns = [r[1] for r in mine if r[1] is not None]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
            sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        )
    return out


def result(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def conversations(seed, many):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "Three?", "no end", "", " \t", "tail. \n", "é.", None]
    rows = []
    for conv in range(many):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None))
            rows.append((conv, rng.choice((turn, turn, turn + 3, 2, None)), role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    return rows


def test_cheapest_edits_are_those_of_all_sequences():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(0, k, rng.choice(("user", "assistant", "system", "tool")), rng.choice(("a.", "b.", "c", ""))) for k in range(rng.randrange(0, 4))]
        found = faults(rows)
        assert cheapest(rows, found)[:2] == exhaustive(rows, found)


def test_repair_equals_brute_force(spark):
    rows = conversations(1, 300)
    rows += [(None, 0, "user", "Hello."), (None, None, None, None), (999, None, "user", None), (2**60, 1, "system", "A."), (2**60, 2**60, "user", "B."), (7, 1, "user", "x" * 200_000 + ".")]
    rows += [(400, 0, "user", "twice."), (400, 0, "user", "twice."), (400, 0, "user", "twice.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fault", F.lit("clash")).withColumn("cost", F.lit(-1))
    spoilt = list(spoil(rows))
    assert sorted(map(tuple, damage(df).collect()), key=repr) == sorted(spoilt, key=repr)
    got = result(repair_all(df, damage(df)))
    assert got == by_hand(spoilt, rows)
    assert {"K", "R", "D", "I"} <= set("".join(v[6] for v in got.values()))


@pytest.mark.parametrize("place", ["in memory", "spilled"])
def test_giant_conversation(spark, monkeypatch, place):
    rng = random.Random(3)
    rows = [(1, k, rng.choice(("user", "assistant", "system")), rng.choice(("a.", "b", f"{k}!"))) for k in range(3_000)]
    if place == "spilled":
        monkeypatch.setattr(conversation_repair, "SPILL", 128)
        steps = conversation_repair.Steps()
        talk = conversation_repair.Conversation("1", steps)
        for (_, turn, role, text), fault in zip(rows, faults(rows)):
            talk.row(turn, role, text, fault)
        assert talk.trail.blocks > 20 and talk.result()[1:] == by_hand(rows, rows)[1]
        assert len(steps.states) < 200
    else:
        assert result(repair_report(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows, rows)


def test_repaired_rows_are_what_was_hashed(spark):
    df = spark.createDataFrame(conversations(2, 60), SCHEMA)
    report = repair_report(df)
    lines = repaired_rows(df, report).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("line", F.concat_ws(":", "role", "text").alias("t")))).alias("all"))
    told = lines.select("conv_id", F.sha2(F.array_join("all.t", "\n"), 256).alias("h")).join(report, "conv_id")
    assert told.count() > 30 and told.filter("h <> repaired_sha256").count() == 0
    roles = repaired_rows(df, report).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("line", "role"))).alias("all")).collect()
    assert all(PATTERN.fullmatch("".join(x["role"][0] for x in r["all"])) for r in roles)


def test_nothing_left(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair_all(none, damage(none)).collect() == []
    gone = next(k for k in range(500) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert result(repair_all(df, damage(df))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
