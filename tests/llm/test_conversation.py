import hashlib
import random
import re
import zlib

import duckdb
import pytest

from kinrank.llm import conversation as C
from pyspark.sql import functions as F

KINDS = "conv_id bigint, turn bigint, role string, text string, copy string, blocks int"


def best_edits(rows):
    """(cost, initials, repaired turns) by trying every list of edits; rows: (role, text, fault)."""
    best = [4 * len(rows) + 1, "", []]

    def go(i, cost, edits, turns):
        if cost > best[0]:
            return
        if not re.match(r"(s?(ua)*u?)$", "".join(r[:1] or "?" for r, _ in turns)):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in turns)):
            if (cost, edits) < (best[0], best[1]) or best[0] > cost:
                best[:] = [cost, edits, list(turns)]
        for role in ("user", "assistant"):
            go(i, cost + 3, edits + "I", [*turns, (role, "")])
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 4, edits + "D", turns)
            if fault not in (1, 2):
                more = 3 if fault == 3 else 0
                go(i + 1, cost + more, edits + "K", [*turns, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + 3 + more, edits + "R", [*turns, (new, text)])
    go(0, 0, "", [])
    return best


def model(rows):
    """The digest row of one conversation, from its (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")
        faults.append(1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0)
        seen.add((role, text))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = [a[:1] + b[:1] for (_, a, _), (_, b, _) in zip(rows, rows[1:])]
    cost, audit, turns = best_edits([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return (gaps, *(faults.count(k) for k in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs),
            cost if rows else 0, audit, sha)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], KINDS)


def summaries(df, **kw):
    got = C.with_all_ids(C.digest(C.repair(df, **kw)), df).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def conversations(rng, n, most=5):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    texts = ["Yes.", "No", "What?  ", " \t", "", None, "Ähm!", "a b\n"]
    out = []
    for c in range(n):
        for t in range(rng.randint(1, most)):
            out.append((c, rng.choice([t, t, t, t + 2, None]), roles[t % 2] if rng.random() < 0.5 else rng.choice(roles), rng.choice(texts)))
    return out


def grouped(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r if r is not None else " ", x if x is not None else " "))
    return by


@pytest.mark.parametrize("rows", [1, 2, 4096])
def test_matches_all_edit_lists(spark, rows):
    data = conversations(random.Random(4), 60) + [(None, 1, "user", "Hi."), (None, None, "assistant", None)]
    assert summaries(table(spark, data), rows=rows) == {c: model(r) for c, r in grouped(data).items()}


def test_long_conversation_over_blocks_and_tasks(spark):
    rng = random.Random(8)
    data = [(7, t, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["Yes.", "cut"]) if rng.random() < .1 else f"Text {t}.")
            for t in range(3000)] + [(1, 0, "user", "x" * 200_000 + "."), (9, 0, "assistant", "End.")]
    whole = summaries(table(spark, data), rows=10 ** 9, chars=10 ** 12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")       # else the small table is one task
    try:
        assert C.blocks(table(spark, data), 16).where("conv_id = 7").select("part").distinct().count() > 1
        assert summaries(table(spark, data), rows=16) == summaries(table(spark, data), rows=500, chars=1000) == whole
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    pieces = C.repair(table(spark, data), rows=100)
    text = [f"{r.role}:{r.text}" for r in C.turns(pieces).where("conv_id = 7").orderBy("part", "block", "place").collect()]
    assert hashlib.sha256("\n".join(text).encode()).hexdigest() == whole[7][-1]
    assert re.fullmatch(r"s?(ua)+", "".join(x[0] for x in text))


def test_walk_keeps_square_root_many_vectors():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 17, 400):
        codes = bytes(rng.randrange(4) | rng.randrange(3) << 2 for _ in range(n))
        edits, states, end = C.walk(codes, C.END, C.BEFORE, True)
        table_ = C.costs(codes)
        assert end in (C.BEFORE, C.A) and len(states) == len(edits) and sum(e != "I" for e in edits) == n
        price = sum({"D": 4, "I": 3, "R": 3, "K": 0}[e] for e in edits)
        price += sum(3 for e, c in zip((e for e in edits if e != "I"), codes) if e != "D" and c >> 2 == C.CUT)
        assert price == min(table_[t] + C.END[t] for t in range(4))


def test_damage_and_query_columns(spark):
    rng = random.Random(6)
    data = conversations(rng, 120, 4) + [(500, 0, "user", "Only."), (None, None, None, None)]
    df = table(spark, data)
    got = C.with_all_ids(C.digest(C.repair(C.damaged(df))), df).collect()
    by = grouped(damage(data))
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(C.repair_sql()).fetchall()))
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: model(by.get(c, [])) for c in {r[0] for r in data}}


def test_empty_table_and_identical_rows(spark):
    none = table(spark, []).where("false")
    assert C.with_all_ids(C.digest(C.repair(none)), none).count() == 0
    same = table(spark, [(1, 0, "user", "Same.")] * 300 + [(2, 0, None, None)])
    got = summaries(same, rows=7)
    assert got[1][2] == 299 and got[1][6] == "K" + "D" * 299 + "I"
    assert C.turns(C.repair(same)).where(F.col("role") == "user").count() == 1
