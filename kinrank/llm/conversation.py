"""Repair of conversation structure by the cheapest edits.

A conversation is well formed if its role initials read ``(s?(ua)+)?``.  Its
rows, by turn, are faulty if blank, a duplicate (role and text seen earlier) or
truncated (no final mark).  Edits: keep (0), rerole to user or assistant (3),
delete (4, forced for blank rows and duplicates), insert an empty user or
assistant turn anywhere (3); a truncated row that stays costs 3 more.  Of the
cheapest edit lists the one with the ASCII-least initials (D, I, K, R) is taken.

The grammar is a machine of four states (before all, after s, after u, after
a), so each position has a vector of four costs to the end.  Rows are range
partitioned by conversation and turn, so that a conversation of any length is
dealt out over tasks, and packed into blocks of at most ``ROWS`` rows.  Within a
block the dynamic program keeps its backward vectors only at every
sqrt(rows)-th position and recomputes a stretch of them while it walks forward
along tight edits.  Conversations of several blocks pass through two chains
over the blocks' 4 x 4 cost tables (bounded rows, no texts): backwards for the
costs behind each block, forwards for the state in which the walk enters it.

`digest` hashes a conversation's repaired text, which has to be read in order: it
streams the blocks of a conversation through one task, one block in memory.

Defined cases: a null role or text is taken as one space, a null turn sorts
first, a null conv_id is a conversation; rows of equal turn go by role, then
text; repeated rows are duplicates; a role whose first letter is none of s, u, a
can only be reroled or deleted; very long texts are blocks of their own; a
conversation without rows is well formed; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinrank.llm.shared import written

ROWS = 4096                  # of a block
CHARS = 4_000_000            # of the texts of a block, which ends with the row that reaches them
RATE = 20                    # one row in so many gets each kind of damage

RING = "other", "s", "u", "a"                # classes of roles
OK, DROP, CUT = 0, 1, 2                      # what is wrong with a row: nothing, must go, truncated
DELETE, REROLE, INSERT, OPEN = 4, 3, 3, 3    # costs
BEFORE, S, U, A = range(4)                   # states
NEXT = (U, U, A, U)                          # the state after a reroled or inserted turn
NEVER = 1 << 40
END = (0, 6, 3, 0)                           # costs behind the last row
ROLE = {U: "user", A: "assistant"}
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"

BLOCK = ("conv_id {id}, part int, block int, codes binary, roles array<string>, texts array<string>, "
         "costs array<bigint>, n_turns bigint, low {turn}, high {turn}")
PIECE = ("conv_id {id}, part int, block int, audit string, cost bigint, repaired array<struct<role:string,text:string>>, "
         "blank bigint, duplicate bigint, truncated bigint, illegal bigint, initials string, "
         "n_turns bigint, low {turn}, high {turn}")
SUMMARY = ("conv_id {id}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
           "audit string, repaired_sha256 string")


# ------------------------------------------------------------------ the dynamic program
def step(code: int, n) -> tuple:
    """The cost vector before a row, from the one behind it."""
    c0, c1, c2, c3 = n[0] + DELETE, n[1] + DELETE, n[2] + DELETE, n[3] + DELETE
    fault, kind = code >> 2, code & 3
    if fault != DROP:
        more = OPEN if fault == CUT else 0
        to_u, to_a = n[2] + REROLE + more, n[3] + REROLE + more
        if kind == U:
            to_u -= REROLE
        elif kind == A:
            to_a -= REROLE
        c0, c1, c2, c3 = min(c0, to_u), min(c1, to_u), min(c2, to_a), min(c3, to_u)
        if kind == S:
            c0 = min(c0, n[1] + more)
    c2, c3 = min(c2, c3 + INSERT), min(c3, c2 + INSERT)
    return min(c0, c2 + INSERT), min(c1, c2 + INSERT), c2, c3


def costs(codes: bytes) -> list[int]:
    """The cost of a block from each state before it to each state behind it, row by row."""
    ends = []
    for t in range(4):
        v = tuple(0 if s == t else NEVER for s in range(4))
        for code in reversed(codes):
            v = step(code, v)
        ends.append(v)
    return [min(ends[t][s], NEVER) for s in range(4) for t in range(4)]


def walk(codes: bytes, behind, state: int, last: bool):
    """The ASCII-least tight edits of a block: (initials, state after each edit, final state).

    Vectors are kept at every `width`-th position and recomputed stretch by stretch."""
    n = len(codes)
    width = max(1, int(n ** 0.5))
    kept, v = {}, tuple(behind)
    for i in range(n - 1, -1, -1):
        if (i + 1) % width == 0 or i + 1 == n:
            kept[i + 1] = v
        v = step(codes[i], v)
    edits, states = [], []
    for low in range(0, n, width):
        high = min(low + width, n)
        stretch = [kept[high]]
        for i in range(high - 1, low - 1, -1):
            stretch.append(step(codes[i], stretch[-1]))
        stretch.reverse()
        for i in range(low, high):
            here, there, code = stretch[i - low], stretch[i - low + 1], codes[i]
            while True:
                left = here[state]
                if left == there[state] + DELETE:
                    edits.append("D")
                elif left == here[NEXT[state]] + INSERT:
                    edits.append("I")
                    state = NEXT[state]
                    states.append(state)
                    continue
                else:
                    more = OPEN if code >> 2 == CUT else 0
                    to = S if code & 3 == S and state == BEFORE else NEXT[state] if code & 3 == NEXT[state] else None
                    if to is not None and left == there[to] + more:
                        edits.append("K")
                        state = to
                    else:
                        edits.append("R")
                        state = NEXT[state]
                states.append(state)
                break
    while last and state in (S, U):
        edits.append("I")
        state = NEXT[state]
        states.append(state)
    return "".join(edits), states, state


# ------------------------------------------------------------------ rows to blocks
def _ordered(conversations: DataFrame) -> DataFrame:
    """Rows by conversation, turn, role and text, with `seen`: an earlier turn has this role and text."""
    space = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"),
                                F.coalesce(F.col("text"), space).alias("text")).withColumn("h", F.unhex(F.md5("text")))
    first = (rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("g"))
             .agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("none"))
             .where("n > 1"))
    rows = rows.join(first, rows.conv_id.eqNullSafe(first.c) & (rows.role == first.r) & (rows.h == first.g), "left")
    seen = F.col("turn").isNotNull() & (F.col("none") | (F.col("turn") > F.col("least")))
    rows = rows.select("conv_id", "turn", "role", "text", F.coalesce(seen, F.lit(False)).alias("seen"))
    return (rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32))
            .sortWithinPartitions("conv_id", "turn", "role", "text"))


def _fault(text: str, seen: bool) -> int:
    """0 sound, 1 blank, 2 duplicate, 3 truncated: the first that holds."""
    end = text.rstrip(SPACES)
    return 1 if not end else 2 if seen else 3 if end[-1] not in ".!?" else 0


def blocks(conversations: DataFrame, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """Runs of rows of one conversation, in order by (part, block).

    A code holds the class of the role (2 bits), the fault to mend (2 bits) and,
    for reports, the kind of fault (from bit 4)."""
    kinds = dict(conversations.dtypes)
    schema = BLOCK.format(id=kinds["conv_id"], turn=kinds["turn"])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, done, size = TaskContext.get().partitionId(), [], 0
        conv, number, codes, roles, texts, length = object(), 0, bytearray(), [], [], 0
        turns, low, high, before = 0, None, None, None
        types = None

        def close():
            known = bytes(c & 15 for c in codes)
            done.append((conv, part, number, bytes(codes), roles, texts, costs(known), turns, low, high))

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), types)], names=names)

        names = ["conv_id", "part", "block", "codes", "roles", "texts", "costs", "n_turns", "low", "high"]
        for b in batches:
            at = {f.name: f.type for f in b.schema}
            types = [at["conv_id"], pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()),
                     pa.list_(pa.int64()), pa.int64(), at["turn"], at["turn"]]
            for start in range(0, b.num_rows, 256):
                rows_ = b.slice(start, 256)
                for c, turn, role, text, seen in zip(*(rows_.column(rows_.schema.get_field_index(k)).to_pylist()
                                                       for k in ("conv_id", "turn", "role", "text", "seen"))):
                    other = c != conv
                    if other or len(codes) >= rows or length >= chars:
                        if codes:
                            close()
                            size += length
                            if size > chars or len(done) >= 4096:
                                yield flush()
                                done, size = [], 0
                        number = 0 if other else number + 1
                        conv, codes, roles, texts, length = c, bytearray(), [], [], 0
                        turns, low, high = 0, None, None
                        before = None if other else before
                    fault = _fault(text, seen or before == (turn, role, text))
                    code = RING.index(role[:1]) if role[:1] in RING else 0
                    codes.append(code | (DROP if fault in (1, 2) else CUT if fault == 3 else OK) << 2 | fault << 4)
                    if turn is not None:
                        if turn != high:
                            turns += 1
                        low, high = turn if low is None else low, turn
                    before = (turn, role, text)
                    roles.append(role), texts.append(text)
                    length += len(text)
        if codes:
            close()
            yield flush()
    return _ordered(conversations).mapInArrow(run, schema)


# ------------------------------------------------------------------ chains over the blocks of long conversations
def _chain(rows: DataFrame, columns: list[str], solve) -> DataFrame:
    """One call of `solve` for each conversation of several blocks, with its blocks' columns in order."""
    gathered = (rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "block", *columns))).alias("blocks"))
                .where(F.size("blocks") > 1))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            convs, parts, numbers, first, second = [], [], [], [], []
            for conv, of in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x, y in zip(of, solve(of)):
                    convs.append(conv), parts.append(x["part"]), numbers.append(x["block"])
                    first.append(y[0]), second.append(y[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(convs, b.schema.field(0).type), pa.array(parts, pa.int32()), pa.array(numbers, pa.int32()),
                 pa.array(first, pa.list_(pa.int64())), pa.array(second, pa.int32())],
                names=["conv_id", "part", "block", "behind", "entry"])
    return gathered.mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, part int, block int, behind array<bigint>, entry int")


def _backward(of):
    """(costs behind a block, 0) for each block; the last one is followed by nothing (END)."""
    out, v = [], list(END)
    for x in reversed(of):
        out.append((v, 0))
        m = x["costs"]
        v = [min(m[4 * s + t] + v[t] for t in range(4)) for s in range(4)]
    return out[::-1]


def _forward(of):
    """(costs behind a block, the state in which the walk enters it)."""
    state = BEFORE
    for x in of:
        yield x["behind"], state
        state = x["exits"][state]


def _matched(rows: DataFrame, other: DataFrame, how: str, *columns: str) -> DataFrame:
    other = other.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("block").alias("b"), *columns)
    same = rows.conv_id.eqNullSafe(other.c) & (rows.part == other.p) & (rows.block == other.b)
    return rows.join(other, same, how).drop("c", "p", "b")


def _exits(rows: DataFrame) -> DataFrame:
    """The state behind a block for each state before it."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            get = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            out = [[walk(bytes(c & 15 for c in codes), behind, s, False)[2] for s in range(4)]
                   for codes, behind in zip(get["codes"].to_pylist(), get["behind"].to_pylist())]
            yield pa.RecordBatch.from_arrays([get["conv_id"], get["part"], get["block"], get["behind"],
                                              pa.array(out, pa.list_(pa.int32()))],
                                             names=["conv_id", "part", "block", "behind", "exits"])
    return rows.select("conv_id", "part", "block", "codes", "behind").mapInArrow(
        run, f"conv_id {dict(rows.dtypes)['conv_id']}, part int, block int, behind array<bigint>, exits array<int>")


# ------------------------------------------------------------------ repaired blocks
def repair(conversations: DataFrame, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """The edits and repaired turns of each block, with counts of faults and what joins blocks together.

    (part, block) orders the blocks of a conversation; `initials` are the roles
    of its first and last row before the repair."""
    of = written(blocks(conversations, rows, chars))
    kinds = dict(of.dtypes)
    behind = _chain(of, ["costs"], _backward)
    known = _matched(of.select("conv_id", "part", "block", "codes"), behind, "inner", "behind")
    entries = written(_chain(_exits(known), ["behind", "exits"], _forward))
    last = entries.groupBy(F.col("conv_id").alias("k")).agg(F.max(F.struct("part", "block")).alias("last"))
    entries = (entries.join(last, F.col("conv_id").eqNullSafe(F.col("k")))
               .withColumn("last", F.struct("part", "block") == F.col("last")).drop("k"))
    joined = _matched(of, entries, "left", "behind", "entry", "last").drop("costs")

    def run(batches):
        import pyarrow as pa
        for b in batches:
            for start in range(0, b.num_rows, 256):
                yield _pieces(pa, b.slice(start, 256))
    return joined.mapInArrow(run, PIECE.format(id=kinds["conv_id"], turn=kinds["low"]))


def _pieces(pa, b):
    get = {f.name: b.column(i) for i, f in enumerate(b.schema)}
    out = []
    for codes, roles, texts, behind, entry, last in zip(*(get[k].to_pylist() for k in (
            "codes", "roles", "texts", "behind", "entry", "last"))):
        plain = bytes(c & 15 for c in codes)
        alone = entry is None
        edits, states, _ = walk(plain, END if alone else behind, BEFORE if alone else entry, alone or last)
        turns, at, cost = [], 0, 0
        after = iter(states)
        for e in edits:
            state = next(after)
            if e == "I":
                turns.append({"role": ROLE[state], "text": ""})
                cost += INSERT
                continue
            if e == "D":
                cost += DELETE
            else:
                turns.append({"role": roles[at] if e == "K" else ROLE[state], "text": texts[at]})
                cost += (REROLE if e == "R" else 0) + (OPEN if plain[at] >> 2 == CUT else 0)
            at += 1
        kinds = [c >> 4 for c in codes]
        starts = [r[:1] for r in roles]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(starts, starts[1:]))
        out.append((edits, cost, turns, kinds.count(1), kinds.count(2), kinds.count(3), illegal,
                    f"{starts[0] or ' '}{starts[-1] or ' '}"))
    cols = list(zip(*out)) or [()] * 8
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    types = [pa.string(), pa.int64(), turn, *[pa.int64()] * 4, pa.string()]
    names = ["audit", "cost", "repaired", "blank", "duplicate", "truncated", "illegal", "initials"]
    arrays = [pa.array(list(c), t) for c, t in zip(cols, types)]
    return pa.RecordBatch.from_arrays([get["conv_id"], get["part"], get["block"], *arrays, get["n_turns"], get["low"], get["high"]],
                                      names=["conv_id", "part", "block", *names, "n_turns", "low", "high"])


def turns(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, block, place, role, text): the repaired turns, in order by (part, block, place)."""
    return (pieces.select("conv_id", "part", "block", F.posexplode("repaired").alias("place", "t"))
            .select("conv_id", "part", "block", "place", "t.role", "t.text"))


def digest(pieces: DataFrame) -> DataFrame:
    """One row for each conversation that has rows: counts, cost, edit initials and hash of the repaired text."""
    kinds = dict(pieces.dtypes)

    def run(batches):
        import pyarrow as pa
        done, conv, now = [], object(), None
        counted = ("blank", "duplicate", "truncated", "illegal", "cost")

        def close():
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["n_turns"]
            done.append((conv, gaps, *(now[k] for k in counted), "".join(now["audit"]), now["sha"].hexdigest()))

        types = None
        names = ["conv_id", "gaps", *counted, "audit", "repaired_sha256"]
        for b in batches:
            types = [b.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for start in range(0, b.num_rows, 256):
                for x in b.slice(start, 256).to_pylist():
                    if x["conv_id"] != conv:
                        if now:
                            close()
                        conv = x["conv_id"]
                        now = {"sha": hashlib.sha256(), "audit": [], "any": False, "low": None, "high": None, "n_turns": 0,
                               "end": None} | dict.fromkeys(counted, 0)
                    for k in counted:
                        now[k] += x[k]
                    first, end = x["initials"]
                    if now["end"] and now["end"] + first not in ("su", "ua", "au"):
                        now["illegal"] += 1
                    now["end"] = end
                    if x["low"] is not None:
                        now["n_turns"] += x["n_turns"] - (x["low"] == now["high"])
                        now["low"] = x["low"] if now["low"] is None else now["low"]
                        now["high"] = x["high"]
                    now["audit"].append(x["audit"])
                    for t in x["repaired"]:
                        now["sha"].update(("\n" if now["any"] else "").encode() + f"{t['role']}:{t['text']}".encode())
                        now["any"] = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), types)], names=names)
                done = []
        if now:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), types)], names=names)
    return (pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
            .mapInArrow(run, SUMMARY.format(id=kinds["conv_id"])))


# ------------------------------------------------------------------ the damage of op12
def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the checksum of `conv_id:turn`: dropped, emptied, without final
    marks, repeated, or given to the user.  Nulls are one space."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % RATE
    text = shown("text")
    return (conversations.withColumn("k", kind).where("k <> 0")
            .select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(shown("role")).alias("role"),
                    F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                    F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy"))
            .drop("copy"))


def with_all_ids(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """`found` with a row of zeros for every conversation that has no rows left."""
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    zero = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    zero |= {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return (ids.join(found, ids.id.eqNullSafe(found.conv_id), "left")
            .select(F.col("id").alias("conv_id"), *[F.coalesce(F.col(c), z).alias(c) for c, z in zero.items()]))


def repair_sql() -> str:
    """The `op12_conversation` rows as DuckDB SQL: damage, faults, and the cheapest edits from the last row to the first."""
    step = ("list_reduce(list_concat([xor(c, b)], range(8)::UBIGINT[]), lambda x, _: "
            "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)")
    checksum = (f"xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, strlen(key) + 1), "
                f"lambda i: ord(substr(key, i, 1))::UBIGINT)), lambda c, b: {step}), 4294967295::UBIGINT)")
    to, sure = {1: 3, 2: 3, 3: 4, 4: 3}, "fault NOT IN (1, 2)"
    role = {3: "'user:'", 4: "'assistant:'"}

    def kept(s: int) -> str:
        cases = f"WHEN role[1] = '{'a' if s == 3 else 'u'}' THEN {to[s]}" + (" WHEN role[1] = 's' THEN 2" if s == 1 else "")
        t = f"v[CASE {cases} END]"
        return (f"CASE WHEN {sure} AND {t} IS NOT NULL THEN {{'c': {t}.c + more, 'a': 'K' || {t}.a, "
                f"'r': list_concat([role || ':' || text], {t}.r)}} END")

    def options(s: int) -> str:
        t = f"v[{to[s]}]"
        return (f"list_min(list_filter([{{'c': v[{s}].c + {DELETE}, 'a': 'D' || v[{s}].a, 'r': v[{s}].r}}, {kept(s)}, "
                f"CASE WHEN {sure} THEN {{'c': {t}.c + {REROLE} + more, 'a': 'R' || {t}.a, "
                f"'r': list_concat([{role[to[s]]} || text], {t}.r)}} END], lambda x: x IS NOT NULL)) AS q{s}")

    def inserted(q: str, r: str) -> str:
        return f"{{'c': {q}.c + {INSERT}, 'a': 'I' || {q}.a, 'r': list_concat([{r}], {q}.r)}}"
    least = lambda s, q: f"list_min([q{s}, {inserted(q, role[to[s]])}])"
    return rf"""
    WITH RECURSIVE k AS (SELECT *, {checksum} % {RATE} AS k FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role,
        coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)),
    d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN ''
          WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
          unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
    f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
            lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM o),
    r AS (SELECT *, CASE fault WHEN 3 THEN {OPEN} ELSE 0 END AS more, coalesce(conv_id::VARCHAR, ' ') AS id FROM f),
    v AS (SELECT id, max(i) + 1 AS i, [{{'c': 0, 'a': '', 'r': []::VARCHAR[]}}, {{'c': {END[1]}, 'a': 'II', 'r': ['user:', 'assistant:']}},
            {{'c': {END[2]}, 'a': 'I', 'r': ['assistant:']}}, {{'c': 0, 'a': '', 'r': []}}] AS v FROM r GROUP BY id
          UNION ALL
          SELECT id, i, [{least(1, 'y3')}, {least(2, 'y3')}, y3, y4] FROM (
            SELECT *, {least(3, 'q4')} AS y3, {least(4, 'q3')} AS y4 FROM (
              SELECT r.id, r.i, {options(1)}, {options(2)}, {options(3)}, {options(4)}
              FROM v JOIN r ON r.id = v.id AND r.i = v.i - 1))),
    s AS (SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
            count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
            count(*) FILTER (b IS NOT NULL AND left(b, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY id)
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
           coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v[1].c, 0)::BIGINT AS cost,
           coalesce(v[1].a, '') AS audit, sha256(coalesce(array_to_string(v[1].r, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS id FROM conversations) c
    LEFT JOIN s ON s.id = c.id LEFT JOIN v ON v.id = c.id AND v.i = 1"""
