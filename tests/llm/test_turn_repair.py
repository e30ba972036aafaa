import hashlib
import heapq
import re
import zlib

from helpers import rng

from tallyhawk.llm import turn_repair
from tallyhawk.llm.sequence_queries import op12_turn_repair

WORD = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
CONV = "conv_id long, turn long, role string, text string"


def fits(roles):
    return re.fullmatch("(s?(ua)+)?", roles) is not None


def cheapest(rows):
    """(cost, edits, roles) by best-first search over whole strings of roles: (initial, fault) rows."""
    heap = [(0, "", 0, "")]
    seen = set()
    while heap:
        cost, edits, i, roles = heapq.heappop(heap)
        if i == len(rows) and fits(roles):
            return cost, edits
        # what may follow hangs on the last two roles, and on inserts made here
        key = (i, roles[-2:] if len(roles) > 1 else roles, len(edits) - len(edits.rstrip("I")))
        if key in seen or not re.fullmatch("s?(ua)*u?", roles):
            continue
        seen.add(key)
        if key[2] < 4:
            for role in "ua":
                heapq.heappush(heap, (cost + 3, edits + "I", i, roles + role))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, roles))
            if fault not in ("b", "d"):
                extra = 3 if fault else 0
                if initial:
                    heapq.heappush(heap, (cost + extra, edits + "K", i + 1, roles + initial))
                for role in "ua":
                    heapq.heappush(heap, (cost + 3 + extra, edits + "R", i + 1, roles + role))


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def report(conv, rows):
    """One row of the query for rows (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, pairs = set(), []
    for _, role, text in rows:
        marks = WORD.findall(text)
        fault = "b" if not marks else "d" if (role, text) in seen else "t" if marks[-1] not in ".!?" else ""
        seen.add((role, text))
        pairs.append((role[:1], fault))
    faults = [f for _, f in pairs]
    turns = {t for t, _, _ in rows if t is not None}
    cost, edits = cheapest(pairs)
    lines, state, i = [], "", 0
    for e in edits:
        needed = "assistant" if state == "u" else "user"
        role, text = (needed, "") if e == "I" else rows[i][1:]
        i += e != "I"
        if e != "D":
            role = needed if e == "R" else role
            lines.append(f"{role}:{text}")
            state = role[:1]
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:])), cost, edits,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def reports(rows):
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    return {c: report(c, r) for c, r in by.items()}


def found(repaired, every):
    return {x.conv_id: tuple(x[c] for c in COLUMNS) for x in turn_repair.repair_report(repaired, every).collect()}


def random_rows(r, conversations, longest):
    rows = []
    for c in range(conversations):
        for t in range(r.randint(1, longest)):
            rows.append((c, r.choice([t, t, t, t // 2, None]), r.choice(["user", "assistant"] if t else ["system", "user"]) if r.random() < 0.9
                         else r.choice(["tool", "system", "", None, "assistant"]), r.choice(["Yes.", "no", "What?", " ", f"t{t}!", None, "Hi. \n"])))
    return rows


def test_search_equals_best_first():
    r = rng(2)
    for _ in range(1500):
        rows = [(r.choice("suaaux"), r.choice(["", "", "", "t", "b", "d"])) for _ in range(r.randint(1, 9))]
        assert turn_repair.Search(rows, turn_repair.END).cheapest(0) == cheapest(rows)


def test_long_conversations_search():
    r = rng(7)
    for n in (60, 300):
        rows = [(r.choice("ua") if r.random() < 0.2 else "ua"[i % 2], r.choice(["", "", "", "", "t", "b", "d"])) for i in range(n)]
        assert turn_repair.Search(rows, turn_repair.END).cheapest(0) == cheapest(rows)


def test_whole_and_cut_conversations_equal_brute_force(spark):
    rows = random_rows(rng(5), 40, 30)
    want = reports([(c, t, " " if a is None else a, " " if x is None else x) for c, t, a, x in rows])
    df = spark.createDataFrame(rows, CONV).repartition(3)
    for block, ranges in ((512, 100_000), (3, 100_000), (5, 7), (1, 50)):
        assert found(turn_repair.repair(df, block=block, rows_per_range=ranges), df) == want


def test_one_conversation_holds_most_rows(spark):
    r = rng(11)
    rows = [(None, t, "ua"[t % 2].replace("u", "user").replace("a", "assistant") if r.random() < 0.9 else "user",
             r.choice([f"Answer {t}.", f"cut {t}", "ok."])) for t in range(400)] + [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello.")]
    df = spark.createDataFrame(rows, CONV).repartition(4)
    assert found(turn_repair.repair(df, block=64, rows_per_range=90), df) == reports(rows)


def test_equal_rows_are_copies(spark):
    rows = [(1, 0, "user", "Hi.")] * 300 + [(1, 1, "assistant", "Hello.")] + [(2, 0, "user", " ")] * 40
    df = spark.createDataFrame(rows, CONV)
    want = reports(rows)
    assert found(turn_repair.repair(df, block=32), df) == want and want[1][7] == "K" + "D" * 299 + "K"


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, 5, "user", "x" * 300_000 + ".")], CONV)
    wide = df.selectExpr("*", "1 AS conv", "2 AS part", "'x' AS fault", "0 AS cost")
    want = reports([(1, None, " ", " "), (2, 5, "user", "x" * 300_000 + ".")])
    assert found(turn_repair.repair(wide), df) == want
    assert turn_repair.repair(df.limit(0)).count() == 0
    none = turn_repair.repair_report(turn_repair.repair(df.limit(0)), df).collect()
    assert {(x.conv_id, x.cost, x.audit) for x in none} == {(1, 0, ""), (2, 0, "")}
    assert {x.repaired_sha256 for x in none} == {hashlib.sha256(b"").hexdigest()}


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = reports(damaged(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {x.conv_id: tuple(x[c] for c in COLUMNS) for x in op12_turn_repair(spark, sf).collect()}
    assert got == {c: want.get(c, (c, *empty)) for c in {r[0] for r in rows}}


def test_damage(spark):
    rows = [(c, t, r, x) for c, t, r, x in random_rows(rng(1), 60, 12)] + [(None, 3, "user", "a."), (None, None, None, None)]
    got = turn_repair.damage(spark.createDataFrame(rows, CONV)).collect()
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r[:2]) + tuple(r[2:])
    assert sorted((tuple(x) for x in got), key=key) == sorted(damaged(rows), key=key)
