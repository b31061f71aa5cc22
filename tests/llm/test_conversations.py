"""Repair of conversations against brute force that knows nothing of signatures."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitspark.llm import conversations as cv
from orbitspark.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\f\r"


def faults(rows):
    """'', blank, duplicate or truncated of each (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def replay(rows, found, audit, names):
    """(cost, repaired rows) of edits with the roles of R and I as given; None where they can't be done."""
    cost, out, at, names = 0, [], 0, iter(names)
    for letter in audit:
        if letter == "I":
            cost, out = cost + 2, [*out, (next(names), "")]
            continue
        if at == len(rows):
            return None
        _, role, text = rows[at]
        if letter == "D":
            cost += 3
        elif found[at] in ("blank", "duplicate"):
            return None
        else:
            cost += (found[at] == "truncated") + (2 if letter == "R" else 0)
            out = [*out, (next(names) if letter == "R" else role, text)]
        at += 1
    return (cost, out) if at == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) else None


def brute_small(rows):
    """Every string of edits with every choice of roles, up to the cost of deleting all."""
    found, best = faults(rows), None
    for n in range(len(rows), len(rows) + 3 * len(rows) // 2 + 1):
        for audit in itertools.product("DIKR", repeat=n):
            if sum(3 if x == "D" else 0 if x == "K" else 2 for x in audit) > 3 * len(rows) or n - audit.count("I") != len(rows):
                continue
            for names in itertools.product(("user", "assistant"), repeat=audit.count("R") + audit.count("I")):
                if (done := replay(rows, found, audit, names)) and (best is None or (done[0], "".join(audit)) < best[:2]):
                    best = (done[0], "".join(audit), done[1])
    return best


def brute_table(rows):
    """Cheapest (cost, audit, repaired) by relaxing whole strings from the last row to the first."""
    found = faults(rows)
    after = {0: (0, "", ()), 3: (0, "", ())}
    moves = {0: "u", 1: "u", 2: "a", 3: "u"}
    to = lambda s, r: {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, r))
    full = {"u": "user", "a": "assistant"}

    def inserted(level):
        for _ in range(4):
            for s in range(4):
                if (t := to(s, moves[s])) in level:
                    c, a, out = level[t]
                    new = (c + 2, "I" + a, ((full[moves[s]], ""), *out))
                    level[s] = min(level.get(s, new), new, key=lambda x: x[:2])
        return level

    after = inserted(after)
    for (_, role, text), fault in zip(reversed(rows), reversed(found)):
        now = {}
        for s in range(4):
            options = [(3 + after[s][0], "D" + after[s][1], after[s][2])]
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                if (t := to(s, role[:1])) is not None:
                    options.append((extra + after[t][0], "K" + after[t][1], ((role, text), *after[t][2])))
                t = to(s, moves[s])
                options.append((2 + extra + after[t][0], "R" + after[t][1], ((full[moves[s]], text), *after[t][2])))
            now[s] = min(options, key=lambda x: x[:2])
        after = inserted(now)
    return after[0]


def brute(rows):
    """All columns of one conversation from its (turn, role, text) in order."""
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = brute_table(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": found.count("blank"), "duplicate": found.count("duplicate"), "truncated": found.count("truncated"),
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired": [tuple(x) for x in out],
    }


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def random_rows(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", ""]
    texts = ["Yes.", "No", "", " \t", "Why?", "Été!", "x. ", "long text here. "]
    return ordered([(None if rng.random() < 0.05 else int(rng.integers(0, n + 2)), str(rng.choice(roles)), str(rng.choice(texts))) for _ in range(n)])


def test_solver_against_every_edit():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3):
        for _ in range(6 if n == 3 else 40):
            rows = random_rows(rng, n)
            assert brute_small(rows)[:2] == brute_table(rows)[:2] and brute_small(rows)[2] == list(brute_table(rows)[2])
            if n == 0:
                break


def test_repair(spark):
    rng = np.random.default_rng(2)
    convs = {c: random_rows(rng, int(rng.integers(1, 14))) for c in range(150)}
    convs[None] = [(None, "user", "Hi."), (None, "user", "Hi.")]
    convs[900] = ordered([(k, "user" if k % 2 else "assistant", f"t {k}" + "." * (k % 3)) for k in range(3000)])
    convs[901] = [(4, " ", " "), (9, " ", "a.")]
    rows = [(c, *r) for c, rs in convs.items() for r in rs]
    rng.shuffle(rows)
    rows = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows] + [(901, 11, None, "b."), (901, 11, "user", None)]
    convs[901] = ordered([*convs[901], (11, " ", "b."), (11, "user", " ")])
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumns({c: F.lit(c) for c in ("conv", "rows", "n", "signature", "letter", "before", "audit", "kind", "copy")})
    got = {r["conv_id"]: r.asDict(recursive=True) for r in cv.repair_conversations(df).collect()}
    assert set(got) == set(convs)
    for c, rs in convs.items():
        g = {k: v for k, v in got[c].items() if k != "conv_id"} | {"repaired": [(x["role"], x["text"]) for x in got[c]["repaired"]]}
        assert g == brute(rs), c


def damaged(rows):
    out, ids = {}, {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            one = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out.setdefault(conv, []).extend([one] * (2 if kind == 3 else 1))
    return {c: ordered(out.get(c, [])) for c in ids}


def check_query(df):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: r.asDict() for r in cv.op11(df).collect()}
    want = damaged(rows)
    assert set(got) == set(want)
    for c, rs in want.items():
        b = brute(rs)
        b["repaired_sha256"] = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in b.pop("repaired")).encode()).hexdigest()
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == b, c
    return got


def test_query_against_brute_force(spark, sf_dir):
    got = check_query(table(spark, "/root/testdata/sf0.01", "conversations"))
    assert sum(r["duplicate"] for r in got.values()) and sum(r["cost"] for r in got.values()) and any("I" in r["audit"] for r in got.values())


def test_query_edges(spark):
    lone = next(c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lone, 0, "user", "gone."), (None, None, None, None), (None, 3, "user", "a."), (7, None, "assistant", None), (7, 2, "user", "x" * 300_000 + "."), (7, 2, "user", "x" * 300_000 + ".")]
    got = check_query(spark.createDataFrame(rows, SCHEMA))
    assert got[lone]["audit"] == "" and got[lone]["cost"] == 0 and got[lone]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert cv.op11(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [3000])
def test_one_signature_is_solved_once(spark, n, monkeypatch):
    rows = [(c, k, ("user", "assistant")[k], f"text {c} {k}.") for c in range(n) for k in range(2)]
    out = cv.repair_conversations(spark.createDataFrame(rows, SCHEMA))
    assert out.where("audit = 'KK' and cost = 0 and size(repaired) = 2").count() == n
    told = cv.describe(spark.createDataFrame(rows, SCHEMA).selectExpr("conv_id conv", "true present", "turn", "role", "text"))
    assert told.select("signature").distinct().count() == 1
