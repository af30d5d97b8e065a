import itertools
import random
import re

from stowline.llm.chat import INSERT, MERGE, NAME, RELABEL, START, _chain, matrix, solve
from stowline.llm.queries import QUERIES
from tests.llm.data import SF_DIR, table_rows

PRICE = {"keep": 0, "merge": MERGE, "insert": INSERT, "relabel": RELABEL, "name": NAME}


def legal(roles):
    body = roles[1:] if roles[:1] == ["system"] else roles
    return bool(roles) and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body))


def cheapest(roles):
    """Least cost over all outputs: each turn takes a role, then joins the turn before or starts one, an empty one first or not."""
    best = float("inf")
    kinds = ("system", "user", "assistant")
    for outs in itertools.product(kinds, repeat=len(roles)):
        for ways in itertools.product(("start", "merge", "insert"), repeat=len(roles)):
            cost, said = 0.0, []
            for role, out, way in zip(roles, outs, ways):
                cost += 0 if role == out else RELABEL if role in kinds else NAME
                if way == "merge":
                    cost += MERGE if said and said[-1] == out else float("inf")
                    continue
                if way == "insert":
                    cost += INSERT if out != "system" else float("inf")
                    said.append({"user": "assistant", "assistant": "user"}.get(out))
                said.append(out)
            if cost < best and legal(said):
                best = cost
    return best


def test_least_cost_and_chained_stretches():
    rng = random.Random(4)
    for _ in range(60):
        roles = [rng.choice(["system", "user", "assistant", None, "bot"]) for _ in range(rng.randint(1, 4))]
        assert solve(roles, START, None)[0] == cheapest(roles), roles
    for _ in range(60):
        roles = [rng.choice(["system", "user", "assistant", None]) for _ in range(rng.randint(3, 40))]
        cut = sorted(rng.sample(range(1, len(roles)), 2))
        parts = [roles[: cut[0]], roles[cut[0]:cut[1]], roles[cut[1]:]]
        path = _chain([(i, matrix(p)) for i, p in enumerate(parts)])
        assert sum(solve(parts[i], b, e)[0] for i, b, e in path) == solve(roles, START, None)[0]


def rendered(rows, conv="conv_id"):
    out = {}
    for r in sorted(rows, key=lambda r: (r[conv], r.place)):
        out.setdefault(r[conv], []).append(r)
    for some in out.values():
        assert [r.place for r in some] == list(range(1, len(some) + 1))
        text = "".join(r.piece for r in some)
        assert legal(re.findall(r"^<\|(system|user|assistant)\|>$", text, re.M)) and text.endswith("<|end|>\n")
    return out


def test_whole_table(spark):
    turns = table_rows("conversations", "conv_id, turn, role, text")
    got = rendered(QUERIES["op3_role_repair"](spark, SF_DIR).collect())
    want = {}
    for c, t, r, x in sorted(turns):
        want.setdefault(c, []).append((t, r))
    assert set(got) == set(want)
    for c, rows in want.items():
        assert [r.turn for r in got[c]] == [t for t, _ in rows]
        cost = sum(PRICE[a] for r in got[c] for a in r.action.split(", "))
        assert cost == solve([r for _, r in rows], START, None)[0]


def test_odd_rows_and_a_long_conversation(spark):
    from stowline.llm.chat import repair

    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant", "user", "system", None, " User "]), f"t{i}", 1, "x") for i in range(3000)]
    rows += [(2, 0, "assistant", None, 1, "x"), (2, 0, "assistant", None, 1, "x"), (2, None, "user", "late", 1, "x"), (None, 0, "user", "x", 1, "x"), (3, 5, None, "", 1, "x"), (4, 0, "system", "s", 1, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, part int, piece string")
    got = rendered(repair(frame).collect())
    assert {c: len(v) for c, v in got.items()} == {1: 3000, 2: 3, 3: 1, 4: 1}
    roles = [(r[2] or "").strip().lower() or None for r in rows[:3000]]
    assert sum(PRICE[a] for r in got[1] for a in r.action.split(", ")) == solve(roles, START, None)[0]
    assert repair(frame.limit(0)).count() == 0


def test_a_stretch_that_is_read_in_several_splits(spark):
    """Small row groups and splits deal the rows of one stretch to many tasks when they are read again."""
    from stowline.llm.chat import repair

    rng = random.Random(10)
    rows = [(1, i, rng.choice(["user", "assistant", "user", "system", None]), f"text {i} {rng.random()}") for i in range(20_000)]
    small = {"parquet.block.size": "8192", "spark.sql.files.maxPartitionBytes": "16384", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        got = rendered(repair(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    cost = sum(PRICE[a] for r in got[1] for a in r.action.split(", "))
    assert cost == solve([r[2] for r in rows], START, None)[0] and len(got[1]) == 20_000
