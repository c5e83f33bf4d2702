"""The winning branch, against a plain order by pairs."""

import random
import time

import pandas as pd

from stratalog.operators.causality import _winner


def clock_of(text):
    return {x[0]: int(x[1:]) for x in text.strip("()").split(",") if x}


def less(a, b):
    a, b = clock_of(a), clock_of(b)
    return a != b and all(v <= b.get(k, 0) for k, v in a.items())


def plain(rows):
    left, order = sorted({(t, c, k) for _, _, c, k, t in rows}), []
    while left:
        one = next(x for x in left if not any(less(y[2], x[2]) for y in left if y is not x))
        order.append(one)
        left.remove(one)
    last = order[0]
    for x in order[1:]:
        last = x if less(last[2], x[2]) else last
    ends = {}
    for branch, pos, c, k, t in rows:
        ends[branch] = max(ends.get(branch, (-1,)), (pos, c, k, t))
    won = [b for b, (_, c, k, t) in sorted(ends.items()) if (t, c, k) == last]
    return (won[0] if won else None, last)


def frame(rows):
    return pd.DataFrame([(1, *r) for r in rows], columns=["repo", "branch", "pos", "client", "clock", "t"])


def test_random_branches():
    rng = random.Random(9)
    for _ in range(300):
        now, rows, seen = dict.fromkeys("ABCD"[: rng.randint(1, 4)], 0), [], {}
        for i in range(rng.randint(1, 14)):
            c = rng.choice(list(now))
            if rng.random() < 0.5:
                other = rng.choice(list(now))
                seen[c] = {k: max(seen.get(c, {}).get(k, 0), v) for k, v in (seen.get(c, {}) | seen.get(other, {})).items()}
            if rng.random() < 0.9:  # else a client's clocks don't form a chain
                seen.setdefault(c, {})[c] = seen.get(c, {}).get(c, 0) + 1
            else:
                seen[c] = {rng.choice(list(now)): rng.randint(1, 3)}
            text = "(" + ",".join(f"{k}{v}" for k, v in sorted(seen[c].items())) + ")"
            rows.append((c, i, c, text, rng.randint(0, 6)))
        got = _winner(frame(rows)).iloc[0]
        assert (got["winner"], (got["t"], got["client"], got["clock"])) == plain(rows)


def test_many_headers_of_twenty_clients():
    clients = [chr(65 + k) for k in range(20)]
    now, rows = dict.fromkeys(clients, 0), []
    rng = random.Random(2)
    known = {c: dict.fromkeys(clients, 0) for c in clients}
    for i in range(100_000):
        c, other = rng.choice(clients), rng.choice(clients)
        known[c][other] = max(known[c][other], now[other])
        now[c] += 1
        known[c][c] = now[c]
        rows.append((c, i, c, "(" + ",".join(f"{k}{v}" for k, v in known[c].items() if v) + ")", i))
    df = frame(rows)
    began = time.perf_counter()
    got = _winner(df).iloc[0]
    assert time.perf_counter() - began < 20 and got["client"] in clients
