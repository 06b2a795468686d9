"""Whitening, conversation repair and the n-gram join, each against a plain implementation."""

import collections
import hashlib
import heapq
import random
import zlib

import duckdb
import numpy as np
import pytest

from tessera.llm import conversations, ngram_join, whitening
from tessera.llm.conversation_sql import CONVERSATION_SQL
from tests.llm.test_operators import docs, empty, texts  # noqa: F401


def plain_components(rows, percent=85, width=4):
    sets = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        sets.append(frozenset(b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    first = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        first[find(i)] += [] if doc_id is None else [doc_id]
    return sorted(((d, len(sets[i]), min(first[find(i)], default=None)) for i, (d, _) in enumerate(rows)), key=repr)


def near_copies():
    rng, words = random.Random(3), [f"w{k}" for k in range(400)]
    out = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([3, 4, 5, 9, 10, 12, 30, 60, 200]))]
        for c in range(rng.choice([1, 2, 5, 12])):
            x = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                x[rng.randrange(len(x))] = rng.choice(words)
            out.append(" ".join(x).upper() if c % 3 == 0 else "\n".join(x))
    return out


@pytest.mark.parametrize("at_once", [2_000_000, 2_000])  # the lesser one deals groups into parts
def test_ngram_join(spark, at_once):
    rows = [(k if k != 7 else None, t) for k, t in enumerate(texts() + near_copies())]
    rows += [rows[-1], (5000, rows[-2][1]), (5001, " \t")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, component_id string").repartition(3)
    found = ngram_join.near_duplicates(df, ["doc_id"], at_once=at_once)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_components(rows)


def test_ngram_join_of_nothing(empty):  # noqa: F811
    assert ngram_join.near_duplicates(empty, ["doc_id"]).collect() == []


def test_trees_find_all_links_and_prune():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 1 << 62, 200)) for _ in range(40)]
    sets = [np.unique(np.concatenate([b[int(d) :], rng.integers(0, 1 << 62, int(d))])) for b in base for d in rng.integers(0, 60, 6)]
    n = np.array([len(s) for s in sets])
    near = {(i, j) for i in range(len(sets)) for j in range(i) if 185 * len(np.intersect1d(sets[i], sets[j])) >= 85 * (n[i] + n[j])}
    links = ngram_join.tree_links(sets, n, 85)
    classes = lambda pairs: ngram_join._Classes(np.arange(len(sets)))

    def roots(pairs):
        c = classes(pairs)
        for a, b in pairs:
            if (u := c.find(a)) != (v := c.find(b)):
                c.join(u, v)
        return [c.find(k) for k in range(len(sets))]

    assert roots(links) == roots(near) and len(links) == len(sets) - len(set(roots(near)))
    order = np.argsort(np.arange(len(sets)) // 6)
    tree = ngram_join.SignatureTree([sets[k] for k in order], n, np.full(len(sets), -1))
    groups = -(-len(sets) // ngram_join.GROUP)
    assert len(tree.group_pairs(85)) < groups * (groups + 1) / 4  # most pairs of nodes are never opened


def cheapest(turns):
    """By shortest paths over (turn, phase), audits in order."""
    best, queue = {}, [(0, "", 0, 0)]
    while queue:
        cost, audit, i, p = heapq.heappop(queue)
        if (i, p) in best:
            continue
        best[i, p] = (cost, audit)
        steps = [("I", 3, i, conversations._NEXT[p, c]) for c in "ua" if (p, c) in conversations._NEXT]
        if i < len(turns):
            steps.append(("D", 4, i + 1, p))
            for c in "sua":
                if turns[i] != "x" and (p, c) in conversations._NEXT:
                    broken, to = 3 * turns[i].isupper(), conversations._NEXT[p, c]
                    steps += [("K", broken, i + 1, to)] if turns[i].lower() == c else [("R", 3 + broken, i + 1, to)] if c != "s" else []
        for letter, more, j, q in steps:
            if j < len(turns) + 1 and audit.count("I") < len(turns) + 4:
                heapq.heappush(queue, (cost + more, audit + letter, j, q))
    return min(best[len(turns), p] for p in (0, 2) if (len(turns), p) in best)


def test_alignment():
    rng = random.Random(1)
    for n in range(10):
        for _ in range(120):
            turns = "".join(rng.choice("suaoSUAOxuaua") for _ in range(n))
            assert cheapest(turns) == conversations.aligned(turns) == conversations.aligned(turns, 0), turns
    long = "".join(rng.choice("uauauauaosxU") for _ in range(600))
    assert conversations.aligned(long, 1 << 30) == conversations.aligned(long, 0)


def plain_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            name = " " if conv is None else conv, " " if turn is None else turn
            fault, role, text = zlib.crc32(f"{name[0]}:{name[1]}".encode()) % 20, role if role is not None else " ", text if text is not None else " "
            text = "" if fault == 1 else text.translate(str.maketrans("", "", ".!?")) if fault == 2 else text
            after += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        letters, seen, count = "", set(), collections.Counter()
        for _, role, text in after:
            body = text.strip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            letter = role[:1] if role[:1] in set("sua") else "o"
            letters += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        cost, audit = cheapest(letters)
        turns = [t for t, _, _ in after if t is not None]
        lines, rest, length = [], list(after), len(audit) - audit.count("D")
        for e in audit:
            due = "user" if (len(lines) + length) % 2 == 0 else "assistant"
            _, role, text = (None, due, "") if e == "I" else rest.pop(0)
            lines += [] if e == "D" else [f"{role if e == 'K' else due}:{text}"]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Fine.", "Why? ", "no end", "", " \n", None, "é été!\n", "same.", f"line {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, None, 2]), role, text))
    return rows + [(100, 0, "user", "x" * 200_000 + "."), (101, None, "user", "a."), rows[3], rows[3]]


def test_conversation_repair(spark, talks):
    df = spark.createDataFrame([(*r, 1, "x") for r in talks], "conv_id long, turn long, role string, text string, cost int, audit string").repartition(3)
    found = conversations.report(df, conversations.damaged(conversations.turns_of(df)))
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert got == plain_repair(talks)
    none = df.limit(0)
    assert conversations.report(none, conversations.damaged(conversations.turns_of(none))).collect() == []


def test_conversation_sql(talks):
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", talks)
    assert {r[0]: r[1:] for r in db.sql(CONVERSATION_SQL).fetchall()} == plain_repair(talks)


def plain_whitening(rows):
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    d = np.unique(x, axis=0)
    n, s = len(d), d.sum(0)
    c = (n * d - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return n, ((n * x - s) ** 2).sum(1), ((n * x - s) / n) @ u, e


def test_whitening(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 40)) @ rng.standard_normal((40, 40)) * np.linspace(1, 3, 40)
    rows = [(int(k) if k != 3 else None, v.tolist()) for k, v in enumerate(base)]
    rows += [(900, rows[6][1])]
    odd = [(901, None), (902, []), (903, [float("nan")] * 40), (904, [None] + [1.0] * 39), (905, [float("inf")] + [1.0] * 39), (906, [1e300] + [1.0] * 39), (907, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in [*rows, rows[5], *odd]], "vec_id long, embedding array<double>, component int").repartition(3)
    got = sorted((r for r in whitening.whiten(df).collect()), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation, r.component))
    twice = [r for r in got if r.vec_id == 5]  # the repeated row
    assert len(twice) == 32 and twice[::2] == twice[1::2]
    got = list(dict.fromkeys(got))
    n, deviation, projected, e = plain_whitening(rows)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, int(deviation[k])))
    assert [r.vec_id for r in got[::16]] == [rows[k][0] for k in order] and {r.n for r in got} == {n}
    assert [r.deviation for r in got[::16]] == [int(deviation[k]) for k in order]
    whitened, want = np.array([r.whitened for r in got]).reshape(-1, 16), (projected[order] / np.sqrt(np.abs(e)))[:, :16]
    assert np.abs(np.abs(whitened) - np.abs(want)).max() < 1e-9
    assert np.abs(whitened * np.sign((whitened * want).sum(0)) - want).max() < 1e-9  # one sign a component
    assert np.allclose([r.explained for r in got[:16]], (e / e.sum())[:16], rtol=1e-10) and got[0].identity_error < 1e-10


def test_whitening_of_little(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 1.0, 3.0]), (3, [2.0, 1.0, 3.0])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(few).collect()
    assert {(r.vec_id, r.component, r.n) for r in rows} == {(1, 1, 2), (2, 1, 2), (3, 1, 2)} and {round(abs(r.whitened), 9) for r in rows} == {1.0}
    assert whitening.whiten(few.limit(1)).collect() == [] and whitening.whiten(few.limit(0)).collect() == []
    assert whitening._deviations(np.array([[1 << 40, 0]]), 1 << 20, np.array([0, 0])).to_pylist() == [None]


def test_chebyshev_filter_certifies_close_values():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    e = np.concatenate([np.linspace(1.02, 1.0, 20), np.linspace(0.98, 0.9, 100)])
    v, passes = (q * e) @ q.T, []
    values, vectors = whitening.top_components(lambda b: passes.append(1) or v @ b, 120, 8)
    assert np.abs(values - e[:8]).max() < 1e-13 and np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 2e-13 and len(passes) < 120
