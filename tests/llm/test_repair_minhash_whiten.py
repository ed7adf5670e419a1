"""Conversation repair, tensored MinHash and contour whitening against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentmark.llm import chat_repair, feast_whiten, minhash_tensor

from tests.llm.conftest import table, words

ROLE = {"u": "user", "a": "assistant"}


# --- conversation repair ------------------------------------------------------

def plain_faults(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        word = text.strip(" \t\n\x0b\f\r")
        faults.append(1 if not word else 2 if (role, text) in seen else 3 if word[-1] not in ".!?" else 0)
        seen.add((role, text))
    return faults


def plain_repair(rows, costs, inserts):
    """Every edit sequence with at most ``inserts`` inserted turns."""
    faults = plain_faults(rows)
    best = None

    def walk(i, left, cost, audit, out):
        nonlocal best
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)):
            key = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
            best = key if best is None else min(best, key)
        if left:
            for r in ROLE.values():
                walk(i, left - 1, cost + costs.insert, audit + "I", out + [(r, "")])
        if i == len(rows):
            return
        _, role, text = rows[i]
        walk(i + 1, left, cost + costs.delete, audit + "D", out)
        if faults[i] not in (1, 2):
            more = costs.truncated if faults[i] == 3 else 0
            walk(i + 1, left, cost + more, audit + "K", out + [(role, text)])
            for r in ROLE.values():
                walk(i + 1, left, cost + more + costs.rerole, audit + "R", out + [(r, text)])
    walk(0, inserts, 0, "", [])
    return best


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("costs", [chat_repair.Costs(), chat_repair.Costs(insert=1), chat_repair.Costs(2, 2, 1, 3),
                                   chat_repair.Costs(3, 4, 2, 1), chat_repair.Costs(1, 1, 1, 1)])
def test_repair_matches_every_edit_sequence(costs):
    rng = random.Random(repr(costs))
    for _ in range(60):
        rows = [(k, rng.choice(["user", "assistant", "system", "tool", " "]),
                 rng.choice(["a.", "b!", "c", "", " ", "d?", f"e{k}."])) for k in range(rng.randint(0, 4))]
        conv = chat_repair.Conversation(costs)
        for r in rows:
            conv.add(*r)
        got = conv.row()
        cost, audit, text = plain_repair(rows, costs, 4 if costs.insert <= 2 else 2)
        assert got[5:] == (cost, audit, digest(text)), rows
        assert got[1:4] == tuple(plain_faults(rows).count(k) for k in (1, 2, 3))


@pytest.mark.parametrize("costs", [chat_repair.Costs(), chat_repair.Costs(insert=2)])
def test_shared_letters_and_pruning_change_nothing(costs, monkeypatch):
    rng = random.Random(9)
    rows = [(k, rng.choice(["user", "assistant", "system"]), rng.choice([f"a{k}.", f"b{k}", "c."])) for k in range(150)]
    got = []
    for settle in (1, 32, 10_000):
        monkeypatch.setattr(chat_repair, "SETTLE", settle)
        conv = chat_repair.Conversation(costs)
        for r in rows:
            conv.add(*r)
        got.append(conv.row())
    assert got[0] == got[1] == got[2]
    assert len(got[0][6].replace("I", "")) == 150


def plain_damage(turns):
    def sp(x):
        return " " if x is None else str(x)
    out = {}
    for conv, turn, role, text in turns:
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        out.setdefault(conv, []).extend([row] * (0 if kind == 0 else 2 if kind == 3 else 1))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {c: sorted(rows, key=order) for c, rows in out.items()}


def test_repair_query_rows(spark):
    rng = random.Random(4)
    turns = []
    for conv in list(range(120)) + [None]:
        for turn in range(rng.randint(1, 4)):
            turns.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), rng.choice(
                ["user", "assistant", "user", "assistant", "system", None]),
                rng.choice(["é a.", "b!", "c", None, "", "long " * 50 + "."])))
    turns += [turns[0]] * 2
    df = spark.createDataFrame([t + ("x", 1) for t in turns],
                               "conv_id bigint, turn bigint, role string, text string, there string, n int")
    rows = chat_repair.damage(df)
    got = {r["conv_id"]: r for r in chat_repair.repair(rows).collect()}
    want = plain_damage(turns)
    assert set(got) == set(want)
    fixed = {}
    for r in chat_repair.apply_audits(rows, chat_repair.repair(rows)).orderBy("position").collect():
        fixed.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, own in want.items():
        cost, audit, text = plain_repair(own, chat_repair.Costs(), 1)
        known = [t for t, _, _ in own if t is not None]
        faults = plain_faults(own)
        initials = [r[:1] for _, r, _ in own]
        g = got[conv]
        assert (g["cost"], g["audit"], g["repaired_sha256"]) == (cost, audit, digest(text))
        assert g["gaps"] == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert [g["blank"], g["duplicate"], g["truncated"]] == [faults.count(k) for k in (1, 2, 3)]
        assert g["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        assert "\n".join(fixed.get(conv, [])) == text
    lost = [c for c, own in want.items() if not own]
    assert lost and all(got[c]["repaired_sha256"] == digest("") and got[c]["audit"] == "" for c in lost)


def test_repair_of_long_and_empty_input(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", f"{k}.") for k in range(3000)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    plain = df.withColumn("there", F.lit(True))
    r = chat_repair.repair(plain).collect()
    assert len(r) == 1 and r[0]["audit"] == "K" * 3000 and r[0]["cost"] == 0
    assert chat_repair.repair(chat_repair.damage(df.limit(0))).count() == 0


# --- MinHash -------------------------------------------------------------------

def plain_set(text, k=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    return [find(i) for i in range(len(sets))]


def near_copies(rng):
    rows, k = [], 100
    for _ in range(12):
        base = words(rng, rng.choice([1, 2, 12, 40, 200])).split()
        for _ in range(rng.randint(1, 12)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 14))):
                text[rng.randrange(len(text))] = "".join(rng.choice("xyz") for _ in range(6))
            rows.append((k, " ".join(text).replace("a", "A", rng.randint(0, 3)), None, None))
            k += 1
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_tensored_minhash_matches_brute_force(spark, edge_rows, block):
    rows = edge_rows + near_copies(random.Random(12))
    got = minhash_tensor.near_duplicates(table(spark, rows), block=block).select(
        "id", "h", "n_shingles", "component_id").collect()
    assert len(got) == len(rows)
    sets = [plain_set(t) for _, t, _, _ in rows]
    roots = plain_components(sets)
    least = {}
    for (i, *_), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(((i, len(s), least.get(r)) for (i, *_), s, r in zip(rows, sets, roots)), key=str)
    assert sorted(((g["id"], g["n_shingles"], g["component_id"]) for g in got), key=str) == want


def test_minhash_empty(spark, no_docs):
    assert minhash_tensor.near_duplicates(no_docs).count() == 0
    some = minhash_tensor.near_duplicates(table(spark, [(1, None, None, None), (2, "", None, None)]))
    assert sorted((r["id"], r["component_id"], r["n_shingles"]) for r in some.collect()) == [(1, 1, 0), (2, 2, 0)]


def test_sweep_keeps_every_pair_that_may_link():
    rng = random.Random(2)
    base = [f"{rng.random()}" for _ in range(130)]
    sets = []
    for _ in range(60):
        words_ = [w if rng.random() > 0.03 else f"{rng.random()}" for w in base[:rng.randint(90, 130)]]
        sets.append(minhash_tensor.shingle_hashes(" ".join(words_))[0])
    n = np.array([len(s) for s in sets])
    sk = np.concatenate([minhash_tensor.sketches(s, np.array([0])) for s in sets])
    bits, got = [minhash_tensor.bitmap(s) for s in sets], []
    for i, j in itertools.product(range(minhash_tensor.SIDE), repeat=2):
        keys = {}
        for k in range(60):
            keys.setdefault((sk[k, i], sk[k, minhash_tensor.SIDE + j]), []).append(k)
        for ks in (np.array(ks) for ks in keys.values()):
            got += minhash_tensor._pairs_left(i << 5 | j + minhash_tensor.SIDE, ks, n[ks], ks, [bits[k] for k in ks], sk[ks])
    assert len(got) == len(set(got))   # each pair under one key
    got = {tuple(sorted(p)) for p in got}
    sims = {(i, j): len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
            for i, j in itertools.combinations(range(60), 2)}
    links = {p for p, s in sims.items() if s >= 0.8}
    assert links and links <= got
    assert len(got) < len(sims) / 2   # and the bound refutes most of the rest


def test_sketches_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 900).astype(np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 1 << 62, 100).astype(np.uint64)))   # 0.8
    hits = []
    for k in range(200):
        salt = np.uint64(rng.integers(1, 1 << 62) | 1)
        s = minhash_tensor.sketches(np.concatenate((a * salt, b * salt)), np.array([0, 900]))
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - 0.8 ** minhash_tensor.ROWS) < 0.03


# --- whitening -------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "w") for i, v in rows],
                                 "vec_id bigint, embedding array<float>, n int, x int, w string")


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((400, 20)) @ rng.standard_normal((20, 20))
    data[7] = data[3]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(data)]
    bad = [(1000, None), (1001, [None] + [0.0] * 19), (1002, [math.nan] * 20), (1003, [math.inf] * 20),
           (1004, []), (1005, [1.0, 2.0]), (1006, [1e30] * 20)]
    got = feast_whiten.whiten(vectors(spark, rows + bad + [(None, rows[0][1])])).collect()
    x = np.floor(np.float32(data).astype(float) * 1024).astype(np.int64) + 100_000
    x = np.concatenate((x, x[:1]))
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    v = y.T @ y / n
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1][:8], vecs[:, ::-1][:, :8]
    assert len(got) == 8 * n
    dev = ((n * x - s) ** 2).sum(axis=1)
    signs = {}
    for r in got:
        k, c = (400 if r["vec_id"] is None else r["vec_id"]), r["component"] - 1
        want = y[k] @ vecs[:, c] / math.sqrt(values[c])
        sign = signs.setdefault(c, math.copysign(1, want * r["whitened"]))
        assert abs(sign * r["whitened"] - want) < 1e-9
        assert r["n"] == n and r["deviation"] == dev[k]
        assert abs(r["explained"] / (values[c] / np.trace(v)) - 1) < 1e-12
        assert r["identity_error"] < 1e-10


def test_whitening_without_variance_and_empty(spark):
    assert feast_whiten.whiten(vectors(spark, [])).count() == 0
    assert feast_whiten.whiten(vectors(spark, [(1, None)])).count() == 0
    assert feast_whiten.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = feast_whiten.whiten(vectors(spark, [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)])).collect()
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-6


@pytest.mark.parametrize("values", [[5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 1], [9, 8, 7, 6, 5, 4, 3, 2, 1.9999, 1, 0],
                                    [1e6, 1, 1, 1e-3, 1e-4, 1e-5, 0, 0], [3, 2]])
def test_eigenpairs_of_clusters_and_low_rank(spark, values):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    for s in (0.5, 4.5, 7.5):
        assert feast_whiten.count_above(v, s) == sum(x > s for x in values)
    got, vecs = feast_whiten.eigenpairs(spark, v, 8)
    want = [x for x in values if x > feast_whiten.RANK * sum(values)][:8]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9 * max(values) * 1e-3)
    assert np.allclose(vecs.T @ vecs, np.eye(len(want)), atol=1e-9)
    assert np.linalg.norm(v @ vecs - vecs * got) < 1e-11 * max(values)
