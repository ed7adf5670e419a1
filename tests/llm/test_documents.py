"""Operators over documents: brute force, edge rows and empty tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contentmark.llm import cdc_dedup, crossparse, golay_simhash, mixing, pu_quality, weak_rules

from tests.llm.conftest import table, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- mixing -----------------------------------------------------------------

def mix_plan(docs):
    return mixing.plan(docs, mixing.cyclic_weights((3, 1, 2)))


def test_mix_edge_rows(edge_docs, edge_rows):
    got = mix_plan(edge_docs).select("doc_id", "text", "source", "_x_size", "_x_source_size", "_x_target",
                                     mixing.taken().alias("taken")).collect()
    assert len(got) == len(edge_rows)
    total = 0
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        size = sum(len(WORD.findall(r["text"] or "")) for r in own)
        assert {r["_x_source_size"] for r in own} == {size}
        assert sum(r["taken"] for r in own) == round(own[0]["_x_target"])
        assert own[0]["_x_target"] <= 2 * size
        total += own[0]["_x_target"]
    assert all(0 <= r["taken"] <= 2 * r["_x_size"] for r in got)
    assert abs(total - 1.5 * sum(len(WORD.findall(r[1] or "")) for r in edge_rows)) < 1e-6


def test_mix_text_follows_plan(edge_docs):
    plan = mix_plan(edge_docs).agg(F.sum(mixing.taken())).first()[0]
    out = mixing.mix(edge_docs, mixing.cyclic_weights((3, 1, 2)))
    assert out.columns == edge_docs.columns
    assert out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == plan
    assert out.where("n_chars <> length(text)").count() == 0


def test_mix_empty(no_docs):
    assert mix_plan(no_docs).count() == 0
    assert mixing.mix(no_docs, mixing.cyclic_weights((3,))).count() == 0


def test_water_level_is_the_fixed_point(spark):
    rng = random.Random(3)
    rows = [(float(rng.randint(1, 100)), float(rng.randint(1, 5))) for _ in range(40)]
    df = spark.createDataFrame(rows, "_x_cap double, _x_w double")
    for budget in (10.0, 700.0, 1500.0):
        level = mixing.water_level(df, budget)
        filled = sum(min(c, level * w) for c, w in rows)
        assert abs(filled - min(budget, sum(c for c, _ in rows))) < 1e-6


# --- weak supervision ---------------------------------------------------------

def measured(text):
    ws = WORD.findall(text or "")
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    count = Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if count[g] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def test_measures_match_brute_force(spark, edge_rows):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "b", "c#", "d\n", "e"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = edge_rows + [(100 + k, t, None, None) for k, t in enumerate(texts)]
    got = weak_rules.measures(table(spark, rows)).select(
        "text", "_x_n_words", "_x_word_chars", "_x_n_symbols", "_x_n_dup_lines", "_x_n_repeat_words").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == measured(r["text"])


def test_rules_tell_junk_from_prose(spark):
    rng = random.Random(1)
    rows = []
    for k in range(60):
        clean = words(rng, 120)
        rows.append((k, clean, "en", "s"))
        rows.append((1000 + 3 * k, " ".join(w + "***" for w in clean.split()), "en", "s"))
        rows.append((1001 + 3 * k, " ".join(w.upper() + "!!" for w in clean.split()), "en", "s"))
        rows.append((1002 + 3 * k, clean.replace(" ", " | "), "en", "s"))
    got = weak_rules.judge(table(spark, rows)).select("doc_id", "_x_kept").collect()
    assert all(r["_x_kept"] == (r["doc_id"] < 1000) for r in got)


def test_judge_edge_and_empty(edge_docs, edge_rows, no_docs):
    got = weak_rules.judge(edge_docs).select("doc_id", "_x_n_words", "_x_base_failed", "_x_kept").collect()
    assert len(got) == len(edge_rows)
    assert all(r["_x_base_failed"] and not r["_x_kept"] for r in got if r["_x_n_words"] < 50)
    assert weak_rules.judge(no_docs).count() == 0


# --- near-duplicates ------------------------------------------------------------

def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(fps))]


def brute_fingerprint(text):
    import xxhash
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near_duplicates_match_brute_force(spark, edge_rows):
    rng = random.Random(4)
    rows = list(edge_rows)
    for k in range(60):
        base = words(rng, 200).split()
        for c in range(rng.randint(1, 4)):
            own = list(base)
            own[rng.randrange(len(own))] = f"new{c}"
            rows.append((1000 + 10 * k + c, " ".join(own), None, None))
    got = golay_simhash.near_duplicates(table(spark, rows)).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = Counter(zip([r[0] for r in rows], fps, brute_components(fps, [r[0] for r in rows])))
    assert Counter((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want


def test_links_of_dense_groups_and_blocks(spark):
    """A chain and a ball of fingerprints, with buckets cut into tiny blocks."""
    rng = random.Random(8)
    fps = [rng.getrandbits(64)]
    for _ in range(80):
        fps.append(fps[-1] ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    centre = rng.getrandbits(64)
    fps += [centre] + [centre ^ 1 << a for a in range(64)] + [rng.getrandbits(64) for _ in range(100)]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    want = brute_components(fps, list(range(len(fps))))
    groups = len(set(want))
    for block in (golay_simhash.BLOCK, 8):
        roots = {r["node"]: r["root"] for r in golay_simhash.components(
            golay_simhash.links(df, block=block)).collect()}
        label = [roots.get(f - (1 << 64) if f >> 63 else f, f - (1 << 64) if f >> 63 else f) for f in fps]
        assert len(set(label)) == groups
        assert len(set(zip(label, want))) == groups


def test_golay_keys_meet_within_one_bit():
    import numpy as np
    tables = golay_simhash.golay_tables()
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 23, 400)
    ka = golay_simhash.golay_keys(a, tables)
    assert max((row >= 0).sum() for row in ka) <= 6
    for bit in range(23):
        kb = golay_simhash.golay_keys(a ^ 1 << bit, tables)
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(ka, kb))


def test_too_many_bits_are_refused(spark):
    with pytest.raises(ValueError):
        golay_simhash.links(spark.createDataFrame([(1,)], "fp bigint"), max_bits=4)


def test_keep_one(edge_docs, edge_rows, no_docs):
    out = golay_simhash.keep_one(edge_docs)
    assert out.columns == edge_docs.columns
    fps = [brute_fingerprint(r[1]) for r in edge_rows]
    groups = brute_components(fps, list(range(len(edge_rows))))
    kept = out.select("doc_id", "text").collect()
    assert len(kept) == len(set(groups))
    assert {r["doc_id"] for r in kept} >= {1, 4, 8, 9, 10}
    assert golay_simhash.keep_one(no_docs).count() == 0
    assert golay_simhash.near_duplicates(no_docs).count() == 0


# --- substring de-duplication ------------------------------------------------------

def test_repeated_passages_go_and_clean_text_stays(spark):
    rng = random.Random(6)
    passage = words(rng, 70)
    rows = [(k, words(rng, 100 + k) + " " + passage + " " + words(rng, 50), None, None) for k in range(20)]
    clean = [(100 + k, words(rng, 150), None, None) for k in range(20)]
    got = {r["doc_id"]: r["text"] for r in cdc_dedup.dedup(table(spark, rows + clean)).collect()}
    for i, text, *_ in clean + rows[:1]:
        assert got[i] == text
    for i, text, *_ in rows[1:]:
        gone = len(text) - len(got[i])
        assert 0.6 * len(passage) < gone <= len(passage) + 2
        assert got[i].startswith(text[:400]) and got[i].endswith(text[-200:])


def test_repeats_inside_one_text_go(spark):
    rng = random.Random(7)
    passage = words(rng, 80)
    text = passage + " " + words(rng, 40) + " " + passage
    got = cdc_dedup.dedup(table(spark, [(1, text, None, None)])).first()["text"]
    assert got.startswith(passage) and len(text) - len(got) > 0.6 * len(passage)


def test_chunks_cover_the_text_and_resist_shifts():
    rng = random.Random(2)
    gear = cdc_dedup.gear_table()
    text = words(rng, 2000)
    ends = cdc_dedup.chunk_ends(text, gear)
    assert ends == sorted(set(ends)) and ends[-1] == len(text)
    shifted = cdc_dedup.chunk_ends("some new words " + text, gear)
    assert len({e - 15 for e in shifted} & set(ends)) > 0.95 * len(ends)


def test_dedup_edge_rows(edge_docs, edge_rows, no_docs):
    out = cdc_dedup.dedup(edge_docs)
    got = out.select("doc_id", "text").collect()
    assert len(got) == len(edge_rows)
    assert out.columns == edge_docs.columns + ["_x_spans"]
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["text"])
    first = edge_rows[0][1]
    assert by[1] == [first, first] and by[2] == [""] and by[4] == [None] and by[5] == [""]
    assert cdc_dedup.dedup(no_docs).count() == 0


# --- classifiers ----------------------------------------------------------------------

def test_pu_quality_ranks_junk_below(spark):
    rng = random.Random(3)
    rows = []
    for k in range(3000):
        clean = words(rng, rng.randint(40, 90))
        junk = k % 4 == 0
        rows.append((k, " ".join(w + "###" for w in clean.split()) if junk else clean, None, None))
    docs = table(spark, rows + [(None, None, None, None), (9000, "", None, None)])
    every = docs.select(F.col("doc_id").alias("id"))
    model = pu_quality.fit(docs, every.where("id % 4 <> 0 and id < 1500"), every)
    assert 0.55 < model["prior"] < 0.95
    got = docs.select("doc_id", pu_quality.score(model, F.col("text")).alias("s")).collect()
    assert len(got) == len(rows) + 2 and all(0 <= r["s"] <= 1 for r in got)
    wrong = sum((r["s"] >= 0.3) != (r["doc_id"] % 4 != 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 9000)
    assert wrong <= 30
    same = [r["s"] for r in got if r["doc_id"] in (None, 9000)]
    assert same[0] == same[1]


def test_pu_quality_without_positives(edge_docs, no_docs):
    none = no_docs.select(F.col("doc_id").alias("id"))
    model = pu_quality.fit(edge_docs, none, edge_docs.select(F.col("doc_id").alias("id")))
    assert {r[0] for r in edge_docs.select(pu_quality.score(model, F.col("text"))).collect()} == {0.5}
    own = pu_quality.fit(edge_docs, *[edge_docs.select(F.col("doc_id").alias("id"))] * 2)
    assert edge_docs.select(pu_quality.score(own, F.col("text")).alias("s")).where("s between 0 and 1").count() == edge_docs.count()
    assert no_docs.select(pu_quality.score(own, F.col("text"))).count() == 0


def test_phrases_match_a_plain_parse():
    import numpy as np
    rng = random.Random(5)
    train = crossparse.fold(words(rng, 200, "abcd"))
    letters = "".join(sorted(set(train)))
    steps = crossparse.table(train, letters)
    code = np.zeros(0x110000, np.int32)
    for i, c in enumerate(letters):
        code[ord(c)] = i + 1
    texts = [crossparse.fold(words(rng, 30, "abcdxy")) for _ in range(20)]

    def plain(text):
        count = i = 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and text[i:j] in train:
                j += 1
            i = max(i + 1, j - 1)
            count += 1
        return count
    segments = [t[k:k + crossparse.SEGMENT] for t in texts for k in range(0, len(t), crossparse.SEGMENT)]
    segments.sort(key=len, reverse=True)
    size = np.array([len(s) for s in segments])
    rows = np.zeros((size[0], len(segments)), np.int32)
    for k, s in enumerate(segments):
        rows[:len(s), k] = [code[ord(c)] for c in s]
    got = crossparse.phrases(rows, size, steps) + 1
    # an unseen character ends a phrase and is one itself in the plain parse
    for s, n in zip(segments, got.tolist()):
        assert abs(n - plain(s)) <= 1 + sum(c not in letters for c in s)


def test_language_id(spark, edge_docs, edge_rows, no_docs):
    rng = random.Random(4)
    kinds = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "nopqrstu"}
    rows = [(k, words(rng, 60, kinds[g]), g if k < 150 else None, None)
            for k in range(240) for g in [("aa", "bb", "cc")[k % 3]]]
    docs = table(spark, rows)
    model = crossparse.fit(docs, F.col("doc_id") < 150)
    got = crossparse.predict(docs, model, "doc_id").collect()
    assert all(r["lang_pred"] == ("aa", "bb", "cc")[r["id"] % 3] for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    out = crossparse.predict(edge_docs, model, "doc_id").collect()
    assert len(out) == len(edge_rows)
    assert [r["lang_pred"] for r in out if r["id"] in (4, 5, 6, 11)] == ["und"] * 4
    assert crossparse.predict(no_docs, model).count() == 0
    none = crossparse.fit(no_docs, F.lit(True))
    assert {r["lang_pred"] for r in crossparse.predict(edge_docs, none).collect()} == {"und"}


def test_language_is_learnt_from_whole_texts(spark):
    """Every labelled text starts with more than a piece of one boilerplate."""
    rng = random.Random(14)
    start = words(rng, 600, "xyz")
    kinds = {"aa": "abcdefgh", "bb": "ghijklmn"}
    rows = [(k, start + " " + words(rng, 4000, kinds[g]), g, None) for k in range(30) for g in [("aa", "bb")[k % 2]]]
    rows += [(100 + k, words(rng, 40, kinds[("aa", "bb")[k % 2]]), None, None) for k in range(20)]
    docs = table(spark, rows)
    model = crossparse.fit(docs, F.col("doc_id") < 100)
    got = crossparse.predict(docs.where("doc_id >= 100"), model).collect()
    assert len(got) == 20 and all(r["lang_pred"] == ("aa", "bb")[r["id"] % 2] for r in got)


def test_scripts_with_many_letters(spark):
    rng = random.Random(15)
    kinds = {"aa": range(0x4E00, 0x4E00 + 400), "bb": range(0x4E00 + 300, 0x4E00 + 700), "cc": range(0x61, 0x7B)}

    some = {g: ["".join(chr(rng.choice(kinds[g])) for _ in range(3)) for _ in range(500)] for g in kinds}

    def text(g, n):
        return "".join(rng.choice(some[g]) for _ in range(n // 3))
    rows = [(k, text(("aa", "bb", "cc")[k % 3], 1500), ("aa", "bb", "cc")[k % 3], None) for k in range(90)]
    rows += [(100 + k, text(("aa", "bb", "cc")[k % 3], 12), None, None) for k in range(60)]
    docs = table(spark, rows)
    model = crossparse.fit(docs, F.col("doc_id") < 100)
    assert len(model["letters"]) > 700
    got = crossparse.predict(docs.where("doc_id >= 100"), model).collect()
    assert len(got) == 60 and all(r["lang_pred"] == ("aa", "bb", "cc")[(r["id"] - 100) % 3] for r in got)


def test_sparse_steps_are_those_of_the_table():
    import numpy as np
    rng = random.Random(16)
    train, letters = crossparse.fold(words(rng, 400, "abcdef")), " abcdef"
    dense, sparse = crossparse.table(train, letters), crossparse.SparseSteps(train, letters)
    every = np.arange(len(dense))
    assert (sparse.take(every) == dense).all()


def test_runs_without_blanks_resist_shifts(spark):
    rng = random.Random(17)
    gear = cdc_dedup.gear_table()
    thai = [chr(c) for c in range(0x0E01, 0x0E2F)]
    text = "".join(rng.choices(thai, k=6000))
    ends = cdc_dedup.chunk_ends(text, gear)
    shifted = cdc_dedup.chunk_ends("".join(rng.choices(thai, k=37)) + text, gear)
    assert len({e - 37 for e in shifted} & set(ends)) > 0.95 * len(ends)
    passage = "".join(rng.choices(thai, k=600))
    rows = [(k, "".join(rng.choices(thai, k=300 + k)) + passage + "".join(rng.choices(thai, k=200)), None, None)
            for k in range(6)]
    got = {r["doc_id"]: r["text"] for r in cdc_dedup.dedup(table(spark, rows)).collect()}
    assert got[0] == rows[0][1]
    assert all(0.6 * 600 < len(t) - len(got[i]) <= 600 for i, t, *_ in rows[1:])


def test_equal_digests_of_other_words_are_no_repeats(spark, monkeypatch):
    rng = random.Random(18)
    texts = [words(rng, 40), "a b c d a b c e", words(rng, 3), " ".join("ab"[k % 2] for k in range(9))]
    monkeypatch.setattr(weak_rules.F, "xxhash64", lambda *c: F.lit(7 << 40).cast("bigint"))
    docs = table(spark, [(k, t, None, None) for k, t in enumerate(texts)])
    got = weak_rules.measures(docs).select("text", "_x_n_repeat_words").collect()
    assert all(r["_x_n_repeat_words"] == measured(r["text"])[4] for r in got)


def test_folding_keeps_letters_and_marks_alone():
    assert crossparse.fold("\u00bd \u00b2 \u2460 \u2167 12_") == ""
    assert crossparse.fold("\u0301\u0e34") == ""          # marks without a letter
    thai, hindi = "\u0e17\u0e35\u0e48", "\u0939\u093f\u0928\u094d\u0926\u0940"
    assert crossparse.fold(f" {thai}\u2167{hindi}\u00bd X ") == f"{thai} {hindi} x"
    rng = random.Random(5)
    import unicodedata
    text = "".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(32, 128)])) for _ in range(4000))
    text = "".join(c for c in text if unicodedata.category(c) not in ("Cn", "Cs")).lower()
    plain = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text)
    assert crossparse.fold(text) == " ".join(plain.split())


def test_texts_without_letters_have_no_language(spark):
    model = {"texts": {"de": "der die das", "en": "the of and"}, "letters": " adefhinorst"}
    rows = [(1, "\u00bd \u00b2 \u2460"), (2, "\u2167"), (3, "\u0301"), (4, "the \u00bd")]
    out = crossparse.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {r["id"]: r["lang_pred"] for r in out} == {1: "und", 2: "und", 3: "und", 4: "en"}
    assert all(r["score"] == 0.0 for r in out if r["id"] < 4)
