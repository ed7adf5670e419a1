"""Token files, packing, vector search and chat formatting."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentmark.llm import bm25_pack, chat, multi_index, tokens, wavelet
from contentmark.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY, vocabulary
from contentmark.llm.tokens import PieceTokenizer


def whole(name):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTE_VOCABULARY, WORD_VOCABULARY])
def test_parts_give_the_ids_of_whole_texts(name):
    rng = random.Random(1)
    some = " \n\t\r\x1c\x85\xa0  　ab'sBééΣ1²½٣!.-​‍字İǅ\U0001d4b3"
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(rng.choice(" \n aB'st1.-,éß") for _ in range(30)) for _ in range(2000)]
    texts += ["I'll don't we've  <|endoftext|> <|startoftext|>\n\n x", "", "   ",
              "a <|endoftext|>", "<|ENDOFTEXT|> é字<|startoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext"]
    encode, direct = PieceTokenizer(vocabulary(name)), whole(name)
    for t, raw in zip(texts, encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == direct(t), repr(t)


@pytest.mark.parametrize("name", [BYTE_VOCABULARY, WORD_VOCABULARY])
def test_chunks_and_generations_give_the_same_ids(name, monkeypatch):
    """Texts split some at a time, between texts of other ways, with parts forgotten
    in between; U+023A lower-cases to a letter outside the plain range."""
    monkeypatch.setattr(tokens, "CHUNK", 40)
    monkeypatch.setattr(tokens, "GENERATION", 30)
    rng = random.Random(7)
    some = ["a", "'s", "'", "'ll", "'re", "'r", "é", "1", "²", " ", "  ", "\n", "\t", ".", "!!", "Z", "st", "'t", "«", "\u023a",
            "字", "\x0b", "\0", "<|endoftext|>"]
    texts = ["".join(rng.choices(some if k % 5 == 0 else some[:-5], k=rng.randint(0, 12))) for k in range(3000)]
    texts += ["\u023aB's", "don't'", "'stand 'llama 're", "\n 'll", "a  \t", "\t's", " " * 5, ""]
    encode, direct = PieceTokenizer(vocabulary(name)), whole(name)
    for k in range(0, len(texts), 500):
        for t, raw in zip(texts[k:k + 500], encode(texts[k:k + 500])):
            assert np.frombuffer(raw, "<u4").tolist() == direct(t), repr(t)
    assert encode([]) == []
    held = tokens.worker_tokenizer(vocabulary(name))
    assert tokens.worker_tokenizer(vocabulary(name)) is held


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = rng.integers(0, 40, n)
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 6).to_bytes())
        assert m.decode().tolist() == ids.tolist()
        for s in (0, 7, 39, 63):
            at = np.flatnonzero(ids == s)
            assert m.count(s) == len(at)
            assert [m.select(s, k) for k in range(len(at))] == at.tolist()
            assert m.rank(s, n // 2) == (ids[:n // 2] == s).sum()
            with pytest.raises(IndexError):
                m.select(s, len(at))
        assert [m.access(i) for i in range(0, n, 97)] == ids[::97].tolist()
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_bytes(b"none" + bytes(20))


def test_token_files_round_trip(edge_docs, edge_rows, no_docs):
    path, direct = vocabulary(BYTE_VOCABULARY), whole(BYTE_VOCABULARY)
    got = wavelet.read_shards(wavelet.write_shards(edge_docs, path, shard_tokens=500)).collect()
    want = {}
    for i, t, *_ in edge_rows:
        ids = np.array(direct(t) + [2], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert len(got) == len(edge_rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    assert wavelet.read_shards(wavelet.write_shards(no_docs, path)).count() == 0


def check_packing(pieces, rows, direct):
    want = {}
    for i, t, *_ in rows:
        ids = np.array(direct(t) + [1], "<u4")
        want.setdefault(i, []).append(ids)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at and n > 0
            at += n
        assert at <= 2048 and at & (at - 1) == 0     # nothing is padded
    assert sum(p["length"] for p in pieces) == sum(len(x) for v in want.values() for x in v)
    for i, docs in want.items():
        own = [p for p in pieces if p["doc_id"] == i]
        for p in own:
            assert any(p["doc_tokens"] == len(d) and zlib.crc32(
                d[p["start"]:p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for d in docs)


def test_packing(edge_docs, edge_rows, no_docs):
    path = vocabulary(WORD_VOCABULARY)
    for size in (1 << 20, 3000):
        out = bm25_pack.pack(edge_docs.repartition(2), path, shard_tokens=size).collect()
        check_packing(out, edge_rows, whole(WORD_VOCABULARY))
    assert bm25_pack.pack(no_docs, path).count() == 0


def test_retrieval_scores_match_plain_bm25():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 60, rng.integers(5, 40)).astype("<u4") for _ in range(50)]
    index = bm25_pack.Index(docs)
    mean = np.mean([len(d) for d in docs])
    sets = [dict(zip(*np.unique(d, return_counts=True))) for d in docs]
    df = {t: sum(t in s for s in sets) for t in range(60)}
    for i in range(0, 50, 7):
        terms = sorted((t for t in sets[i] if 1 < df[t] <= max(2, bm25_pack.MAX_POSTING_SHARE * 50)),
                       key=lambda t: (df[t], t))[:bm25_pack.QUERY_TERMS]
        score = np.zeros(50)
        for t in terms:
            for d, s in enumerate(sets):
                if t in s:
                    norm = bm25_pack.K1 * (1 - bm25_pack.B + bm25_pack.B * len(docs[d]) / mean)
                    score[d] += np.log(1 + (50 - df[t] + .5) / (df[t] + .5)) * s[t] * (bm25_pack.K1 + 1) / (s[t] + norm)
        got = index.neighbours(i)
        assert set(got) == set(np.flatnonzero(score).tolist())
        assert np.all(np.diff(score[got]) <= 1e-9)


def test_neighbours_share_windows():
    rng = np.random.default_rng(5)
    docs, kind = [], []
    for k in range(120):    # two topics with words of their own
        topic = k % 2
        docs.append(rng.integers(topic * 4000, topic * 4000 + 4000, 400).astype("<u4"))
        kind.append(topic)
    order = [kind[k] for k in bm25_pack.order_by_retrieval(docs)]
    assert len(order) == 120
    assert sum(a == b for a, b in zip(order, order[1:])) > 70    # about 60 by chance


def test_related_documents_meet_across_partitions(spark):
    """Pairs with words of their own lie far apart in the input."""
    rng = random.Random(12)
    some = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(1500)]
    common = some[:40]
    texts = [" ".join(rng.sample(some[40 + 20 * (k % 64):60 + 20 * (k % 64)], 20) * 4 + rng.choices(common, k=40))
             for k in range(128)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    docs = docs.repartitionByRange(4, "doc_id")        # k and k + 64 lie in different partitions
    out = bm25_pack.pack(docs, vocabulary(WORD_VOCABULARY), shard_tokens=4000).collect()
    windows = {}
    for p in out:
        windows.setdefault(p["doc_id"], set()).add(p["sequence_id"])
    assert sum(bool(windows[k] & windows[k + 64]) for k in range(64)) >= 48


def test_index_weighs_by_the_corpus():
    docs = [np.array(d, "<u4") for d in ([1, 2, 3], [1, 4], [2, 5])]
    stats = bm25_pack.Statistics({bm25_pack.N_DOCS: 1000, bm25_pack.N_TOKENS: 9000, 1: 900, 2: 2, 3: 5, 4: 5, 5: 5})
    got = bm25_pack.Index(docs, stats).neighbours(0)
    assert got.index(2) < got.index(1)      # term 2 is rare in the corpus, term 1 is not
    whole = bm25_pack.Statistics.of(docs)
    assert (whole.n_docs, whole.n_tokens, whole.df.tolist()) == (3, 7, [0, 2, 2, 1, 1, 1])


def plain_scores(docs):
    """BM25 of every document for every other as query, nothing cut."""
    sets = [dict(zip(*np.unique(d, return_counts=True))) for d in docs]
    df = {t: sum(t in s for s in sets) for s in sets for t in s}
    n, mean = len(docs), np.mean([len(d) for d in docs])
    return np.array([[sum(np.log(1 + (n - df[t] + .5) / (df[t] + .5)) * s[t] * (bm25_pack.K1 + 1)
                          / (s[t] + bm25_pack.K1 * (1 - bm25_pack.B + bm25_pack.B * len(d) / mean))
                          for t in q if t in s) for d, s in zip(docs, sets)] for q in sets])


def test_copies_and_templates_are_retrieved():
    """Two templates make half of the rows each, a third of all are copies."""
    rng = np.random.default_rng(7)
    docs = []
    for k in range(90):
        body = np.arange(60) + 100 * (k % 2)
        body[rng.integers(0, 60, 3)] = rng.integers(300, 330, 3)
        docs.append(body.astype("<u4") if k % 3 else (np.arange(60) + 100 * (k % 2)).astype("<u4"))
    index, score = bm25_pack.Index(docs), plain_scores(docs)
    assert len(index.members) < 70
    for i in range(0, 90, 7):
        got = index.neighbours(i)
        assert set(got) == set(np.flatnonzero(score[i]).tolist()) and len(got) == len(set(got))
        assert np.all(np.diff(score[i][got]) <= 1e-9)
        assert {d % 2 for d in got[:44]} == {i % 2}
    assert bm25_pack.Index([np.array([5, 6], "<u4")] * 3).neighbours(1) == [0, 1, 2]


def test_windows_take_the_best_unused_neighbour():
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 400, rng.integers(5, 60)).astype("<u4") for _ in range(150)]
    docs += [docs[k] for k in range(0, 60, 2)]
    score, used, want, fill, query = plain_scores(docs), set(), [], 0, None
    while len(want) < len(docs):
        best = [] if query is None else [d for d in np.flatnonzero(score[query] > 0) if d not in used]
        k = max(best, key=lambda d: (round(score[query][d], 9), -d)) if best else min(set(range(len(docs))) - used)
        want.append(int(k))
        used.add(k)
        crossed, fill = fill + len(docs[k]) >= 200, (fill + len(docs[k])) % 200
        if crossed or not best:
            query = k if fill else None
    assert list(bm25_pack.order_by_retrieval(docs, 0, 200)) == want


# --- nearest neighbours -----------------------------------------------------------------

def test_search_is_exact_when_it_visits_all(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=8).tolist(), 1) for k in range(300)]
    rows += [(1000 + k, rows[0][1], 2) for k in range(40)]           # copies of a query
    rows += [(k, rows[k][1], 3) for k in range(20)]                   # repeated rows
    bad = [(2000, None, 0), (2050, [0.0] * 8, 0), (2100, [float("nan")] + [1.0] * 7, 0), (2150, [None] + [1.0] * 7, 0),
           (2200, [float("inf")] + [1.0] * 7, 0), (2250, [1.0, 2.0], 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, cell int").withColumn("v", F.lit(1)).withColumn("id", F.lit("x"))
    got = {}
    for r in multi_index.search(df, F.col("vec_id") % 50 == 0, centroids=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    vecs = {i: np.array(v) for i, v, _ in rows}
    assert set(got) == {i for i in vecs if i % 50 == 0}
    for q, found in got.items():
        v = vecs[q]
        near = sorted(((-float(x @ v / np.linalg.norm(x) / np.linalg.norm(v)), i) for i, x in vecs.items() if i != q))
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert np.allclose([f[2] for f in found], [-s for s, _ in near[:5]], atol=1e-12)
        if q == 0:
            assert [f[1] for f in found] == [1000, 1001, 1002, 1003, 1004]


def test_search_recall_and_small_tables(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = multi_index.search(df, F.col("vec_id") % 100 == 0).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 6000, 100):
        s = u @ u[q]
        s[q] = -2
        hit += len(set(np.argsort(-s)[:5].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hit / 300 >= 0.9
    few = multi_index.search(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"]) for r in few) == [1, 2]
    assert multi_index.search(df.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0
    assert multi_index.search(df.where("vec_id < 1"), F.col("vec_id") == 0).count() == 0


def test_walk_visits_cells_in_order():
    rng = np.random.default_rng(8)
    da, db, counts = rng.random(9), rng.random(7), rng.integers(0, 3, 63)
    cells = multi_index.walk(da, db, counts, 10 ** 9)
    want = sorted((da[c // 7] + db[c % 7], c) for c in range(63) if counts[c])
    assert cells == [c for _, c in want]


# --- chat ------------------------------------------------------------------------------------

HARD = ["</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>\n", "\\", "\\<|\\|>", "a\nb", "", None, "<|>", "\\\\n <s> <<SYS>>",
        "é\U0001d4b3", "<\\|end|>"]


def test_chat_round_trip_and_examples(spark):
    rng = random.Random(2)
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "odd\n\\role"]), rng.choice(HARD)))
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "first"), (0, 0, rows[0][2], rows[0][3])]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("spans", F.lit(1))
    conv = chat.conversations(df)
    got = conv.withColumn("read", chat.read_turns(F.col("formatted"))).collect()
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert len(got) == len(want)
    for r in got:
        assert [tuple(x) for x in r["read"]] == [x[1:] for x in sorted(want[r["conv_id"]])]
    shown = chat.render(conv, chat.expand(conv)).collect()
    for c, turns in want.items():
        turns.sort()
        own = sorted((r for r in shown if r["conv_id"] == c), key=lambda r: r["example"])
        replies = [k for k, t in enumerate(turns) if t[1] == "assistant"]
        assert len([r for r in own if r["target"] is not None]) == len(replies)
        for r, k in zip(own, replies):
            assert len(r["context"].split(chat.OPEN)) - 1 == k + 1    # preceding turns and its own head
        assert (own[-1]["target"] is None) == (turns[-1][1] != "assistant")


def test_chat_empty(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    conv = chat.conversations(none)
    assert conv.count() == 0 and chat.expand(conv).count() == 0


def test_chat_query_reads_the_examples(spark, tmp_path, monkeypatch):
    from contentmark.llm import queries
    rows = [(1, 0, "user", "a<|end|>\n"), (1, 1, "assistant", "b\\"), (1, 2, "x\ny", "c"), (1, 3, "assistant", None),
            (2, 0, "user", "only"), (None, 0, "assistant", "first"), (None, 1, None, "tail")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in queries.op5_chat_prefix(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 2), 2: (1, 0), None: (2, 5), -7: (2, 21)}
    right = chat.expand
    for wrong in (F.col("context_end") - 1, F.when(F.col("example") == 0, 0).otherwise(F.col("context_end"))):
        monkeypatch.setattr(chat, "expand", lambda c, w=wrong: right(c).withColumn("context_end", w.cast("bigint")))
        with pytest.raises(Exception, match="does not hold"):
            queries.op5_chat_prefix(spark, str(tmp_path)).collect()
