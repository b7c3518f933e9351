"""Operators 3, 6, 9, 10 and the pipeline: against brute force, and their defined cases."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat_transcripts, setsketch_dedup, topk, warc
from plumbline.llm.components import connected_components
from plumbline.llm.shingles import WordHashes, shingle_set

# 3 --------------------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path, monkeypatch):
    big, other = "<p>é" + "x" * 1000, "y" * 999
    rows = [(1, "u1", big), (5, "u\r\n5", big), (3, "", big), (2, None, other), (4, "u4", other), (6, "u6", None), (7, "u7", ""), (5, "u\r\n5", big), (None, "n", big), (8, "u8", "z" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS file")
    monkeypatch.setattr(warc, "RANGE", 500)
    got = sorted(map(tuple, warc.archive(df, str(tmp_path)).collect()), key=str)
    want = []
    for page, url, html in rows:
        raw = (html or "").encode()
        again = html == big and page != 5
        want.append((page, url, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 5 if again else None))
    assert got == sorted(want, key=str)
    index = warc.write(df, str(tmp_path / "b"))
    some = warc.read(index.where("page_id = 8"), str(tmp_path / "b")).collect()
    assert [r["payload"] for r in some] == [bytearray(b"z" * 300_000)]
    assert warc.archive(df.limit(0), str(tmp_path / "c")).count() == 0


# 6 --------------------------------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in (rng.normal(0, 0.2, 8) if i % 3 else np.full(8, 0.25))]) for i in range(400)]
    rows += [(900, None), (950, [0.1, None] * 4), (1000, [float("nan")] * 8), (1050, [math.inf] * 8), (1100, [0.5] * 3), (1101, [0.25] * 3), (1150, []), (50, rows[50][1]), (None, [0.1] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS block", "2 AS id")
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in sound:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in sound if i != q and len(w) == len(v))[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    for block in (2048, 37):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "SLICE", 3)
        monkeypatch.setattr(topk, "QUERIES", 4)
        assert sorted(map(tuple, topk.top_k(df, F.col("id") % 50 == 0).collect())) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_a_walk_ends_where_bounds_fall_below_the_kth(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in np.abs(rng.normal(0.5, 0.1, 8)) / (1 + i // 50)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for q in range(0, 1000, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in whole.items() if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    planned, cut = [], topk.cut

    def counted(df, name):
        out = cut(df, name)
        if name == "plan":
            planned.append(sum(len(r["rows"]) // 4 for r in out.collect()))
        return out

    for at, value in {"BLOCK": 10, "QUERIES": 7, "FIRST": 1, "GROWTH": 2, "cut": counted}.items():
        monkeypatch.setattr(topk, at, value)
    assert sorted(map(tuple, topk.top_k(df, F.col("id") % 50 == 0).collect())) == sorted(want)
    # 20 queries and 100 blocks or more: the walk scores a small part of them, and stops after a round without any
    assert planned[0] == 20 and 20 <= sum(planned) < 400 and planned[-1] < 20 * 2 ** (len(planned) - 1)


def test_products_stay_exact():
    big = np.array([[2**26, -(2**26)] * 4], np.int32)
    assert topk.product(big, big)[0, 0] == 8 * 2**52


def test_large_components_are_not_cut(spark, monkeypatch):
    rng = np.random.default_rng(66)
    size = [1.0, 2.0**19, 2.0**20, 2.0**21, 2.0**21, 2.0**21, 2.0**18]
    rows = [(i, [float(x) for x in rng.normal(0, size[i % 7], 4)]) for i in range(300)] + [(400, [2.0**23, -(2.0**23), 0.0, 0.0]), (401, [2.0**23 + 1, 2.0**23, 0.0, 0.0])]
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for q in range(0, 300, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in whole.items() if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    want = [w for w in want if abs(w[3]) < 2**63]
    asked = sorted({w[0] for w in want if sum(x[0] == w[0] for x in want) == 5})
    assert asked and max(abs(w[3]) for w in want) > 2**58
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK", 37)
    assert sorted(map(tuple, topk.top_k(df, F.col("id").isin(asked)).collect())) == sorted(w for w in want if w[0] in asked)
    far = np.array([[2**62, -(2**62), 3]])
    assert topk.product(far, far)[0, 0] == 2**125 + 9
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [2.0**60]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("id") == 0).collect()


# 9 --------------------------------------------------------------------------------------------------------------------


def brute_path(model, seen):
    s = len(chat_transcripts.STATES)
    best, at = -math.inf, None
    for path in itertools.product(range(s), repeat=len(seen)):
        score = model.start[path[0]] + model.emit[path[0], seen[0]] + sum(model.move[a, b] + model.emit[b, o] for a, b, o in zip(path, path[1:], seen[1:], strict=False))
        if score > best:
            best, at = score, list(path)
    return at


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(9)
    s = len(chat_transcripts.STATES)
    model = chat_transcripts.Model(rng.random(s) * 9, rng.random((s, s)) * 9, rng.random((s, chat_transcripts.SYMBOLS)) * 9)
    for n in (1, 3, 5):
        seen = rng.integers(0, chat_transcripts.SYMBOLS, n).tolist()
        assert chat_transcripts.viterbi(model, seen) == brute_path(model, seen)


def talk(n, turns):
    rng = np.random.default_rng(90)
    out = []
    for c in range(n):
        for t in range(turns):
            role = "user" if t % 2 == 0 else "assistant"
            out.append((c, t, role, "\n".join("word " * rng.integers(1, 9) + "." for _ in range(1 if role == "user" else 3))))
    return out


def test_chat_blocks_do_not_change_the_path(spark, monkeypatch):
    df = spark.createDataFrame(talk(3, 40), "conv_id long, turn long, role string, text string")
    rows = chat_transcripts.written(df)
    model = chat_transcripts.train(chat_transcripts.blocks(rows))
    bare = rows.withColumn("lines", F.transform("lines", lambda x: F.regexp_replace(x, r"^(\S+: |### \S+: |\[\w+\] )", "")))
    for given in (rows, bare):
        whole = [r for r in chat_transcripts.parse(given, model).collect()]
        monkeypatch.setattr(chat_transcripts, "SPAN", 7)
        monkeypatch.setattr(chat_transcripts, "GROUP", 2)
        cut = [r for r in chat_transcripts.parse(given, model).collect()]
        monkeypatch.undo()
        role = lambda found: sorted((r["conv_id"], r["turn"], r["role"]) for r in found if r["opens"])
        assert role(cut) == role(whole)


def test_crowded_turns_keep_their_order(spark, monkeypatch):
    rng = np.random.default_rng(91)
    roles = ["user", "assistant", None]
    given = [(conv, turn, roles[rng.integers(3)], "\n".join(f"line {rng.integers(10**6)} {'?' if rng.integers(2) else '.'}" for _ in range(rng.integers(1, 4)))) for conv in (7, None) for turn in (None, 0, 1, 2, 3000) for _ in range(40)]
    rows = chat_transcripts.written(spark.createDataFrame([*given, (8, 0, "user", "alone")], "conv_id long, turn long, role string, text string"))

    def sequence():
        found = sorted(chat_transcripts.blocks(rows).collect(), key=lambda r: (r["conv_id"] or 0, r["chunk"], r["sub"]))
        out = {}
        for r in found:
            out.setdefault(r["conv_id"], []).extend(r["rows"])
        return out, max(len(r["rows"]) for r in found), len(found)

    def recovered():
        return sorted((str(r["conv_id"]), str(r["turn"]), r["role"]) for r in chat_transcripts.parse(rows).collect() if r["opens"])

    whole, model, turns = sequence(), chat_transcripts.train(chat_transcripts.blocks(rows)), recovered()
    monkeypatch.setattr(chat_transcripts, "CROWD", 8)
    split, other = sequence(), chat_transcripts.train(chat_transcripts.blocks(rows))
    assert split[0] == whole[0] and split[1] < 40 and split[2] > whole[2]
    assert (model.start == other.start).all() and (model.move == other.move).all() and (model.emit == other.emit).all()
    assert recovered() == turns


def test_chat_cases(spark):
    rows = [(1, 0, " USER ", "hi?"), (1, 1, "assistant", "a\nb"), (1, 1, "assistant", "a\nb"), (2, 0, None, "User: x"), (2, 1, "alien", None), (None, None, "system", ""), (3, 0, "user", "y" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS rows", "2 AS chunk")
    got = {(r["conv_id"], r["turn"]): (r["role"], r["rendered"]) for r in chat_transcripts.format_turns(df).collect()}
    assert got[1, 0] == ("user", "<|im_start|>user\nhi?<|im_end|>") and got[1, 1] == ("assistant", "<|im_start|>assistant\na\nb<|im_end|>")
    assert got[2, 0][0] == "user" and got[None, None] == ("system", "<|im_start|>system\n<|im_end|>") and len(got[3, 0][1]) > 100_000
    assert chat_transcripts.format_turns(df.limit(0)).count() == 0
    raw = spark.createDataFrame([(1, "### Human: hello\nmore\nAI: fine.")], "conv_id long, text string")
    model = chat_transcripts.train(chat_transcripts.blocks(chat_transcripts.written(df)))
    assert [r["role"] for r in chat_transcripts.parse(chat_transcripts.lines_of(raw), model).orderBy("turn").collect()] == ["user", "assistant"]


# 10 -------------------------------------------------------------------------------------------------------------------


def brute_groups(rows):
    memo = WordHashes()
    sets = [(i, set(shingle_set(t, memo).tolist())) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations([x for x in sets if x[0] is not None], 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            p, q = sorted((top(i), top(j)))
            parent[q] = p
    return sorted(((i, len(s), top(i) if i is not None else None, i is not None and top(i) == i) for i, s in sets), key=str)


def family(seed, n, words=60, edits=3):
    """A text and edited copies, each from a copy before it: links are chains, and some members aren't linked at all."""
    rng = np.random.default_rng(seed)
    out = [[f"w{seed}_{i}" for i in range(words)]]
    for _ in range(n - 1):
        w = list(out[rng.integers(len(out))])
        for at in rng.integers(0, words, rng.integers(1, edits + 1)):
            w[at] = f"e{rng.integers(1e9)}"
        out.append(w)
    return [" ".join(w) for w in out]


ODD = ["", None, " \t", "one two", "One TWO", "a b c d", "x " * 30_000, "x " * 30_000]


@pytest.mark.parametrize("limits", [None, (4, 3, 8), (2, 10**6, 3)])
def test_groups_equal_brute_force(spark, monkeypatch, limits):
    if limits:  # large buckets by blocks, and split by other bands
        monkeypatch.setattr(setsketch_dedup, "SMALL", limits[0])
        monkeypatch.setattr(setsketch_dedup, "HUGE", limits[1])
        monkeypatch.setattr(setsketch_dedup, "SQUARE", limits[2])
    shared = " ".join(f"common{i}" for i in range(40))
    texts = family(1, 60) + family(2, 50, 45, 2) + [shared + " " + " ".join(f"u{i}_{k}" for k in range(25)) for i in range(30)] + ODD + family(1, 3)[:1] * 5
    rows = [(10_000 - 3 * i, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS label")
    assert sorted(map(tuple, setsketch_dedup.near_duplicates(df).collect()), key=str) == brute_groups(rows)


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, ""), (4, None), (None, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))
    kept = setsketch_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect() if r["text"]) == [(0, "a b c d e f"), (1, "a b c d e f")]
    assert kept.count() == 4 and setsketch_dedup.near_duplicates(df.limit(0)).count() == 0


def test_registers():
    rng = np.random.default_rng(10)
    a, b = rng.integers(0, 2**64, 4000, np.uint64), rng.integers(0, 2**64, 1000, np.uint64)
    assert (setsketch_dedup.merge(setsketch_dedup.registers(a), setsketch_dedup.registers(b)) == setsketch_dedup.registers(np.concatenate([a, b]))).all()
    found = []
    for j in (0.5, 0.75, 0.9):
        shared = int(2000 * 2 * j / (1 + j))
        x = np.concatenate([a[:shared], a[shared:2000]])
        y = np.concatenate([a[:shared], rng.integers(0, 2**64, 2000 - shared, np.uint64)])
        est = setsketch_dedup.estimate(np.array([2000.0]), np.array([2000.0]), setsketch_dedup.registers(x)[None], setsketch_dedup.registers(y)[None])[0]
        found.append(abs(est - shared / (4000 - shared)))
    assert max(found) < 0.16


def test_components(spark):
    rng = np.random.default_rng(11)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, int(x)) for x in rng.integers(200, 260, 80)] + [(1, 1), (None, 2), (5, 4)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(100, 161)} == {100} and got[5] == got[4] == 4 and 1 not in got
    assert all(v == 7 for k, v in got.items() if 200 <= k < 260)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# pipeline -------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    from plumbline.llm import decontaminate, quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r["doc_id"] for r in quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    kept = {g[0] for g in brute_groups(rows) if g[3]}
    held = {r["doc_id"] for r in decontaminate.find(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: lib.encode(t) for i, t in rows if i in kept and i not in held}
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and len(got) > 50
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "sentencepiece"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
