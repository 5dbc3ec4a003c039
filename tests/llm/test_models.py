"""Quality field, decontamination, language model and the pipeline."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from changeloom.llm import decontam, hmm_lm, quality

SF = "/root/testdata/sf0.001"


def test_marginals_by_enumeration():
    import itertools

    r = np.random.default_rng(0)
    count = np.array([3, 1, 4])
    node, edge = r.normal(size=(8, 2)), r.normal(size=(2, 2))
    prob, pair, logz = quality.marginals(node, edge, count)
    at = 0
    for k, n in enumerate(count):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        s = np.array([sum(node[at + t, y] for t, y in enumerate(p)) + sum(edge[a, b] for a, b in zip(p, p[1:])) for p in paths])
        w = np.exp(s - np.logaddexp.reduce(s))
        assert logz[k] == pytest.approx(np.logaddexp.reduce(s))
        for t in range(n):
            assert prob[at + t, 1] == pytest.approx(sum(x for x, p in zip(w, paths) if p[t]))
        for i in (0, 1):
            for j in (0, 1):
                assert pair[k, i, j] == pytest.approx(sum(x * sum((a, b) == (i, j) for a, b in zip(p, p[1:])) for x, p in zip(w, paths)))
        at += n


def quality_rows(n=400):
    r = random.Random(7)
    good = lambda: " ".join(r.choice("some plain words stand here and there in a line".split()) for _ in range(12)) + "."
    bad = lambda: " ".join("BUY!!" if r.random() < 0.7 else "now" for _ in range(12))
    docs, labels = [], []
    for k in range(n):
        ok = r.random() < 0.7
        lines = [good() for _ in range(r.randrange(1, 6))] + ([] if ok else [bad() for _ in range(r.randrange(2, 6))])
        docs.append((k, "\n".join(lines), 5))
        labels.append((k, int(ok)))
    return docs, labels


def test_quality_on_held_out_rows(spark):
    docs, labels = quality_rows()
    frame = spark.createDataFrame([*docs, (None, "x", 1), (9000, None, 1), (9001, "", 1)], "doc_id long, text string, score int").repartition(3)
    told = spark.createDataFrame([*labels, (3, 1 - labels[3][1]), (None, 1), (5, None)], "doc_id long, quality int")
    field = quality.train(frame, told, limit=150)
    got = {r.doc_id: r for r in quality.scored(frame, field).collect()}
    truth = dict(labels)
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out == (k in set(held)) for k in truth) and not got[None].held_out
    assert sum(got[k].predicted == truth[k] for k in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[9000].score == got[9001].score
    assert quality.scored(frame.where("false"), field).count() == 0
    assert quality.scored(frame, quality.train(frame, told.where("false"))).count() == len(docs) + 3


def items(n=40):
    r = random.Random(11)
    return [(k, " ".join(f"{r.choice('abcdefgh')}{r.randrange(400)}" for _ in range(r.randrange(15, 70))) + ". The answer is " + f"{r.randrange(99999)} of them all.") for k in range(n)]


def test_wand_finds_all_above_threshold():
    index = decontam.Index(items())
    r = random.Random(1)
    for _ in range(200):
        terms = sorted(r.sample(range(len(index.terms)), r.randrange(1, 40)))
        score = collections.Counter()
        for t in terms:
            for i, w in zip(index.items[t], index.weights[t]):
                score[i] += w
        for th in (0.02, 0.1):
            assert sorted(i for i, _ in index.retrieve(terms, th)) == sorted(i for i, s in score.items() if s >= th)


def test_leaks(spark):
    bench = items()
    r = random.Random(2)
    noise = lambda n: " ".join(f"noise{r.randrange(3000)}" for _ in range(n))
    docs = [(k, f"{noise(r.randrange(90))} {bench[k][1].upper() if k % 3 else bench[k][1]} {noise(50)}") for k in range(20)]
    docs += [(100 + k, noise(120) + " The answer is 5 of them all.") for k in range(20)] + [(200, None), (201, ""), (None, bench[3][1])]
    docs += [(300, " ".join(bench[5][1].split()[: len(bench[5][1].split()) // 3]))]  # a third of an item isn't the item
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int").repartition(3)
    table = spark.createDataFrame([*bench, (77, None), (None, "x"), (78, "two words")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.leaks(frame, table).collect()}
    assert got == {(k, k) for k in range(20)} | {(None, 3)}
    # A row goes for its own text: with and without a doc_id, and not for another row that shares its doc_id.
    more = frame.unionByName(spark.createDataFrame([(3, "clean words under a doc_id that is used twice", 0), (None, "clean", 0)], frame.schema)).withColumn("_bad", F.lit(1))
    kept = sorted((x.doc_id or -1, x.text or "") for x in decontam.without_leaks(more, table).collect())
    assert kept == sorted([(d, t or "") for d, t in docs[20:-2]] + [(300, docs[-1][1]), (3, "clean words under a doc_id that is used twice"), (-1, "clean")])
    assert decontam.leaks(frame, table.where("false")).count() == 0 and decontam.leaks(frame.where("false"), table).count() == 0


def test_long_items_are_found(spark):
    """Items of 33 to 500 words, word for word at any offset."""
    r = random.Random(5)
    bench = [(k, " ".join(f"{r.choice('abcdefgh')}{r.randrange(400)}" for _ in range(n)) + ". The answer is " + f"{r.randrange(99999)} of them all.") for k, n in enumerate([33, 64, 100, 130, 150, 200, 300, 400, 500] * 4)]
    noise = lambda n: " ".join(f"noise{r.randrange(3000)}" for _ in range(n))
    docs = [(k, f"{noise(r.randrange(90))} {t} {noise(r.randrange(90))}") for k, t in bench]
    docs += [(100 + k, noise(20) + " " + " ".join(t.split()[: len(t.split()) // 3])) for k, t in bench]  # a third of an item isn't the item
    got = {(x.doc_id, x.item_id) for x in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(k, k) for k, _ in bench}


def test_shards_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_WORDS", 300)
    bench = items()
    frame = spark.createDataFrame([(k, "pad " * 9 + t) for k, t in bench], "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.leaks(frame, spark.createDataFrame(bench, "item_id long, text string")).collect()} == {(k, k) for k, _ in bench}


def test_shards_have_the_weights_of_all_items(spark, monkeypatch):
    """Scores, and what passes, don't change with the number of shards."""
    bench = [(k, t + (" common words stand here" if k % 9 == 0 else "")) for k, t in items(200)]
    docs = [(k, "pad " * 9 + " ".join(w for n, w in enumerate(t.split()) if k % 2 or n % 9)) for k, t in bench]
    frame, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    run = lambda: sorted((x.doc_id, x.item_id, round(x.score, 9)) for x in decontam.leaks(frame, table, overlap=0.2).collect())
    one = run()
    monkeypatch.setattr(decontam, "SHARD_WORDS", 3000)
    assert run() == one and len(one) > 150 and any(s < 0.99 for _, _, s in one)


def test_forward_and_counts_by_enumeration():
    import itertools

    m = hmm_lm.Model(10, 5, {"\n": 2}, {"\n": 0}, np.zeros(hmm_lm.SHARED))
    r = np.random.default_rng(3)
    hmm_lm.update(m, r.random(hmm_lm.STATES), r.random((hmm_lm.STATES,) * 2), r.random((m.classes, hmm_lm.STATES)))
    seq, count = np.array([3, 9, 0, 4, 0, 0]), np.array([3, 2, 1])
    logp = hmm_lm.forward(m, seq, count)
    first, move, emit, log_p = hmm_lm.expected(m, *hmm_lm.by_step(seq, count)[:2])
    assert log_p == pytest.approx(logp.sum(), rel=1e-5)
    at, f2, m2, e2 = 0, np.zeros_like(first), np.zeros_like(move), np.zeros_like(emit)
    for k, n in enumerate(count.tolist()):
        total, parts = 0.0, []
        for p in itertools.product(range(hmm_lm.STATES), repeat=n):
            w = m.start[p[0]] * np.prod([m.move[a, b] for a, b in zip(p, p[1:])]) * np.prod([m.emit[seq[at + t], s] for t, s in enumerate(p)])
            total += w
            parts.append((w, p))
        assert logp[k] == pytest.approx(math.log(total))
        for w, p in parts:
            f2[p[0]] += w / total
            for t, s in enumerate(p):
                e2[seq[at + t], s] += w / total
            for a, b in zip(p, p[1:]):
                m2[a, b] += w / total
        at += n
    assert np.allclose(first, f2, 1e-4) and np.allclose(move, m2, 1e-4) and np.allclose(emit, e2, 1e-4)


@pytest.mark.parametrize("hot", [200_000, 20])
def test_language_model(spark, monkeypatch, hot):
    monkeypatch.setattr(hmm_lm, "HOT", hot)
    monkeypatch.setattr(hmm_lm, "OWN", 15)
    r = random.Random(6)
    pools = [["red", "blue", "green", "pink"], ["uno", "dos", "tres", "cuatro"]]
    docs = [(k, " ".join(r.choice(pools[k % 2]) + ("" if r.random() < 0.8 else str(r.randrange(40))) for _ in range(r.randrange(5, 60)))) for k in range(120)]
    docs += [(500, None), (501, ""), (502, "Never SEEN é")]
    frame = spark.createDataFrame([*[(*d, 1) for d in docs], (None, "red red", 1)], "doc_id long, text string, score int").repartition(3)
    m, counts = hmm_lm.train(frame)
    got = {x.doc_id: x for x in hmm_lm.scored(frame, m, counts).collect()}
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"] for d, t in docs}
    c = collections.Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in words.items():
        x = got[d]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert x.held_out == (zlib.crc32(str(d).encode()) % 7 == 2)
        assert x.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        # The model's score by plain loops: classes by the forward recursion, tokens inside shared classes by their counts.
        shared = lambda w: len(m.own) + zlib.crc32(w[-2:].encode()) % hmm_lm.SHARED
        in_class = collections.defaultdict(lambda: [0, 0])
        for w, k in c.items():
            if w not in m.own:
                in_class[shared(w)][0] += k
                in_class[shared(w)][1] += 1
        now, score = None, 0.0
        for w in ws:
            f = (m.start if now is None else now @ m.move) * m.emit[m.own.get(w, shared(w))]
            score += math.log10(f.sum())
            now = f / f.sum()
            if w not in m.own:
                k, v2 = in_class[shared(w)]
                score += math.log10((c[w] + 1) / (k + v2 + 1))
        assert x.score == pytest.approx(score), (d, ws[:5])
    held = [x for x in got.values() if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
    assert not got[None].held_out
    assert hmm_lm.scored(frame, *hmm_lm.train(frame.where("false"))).count() == len(docs) + 1


def test_language_model_learns_from_all_training_texts(spark):
    """Texts of over 24,000 characters, as a corpus of books has: the model must equal Baum-Welch by plain loops over all of them."""
    r = random.Random(4)
    docs = [(k, " ".join(r.choice(["red", "blue", "green"] if (t // 5) % 2 else ["uno", "dos", "tres"]) for t in range(6000))) for k in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    m, _ = hmm_lm.train(frame)
    texts = [t for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2]
    assert len(texts) > 5 and min(map(len, texts)) > 24_000
    seq = np.concatenate([[m.own[w] for w in t.split()] + [m.own["\n"]] for t in texts])
    count = np.array([6001] * len(texts))
    want = hmm_lm.Model(m.total, m.distinct, m.hot, m.own, m.inside)
    seen = np.bincount(seq, minlength=m.classes) + 1.0
    noise = np.random.default_rng(9).dirichlet(np.ones(hmm_lm.STATES), m.classes) * hmm_lm.STATES
    hmm_lm.update(want, np.ones(hmm_lm.STATES), np.ones((hmm_lm.STATES,) * 2) + 20 * np.eye(hmm_lm.STATES), seen[:, None] * noise)
    before = hmm_lm.forward(want, seq, count).sum()
    gains = [before]
    assert 3 <= m.passes <= hmm_lm.PASSES
    for _ in range(m.passes):
        hmm_lm.update(want, *plain_expected(want, seq, count))
        gains.append(hmm_lm.forward(want, seq, count).sum())
    assert np.allclose(m.move, want.move, atol=1e-4) and np.allclose(m.emit, want.emit, atol=1e-4)
    assert hmm_lm.forward(m, seq, count).sum() == pytest.approx(gains[-1], rel=1e-4)
    assert all(b - a >= hmm_lm.GAIN * abs(b) for a, b in zip(gains[:-3], gains[1:-2], strict=True))
    assert gains[-2] - gains[-3] < hmm_lm.GAIN * abs(gains[-2]) or m.passes == hmm_lm.PASSES


def plain_expected(m, seq, count):
    """Forward-backward of one sequence after the other, in double precision."""
    first, move, emit, at = np.zeros(hmm_lm.STATES), np.zeros((hmm_lm.STATES,) * 2), np.zeros((m.classes, hmm_lm.STATES)), 0
    for n in count.tolist():
        p = m.emit[seq[at : at + n]]
        f, b = np.zeros((n, hmm_lm.STATES)), np.ones((n, hmm_lm.STATES))
        for t in range(n):
            f[t] = (f[t - 1] @ m.move if t else m.start) * p[t]
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = m.move @ (p[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
            pair = m.move * np.outer(f[t], p[t + 1] * b[t + 1])
            move += pair / pair.sum()
        g = f * b
        g /= g.sum(axis=1, keepdims=True)
        first += g[0]
        np.add.at(emit, seq[at : at + n], g)
        at += n
    return first, move, emit


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_pipeline(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[:5] == columns and (len(out.columns) == 5 or name == corpus_pipeline.STAGES[-1][0])
        rows = out.collect()
        now = {r.doc_id: r.text for r in rows}
        assert len(now) == len(rows) and set(now) <= set(before) and now
        if name in ("quality", "near_dedup", "decontaminate"):
            assert all(now[d] == before[d] for d in now) and len(now) < len(before)
        elif name == "passages":
            assert set(now) == set(before) and all(len(now[d]) <= len(before[d]) for d in now)
            assert all(r.n_chars == len(r.text) for r in rows)
        else:
            assert now == before and all(r.n_tokens == len(r.ids) > 0 or not r.text for r in rows)
        docs = spark.createDataFrame(rows, out.schema)
        before = now
    assert corpus_pipeline.run(spark, SF).count() == len(before)


def test_empty_documents_pass_the_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false") if os.path.isdir(SF) else pytest.skip("no driver tables")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


