"""Near duplicates, repeated passages, vectors and components against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa

from changeloom.llm import near_dup, repeats, vectors
from changeloom.llm.components import components

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def find(up, x):
    while up.setdefault(x, x) != x:
        x = up[x]
    return x


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    up = {}
    for a, b in edges:
        a, b = find(up, a), find(up, b)
        up[max(a, b)] = min(a, b)
    got = {n.node: n.component for n in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(find(up, x) == c for x, c in got.items()) and {x for e in edges for x in e if e[0] != e[1]} <= set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_one_task_and_by_steps(spark, monkeypatch):
    """Few edges are followed at once, more by joins: both as plain union-find, for numbers and bytes, with nulls and loops."""
    from changeloom.llm import components as module

    r = random.Random(5)
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(60)] + [(k + 1, k) for k in range(200, 260)] + [(5, 5)]
    up = {}
    for a, b in edges:
        if a != b:
            a, b = find(up, a), find(up, b)
            up[max(a, b)] = min(a, b)
    want = {x: find(up, x) for x in list(up)}
    frame = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    named = frame.selectExpr("cast(lpad(hex(a), 4, '0') as binary) a", "cast(lpad(hex(b), 4, '0') as binary) b")
    for few in (0, len(edges) + 1, len(edges) + 2):
        monkeypatch.setattr(module, "FEW", few)
        assert {x.node: x.component for x in components(frame).collect()} == want
        assert {int(x.node, 16): int(x.component, 16) for x in components(named).collect()} == want
        assert components(frame).count() == len(want)


def test_few_files_with_many_partitions(spark, monkeypatch):
    """A table that an operator writes for itself has a file a core or for each 10,000 rows, not one for each shuffle partition."""
    import pathlib
    import sys

    from changeloom.llm import common

    files = {}

    def counted(df, name, put=common.materialize):
        out = put(df, name)
        path = pathlib.Path(out._changeloom_path.removeprefix("file:").replace("//", "/"))
        files[name] = max(files.get(name, 0), len(list(path.glob("part-*"))))
        return out

    for module in ("near_dup", "repeats", "components"):
        monkeypatch.setattr(sys.modules[f"changeloom.llm.{module}"], "materialize", counted)
    most = spark.sparkContext.defaultParallelism
    r = random.Random(3)
    said = [" ".join(f"{r.choice(WORDS)}{r.randrange(500)}" for _ in range(70)) for _ in range(60)]
    docs = spark.createDataFrame([(3 * k + j, text + " end" * j) for k, text in enumerate(said) for j in range(3)], "doc_id long, text string")
    settings = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        docs = common.materialize(docs.coalesce(1), "docs")
        assert {x.component_id for x in near_dup.near_duplicates(docs, 4).collect()} == set(range(0, 180, 3))
        assert repeats.remove_repeats(docs).where("removed is not null").count() == 120
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    steps = ("classes", "shared", "sets", "pairs", "layout", "components", "near", "sketches", "runs", "spans")
    assert all(0 < files[k] <= most for k in steps), files


def sets(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def near_docs():
    r = random.Random(8)
    docs = []
    for _ in range(12):
        base = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(r.choice([3, 8, 40, 120]))]
        for _ in range(r.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = r.choice(WORDS)
            docs.append(" ".join(copy).title())
    docs += [None, "", "  \n", "One", "one", "two words", docs[0], "É é x y z", "é É x y z"]
    return list(enumerate(docs))


def test_near_duplicates(spark):
    docs = near_docs()
    for n in (4, 5):
        shingles = {d: sets(t, n) for d, t in docs}
        up = {}
        for a, _ in docs:
            for b, _ in docs:
                both = len(shingles[a] & shingles[b])
                if a < b and both and 100 * both >= 80 * len(shingles[a] | shingles[b]):
                    x, y = find(up, a), find(up, b)
                    up[max(x, y)] = min(x, y)
        frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, component_id int").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame, n).collect()}
        assert got == {d: (len(shingles[d]), find(up, d), find(up, d) == d) for d, _ in docs}


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f", "k"), (1, "a b c d e f", "k"), (None, "a b c d e f", "k"), (2, "a b c d e f", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dup.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert sorted((r.doc_id or 0, r.lang) for r in near_dup.keep_one(docs).collect()) == [(0, "k"), (1, "k")]
    assert near_dup.keep_one(docs.where("false")).count() == 0


def test_rows_that_share_a_doc_id_are_told_apart(spark):
    """Another text under the same doc_id is another node; of rows that repeat doc_id and text one stays, the least by its other columns."""
    rows = [(5, "a b c d e f g", "y", 1), (5, "a b c d e f g", "x", 2), (5, "h i j k l m n", "z", 3), (3, "A B c d e f g", None, 4), (7, "h i j k l m n", "", 5), (8, "", "a", 6), (8, "", "a", 6), (9, None, "a", 7), (4, "o p q r s t", "w", 8), (4, "o p q r s t", "v", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, _at int").repartition(4)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r._at) for r in kept.collect()) == [(3, 4), (4, 9), (5, 3), (8, 6), (8, 6), (9, 7)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect())
    assert got == [(3, 3, True), (4, 4, True), (4, 4, True), (5, 3, False), (5, 3, False), (5, 5, True), (7, 5, False), (8, 8, True), (8, 8, True), (9, 9, True)]


def loose_group(size, edits, seed=5):
    """Near copies of one text that isn't there, each with so many changed words."""
    r = random.Random(seed)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    out = []
    for k in range(size):
        copy = list(base)
        for at in r.sample(range(120), edits[k % len(edits)]):
            copy[at] = f"x{r.randrange(10**6)}"
        out.append((k, " ".join(copy)))
    return out


def brute_components(docs, n):
    sets_of, up = [(d, sets(t, n)) for d, t in docs], {}
    for k, (a, s) in enumerate(sets_of):
        for b, t in sets_of[:k]:
            if 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(up, a), find(up, b)
                up[max(x, y)] = min(x, y)
    return {d: find(up, d) for d, _ in docs}


def test_blocks_of_a_large_group(spark, monkeypatch):
    """Groups of components below and around the threshold, in one block and in many: as brute force."""
    docs = loose_group(150, (2, 3, 4, 5, 6)) + [(1000 + d, t) for d, t in loose_group(60, (1, 5), 6)]
    want = brute_components(docs, 4)
    assert 20 < len(set(want.values())) < 200
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for rows, elements in ((1024, 1 << 21), (16, 1 << 21), (1024, 2000)):
        monkeypatch.setattr(near_dup, "ROWS", rows)
        monkeypatch.setattr(near_dup, "ELEMENTS", elements)
        assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame, 4).collect()} == want


def test_rows_stay_in_proportion_below_the_threshold(spark, monkeypatch):
    """In a group of near copies that don't link, no step of the three rounds makes more than M rows a member (all pairs: 19,900)."""
    made = {}

    def counted(df, name, put=near_dup.materialize):
        out = put(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dup, "materialize", counted)
    docs = spark.createDataFrame(loose_group(200, (6,)), "doc_id long, text string")
    assert len({r.component_id for r in near_dup.near_duplicates(docs, 4).collect()}) > 160
    assert made["sets"] > 100 and all(k <= near_dup.M * 200 for k in made.values()), made


def test_candidates_hold_similar_pairs():
    r = random.Random(4)
    kept = total = 0
    for _ in range(150):
        a = [r.choice(WORDS) + str(r.randrange(99)) for _ in range(200)]
        b = list(a)
        for _ in range(4):
            b[r.randrange(200)] = "changed"
        s, t = near_dup.shingle_sets(pa.array([" ".join(a), " ".join(b)]), 5)
        if len(np.intersect1d(s, t)) >= 0.8 * len(np.union1d(s, t)):
            total += 1
            x, y = near_dup.half_keys([s, t])
            same = x == y
            kept += bool(same[: near_dup.M].any() and same[near_dup.M :].any())
    assert total > 50 and kept == total


def brute_spans(docs, least):
    """Units by plain loops; paragraphs as tuples of words; spans of later occurrences."""
    found, spans = {}, collections.defaultdict(list)
    for d, text in sorted(docs, key=lambda x: x[0]):
        words = [(m.group(), m.start(), m.end(), text.count("\n", 0, m.start())) for m in re.finditer(r"[^ \n]+", text or "")]
        words = [w for w in words if w[0].strip()]
        cut = [k for k, w in enumerate(words) if k == 0 or words[k - 1][3] != w[3] or words[k - 1][0].endswith(repeats._ENDS) or w[0][0].isupper()]
        borders = [*cut, len(words)]
        runs = set()
        for i, a in enumerate(cut):
            runs |= {(a, z) for z in borders[i + 1 :] if z - a >= least and all(y - a < least for y in borders[i + 1 :] if y < z)}
        for i, z in enumerate(borders[1:]):
            runs |= {(a, z) for a in cut[: i + 1] if z - a >= least and all(z - b < least for b in cut[: i + 1] if b > a)}
        for a, z in sorted(runs, key=lambda x: words[x[0]][1]):
            key = tuple(w[0].lower() for w in words[a:z])
            span = (words[a][1], words[z - 1][2])
            if key in found and found[key] != (d, a):
                spans[d].append(span)
            else:
                found[key] = (d, a)
    return {d: repeats.merged(s) for d, s in spans.items()}


def repeat_docs():
    r = random.Random(3)
    sentence = lambda: " ".join(r.choice(WORDS) for _ in range(r.randrange(2, 9))).capitalize() + "."
    passages = [" ".join(sentence() for _ in range(5)) for _ in range(4)]
    docs = []
    for d in range(40):
        parts = [r.choice([sentence(), sentence().lower(), r.choice(passages), "\n", "x"]) for _ in range(12)]
        docs.append((d, " ".join(parts).replace(" \n ", "\n")))
    return docs + [(90, ""), (91, None), (92, passages[0]), (93, "  " + passages[1] + "\n\n")]


def test_repeats_are_those_of_brute_force(spark):
    docs = repeat_docs()
    want = brute_spans(docs, 12)
    frame = spark.createDataFrame([(*d, "o") for d in docs], "doc_id long, text string, removed string").repartition(3)
    out = repeats.remove_repeats(frame, 12).collect()
    assert len(out) == len(docs) and len(want) > 10
    text = dict(docs)
    for r in out:
        assert [tuple(s) for s in r.removed or []] == want.get(r.doc_id, []), r.doc_id
        assert r.text == (repeats.cut(text[r.doc_id], want[r.doc_id]) if r.doc_id in want else text[r.doc_id])


def test_passage_stays_once_and_other_words_stay(spark):
    words = [f"w{k}" for k in range(60)]
    passage = "Alpha " + " ".join(words[:29]) + ". Beta " + " ".join(words[29:]) + "."
    rows = [(k, f"own{k} before {passage} after own{k} text") for k in range(30)] + [(None, passage), (50, "Clean document. Nothing repeats.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.text for r in repeats.kept_text(docs).collect()}
    assert got[0] == rows[0][1] and got[None] == passage and got[50] == rows[-1][1]
    assert all(got[k] == f"own{k} before after own{k} text" for k in range(1, 30))
    assert repeats.kept_text(docs.where("false")).count() == 0


def test_word_facts_are_those_of_each_word():
    said = ["Aa", "", "\n", "b.", "é", "École!", "ΟΔΟΣ.", "a\tB", "\x1c", "x\x7f", "你好。", "Z", "9?", "\r", "İ", "…"]
    for words in (pa.array(said), pa.array(said).slice(3, 7), pa.array([], pa.string())):
        h, real, brk, stop, upper, size = (x.tolist() for x in repeats.word_facts(words))
        w = words.to_pylist()
        assert h == repeats.mix(repeats.word_hashes(pa.array([" ".join(x.lower().split()) for x in w], pa.string()))).tolist()
        assert real == [bool(x.strip()) for x in w] and brk == [x == "\n" for x in w] and stop == [x.endswith(repeats._ENDS) for x in w]
        assert upper == [x[:1].isupper() for x in w] and size == [0 if x == "\n" else len(x) for x in w]


def test_texts_without_words_stay(spark):
    rows = [(1, ""), (2, None), (3, " \n "), (4, "\n")]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == rows and all(r.removed is None for r in got)


def test_a_repeated_row_keeps_one_copy(spark):
    """Rows that share a doc_id, with equal or other texts, and columns named like the operator's own."""
    passage = "Alpha " + " ".join(f"w{k}" for k in range(40)) + "."
    plain = " ".join(f"v{k}" for k in range(70))
    rows = [(1, "own " + passage, 1, "a"), (1, "own " + passage, 1, "b"), (1, "other " + passage, 2, "c"), (2, passage, 3, "d"), (5, plain, 4, "e"), (5, plain, 4, "f"), (None, passage, 5, "g"), (None, passage, 5, "g"), (7, None, 6, "h"), (7, "", 6, "h")]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, _spans int, _of string").repartition(parts)
        out = repeats.kept_text(docs)
        assert out.columns == docs.columns
        got = [(r.doc_id, r.text, r._of) for r in out.collect()]
        assert len(got) == len(rows)
        of = lambda d: sorted(t or "" for i, t, _ in got if i == d)
        assert sum(passage in t for t in of(1)) == 1 and of(2) == [""] and of(5) == ["", plain]
        assert of(None) == [passage, passage] and of(7) == ["", ""]


def long_docs():
    """Lower-case texts without punctuation or line ends, with passages at any place; one repeats itself, one is periodic."""
    r = random.Random(8)
    plain = lambda n: [f"q{r.randrange(5000)}" for _ in range(n)]
    passages = [plain(n) for n in (50, 51, 52, 60, 81, 86, 300)]
    docs = [(k, plain(r.randrange(70)) + passages[k % 7] + plain(r.randrange(70))) for k in range(28)]
    docs += [(100, plain(20) + 3 * passages[4] + plain(9)), (101, ["a"] * 160), (102, ["b", *["a"] * 160]), (103, plain(400))]
    return [(d, " ".join(w)) for d, w in docs]


def test_long_runs_are_those_of_brute_force(spark):
    docs, seen, want = long_docs(), {}, {}
    for d, text in docs:
        words, gone = text.split(), set()
        for k in range(len(words) - 50):
            key = tuple(words[k : k + 51])
            first = seen.setdefault(key, (d, k))
            if first[0] != d or k >= first[1] + 51:
                gone |= set(range(k, k + 51))
        want[d] = " ".join(w for k, w in enumerate(words) if k not in gone)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text.strip() for r in repeats.kept_text(frame).collect()}
    assert got == want
    assert sum(len(got[d].split()) < len(t.split()) for d, t in docs) == 21
    assert len(got[101].split()) == 51


def test_sides_of_removed_paragraphs():
    text = "one two Alpha beta gamma. three four five six seven"
    para = (8, 25)
    assert repeats.with_sides(text, [para], [(0, len(text))]) == [(8, len(text))]
    assert repeats.with_sides(text, [], [(4, 19)]) == [(4, 18)] and repeats.with_sides(text, [para], []) == [para]


def test_cut():
    assert repeats.cut("a B c", [(2, 3)]) == "a c" and repeats.cut("B\nc", [(0, 1)]) == "c" and repeats.cut("a\nB\nc", [(2, 3)]) == "a\nc" and repeats.cut("B", [(0, 1)]) == ""


def test_vectors(spark):
    r = np.random.default_rng(1)
    rows, base = [], r.normal(size=(40, 16))
    for k in range(160):
        v = base[r.integers(40)] + r.choice([0.0, 0.02, 0.05]) * r.normal(size=16)
        rows.append((k, v.tolist(), int(r.integers(2))))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [1.0, None] * 8, 1), (204, rows[0][1], None), (205, rows[0][1], rows[0][2]), (None, rows[0][1], rows[0][2]), (206, [], 1), (207, [1e300] * 16, 1), (208, [2e300] * 16, 1), (209, [1.0] * 8, 1)]
    usable = [(k, np.array(v, float), c) for k, v, c in rows if k is not None and c is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {k: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for k, v, _ in usable}
    up, links = {}, collections.Counter()
    for a, x, c in usable:
        for b, y, d in usable:
            if a < b and c == d and len(x) == len(y) and unit[a] @ unit[b] >= 0.98:
                links.update([a, b])
                i, j = find(up, a), find(up, b)
                up[max(i, j)] = min(i, j)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in vectors.near_duplicates(frame).collect()}
    assert got.pop(None) == (0, None, True) and sum(links.values()) > 50
    assert got == {k: (links[k], find(up, k), find(up, k) == k) for k, _, _ in rows if k is not None}
    assert vectors.near_duplicates(frame.where("false")).count() == 0


def test_long_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    r = np.random.default_rng(1)
    rows = [(k, (np.ones(12) + 0.01 * r.normal(size=12)).tolist(), 1) for k in range(60)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(g.n_links, g.component_id) for g in got} == {(59, 0)}
