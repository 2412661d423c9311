from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from maskwork.llm import components, exact_dedup, line_dedup, ngram_join, vector_forest

SCHEMA = "doc_id long, text string, _row string, component long"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (6, " o n e "), (7, "word " * 30_000), (8, "x" * 200_000), (None, "one"), (9, "Été a b c d e"), (10, "Été a b c d e f")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "extra", 0) for i, t in rows], SCHEMA)


def near_copies(seed, n):
    """Documents, near copies with a few words changed, and passages that some share."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            t = rng.choice(out).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([[rng.choice(words)], [], [t[k], rng.choice(words)]])
                t = t or ["w"]
        else:
            t = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20, 60, 150]))]
            if rng.random() < 0.3:
                t += passage
        out.append(" ".join(t))
    return list(enumerate(out))


def brute_components(rows, k, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if both and den * both >= num * len(s | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return Counter((d, len(s), d if not s else min((x for x in least[find(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80), (1, 50)])
def test_ngram_components_match_brute_force(spark, k, num):
    rows = near_copies(k, 220)
    got = ngram_join.link_components(frame(spark, rows), k, num, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, k, num, 100)


def test_ngram_blocks_and_components_that_a_star_misses(spark, monkeypatch):
    rows = near_copies(11, 160)
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    got = ngram_join.link_components(frame(spark, rows), 1, 60, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 1, 60, 100)


def test_ngram_odd_rows(spark):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.link_components(frame(spark, ODD), 4, 85, 100).collect()}
    assert got[1, 0] == 1 and got[2, 0] == 2 and got[3, 0] == 3
    assert got[4, 1] == got[5, 1] == got[None, 1] == 4 and got[6, 1] == 6
    assert got[7, 1] == 7 and got[8, 1] == 8 and got[9, 3] == 9
    assert ngram_join.link_components(frame(spark, []), 4, 85, 100).collect() == []
    kept = ngram_join.keep_one(frame(spark, ODD))
    assert kept.columns == ["doc_id", "text", "_row", "component"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 6, 7, 8, 9, 10])


def test_keep_one_is_by_row(spark):
    text = "a passage of quite enough words to have several shingles of five words each"
    other = "something else that nobody copied from any of the other rows in here"
    rows = [(1, text), (1, text), (7, text + " too"), (7, other), (None, text + " also"), (None, "only words that a row without an id holds"), (9, ""), (9, "")]
    kept = Counter((r.doc_id, r.text) for r in ngram_join.keep_one(frame(spark, rows).repartition(3)).collect())
    assert kept == Counter([(1, text), (7, other), (None, "only words that a row without an id holds"), (9, ""), (9, "")])
    clash = spark.createDataFrame([(1, text, 1, "a", "b", 3, True), (2, text, 2, "c", "d", 4, False)], "doc_id long, text string, key long, _id string, `_row.x` string, component long, whole boolean")
    (r,) = ngram_join.keep_one(clash).collect()
    assert tuple(r) == (1, text, 1, "a", "b", 3, True)


def test_parity_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        s = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900), dtype=np.uint64))
        t = np.unique(np.concatenate([s[: rng.integers(0, len(s) + 1)], rng.integers(0, 1 << 63, rng.integers(1, 90), dtype=np.uint64)]))
        a, b = ngram_join.parity_bits(s), ngram_join.parity_bits(t)
        size = min(len(a), len(b))
        differ = int(np.bitwise_count(ngram_join.folded(a, size) ^ ngram_join.folded(b, size)).sum())
        assert differ <= len(np.setxor1d(s, t))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1400)] + [(5000, 5000 + k) for k in range(50)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(5))
    assert {r.node: r.component for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_exact_groups(spark):
    rows = ODD + [(20, "a b"), (21, "a  b"), (22, "ab")]
    got = exact_dedup.duplicate_groups(frame(spark, rows).repartition(7)).collect()
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[strip(t)].append((-len(t or ""), d is None, d or 0, d))
    want = Counter()
    for key, own in groups.items():
        best = min(own)
        digest = hashlib.sha256(key.encode()).hexdigest()
        kept = False
        for row in sorted(own):
            want[row[3], best[3], len(own), not kept and row == best, digest] += 1
            kept = True
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup.duplicate_groups(frame(spark, [])).collect() == []


def test_exact_drop_is_by_row(spark):
    rows = [(5, "ab"), (5, "a b"), (5, "a  b"), (8, "a  b"), (5, "a  b"), (6, "cd"), (6, "c d"), (6, "ef"), (None, "gh"), (None, "g h"), (None, "g h")]
    kept = Counter((r.doc_id, r.text) for r in exact_dedup.drop_duplicates(frame(spark, rows).repartition(4)).collect())
    assert kept == Counter([(5, "a  b"), (6, "c d"), (6, "ef"), (None, "g h")])
    clash = spark.createDataFrame([(1, "x", 1, "a", "b", 3, True), (2, "x", 2, "c", "d", 4, False)], "doc_id long, text string, _key long, _id string, _gid string, n long, whole boolean")
    (r,) = exact_dedup.drop_duplicates(clash).collect()
    assert tuple(r) == (1, "x", 1, "a", "b", 3, True)


def test_exact_drop_keeps_one_of_each_group_and_all_columns(spark):
    df = frame(spark, ODD + [(20, "a b"), (21, "a  b"), (22, "ab")]).repartition(3)
    out = exact_dedup.drop_duplicates(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([3, 6, 7, 8, 9, 10, 21])


def test_patience():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert line_dedup.patience([1, 1, 2], [1, 1, 2]) == [(0, 0), (1, 1), (2, 2)]
    assert line_dedup.patience([1, 2], [3]) == [] and line_dedup.patience([], [1]) == []
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.randrange(1, 12) for _ in range(rng.randrange(15))] for _ in "ab")
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_lines_go_from_later_documents(spark):
    passage = "this passage has more than eight words in it , surely"
    rows = [(1, f"first\n{passage}\nsecond"), (2, f"other start\n {passage} \nother end"), (3, f"{passage}\nnew words that only this document has in it\nend"), (4, "first\nsecond"), (5, None), (6, ""), (7, f"first\n{passage}\nsecond"), (7, f"first\n{passage}\nsecond")]
    got = {r.doc_id: r for r in line_dedup.report(frame(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[1].n_removed == 0 and got[1].n_lines == 3
    assert got[2].text == "other start\nother end" and got[2].partners == [1] and got[2].removed_words == 11
    assert got[3].text == "new words that only this document has in it\nend"
    assert got[4].text == "first\nsecond" and got[5].text is None and got[5].n_lines == 0 and got[6].text == ""
    assert got[7].text == "" and got[7].n_removed == 3
    assert line_dedup.remove_repeats(frame(spark, rows)).columns == ["doc_id", "text", "_row", "component"]
    assert line_dedup.report(frame(spark, [])).collect() == []


def test_common_lines_meet_their_first_holder_only(spark):
    line = "a license line of more than eight words that all documents have"
    rows = [(k, f"own text number {k}\n{line}") for k in range(80)]
    got = line_dedup.report(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in got if r.n_removed) == list(range(1, 80)) and all(0 in r.partners for r in got if r.n_removed)


def lines_by_brute_force(rows):
    """Lines that go from each document, aligned with every earlier one."""
    import xxhash

    own = []
    for _, t in rows:
        split = (t or "").encode().split(b"\n")
        own.append(([xxhash.xxh3_64_intdigest(x.strip()) >> 1 if x.strip() else 0 for x in split], [len(x.split()) for x in split]))
    return {rows[j][0]: set().union(*(line_dedup.blocks(own[i][0], *own[j]) for i in range(j))) for j in range(len(rows))}


def long_line(k):
    return f"line number {k} " + "with more words than eight in it"


def crossed_lines():
    """Hot lines in other orders than the first holder's, or repeated by it; blocks of short lines."""
    a, b = long_line("a"), long_line("b")
    rows = [(0, f"{a}\n{b}\nthree short words\nfirst"), (1, f"{b}\n{b}\nmiddle\n{b}\nfour very short words")]
    for k in range(2, 60):
        own = long_line(f"of {k} only")
        tail = ["three short words\nfour very short words\ntwo words", "two words", ""][k % 3]
        rows.append((k, "\n".join([f"{a}\n{own}\n{b}", f"{b}\n{own}\n{a}", f"{own}\n{b}\n{tail}\n\n{a}\n{b}", f"{own}\n{tail}"][k % 4 :][:1])))
    return rows


def shuffled_lines(seed, n):
    rng = random.Random(seed)
    pool = [long_line(k) for k in range(5)] + [f"s{k} s s" for k in range(4)] + ["one", "two words", "", "", "four words of five"]
    return [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for k in range(n)]


@pytest.mark.parametrize("rows", [crossed_lines(), shuffled_lines(1, 90), shuffled_lines(2, 90)])
def test_lines_match_brute_force_over_all_pairs(spark, rows):
    want = lines_by_brute_force(rows)
    got = line_dedup.report(frame(spark, rows).repartition(5)).collect()
    for r in got:
        kept = [x for k, x in enumerate(dict(rows)[r.doc_id].split("\n")) if k not in want[r.doc_id]]
        assert (r.text, r.n_removed) == ("\n".join(kept), len(want[r.doc_id])), r.doc_id


def test_lines_on_odd_rows_and_clashing_columns(spark):
    line = long_line("a")
    long = "\n".join(f"{k} filler" for k in range(20_000))
    rows = [(None, f"{line}\nnull id"), (None, f"{line}\nother text"), (3, f"{line}\nlate"), (3, f"{line}\nlate"), (3, f"other with the same id\n{line}"), (1, f"{long}\n{line}"), (2, long)]
    names = ["gone", "partners", "removed_words", "_sig", "_row", "n_lines", "id"]
    df = spark.createDataFrame([(i, t, *"abcdefg") for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = line_dedup.report(df).collect()
    assert Counter((r.doc_id, r.text if len(r.text) < 100 else len(r.text)) for r in got) == Counter([(None, "null id"), (None, "other text"), (3, "late"), (3, "late"), (3, "other with the same id"), (1, len(rows[5][1])), (2, "")])
    assert all((r.gone, r._sig, r._row, r.id) == ("a", "d", "e", "g") for r in got) and {r.n_lines for r in got} == {2, 20_000, 20_001}
    kept = line_dedup.remove_repeats(df)
    assert kept.columns == df.columns and {tuple(r)[2:] for r in kept.collect()} == {tuple("abcdefg")}


def test_common_subsequence(monkeypatch):
    rng = random.Random(5)
    for bits in (1 << 28, 20):
        monkeypatch.setattr(line_dedup, "LCS_BITS", bits)
        for _ in range(100):
            a, b = ([rng.randrange(1, 6) for _ in range(rng.randrange(14))] for _ in "ab")
            got = line_dedup.common(a, b)
            size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
            assert len(got) == size[-1][-1] and all(a[i] == b[j] for i, j in got)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert line_dedup.blocks([1, 2, 1], [3, 1], [9, 9]) == [1]


def vectors(seed, n, width=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, width))
    v = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, width)) * rng.choice([0.02, 0.1, 0.25], (n, 1))
    return v.astype(np.float32), rng.integers(0, 3, n)


VECTORS = "vec_id long, embedding array<float>, label int, node string"


def links(v, label, limit=0.93):
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = (u @ u.T >= limit) & (label[:, None] == label[None, :])
    np.fill_diagonal(s, False)
    return s


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 60, "block": 40}])
def test_forest_against_brute_force(spark, options):
    v, label = vectors(3, 600)
    df = spark.createDataFrame([(i, x.tolist(), int(c), "z") for i, (x, c) in enumerate(zip(v, label))], VECTORS)
    got = {r.vec_id: r for r in vector_forest.link(df, **options).collect()}
    want = links(v, label).sum(1)
    n = np.array([got[i].n_links for i in range(len(v))])
    assert (n <= want).all() and n.sum() >= (1.0 if not options else 0.9) * want.sum() > 0
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    if not options:
        parent = list(range(len(v)))
        for i, j in zip(*np.nonzero(links(v, label))):
            a, b = sorted((i, j))
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        for i in range(len(v)):
            a = i
            while parent[a] != a:
                a = parent[a]
            assert got[i].component_id == a


@pytest.mark.parametrize("depth", [10, 12])
@pytest.mark.parametrize("noise", [0.02, 0.033, 0.05])
def test_forest_recall_does_not_fall_with_depth(depth, noise):
    rng = np.random.default_rng(depth)
    rows = rng.standard_normal((1 << 16, 64))
    group = len(rows) // 3
    rows = vector_forest.unit(rows)
    rows[:group] = rows[0] + noise * rng.standard_normal((group, 64))
    rows = vector_forest.unit(rows)
    some = rows[:1000]
    want = np.triu(some @ some.T >= 0.93, 1)
    met = np.zeros_like(want)
    for t in range(vector_forest.TREES):
        own = vector_forest.leaves(some, vector_forest.fit_tree(rows, depth, t, vector_forest.reach(0.93)), depth, t)
        held = defaultdict(list)
        for k, at in enumerate(own):
            for x in at:
                held[x].append(k)
        for x in held.values():
            met[np.ix_(x, x)] = True
    assert want.sum() > 100
    assert (met & want).sum() >= 0.999 * want.sum()


def test_forest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (13, [1e-30, 0.0], 1)]
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in vector_forest.link(spark.createDataFrame([(*r, "x") for r in rows], VECTORS)).collect())
    want = Counter([(1, 4, 1), (2, 4, 1), (3, 4, 1), (3, 4, 1), (13, 4, 1), (None, 0, None)] + [(k, 0, k) for k in (4, 5, 6, 7, 8, 9, 10, 11, 12)])
    assert got == want
    assert vector_forest.link(spark.createDataFrame([], VECTORS)).collect() == []
