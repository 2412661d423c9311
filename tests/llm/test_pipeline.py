from __future__ import annotations

import re
from collections import Counter, defaultdict


import duckdb
import pytest

import corpus_pipeline
from maskwork.llm import queries

from .test_dedup import brute_components

TABLES = "documents embeddings labels".split()


def test_names_and_numbers():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES] == [str(k) for k in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mixing", "sentencepiece"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, data, name):
    got = queries.QUERIES[name](spark, data)
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = db.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    show = lambda v: repr(round(v, 9)) if isinstance(v, float) else repr(v)
    place = [want.columns.index(c) for c in columns]
    assert Counter(tuple(show(r[c]) for c in columns) for r in got.collect()) == Counter(tuple(show(r[k]) for k in place) for r in want.fetchall())


def test_every_query_runs_over_all_rows(spark, data):
    for name, query in queries.QUERIES.items():
        table = "embeddings" if name.startswith("op6") else "documents"
        assert query(spark, data).count() == spark.read.parquet(f"{data}/{table}.parquet").count(), name


def test_run_against_brute_force(spark, data):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    docs = [d for d in docs if re.search(r"[^\W\d_]", d[1])]
    groups = defaultdict(list)
    for d in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", d[1])].append(d)
    kept = {min(own, key=lambda d: (-len(d[1]), d[0]))[0] for own in groups.values()}
    docs = [d for d in docs if d[0] in kept]
    rep = {d: c for d, _, c in brute_components([d[:2] for d in docs], 5, 80, 100)}
    docs = [d for d in docs if rep[d[0]] == d[0]]
    got = corpus_pipeline.run(spark, data).collect()
    ids = {d[0] for d in docs}
    assert {r.doc_id for r in got} <= ids and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    # the mix: every source's words are its target's, by whole passes
    size = {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", d[1])) for d in docs}
    source = {d[0]: d[2] for d in docs}
    whole, seen = Counter(), Counter()
    for d in ids:
        whole[source[d]] += size[d]
    for r in got:
        seen[r.source] += size[r.doc_id]
    names = sorted(whole)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    open_, total = set(names), sum(whole.values())
    while True:
        left, share = total - sum(3 * whole[s] for s in names if s not in open_), sum(weight[s] for s in open_)
        target = {s: left * weight[s] / share if s in open_ else 3 * whole[s] for s in names}
        over = {s for s in open_ if target[s] > 3 * whole[s]}
        if not over:
            break
        open_ -= over
    longest = max(size.values())
    assert all(target[s] - 1 <= seen[s] <= target[s] + longest for s in names)


ODD = "doc_id long, text string, lang string, source string, n_chars long, ids string, target string, _order string"


def test_stages_on_odd_rows(spark, data):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, "plain english words for a document", "en", None, 1), (3, "plain english words for a document", "en", None, 1), (4, "12 34", "en", "a", 1), (None, "words without an id here", "fr", "a", None), (5, "w " * 9000, "en", "b", 1)]
    df = spark.createDataFrame([(*r, "i", "t", "o") for r in rows], ODD)
    empty = df.limit(0)
    want = {"language_id": [3, 3, None, 5], "exact_dedup": [1, 3, 4, None, 5], "ngram_join": [1, 2, 3, 4, None, 5]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, data)
        got = [r.doc_id for r in out.collect()]
        if name in want:
            assert Counter(got) == Counter(want[name]), name
        if name != "sentencepiece":
            assert out.columns == df.columns and {r.target for r in out.collect()} <= {"t"}
        else:
            assert len(got) == len(rows)
        assert stage(spark, empty, data).collect() == []


