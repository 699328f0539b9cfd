"""The registered queries and the pipeline, stage by stage, over the test tables."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.compare import check, connect
from trialframe.llm import ORACLES, QUERIES, mixing, quality
from trialframe.llm.common import table

from . import helpers as H


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_matches_sql(spark, sf_dir, name):
    _, problem = check(spark, connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
    assert problem is None, problem


def test_each_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    field = quality.train_lines(docs, table(spark, sf_dir, "labels"))
    plain = [tuple(r) for r in docs.collect()]
    want = [r for r in plain if quality.verdict(r[1] or "", field, quality.MIN_CONTENT_SHARE)["kept"]]
    stages = dict(corpus_pipeline.STAGES)
    frame = lambda rows: spark.createDataFrame(rows, docs.schema).repartition(4)
    got = lambda name, rows: Counter(tuple(r) for r in stages[name](spark, frame(rows), sf_dir).collect())
    assert Counter(tuple(r) for r in stages["quality_rules"](spark, docs, sf_dir).collect()) == Counter(want)
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    kept = {r[0] for r in want}
    clean = [r[0] for r in plain if labels.get(r[0]) == 1 and not quality.base_rules(r[1] or "")["base_failed"]]
    junk = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean) and sum(i in kept for i in junk) <= 0.1 * len(junk)

    groups = defaultdict(list)
    for r in want:
        groups[H.bare(r[1])].append(r)
    best = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]
    assert got("exact_dedup", want) == Counter(best)

    best.sort()
    near = [best[i] for i, g in enumerate(H.near_groups([r[1] for r in best])) if g == i]
    assert got("near_dedup", best) == Counter(near)

    mixed = got("source_mix", near)
    assert set(mixed) == set(near)
    cost, used = Counter(), Counter()
    for r, n in mixed.items():
        cost[r[3]] += max(1, len(H.words(r[1])))
        used[r[3]] += n * max(1, len(H.words(r[1])))
    rates = [used[s] / cost[s] for s in cost]
    longest = max(len(H.words(r[1])) for r in near)
    assert all(used[s] >= cost[s] for s in cost) and max(used[s] - 1.5 * min(rates) * cost[s] for s in cost) <= longest
    pieces = stages["packing"](spark, frame(near), sf_dir).collect()
    lengths = Counter()
    for p in pieces:
        lengths[p.doc_id] += p.length
    assert lengths == {p.doc_id: p.doc_tokens for p in pieces} and set(lengths) == {r[0] for r in near}


def test_run_is_its_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert mixing.SEED == 17


def test_stages_of_awkward_rows(spark, sf_dir):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [r[:5] for r in H.awkward_rows()]
    for data in (rows, []):
        docs = spark.createDataFrame(data, names)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "packing" or out.columns == docs.columns
            out.count()
