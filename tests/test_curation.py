"""Readers, unit tables, rules and joins on small hand-made inputs."""

import json
import random
import math

import pytest
from pyspark.sql import functions as F

from trialframe.functions import text as X
from trialframe.functions import units as U
from trialframe.operators import corpus as C
from trialframe.operators import joins as J
from trialframe.operators import records as D
from trialframe.operators import rules as L
from trialframe.operators import vocabulary as V
from trialframe.sources import readers as S
from trialframe.sources import writers as W


def _one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expr.alias("r")).first().r


@pytest.mark.parametrize(
    "text, want",
    [("5 % w/w", 5.0), ("about 2.5wt%", 2.5), ("50 mg/g", 5.0), ("50 mg / g", 5.0), ("5 g/100 g", 5.0), ("5 g per 100 g", 5.0), ("none", None), (None, None)],
)
def test_parse_concentration(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(U.parse_concentration("t").alias("r")).first().r
    assert got == want or math.isclose(got, want)


@pytest.mark.parametrize(
    "value, unit, area, kind, mode, want",
    [
        (2.0, "µg/cm²", None, "amount_per_area", "strict", 2.0), (2.0, "μg / cm^2", None, "amount_per_area", "strict", 2.0),
        (2.0, "mg/cm2", None, "amount_per_area", "strict", 2000.0), (2.0, "ng/cm2", None, "amount_per_area", "strict", 0.002),
        (1.0, "µg·cm⁻²·h⁻¹", None, "amount_per_area", "strict", None), (1.0, "mg/cm2 per h", None, "amount_per_area", "strict", None),
        (1.0, "ug/cm2h", None, "amount_per_area", "strict", None), (1.0, "ug/cm2/hr-1", None, "amount_per_area", "strict", None),
        (1.0, "µg·cm⁻²", None, "amount_per_area", "strict", 1.0), (1.0, "mg per cm2", None, "amount_per_area", "strict", 1000.0),
        (2.0, "mg/cm2/h", None, "amount_per_area", "strict", None), (2.0, "mg/cm2/h", None, "amount_per_area", "loose", 2000.0),
        (6.0, "mg", 3.0, "amount_total", "strict", 2000.0), (6.0, "mg", None, "amount_total", "strict", None),
        (6.0, "mg", 0.0, "amount_total", "strict", None), (6.0, "%", 3.0, "percent", "strict", None),
    ],
)
def test_amounts(spark, value, unit, area, kind, mode, want):
    df = spark.createDataFrame([(value, unit, area, kind)], "v double, u string, a double, k string")
    got = df.select(U.amount_to_ug_cm2("v", "u", "a", "k", mode).alias("r")).first().r
    assert got == want or math.isclose(got, want)


def test_times_balance_and_targets(spark):
    df = spark.createDataFrame([(90.0, " Min "), (2.0, "HRS"), (1.0, "day")], "v double, u string")
    assert [r[0] for r in df.select(U.time_to_hours("v", "u")).collect()] == [1.5, 2.0, None]
    texts = spark.createDataFrame([("q.s. to 100%",), ("qs",), ("Balance",), ("make up to 100",), ("5%",)], "t string")
    assert [r[0] for r in texts.select(U.is_balance("t")).collect()] == [True, True, True, True, False]
    ans = spark.createDataFrame([("50 mg/g", None, "", ""), ("", 5.1, "%", "w/w"), ("", 7.0, "%", "w/w"), ("x", None, "", "")], "r string, v double, u string, b string")
    assert [r[0] for r in ans.select(U.target_answer("r", "v", "u", "b")).collect()] == ["yes", "yes", "no", "uncertain"]


def test_text_keys(spark):
    assert _one(spark, X.norm_ws("t"), t=" a \n b\t") == "a b"
    assert _one(spark, X.safe_filename("t"), t=" HTTPS://x.org/A b?c ") == "x.org_a_b_c"
    assert _one(spark, X.safe_filename("t"), t="???") == "unknown"
    assert _one(spark, X.norm_label("t"), t="Formulation Gel F-1") == "f1"
    assert _one(spark, X.id_tokens("t"), t="f1 / Gel 2, B, formulation C") == ["F1", "B", "C", "GEL2", "FORMULATIONC"]
    assert _one(spark, X.anchor_pages("t"), t="Page 3, p. 2 and page3; p0") == [1, 2]
    assert _one(spark, X.table_hint("t"), t="see Table 4b") == "Table 4"
    assert _one(spark, X.keyword_score("t", X.PAGE_KEYWORDS, X.PAGE_STRONG), t="Franz cell, Table 1") == 6
    f = spark.range(1).select(*[c.alias(n) for n, c in X.expr_features(F.lit("add(mul(Q, 1.5), sub(ARG2, -2.0e-3))")).items()]).first()
    assert (f.operator_calls, f.constants, f.variables) == (3, 2, ["Q", "C2"])


def test_python_literals_parse(spark):
    df = spark.createDataFrame([("{'a': None, 'b': True}",), ('{"a": "x", "b": false}',), ("nan",), ("{broken",)], "t string")
    got = [r.v for r in df.select(X.safe_parse("t", "a string, b boolean").alias("v")).collect()]
    assert (got[0].a, got[0].b) == (None, True) and (got[1].a, got[1].b) == ("x", False) and got[2] is None
    assert got[3] is None or (got[3].a is None and got[3].b is None)


def test_empty_doi_policies(spark):
    df = spark.createDataFrame(
        [(1, "", "t1", 2001), (2, "", "t2", 2002), (3, "d", "t3", 2003), (4, "d", "t4", None), (5, None, "t1", 2001)],
        "id long, doi string, title string, year int",
    )
    assert sorted(r.id for r in C.dedupe_corpus(df).collect()) == [1, 2, 3]
    assert sorted(r.id for r in C.dedupe_corpus(df, empty_is_key=True).collect()) == [1, 3]


def test_pending_retries_failures(spark):
    todo = spark.createDataFrame([(" A ",), ("b",), ("c",), (None,)], "doi string")
    done = spark.createDataFrame([("a", ""), ("B", "timeout")], "doi string, error string")
    left = C.pending(todo, done, {"doi": X.norm_key("doi")}, error="error")
    assert sorted(str(r.doi) for r in left.collect()) == ["None", "b", "c"]


def test_pages_fall_back_to_the_first_three(spark):
    df = spark.createDataFrame([("d", i, "nothing here") for i in range(5)], "doc string, page int, text string")
    r = C.select_pages(df, ["doc"], "page", "text", first=0).first()
    assert r.pages == 3 and "PAGE 3" in r.text and "PAGE 4" not in r.text


def test_neighbours_are_clipped(spark):
    df = spark.createDataFrame([("d", 0, 3), ("d", 2, 3), ("e", 9, 3)], "doc string, page int, n int")
    assert sorted(C.expand_neighbours(df, ["doc"], "page", "n").select("page").toPandas().page) == [0, 1, 2]


def test_join_checked_names_lost_keys(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(J.LostRows, match="2"):
        J.join_checked(a, b, ["k"])
    assert J.join_checked(a.filter("k = 1"), b, ["k"]).columns == ["k", "v"]


def test_label_matching_rules(spark):
    curves = spark.createDataFrame([("p", "Gel alpha"), ("p", "curve F2"), ("p", "alphabet soup"), ("p", "zzz"), ("q", "x")], "k string, c string")
    labels = spark.createDataFrame([("p", "alpha formulation", 1), ("p", "F2 cream", 2), ("p", "gel", 3)], "k string, l string, o int")
    got = {r.c: (r.mapped_label, r.status) for r in J.match_labels(curves, labels, ["k"], "c", "l", "o").collect()}
    assert got["Gel alpha"] == ("alpha formulation", "exact_norm_match")
    assert got["curve F2"] == ("F2 cream", "token_match")
    assert got["alphabet soup"] == ("alpha formulation", "substring_norm_match")
    assert got["zzz"] == (None, "unmapped") and got["x"] == (None, "no_formulations")


def _curves(spark, items):
    return spark.createDataFrame([(c, i, float(v)) for c, vs in items.items() for i, v in enumerate(vs)], "c string, p int, v double")


def _matched(spark, pred, canon, **how):
    return {r.pred_curve: r.canon_curve for r in J.match_curve_sets(_curves(spark, pred), _curves(spark, canon), "c", "p", "v", **how).collect()}


def test_curve_matching_with_copies(spark):
    canon = {"A": [0, 1, 2], "B": [0, 1, 2.5], "A2": [0, 1, 2]}
    pred = {"x": [0, 1, 2.000001], "y": [0, 1, 2.5], "z": [0, 1, 9], "x2": [0, 1, 2.000001], "x3": [0, 1, 2.000001]}
    assert _matched(spark, pred, canon) == {"x": "A", "x2": "A2", "x3": None, "y": "B", "z": None}


def test_a_curve_whose_closest_reference_is_taken_gets_the_next_one(spark):
    assert _matched(spark, {"x": [0, 1], "y": [0, 1.000004]}, {"A": [0, 1], "B": [0, 1.000009]}) == {"x": "A", "y": "B"}


@pytest.mark.parametrize("closest", [False, True])
def test_curve_matching_one_by_one(spark, closest):
    """Crowded curves, with copies on both sides, against serving them one after the other."""
    rng = random.Random(3)
    level = lambda: rng.randint(0, 40) / 4e6
    canon = {f"c{i:02d}": [1, 2 + level()] for i in range(25)} | {f"d{i}": [1, 2.5] for i in range(3)}
    pred = {f"p{i:02d}": [1, 2 + level()] for i in range(30)} | {f"q{i}": [1, 2.5 + rng.choice([0, 1e-6])] for i in range(5)}
    gap = lambda p, c: max(abs(x - y) for x, y in zip(pred[p], canon[c], strict=True))
    head = lambda c: min(k for k in canon if canon[k] == canon[c])
    open_pairs = sorted((((gap(p, c), p) if closest else (p, gap(p, c))), head(c), c, p) for p in pred for c in canon if gap(p, c) <= 1e-5)
    want = dict.fromkeys(pred)
    for _, _, c, p in open_pairs:
        if want[p] is None and c not in want.values():
            want[p] = c
    assert _matched(spark, pred, canon, closest=closest) == want
    assert _matched(spark, pred, canon, closest=closest, cap=4) == want


def test_curve_set_verdict(spark):
    canon = {"A": [0, 1, 2], "B": [0, 1, 2.5]}
    def verdict(pred):
        a, b = _curves(spark, pred), _curves(spark, canon)
        r = J.curve_set_verdict(a, b, J.match_curve_sets(a, b, "c", "p", "v"), "c", "p", "v").first()
        return r.curve_set_matches, r.same_sequence, r.n_matched
    assert verdict({"x": [0, 1, 2], "y": [0, 1, 2.500001]}) == (True, True, 2)
    assert verdict({"x": [0, 1, 2.5], "y": [0, 1, 2]}) == (True, False, 2)
    assert verdict({"x": [0, 1, 2]}) == (False, False, 1)


def test_curve_set_verdict_of_more_points_than_a_task_takes(spark):
    canon = {"A": [0, 1, 2], "B": [0, 1, 2.5]}
    a, b = _curves(spark, canon), _curves(spark, canon | {"C": [7, 8, 9.5]})
    for pred, want in ((a, (True, 0.0)), (b, (False, 0.0))):
        r = J.curve_set_verdict(pred, a, J.match_curve_sets(pred, a, "c", "p", "v"), "c", "p", "v", cap=2).first()
        assert (r.same_sequence, r.sequence_max_abs_diff) == want


def test_leakage_and_completeness(spark):
    a = spark.createDataFrame([("r1", 0.1), ("r2", 0.2)], "run string, x double")
    b = spark.createDataFrame([("r2", 0.3), ("r3", 0.1 + 1e-12)], "run string, x double")
    assert {(r.kind, r.value) for r in J.leakage_check(a, b, "run", ["x"]).collect()} == {("run", "r2"), ("condition", "0.1")}
    ing = spark.createDataFrame([("a", "Ethanol", True), ("a", "odd", False), ("b", " PG ", False), ("c", "odd", False)], "r string, n string, ok boolean")
    assert {r.r: r.completeness for r in V.completeness_class(ing, ["r"], "n", F.col("ok")).collect()} == {"a": "A", "b": "B", "c": "A"}


def test_components_rule(spark):
    df = spark.createDataFrame(
        [
            (5.0, "% w/w", "", None), (None, "", "", json.dumps([{"name_raw": "Ibuprofen", "concentration_value": 5, "concentration_unit": "%"}])),
            (None, "", "", "[{'name_raw': 'IBU', 'concentration_value': None, 'concentration_unit': 'mg/g', 'remark': '50 mg/g'}]"),
            (7.0, "mg", "", "[]"),
        ],
        "api_concentration_value double, api_concentration_unit string, api_basis string, components_json string",
    )
    got = [(r.pct_inferred, r.evidence_inferred[:10], r.confirmed) for r in L.api_from_components(df).collect()]
    assert got[0] == (5.0, "from_api_f", True) and got[1] == (5.0, "Ibuprofen:", True)
    assert got[2] == (5.0, "IBU: IBU m", True) and got[3] == (None, "", False)


def test_merge_keeps_text_first(spark):
    text = spark.createDataFrame([(1, "d", "L", "amount", 6.0, 3.0)], "id int, doi string, formulation_label string, endpoint_kind string, endpoint_time_h double, endpoint_value double")
    fig = spark.createDataFrame([(2, "d", "L", "amount", 6.0, 3.0, True), (3, "d", "M", "amount", 6.0, 3.0, False), (4, "d", "N", "amount", 6.0, 3.0, True)],
                                "id int, doi string, formulation_label string, endpoint_kind string, endpoint_time double, endpoint_value_ug_per_cm2 double, ok boolean")
    got = {(r.id, r.source) for r in D.merge_sources(text, fig, ["id"], "ok").collect()}
    assert got == {(1, "text"), (4, "figure")}


# ---- sources and sinks ---------------------------------------------------------------------------
def test_search_dump(spark, tmp_path):
    hit = {"id": "1", "doi": "10.1/x", "title": "T", "pubYear": "20x1", "doiUrl": "", "pmidUrl": None, "fullTextUrlList": {"fullTextUrl": [{"url": "http://f"}]}}
    (tmp_path / "a.json").write_text(json.dumps({"query": "q", "resultList": {"result": [hit, {**hit, "id": "2", "doiUrl": "http://d", "pubYear": "1999"}]}}))
    (tmp_path / "b.json").write_text(json.dumps({"query": "q2", "resultList": {"result": []}}))
    got = {r.id: (r.url, r.year, r.query_used) for r in S.read_search_dump(spark, str(tmp_path)).collect()}
    assert got == {"1": ("http://f", None, "q"), "2": ("http://d", 1999, "q")}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [64, 1000, None])
def test_csv_in_byte_ranges(spark, tmp_path, split, end):
    """Ranges far smaller than a record, quotes and line breaks everywhere: the rows of a reader that takes the file whole."""
    import csv

    rng = random.Random(split or 1)
    bits = ["a", "\n", "\n\n", '"', ",", " ", "x" * 40, "é", "\\", "\n,\n", '""']
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) + "z", rng.choice(["", "1.5", "bad"])) for i in range(120)]
    for name, part in (("a.csv", rows[:100]), ("b.csv", rows[100:]), ("c.csv", [])):
        with open(tmp_path / name, "w", newline="", encoding="utf-8-sig") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerows([("id", "note\nof two lines", "v"), *part])
    got = S.read_records_csv(spark, str(tmp_path), "id int, note string, v double", split)
    assert sorted(map(tuple, got.collect())) == [(i, t, float(v) if v == "1.5" else None) for i, t, v in rows]
    if split:
        assert S._csv_lines(spark, str(tmp_path), split).select("file", "block").distinct().count() > 4


def test_csv_with_mark_and_line_breaks(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(b'\xef\xbb\xbfdoi,note,v\r\n10.1/x,"two\nlines, ""q""",1.5\r\n,,\r\n')
    rows = S.read_records_csv(spark, str(tmp_path / "r.csv"), "doi string, note string, v double").orderBy(F.asc_nulls_last("doi")).collect()
    assert rows[0].doi == "10.1/x" and rows[0].note.replace("\r", "") == 'two\nlines, "q"' and rows[0].v == 1.5
    assert len(rows) == 2 and rows[1].doi is None


def test_extraction_lines(spark, tmp_path):
    good = {"doi": "d", "title": "t", "records": [{"study_type": "IVPT", "endpoint_main": {"value": 3.5, "unit": "ug"}}, {"study_type": "IVRT"}]}
    (tmp_path / "x.jsonl").write_text(json.dumps(good) + "\n{bad line\n" + json.dumps({"doi": "e", "records": []}) + "\n")
    papers = S.read_extraction_jsonl(spark, str(tmp_path / "x.jsonl"))
    assert papers.count() == 2
    flat = D.flatten_records(papers, ["doi"]).select("doi", "record_idx", "study_type", "endpoint_main.value").collect()
    assert [tuple(r) for r in flat] == [("d", 1, "IVPT", 3.5), ("d", 2, "IVRT", None)]


def test_experiment_pair(spark):
    f = spark.createDataFrame([("R1", 20.0, 10.0), ("R2", 21.0, 11.0)], ["Run No", "Poloxamer 407 (%)", "Ethanol"])
    r = spark.createDataFrame([("R1", 3.0, 1.0, 2.0)], ["run no", "R_t10", "R_t1", "R_t2"])
    got = S.read_experiment_pair(f, r, {"run_no": ["Run No"], "c1": ["poloxamer"], "c2": ["ethanol"]})
    assert got.columns == ["run_no", "c1", "c2", "R_t1", "R_t2", "R_t10"] and [tuple(x) for x in got.collect()] == [("R1", 20.0, 10.0, 1.0, 2.0, 3.0)]


def test_routed_and_status_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "pass"), (2, "fail"), (3, "pass")], "id int, route string")
    W.write_routed(df, "route", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/route=pass")).count() == 2
    for _ in range(2):
        W.status_append(df.select("id"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6


def test_ensure_columns_and_combined_order(spark):
    df = D.ensure_columns(spark.range(1), {"id": F.lit(9), "x": F.lit("d")})
    assert [tuple(r) for r in df.collect()] == [(0, "d")]
    a, b = spark.createDataFrame([("z", 1)], "m string, i int"), spark.createDataFrame([("y", 2), ("other", 0)], "m string, i int")
    assert [r.m for r in S.combine_parts([a, b], {"m": ["z", "y"]}, ["m", "i"]).collect()] == ["z", "y", "other"]


def test_curves_match_one_to_one_with_repeated_points(spark):
    from trialframe.operators import joins as J

    curve = lambda name, values: [(name, i, v) for i, v in enumerate(values)]
    canon = spark.createDataFrame(curve("c1", [1.0, 2.0]) + curve("c2", [1.0, 2.0]) + curve("c3", [5.0, 6.0]) + curve("c3", [5.0, 6.0]), "k string, i int, v double")
    pred = curve("p1", [1.0, 2.0]) + curve("p2", [1.0, 2.0]) + curve("p3", [1.0, 2.0]) + curve("p4", [5.000001, 6.0]) + curve("p5", [5.1, 6.0]) + curve("p4", [5.000001, 6.0])
    got = {r.pred_curve: r.canon_curve for r in J.match_curve_sets(spark.createDataFrame(pred, "k string, i int, v double"), canon, "k", "i", "v").collect()}
    assert got == {"p1": "c1", "p2": "c2", "p3": None, "p4": "c3", "p5": None}
    a = spark.createDataFrame([("x", 0), ("y", 1)], "id string, pos int")
    b = spark.createDataFrame([("y", 0), ("x", 1)], "id string, pos int")
    same = lambda p, q: spark.range(1).select(J.same_order(p, q, "id", "pos").alias("s")).first().s
    assert same(a, a) and not same(a, b) and not same(a, a.limit(1))


def test_written_tables_can_be_released(spark):
    import os

    from trialframe.plans.stage import staged
    from trialframe.session import _written, release, shared_dir

    kept = list(_written)
    _written.clear()
    staged(spark.range(3), "released")
    path = _written[0]
    assert path.startswith(shared_dir(spark)) and os.path.isdir(path)
    assert release(spark) == 1 and not os.path.exists(path)
    _written.extend(kept)


def test_labels_inside_each_other_against_all_pairs(spark):
    import random

    from trialframe.functions.text import norm_label
    from trialframe.operators import joins as J

    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abc") for _ in range(n))
    labels = [("k", text(rng.randint(1, 14)), i) for i in range(25)]
    curves = [("k", text(rng.randint(1, 18))) for _ in range(120)] + [("other", "abc"), ("k", "")]
    lab = spark.createDataFrame(labels, "k string, label string, o int")
    cur = spark.createDataFrame(curves, "k string, curve string").distinct()
    forms = {r.label: r.n for r in lab.select("label", norm_label("label").alias("n")).collect()}
    got = {(r.k, r.curve): (r.status, r.mapped_label) for r in J.match_labels(cur, lab, ["k"], "curve", "label", "o").collect()}
    for (k, c), (status, mapped) in got.items():
        if status in ("exact_norm_match", "token_match", "no_formulations"):
            continue
        inside = [(o, name) for _, name, o in labels if k == "k" and c and forms[name] and (c in forms[name] or forms[name] in c)]
        assert (status, mapped) == (("substring_norm_match", min(inside)[1]) if inside else ("unmapped", None)), c
    assert {s for s, _ in got.values()} >= {"substring_norm_match", "unmapped", "no_formulations"}
