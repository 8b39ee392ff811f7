"""Sequence ratios, whole-text distances, calibration, dense retrieval, citations, leak-free splits and alignment."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions import citations, sequences
from citeloom.operators import calibration, evaluation, labelling, leakage, retrieval, splitting


def distance_by_hand(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_ratio_and_distance_by_definition():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rng.choices(x, k=rng.randint(0, 25))) for x in ("abc", "abcd😀"))
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert sequences.ratio(a, b) == pytest.approx(want)
        assert sequences.ratio(a, b, 0.8) is not None or want < 0.8
        assert sequences.edit_distance(a, b) == distance_by_hand(a, b)


def test_whole_texts_of_a_megabyte_with_a_thousand_edits(spark):
    rng = random.Random(2)
    a = "".join(rng.choices("abcdefgh é", k=1_000_000))
    b = list(a)
    for at in sorted(rng.sample(range(0, 1_000_000, 50), 1000), reverse=True):
        b[at : at + 1] = rng.choice([["x"], ["y", b[at]], []])
    df = spark.createDataFrame([(1, a, "".join(b)), (2, "", ""), (3, "kitten", "sitting"), (4, None, "x")], "doc_id long, a string, b string")
    got = {r.doc_id: r.distance for r in evaluation.edit_distance_norm(df, None).collect()}
    assert got == {1: pytest.approx(1000 / max(len(a), len(b)), abs=2e-8), 2: 0.0, 3: 3 / 7, 4: 0.0}


def test_sequence_similarity_loses_no_pair(spark):
    rng = random.Random(3)
    texts = {i: "".join(rng.choices("ab", k=rng.randint(1, 14))) for i in range(60)}
    pairs = [(i, j) for i in texts for j in texts if i < j]
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {(r.id1, r.id2): r.ratio for r in leakage.sequence_similarity(spark.createDataFrame(pairs, "id1 long, id2 long"), df, 0.8).collect()}
    ratio = lambda i, j: difflib.SequenceMatcher(None, texts[i], texts[j], autojunk=False).ratio()
    assert got == {p: pytest.approx(r) for p in pairs if (r := ratio(*p)) >= 0.8} and got


def fitted_by_hand(points):
    """At each place the greatest of the least means of what begins at or before it and ends at or after it."""
    sums = np.cumsum([(0, 0), *((n, r) for _, n, r in points)], axis=0)
    mean = lambda j, k: (sums[k + 1][1] - sums[j][1]) / (sums[k + 1][0] - sums[j][0])
    return [max(min(mean(j, k) for k in range(i, len(points))) for j in range(i + 1)) for i in range(len(points))]


@pytest.mark.parametrize("seed", [1, 2])
def test_calibration_by_hand(spark, seed):
    rng = random.Random(seed)
    rows = [(c := rng.randint(0, 40) / 40, rng.random() < (c if seed == 1 else 1 - c)) for _ in range(400)] + [(None, True), (0.5, None)]
    points = calibration.reliability(spark.createDataFrame(rows, "confidence double, correct boolean")).cache()
    by = {}
    for c, right in rows[:-2]:
        n, r = by.get(c, (0, 0))
        by[c] = n + 1, r + right
    listed = [(c, *by[c]) for c in sorted(by)]
    blocks = calibration.isotonic(points, parts=6, least=3)
    got = {r.confidence: r.probability for r in calibration.calibrate(points, blocks, parts=4).collect()}
    assert got == {c: pytest.approx(p) for (c, _, _), p in zip(listed, fitted_by_hand(listed))}
    probs = [r.probability for r in blocks.orderBy("low").collect()]
    assert probs == sorted(set(probs))
    curve = {r.confidence: (r.coverage, r.precision) for r in calibration.curve(points, parts=5).collect()}
    for k, (c, _, _) in enumerate(listed):
        n, right = sum(x[1] for x in listed[k:]), sum(x[2] for x in listed[k:])
        assert curve[c] == (pytest.approx(n / 400), pytest.approx(right / n))
    row = calibration.choose_cutoffs(points, 0.8, 0.5, parts=5).first()
    assert row.high == min((c for c in curve if curve[c][1] >= 0.8), default=None)
    assert row.low == min((c for (c, _, _), p in zip(listed, fitted_by_hand(listed)) if p >= 0.5), default=None) or row.low in [b.low for b in blocks.collect()]


def test_calibration_of_unseen_and_no_confidences(spark):
    points = spark.createDataFrame([(0.2, 10, 1), (0.6, 10, 7)], "confidence double, n long, right long")
    asked = spark.createDataFrame([(0.1,), (0.3,), (0.9,)], "confidence double")
    assert sorted((r.confidence, r.probability) for r in calibration.calibrate(asked, calibration.isotonic(points)).collect()) == [(0.1, 0.1), (0.3, 0.1), (0.9, 0.7)]
    none = calibration.reliability(spark.createDataFrame([], "confidence double, correct boolean"))
    assert calibration.isotonic(none).collect() == [] and calibration.curve(none).collect() == []


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + 0.6 * rng.normal(size=12)).tolist(), f"l{i % 6}") for i in range(400)]
    rows += [(500, None, "x"), (501, [0.0] * 12, "x"), (502, [1.0, None] * 6, "x"), (503, [float("nan")] * 12, "x"), (504, rows[0][1], "l0")]
    return spark.createDataFrame(rows, "id long, vector array<double>, label string").cache()


def test_dense_retrieval_reaches_its_recall(spark, vectors):
    unit = retrieval.unit_vectors(vectors).cache()
    assert unit.count() == 401
    centres = retrieval.centroids(unit, lists=8)
    index = retrieval.inverted_file(unit, centres)
    assert index.count() == 401
    queries = unit.where("id % 5 = 0 or id = 504")
    truth = retrieval.exact(queries, unit, 10).cache()
    by = {r.id: np.array(r.vector) for r in unit.collect()}
    for q in (0, 5, 504):
        want = sorted(((-round(float(by[q] @ v), 9), i) for i, v in by.items() if i != q))[:10]
        assert [(r.id, r.rank) for r in truth.where(f"query = {q}").orderBy("rank").collect()] == [(i, k) for k, (_, i) in enumerate(want, 1)]
    probes = retrieval.probes_for(unit, index, centres, least=0.9, sample=100)
    assert probes < 8 and retrieval.recall(retrieval.search(queries, index, centres, 10, probes), truth) >= 0.88
    assert retrieval.recall(retrieval.search(queries, index, centres, 10, 8), truth) == 1.0
    votes = retrieval.vote(truth, vectors.select("id", "label")).join(vectors.select(F.col("id").alias("query"), F.col("label").alias("own")), "query")
    assert votes.where("label = own").count() / votes.count() > 0.8


CITATIONS = {
    "Arist. EN 1098a16": ("Arist", "EN", [("1098a16", "1098a16", False)]),
    "Hom. Il. vi. 208": ("Hom", "Il", [("6.208", "6.208", False)]),
    "Hdt. 8.82-84": ("Hdt", None, [("8.82", "8.84", False)]),
    "Thuc. 1.2, 3.4": ("Thuc", None, [("1.2", "1.2", False), ("3.4", "3.4", False)]),
    "Pl. Rep. 332 D": ("Pl", "Rep", [("332d", "332d", False)]),
    "Liv. III.38 sqq.": ("Liv", None, [("3.38", "3.38", True)]),
    "Ar. Pol. 1252a1–1253b2": ("Ar", "Pol", [("1252a1", "1253b2", False)]),
    "Plut. Sol. 28.3; 30, 31.2": ("Plut", "Sol", [("28.3", "28.3", False), ("28.30", "28.30", False), ("31.2", "31.2", False)]),
    "Cic. 5-": ("Cic", None, [("5", "5", True)]),
    "no place": ("no", "place", []),
    "": (None, None, []),
}


def test_citations_are_read_as_structures(spark):
    df = spark.createDataFrame([(k,) for k in [*CITATIONS, None]], "bibl string")
    got = {r.bibl: r.p for r in df.select("bibl", citations.parsed(F.col("bibl")).alias("p")).collect()}
    assert got.pop(None) is None or got[""] is not None
    assert {k: (p.author, p.work, [tuple(x) for x in p.passages]) for k, p in got.items()} == CITATIONS
    assert all(citations.roman(citations.written(n)) == n for n in range(1, 300)) and citations.roman("iiii") is None


def test_no_abbreviation_or_work_is_in_two_splits(spark):
    rng = random.Random(7)
    rows = [(i, f"a{g}.{rng.randint(0, 3)}" if rng.random() < 0.9 else None, f"w{g}.{rng.randint(0, 3)}" if rng.random() < 0.9 else None) for i, g in enumerate(rng.randint(0, 60) for _ in range(900))]
    out = splitting.leak_free_split(spark.createDataFrame(rows, "id long, abbreviation string, work string"), "abbreviation", "work", (0.7, 0.15, 0.15)).cache()
    assert out.count() == 900
    for c in ("abbreviation", "work"):
        assert out.where(f"{c} is not null").groupBy(c).agg(F.countDistinct("split").alias("n")).where("n <> 1").count() == 0
    assert out.where("split is null").count() == sum(a is None and w is None for _, a, w in rows)
    share = out.where("split = 'train'").count() / 900
    assert 0.6 < share < 0.8


def test_components_of_long_chains_and_stars(spark):
    edges = [(f"n{k:03}", f"n{k + 1:03}") for k in range(150)] + [("s0", f"s{k}") for k in range(1, 50)] + [("x", "x")]
    got = {r.node: r.component for r in splitting.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"n{k:03}": "n000" for k in range(151)} | {f"s{k}": "s0" for k in range(50)} | {"x": "x"}


def test_predictions_of_other_bounds_are_carried_over(spark):
    tokens = spark.createDataFrame([(0, k, 2 * k, 2 * k + 2) for k in range(6)], "doc_id long, pos int, start int, end int")
    coarse = spark.createDataFrame([(0, 0, 4, "B-BIBL"), (0, 4, 8, "I-BIBL"), (0, 8, 11, "B-QUOTE")], "doc_id long, start int, end int, label string")
    labels = lambda p: [r.label for r in labelling.align_predictions(tokens, p).orderBy("pos").collect()]
    assert labels(coarse) == ["B-BIBL", "I-BIBL", "I-BIBL", "I-BIBL", "B-QUOTE", "I-QUOTE"]
    fine = spark.createDataFrame([(0, k, k + 1, "B-BIBL" if k == 2 else "I-BIBL" if k in (3, 4) else "O") for k in range(9)], "doc_id long, start int, end int, label string")
    assert labels(fine) == ["O", "B-BIBL", "I-BIBL", "O", "O", "O"]
