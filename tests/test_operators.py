"""Golden cases of the annotation operators."""

import os

import pytest
from pyspark.sql import functions as F

from citeloom.functions import labels as L, markup, urn
from citeloom.sources import readers
from citeloom.operators import evaluation, labelling, leakage, lexing, profiling, resolution, splitting, structure, tokens as T, wellformed

TYPES = {"bibl": "BIBL", "quote": "QUOTE", "cit": "CIT"}


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def spans(df):
    return sorted((r.doc_id, r.start, r.end, r.type, r.attrs) for r in df.collect())


def test_spans_nested_empty_unbalanced_and_upper_case(spark):
    df = texts(spark, "<p>See <bibl>Hom. 1.1</bibl> there.</p>", '<p><cit n="1"><bibl>Hdt. 8</bibl><quote>some</quote></cit></p>', "<bibl/>x</bibl><BIBL>é😀</BIBL><bibl>open", None, "")
    text, found = lexing.strip_with_spans(df, TYPES)
    assert spans(found) == [(0, 7, 15, "BIBL", ""), (1, 3, 9, "BIBL", ""), (1, 3, 13, "CIT", ' n="1"'), (1, 9, 13, "QUOTE", ""), (2, 0, 0, "BIBL", ""), (2, 1, 3, "BIBL", "")]
    got = {r.doc_id: r.text for r in text.collect()}
    assert got == {0: "<p>See Hom. 1.1 there.</p>", 1: "<p>Hdt. 8some</p>", 2: "xé😀open"}


def test_rendering_spans_gives_the_source_back(spark):
    source = '<p>a <cit n="1"><bibl>b</bibl> <quote>c</quote></cit> d<bibl></bibl></p>'
    text, found = lexing.strip_with_spans(texts(spark, source, "no tag"), TYPES)
    assert {r.doc_id: r.text for r in labelling.render(text, found).collect()} == {0: source, 1: "no tag"}


def test_names_are_exact(spark):
    df = texts(spark, '<biblScope>x</biblScope><bibl n="1">y</bibl>')
    assert df.select(markup.strip_tags(F.col("text"))).first()[0] == "<biblScope>x</biblScope>y"
    assert df.select(markup.extract_citations(F.col("text")).alias("x")).first()["x"]["bibl"] == ["y"]


def test_labels_after_markers(spark):
    df = texts(spark, "[CIT_START] a [BIBL_START] b c [BIBL_END] d [QUOTE_START] e")
    rows = labelling.bio_labels(T.tokenize_with_offsets(df, T.MARKED)).orderBy("pos").collect()
    assert [r.label for r in rows] == ["", "B-CIT", "", "B-BIBL", "I-BIBL", "", "O", "", "B-QUOTE"]
    kept = labelling.drop_markers(labelling.bio_labels(T.tokenize_with_offsets(df, T.MARKED))).orderBy("pos").collect()
    assert [(r.pos, r.label) for r in kept] == [(0, "B-CIT"), (1, "B-BIBL"), (2, "I-BIBL"), (3, "O"), (4, "B-QUOTE")]


@pytest.mark.parametrize("n,size,stride", [(1, 8, 4), (8, 8, 4), (9, 8, 4), (37, 8, 4), (40, 9, 3), (12, 4, 4)])
def test_each_token_has_one_owner_that_holds_it(spark, n, size, stride):
    tokens = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("pos"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"))
    owned = T.reliable_center(tokens, size, stride).select("pos", "owner")
    windows = T.sliding_windows(tokens, size, stride).select("pos", F.col("window_idx").alias("owner"))
    assert owned.join(windows, ["pos", "owner"]).count() == n
    assert sorted(r.window_idx for r in T.sliding_windows(tokens, size, stride).select("window_idx").distinct().collect()) == list(range(-(-n // stride)))


def labelled(spark, *labels):
    return spark.createDataFrame([(0, i, 2 * i, 2 * i + 1, x) for i, x in enumerate(labels)], "doc_id long, pos int, start int, end int, label string")


def test_decoders_differ_on_a_changed_type(spark):
    df = labelled(spark, "I-BIBL", "I-QUOTE", "O", "B-CIT", "B-CIT")
    got = lambda mode: sorted((r.start, r.end, r.type) for r in labelling.decode_entities(df, mode).collect())
    assert got("insert") == [(0, 3, "BIBL"), (6, 7, "CIT"), (8, 9, "CIT")]
    assert got("chunk") == [(0, 1, "BIBL"), (2, 3, "QUOTE"), (6, 7, "CIT"), (8, 9, "CIT")]


def test_existing_spans_win(spark):
    df = labelled(spark, "B-BIBL", "I-BIBL", "I-BIBL", "O", "B-QUOTE")
    existing = spark.createDataFrame([(0, 0, 1, "BIBL")], "doc_id long, start int, end int, type string")
    assert [r.label for r in labelling.resolve_against_existing(df, existing).orderBy("pos").collect()] == ["O", "O", "O", "O", "B-QUOTE"]


def test_merge_wrap_and_crossing(spark):
    docs = texts(spark, "aa bb cc dd")
    df = spark.createDataFrame([(0, 0, 2, "BIBL", " n='1'"), (0, 3, 5, "BIBL", ""), (0, 6, 8, "QUOTE", ""), (0, 7, 11, "CIT", "")], "doc_id long, start int, end int, type string, attrs string")
    assert (0, 7, 11, "CIT", "") not in spans(structure.drop_crossing(df))
    out = spans(structure.post_process(docs, df))
    assert out == [(0, 0, 5, "BIBL", " n='1'"), (0, 0, 8, "CIT", ""), (0, 6, 8, "QUOTE", "")]


def test_snap_keeps_a_span_that_ends_before_a_tag(spark):
    docs = texts(spark, "ab<i>cd</i>")
    df = spark.createDataFrame([(0, 0, 2, "A"), (0, 3, 7, "B"), (0, 0, 4, "C"), (0, 3, 4, "D")], "doc_id long, start int, end int, type string")
    assert sorted((r.start, r.end, r.type) for r in lexing.snap_spans(df, docs).collect()) == [(0, 2, "A"), (0, 2, "C"), (5, 7, "B")]


def test_trim(spark):
    df = spark.createDataFrame([("  a b \n", 0, 7), ("   ", 0, 3), ("ab", 0, 2)], "text string, start int, end int")
    args = (F.col("text"), F.col("start"), F.col("end"))
    got = df.select(markup.trimmed_start(*args).alias("s"), markup.trimmed_end(*args).alias("e")).collect()
    assert [(r.s, r.e) for r in got] == [(2, 5), (3, 3), (0, 2)]


def predictors():
    """One that begins a citation at each capital, and one whose entities run over whatever stands between."""
    import re

    capitals = lambda: lambda windows: [["B-BIBL" if re.match(r"\s*[A-Z]", t) else "O" for t in w] for w in windows]
    whole = lambda: lambda windows: [["B-BIBL"] + ["I-BIBL"] * (len(w) - 1) for w in windows]
    return capitals, whole


capitals, whole = predictors()


def test_tag_corpus_stays_out_of_markup(spark):
    from citeloom.plans import binding

    declared = '<?xml version="1.0" encoding="UTF-8"?><!-- A Comment --><p class="Foo">Bar baz</p>'
    df = texts(spark, declared, "<p>Foo <i>Bar</i> one</p><p>two <b>Il.</p> three</b>", "<i>a</i> b <i>c</i>")
    got = {r.doc_id: r.text for r in structure.tag_corpus(df, capitals, TYPES, True, 8, 4).collect()}
    assert got[0] == declared.replace(">Bar baz", "><bibl>Bar</bibl> baz")
    assert got[1] == "<p><bibl>Foo</bibl> <i><bibl>Bar</bibl></i> one</p><p>two <b><bibl>Il</bibl>.</p> three</b>"
    got = {r.doc_id: r.text for r in structure.tag_corpus(df, whole, TYPES, True, 64, 64).collect()}
    assert got[1] == df.where("doc_id = 1").first().text and got[2] == "<i>a</i> b <i>c</i>"
    got = {r.doc_id: r.text for r in structure.tag_corpus(texts(spark, "x <i>c</i> d"), whole, TYPES, True, 64, 64).collect()}
    assert got[0] == "<bibl>x <i>c</i> d</bibl>"
    if os.path.isdir("/root/testdata/sf0.001"):
        pages = binding.pages(spark, "/root/testdata/sf0.001")
        tagged = structure.tag_corpus(pages, capitals, binding.ADJACENT, True, 128, 64)
        nested = "<[^<>]*<[A-Za-z/]"
        count = lambda d: d.select(F.sum(F.regexp_count("text", F.lit(nested)))).first()[0]
        assert tagged.count() == pages.count() and count(tagged) <= count(pages)
        one, two = ({r.doc_id: r.balanced for r in wellformed.parse_status(d).collect()} for d in (pages, tagged))
        assert one == two


def test_predictors_get_whole_windows(spark):
    seen = lambda: lambda ws: [[str(len(w))] * len(w) for w in ws]
    df = texts(spark, " ".join(f"t{i}" for i in range(2500)), "a b", "")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = labelling.label_windows(T.windows(df, 16, 8), seen, 16).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.doc_id, r.window_idx, r.label) for r in rows} == {(0, i, str(min(16, 2500 - 8 * i))) for i in range(313)} | {(1, 0, "2")}
    with pytest.raises(Exception, match="each token"):
        labelling.label_windows(T.windows(df, 16, 8), lambda: lambda ws: [["O"] for w in ws], 16).collect()


def test_no_shuffle_before_tokens_and_events(spark):
    df = texts(spark, "a <b>c</b>")
    windows = T.sliding_windows(T.tokenize_with_offsets(df, counted=True), 8, 4).withColumn("label", F.lit("O"))
    for plan in (T.tokenize_with_offsets(df), lexing.markup_events(df), lexing.without_tags(df, ["b"]), T.window_text(T.windows(df, 8, 4)), T.merge_window_labels(windows, 8, 4)):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_offsets_of_long_texts(spark):
    words = ["x" * (i % 7 + 1) for i in range(40_000)]
    got = T.tokenize_with_offsets(texts(spark, " ".join(words))).orderBy("pos").select("start", "end").collect()
    at = 0
    for word, row in zip(words, got):
        assert (row.start, row.end) == (at, at + len(word) + (at > 0))
        at = row.end


def test_tag_corpus_keeps_text(spark):
    df = texts(spark, "<p>Hom said <quote>x y</quote> at Hdt</p>", "", "plain Text")
    predictor = capitals
    got = {r.doc_id: r.text for r in structure.tag_corpus(df, predictor, TYPES, True, 8, 4).collect()}
    assert got[0] == "<p><bibl>Hom</bibl> said <quote>x y</quote> at <bibl>Hdt</bibl></p>" and got[2] == "plain <bibl>Text</bibl>"


def test_over_long_windows_are_an_error(spark):
    with pytest.raises(Exception, match="more than 3 tokens"):
        labelling.label_windows(T.windows(texts(spark, "a b c d e"), 5, 5), capitals, 3).collect()


def test_profile(spark):
    df = texts(spark, "<bibl>a</bibl><quote>b</quote>" * 3, "<bibl>a</bibl>", "none")
    row = profiling.corpus_profile(profiling.tag_counts(df), min_tags=2).first()
    assert (row.n_included, row.n_excluded, row.tags_total, row.bibl_share_mean) == (1, 2, 6, 0.5)
    status = {r.doc_id: r.balanced for r in wellformed.parse_status(texts(spark, "<b>x</b>", "<b>x", "</b><b>", "")).collect()}
    assert status == {0: True, 1: False, 2: False, 3: True}


def test_splits_keep_groups_together(spark):
    df = spark.range(600).select("id", F.concat(F.lit("g"), F.col("id") % 60).alias("g"))
    out = splitting.group_split(df, "g", (0.7, 0.15, 0.15))
    assert out.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n <> 1").count() == 0
    assert {r.split: r.n for r in splitting.split_report(out).collect()} == {"train": 420, "val": 90, "test": 90}
    folds = splitting.kfold(df, "g", 4).groupBy("fold").agg(F.countDistinct("g").alias("n")).collect()
    assert [r.n for r in folds] == [15] * 4
    with pytest.raises(ValueError):
        splitting.check_ratios((0.8, 0.2, 0.1))


def test_leaks(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "train"), (2, long, "test"), (3, long, "test"), (4, long.replace("w30", "x"), "val"), (5, None, "test"), (6, " ", "train"), (7, " ", "test"), (8, "a b", "val")]
    df = spark.createDataFrame(rows, "id long, text string, split string")
    assert [(r.split1, r.split2, r.hits) for r in leakage.exact_leaks(df).collect()] == [("test", "train", 2)]
    near = sorted((r.id1, r.id2) for r in leakage.fuzzy_leaks(df, 0.8).collect())
    assert near == [(1, 4), (2, 4), (3, 4)]
    assert leakage.leak_verdict(leakage.exact_leaks(df)).first().leak


def test_leaks_match_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randint(3, 40))]
        for k in range(rng.randint(1, 3)):
            changed = list(words)
            for j in rng.sample(range(len(words)), rng.randint(0, 2)):
                changed[j] = "x"
            rows.append((len(rows), " ".join(changed), rng.choice(["train", "val", "test"])))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t, _ in rows}
    for threshold in (0.25, 0.6):
        want = {(a, b) for a, x, s in rows for b, y, z in rows if s < z and x != y and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
        df = spark.createDataFrame(rows, "id long, text string, split string")
        assert {(r.id1, r.id2) for r in leakage.fuzzy_leaks(df, threshold).collect()} == want and len(want) >= 5


def test_medians(spark):
    import random
    import statistics

    rng = random.Random(4)
    for n in (1, 2, 3, 500, 501):
        rows = [(rng.randrange(5), rng.random(), None if rng.random() < 0.3 else rng.gauss(0, 1), None) for _ in range(n)]
        table = profiling.value_counts(spark.createDataFrame(rows, "a int, b double, c double, d double"), ["a", "b", "c", "d"])
        got = {r.name: r.median for r in profiling.medians(table, 20).collect()}
        middle = lambda k: statistics.median(x) if (x := [r[k] for r in rows if r[k] is not None]) else None
        assert [got.get(c) for c in "abcd"] == [middle(k) for k in range(4)]


def test_declared_charsets(spark, tmp_path):
    texts = {"UTF-8": "é日", "ISO-8859-1": "é", "windows-1252": "“€”", "ISO-8859-15": "€", "ISO-8859-7": "λόγος", "UTF-16": "日本", "UTF-32": "λ😀", "koi8-r": "слово"}
    for name, text in texts.items():
        (tmp_path / f"{name}.xml").write_bytes(f'<?xml version="1.0" encoding="{name}"?><p>{text}</p>'.encode(name))
    (tmp_path / "none.xml").write_bytes("<p>é</p>".encode())
    (tmp_path / "mark.xml").write_bytes("\ufeff<p>é</p>".encode())
    (tmp_path / "what.xml").write_bytes(b'<?xml version="1.0" encoding="no-such-set"?><p/>')
    got = {os.path.basename(r.filename)[:-4]: r.text for r in readers.read_xml_corpus(spark, str(tmp_path)).collect()}
    assert {k: v and v.split("?>")[-1] for k, v in got.items()} == {k: f"<p>{t}</p>" for k, t in texts.items()} | {"none": "<p>é</p>", "mark": "<p>é</p>", "what": None}


def test_flags(spark):
    df = spark.createDataFrame([("<cit><citation>x</citation></cit>", "abcd", "ab")], "t string, a string, b string")
    row = df.select(markup.strip_tags(F.col("t"), prefix_match=True).alias("t"), leakage.levenshtein_ratio(F.col("a"), F.col("b")).alias("r"), leakage.levenshtein_ratio(F.col("a"), F.col("b"), 0.6).alias("none")).first()
    assert tuple(row) == ("x</citation>", 0.5, None)


def test_group_split_takes_the_first_trial_that_fits(spark):
    df = spark.createDataFrame([(f"g{i}",) for i in range(40) for _ in range(1 + i % 5 * 20)], "g string")
    one, ten = (sorted(map(tuple, splitting.group_assignment(df, "g", (0.6, 0.2, 0.2), at_once=n).collect())) for n in (3, 100))
    assert one == ten and len(one) == 40
    assert splitting.group_assignment(df.limit(0), "g").count() == 0


def test_entity_scores(spark):
    truth, predicted = labelled(spark, "B-BIBL", "I-BIBL", "O", "B-QUOTE"), labelled(spark, "B-BIBL", "O", "O", "B-QUOTE")
    row = evaluation.entity_prf(truth, predicted).first()
    assert (row.n_true, row.n_predicted, row.n_hit, row.f1) == (2, 2, 1, 0.5)
    none = evaluation.entity_prf(labelled(spark, "O"), labelled(spark, "O")).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)
    assert evaluation.length_mismatch(truth, labelled(spark, "O")).first().n_predicted == 1


def test_urns(spark):
    df = spark.createDataFrame([("urn:cts:greekLit:tlg1.tlg2.ed1:7.1",), ("urn:cts:latinLit:phi1",), ("urn:cts:x",), ("",), (None,)], "urn string")
    got = [r.p and tuple(r.p) for r in df.select(urn.parse(F.col("urn")).alias("p")).collect()]
    assert got == [("greekLit", "tlg1", "tlg1.tlg2", "ed1", "7.1"), ("latinLit", "phi1", None, None, None), None, None, None]
    places = spark.createDataFrame([("Hom. Il. 7.268-272",), ("Pl. Rep. 332 d",), ("sqq.",)], "c string").select(urn.passage(F.col("c")).alias("p")).collect()
    assert [r.p for r in places] == ["7.268", "332d", ""]


def test_orchestration(spark):
    rows = [(1, "r", 0.9, "m", 1.0), (2, "r", 0.6, "m", 0.7), (3, "r", 0.6, None, None), (4, "r", 0.5, "m", 0.1), (5, None, None, "m", 0.2), (6, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, rule_urn string, rule_confidence double, model_urn string, model_confidence double")
    got = {r.id: (r.method, r.urn) for r in resolution.orchestrate(df).collect()}
    assert got == {1: ("rule-based", "r"), 2: ("dnn-override", "m"), 3: ("rule-based-verified", "r"), 4: ("dnn-preferred", "m"), 5: ("dnn-only", "m"), 6: ("unresolved", None)}


def test_fit_length(spark):
    row = spark.createDataFrame([([1, 2, 3],)], "x array<int>").select(L.fit_length(F.col("x"), 5, 0).alias("a"), L.attention(F.col("x"), 5).alias("b"), L.fit_length(F.col("x"), 2, 0).alias("c")).first()
    assert (row.a, row.b, row.c) == ([1, 2, 3, 0, 0], [1, 1, 1, 0, 0], [1, 2])
