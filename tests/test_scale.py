"""What queries send between tasks, and what it costs where texts are long."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions import sequences
from citeloom.operators import evaluation, labelling, resolution, tokens
from citeloom.plans import catalogue

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@tables
@pytest.mark.parametrize("name", ["d5_align_predictions", "b10_trim_span", "c2_fit_length", "d3_extraction_dataset"])
def test_documents_are_worked_on_inside_their_rows(spark, name):
    assert "hashpartitioning" not in plan(catalogue.QUERIES[name](spark, SF))


def test_arrays_of_other_bounds_are_aligned(spark):
    tokens = [(k, 2 * k, 2 * k + 2) for k in (3, 1, 0, 2)] + [(4, 8, 8)]
    schema = "doc_id long, tokens array<struct<pos:int,start:int,end:int>>, predicted array<struct<start:int,end:int,label:string>>"
    rows = spark.createDataFrame([(0, tokens, [(4, 8, "B-CIT"), (0, 3, "B-BIBL"), (3, 4, "O")]), (1, tokens, None), (2, None, []), (3, [], [])], schema)
    got = {r.doc_id: r.labels for r in labelling.align_arrays(rows).collect()}
    assert got == {0: ["I-CIT", "I-BIBL", "B-BIBL", "B-CIT", "O"], 1: ["O"] * 5, 2: None, 3: []}


def test_unlike_chunks_are_compared_fast(spark):
    """Two texts of 60,000 characters that have little in common, and one that lacks a character in three."""
    import random

    chance = random.Random(3)
    a, b = ("".join(chance.choice("abcdefgh \u00e9") for _ in range(60_000)) for _ in range(2))
    pairs = spark.createDataFrame([(k, a, b) for k in range(8)] + [(8, a, a.replace("a", ""))], "doc_id long, a string, b string")
    evaluation.edit_distance_norm(pairs.limit(0)).collect()
    began = time.time()
    got = {r.doc_id: r.distance for r in evaluation.edit_distance_norm(pairs).collect()}
    assert time.time() - began < 12
    assert all(0.5 < got[k] < 0.8 for k in range(8))


def test_bits_give_the_edit_distance():
    import random

    chance = random.Random(5)
    for _ in range(300):
        a, b = ("".join(chance.choice("abc\u00e9\U0001d11e") for _ in range(chance.randrange(400))) for _ in range(2))
        assert sequences.bit_edit_distance(a, b) == sequences.edit_distance(a, b)
    assert sequences.bit_edit_distance("", "") == 0 and sequences.bit_edit_distance("abc", "") == 3


def test_similar_texts_are_those_found_by_hand(spark, monkeypatch):
    """Over several cells; urns shared by texts, texts shared by urns, ties and texts shorter than a gram."""
    import random

    chance = random.Random(7)
    monkeypatch.setattr(resolution, "KNOWN", 40)
    monkeypatch.setattr(resolution, "ASKED", 15)
    text = lambda: "".join(chance.choice("abAé𝄞 ") for _ in range(chance.choice((0, 1, 2, 3, 5, 8, 13))))
    known = [(i, text(), f"u{chance.randrange(120)}") for i in range(300)]
    asked = [(i, text()) for i in range(60)]
    grams = lambda t: {t[i : i + 3] for i in range(max(1, len(t) - 2))} if t else set()
    want = {}
    for i, t in asked:
        best = {}
        for _, x, u in known:
            a, b = grams(t.lower()), grams(x.lower())
            if a and b and len(a & b) / len(a | b) >= 0.3:
                best[u] = max(best.get(u, 0), len(a & b) / len(a | b))
        for rank, (u, value) in enumerate(sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5], 1):
            want[i, rank] = (u, round(value, 9))
    got = resolution.retrieve_similar(spark.createDataFrame(asked, "id long, text string"), spark.createDataFrame(known, "id long, text string, urn string"))
    assert {(r.query, r["rank"]): (r.urn, round(r.similarity, 9)) for r in got.collect()} == want


def test_similar_texts_that_share_most_grams_make_no_row_a_pair(spark):
    """2,000 queries and 8,000 texts of few letters: 16 million pairs share grams."""
    letters = F.expr("array_join(transform(sequence(1, 60), i -> substring('abcd', 1 + cast(pmod(xxhash64(id, i), 4) as int), 1)), '')")
    rows = spark.range(10_000).withColumn("text", letters)
    began = time.time()
    assert resolution.retrieve_similar(rows.where("id < 2000"), rows.where("id >= 2000").withColumn("urn", F.concat(F.lit("u"), "id"))).count() > 2000
    assert time.time() - began < 30


def test_labels_inside_rows_are_those_of_the_windows(spark):
    texts = [
        "a [BIBL_START] b c[BIBL_END] d [QUOTE_START][CIT_START] e [CIT_END] f",
        "[BIBL_START] open at the end",
        "no markers here",
        "[BIBL_END] x [QUOTE_START]\n[BIBL_START]",
        "[CIT_START][CIT_END]",
        "",
        None,
        "after an open one",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    slow = labelling.drop_markers(labelling.bio_labels(tokens.tokenize_with_offsets(docs, tokens.MARKED)))
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "pos", "start", "end", "token", "label").collect()))
    assert rows(labelling.labelled_tokens(docs, {})) == rows(slow)


@tables
def test_true_labels_need_no_window(spark):
    assert "Window" not in plan(catalogue.QUERIES["i4_length_mismatch"](spark, SF))


@tables
@pytest.mark.parametrize("name", ["i1_token_accuracy", "i2_entity_prf", "i3_classification_report"])
def test_labels_are_compared_inside_rows(spark, name):
    """Nothing is joined or ordered; what is shuffled are sums."""
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert "Window" not in text and "Join" not in text


def test_entities_counted_inside_rows_are_those_of_the_windows(spark):
    import random

    chance = random.Random(11)
    labels = lambda n: [chance.choice(("O", "B-BIBL", "I-BIBL", "B-QUOTE", "I-QUOTE", "I-CIT")) for _ in range(n)]
    rows = [(k, [(3 * i, 3 * i + 2) for i in range(n)], labels(n), labels(n)) for k in range(60) for n in [chance.choice((0, 1, 2, 9))]]
    wide = spark.createDataFrame(rows + [(60, None, None, None)], "doc_id long, tokens array<struct<start:int,end:int>>, truth array<string>, predicted array<string>")
    long = lambda c: wide.selectExpr("doc_id", f"posexplode(arrays_zip(tokens, {c})) as (pos, x)").selectExpr("doc_id", "pos", "x.tokens.start", "x.tokens.end", f"x.{c} as label")
    want = evaluation._by_type(long("truth"), long("predicted"))
    counts = lambda df: sorted(map(tuple, df.select("type", "t", "p", "h").collect()))
    assert counts(evaluation.entity_counts(wide)) == counts(want)


@tables
def test_citations_of_negatives_are_made_once(spark):
    """One read of the stored citations for each use, none of the documents."""
    assert "documents" not in plan(catalogue.QUERIES["j12_synthetic_negatives"](spark, SF))


@tables
def test_candidates_bring_their_truth_along(spark):
    text = plan(catalogue.QUERIES["i8_urn_metrics"](spark, SF))
    assert "documents" not in text and "SortMergeJoin" not in text


def test_urn_parts(spark):
    from citeloom.functions import urn

    texts = ["urn:cts:a:b.c.d:1.2", "urn:cts:a:b", "urn:cts:a:b..d:", "urn:cts::b.c", "urn:cts:a:.c", "urn:cts:", "urn:cts", "urn:ctsx:a:b", "", None, "urn:cts:a:b.c.d.e:1:2"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, urn string").select("id", urn.parse(F.col("urn")).alias("p"))
    got = {r.id: r.p and tuple(r.p) for r in rows.collect()}
    assert got == {0: ("a", "b", "b.c", "d", "1.2"), 1: ("a", "b", None, None, None), 2: ("a", "b", None, "d", None), 10: ("a", "b", "b.c", "d", "1")} | dict.fromkeys(range(3, 10))


@tables
@pytest.mark.parametrize("name", ["h3_similarity", "h3_sequence_ratio"])
def test_pairs_of_least_shingles_are_made_once(spark, name):
    """No shingles in the plan, and one look at each pair of texts, after they are dealt out."""
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert "md5" not in text and "ArrowEvalPython" not in text


def test_least_shingles(spark):
    from hashlib import md5

    from citeloom.operators import leakage

    texts = ["A b\x0bc  d e\x85f", "a b c d", "", None, " a b c d E "]
    got = {r.id: r.least for r in leakage.least_shingles(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    assert got == {0: md5("a b c d e\x85f".encode()).hexdigest(), 4: md5(b"a b c d e").hexdigest()}


def test_shingle_sets_are_cut_outside_the_plan_and_counted_by_hashing(spark, monkeypatch):
    from citeloom.operators import leakage

    texts = ["a b c d e f", "A  b\x0bc d\te f", "a b c d", "a b c d e f a b c d e f", "b a c d e f", None, "é b c d e f"]
    rows = spark.createDataFrame([(i, t, "xy"[i % 2]) for i, t in enumerate(texts)], "id long, text string, split string")
    sets = leakage.shingle_sets(rows)
    assert "array_distinct" not in plan(sets)
    got = {r.id: (r.n, frozenset(r.s)) for r in sets.collect()}
    assert {k: n for k, (n, _) in got.items()} == {0: 2, 1: 2, 3: 6, 4: 2, 6: 2}
    assert got[0] == got[1] and got[0][1] < got[3][1] and len(got[0][1] & got[6][1]) == 1 and not got[0][1] & got[4][1]
    # Whole sets reach the comparison of pairs only for texts that are in one.
    asked = []
    of = leakage.pair_similarity
    monkeypatch.setattr(leakage, "pair_similarity", lambda pairs, sets: asked.append({r.id for r in sets.collect()}) or of(pairs, sets))
    assert {(r.id1, r.id2) for r in leakage.fuzzy_leaks(spark.createDataFrame([(0, "a b c d e f", "x"), (1, "a b c d e f!", "y"), (2, "a b c d e  f", "y"), (3, "q r s t u v", "x")], "id long, text string, split string"), 0.9).collect()} == {(0, 2)}
    assert asked == [{0, 2}]


@tables
def test_xml_files_stand_in_archives(spark, monkeypatch):
    """A hundred or more files to read, of which 16 or fewer share a file of the file system."""
    from citeloom.sources import storage

    made = []
    of = storage.new_path
    monkeypatch.setattr(storage, "new_path", lambda *x: made.append(of(*x)) or made[-1])
    n = catalogue.QUERIES["a5_read_xml_corpus"](spark, SF).count()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(made[0]).count()
    assert n / 16 <= files < n / 2


def test_files_in_archives_are_read_as_they_are(spark, tmp_path):
    """Sizes that end in, before and on a block, long and foreign names, a charset that isn't UTF-8."""
    import tarfile

    from citeloom.sources import readers, writers

    texts = {f"{'d' * k}é/{k}.xml": "é" + "x" * k for k in (0, 1, 100, 300)} | {f"{k}.xml": "x" * k for k in (1, 510, 511, 512, 513, 1024)}
    files = spark.createDataFrame(list(texts.items()), "name string, text string").coalesce(1)
    writers.write_archives(files, f"{tmp_path}/a", 4)
    got = readers.read_xml_corpus(spark, f"{tmp_path}/a", "*.txt", archives=True).collect()
    assert {r.filename.split(".txt/")[1]: r.text for r in got} == texts and len(got) == len(texts)
    assert len(list((tmp_path / "a").glob("*.txt"))) == 3
    inner = tmp_path / "x.xml"
    inner.write_bytes('<?xml version="1.0" encoding="windows-1252"?><p>“€”</p>'.encode("windows-1252"))
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as archive:
        archive.add(inner, "d/x.xml")
    (row,) = readers.read_xml_corpus(spark, str(tmp_path), "*.tar.gz", archives=True).collect()
    assert row.filename.endswith("/b.tar.gz/d/x.xml") and row.charset == "WINDOWS-1252" and row.text.endswith("<p>“€”</p>")


def test_labels_of_texts_are_those_of_their_windows(spark, monkeypatch):
    texts = ["", None, "a", "A b. C  ", " \n", " ".join(f"t{i}é" for i in range(900)), "x" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = lambda: lambda windows: [[f"B-{len(w)}{t.strip()[:1]}" for t in w] for w in windows]
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "window_idx", "n", "pos", "start", "end", "token", "label").collect()))
    for size, stride in ((16, 8), (7, 3), (5, 5)):
        got = labelling.label_texts(docs, sizes, size, stride)
        assert "Generate" not in plan(got)
        assert rows(got) == rows(labelling.label_windows(tokens.windows(docs, size, stride), sizes, size))
    with pytest.raises(Exception, match="each token"):
        labelling.label_texts(docs, lambda: lambda windows: [["O"] for _ in windows], 16, 8).collect()


@tables
def test_windows_are_labelled_in_one_pass(spark):
    """A token goes to Python once: no window is made of structures of columns."""
    assert "Generate" not in plan(catalogue.QUERIES["d5_label_windows"](spark, SF))


def test_spans_inside_rows_win_as_in_tables(spark):
    """Labels by chance over several documents, spans that are empty, adjoin tokens, overlap, or lie outside."""
    import random

    chance = random.Random(13)
    kinds = ("O", "B-BIBL", "I-BIBL", "B-QUOTE", "I-QUOTE", "I-CIT")
    rows, existing = [], []
    for k in range(80):
        n = chance.choice((0, 1, 2, 12))
        words = [chance.choice(("a", " bb", "\n cé")) for _ in range(n)]
        spans = [(s, s + chance.choice((0, 0, 1, 2, 5)), chance.choice(("BIBL", "QUOTE", "CIT"))) for s in (chance.randrange(25) for _ in range(chance.randrange(4)))]
        rows.append((k, words, [chance.choice(kinds) for _ in range(n)], spans))
        existing += [(k, *x) for x in spans]
    wide = spark.createDataFrame(rows + [(80, [], [], [])], "doc_id long, tokens array<string>, labels array<string>, spans array<struct<start:int,end:int,type:string>>").coalesce(2)
    long = [(k, i, sum(map(len, w[:i])), sum(map(len, w[: i + 1])), x[i]) for k, w, x, _ in rows for i in range(len(w))]
    predicted = spark.createDataFrame(long, "doc_id long, pos int, start int, end int, label string")
    want = labelling.resolve_against_existing(predicted, spark.createDataFrame(existing, "doc_id long, start int, end int, type string"))
    assert sorted(map(tuple, labelling.resolve_arrays(wide).collect())) == sorted(map(tuple, want.collect()))


@tables
def test_labels_against_spans_are_resolved_inside_rows(spark):
    text = plan(catalogue.QUERIES["d7_resolve_against_existing"](spark, SF))
    assert "Join" not in text and "Window" not in text and "hashpartitioning" not in text


@tables
def test_crossing_spans_are_dropped_inside_rows(spark):
    """No spans of many documents are sorted or hashed in one task."""
    text = plan(catalogue.QUERIES["e3_drop_crossing"](spark, SF))
    assert "hashpartitioning" not in text and "Window" not in text and "Sort " not in text


def test_spans_in_rows_are_those_of_events(spark):
    import random

    from citeloom.operators import lexing

    chance = random.Random(17)
    parts = ["<p>", "</p>", "<P n='1' >", "<p/>", '<h1 a="x"/>', "<h1\n>", "</h1 >", "</h1/>", "<pre>", "<p:x>", "\u00e9\U0001d11e", " a ", "<", "<!-- <p> -->", "<script>1<p></script>", "<![CDATA[</p>]]>", "<p"]
    texts = [None, "", "<p></p>"] + ["".join(chance.choice(parts) for _ in range(chance.randrange(14))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    types = {"p": "QUOTE", "h1": "BIBL", "script": "CIT"}
    text, spans = lexing.strip_with_spans(docs, types)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(text) == rows(lexing.without_tags(docs, list(types)))
    assert rows(spans) == rows(lexing.spans_of(lexing.markup_events(docs), types))


def test_entities_found_inside_rows_are_those_of_tables(spark):
    import random

    from citeloom.operators import lexing

    chance = random.Random(19)
    parts = ["Foo", " bar", "\n", "  ", ".", "<i>", "</i>", "é", "<", " <b> ", "<p>", "</p>", " Baz"]
    docs = spark.createDataFrame([(k, "".join(chance.choice(parts) for _ in range(chance.choice((0, 1, 3, 30))))) for k in range(150)], "doc_id long, text string")
    kinds = ("O", "O", "B-BIBL", "I-BIBL", "B-QUOTE", "I-QUOTE")
    predictor = lambda: lambda windows: [[kinds[(sum(map(ord, t)) + len(w) * i) % 6] for i, t in enumerate(w)] for w in windows]
    rows = lexing.spans_in_rows(docs, {"p": "QUOTE"})
    text, existing = rows.select("doc_id", "text"), rows.select("doc_id", F.inline("spans"))
    ordered = lambda df: sorted(map(tuple, df.select("doc_id", "start", "end", "type").collect()))
    for size, stride in ((8, 4), (7, 3), (4, 4)):
        labelled = labelling.label_windows(tokens.windows(text, size, stride, lexing.text_tokens(F.col("text"), tokens.TOKEN)), predictor, size)
        merged = tokens.merge_window_labels(labelled, size, stride).select("doc_id", "pos", "start", "end", "label")
        merged = labelling.resolve_against_existing(merged, existing)
        want = labelling.trim_spans(labelling.decode_entities(merged), text).where("start < end")
        found = labelling.find_entities(rows.select("doc_id", lexing.tiles(F.col("text"), tokens.TOKEN).alias("x"), "spans"), predictor, size, stride)
        assert "Exchange" not in plan(found).replace("RoundRobin", "") and ordered(found) == ordered(want)


def test_texts_do_not_follow_their_spans(spark):
    """A text of 200,000 characters with 400 spans, which were 80 MB, and neighbours with and without blanks between."""
    from citeloom.operators import structure

    schema = "doc_id long, start int, end int, type string, attrs string"
    rows = [(0, 500 * k, 500 * k + 10, "BIBL", "") for k in range(400)] + [(1, 0, 2, "BIBL", "x"), (1, 3, 5, "BIBL", ""), (1, 5, 7, "QUOTE", ""), (1, 9, 10, "QUOTE", "")]
    docs = spark.createDataFrame([(0, "ab cd" * 40_000), (1, "aa bbccd e")], "doc_id long, text string")
    df = spark.createDataFrame(rows, schema)
    merged = structure.merge_adjacent(df, docs)
    # The documents are joined with one row a document: an aggregate stands below that join.
    assert "collect_set" in plan(merged)
    assert sorted(map(tuple, merged.where("doc_id = 1").collect())) == [(1, 0, 5, "BIBL", "x"), (1, 5, 7, "QUOTE", ""), (1, 9, 10, "QUOTE", "")]
    assert merged.where("doc_id = 0").count() == 400
    assert [tuple(r) for r in structure.wrap_pairs(merged, docs).collect()] == [(1, 0, 7, "CIT", "")]
    assert structure.merge_adjacent(df, docs, 0).where("doc_id = 1").count() == 4


def moved(spark, what):
    """Bytes and rows that what() shuffles."""
    sc = spark.sparkContext
    stages = lambda: {(x.stageId(), x.attemptId()): (x.shuffleWriteBytes(), x.shuffleWriteRecords()) for x in _stages(sc)}
    before = stages()
    what()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    new = [x for k, x in stages().items() if x != before.get(k)]
    return sum(b for b, _ in new), sum(n for _, n in new)


def _stages(sc):
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def _near_copies(n, words):
    """n texts a split that differ in a word each."""
    base = [f"w{i}" for i in range(words)]
    return [(2 * k + x, " ".join([*base[: 7 * k], f"x{k}y{x}", *base[7 * k + 1 :]]), "ab"[x]) for k in range(n) for x in (0, 1)]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sets_are_not_moved_once_a_pair(spark, no_broadcast):
    """Twice the near copies, four times the pairs; each set is of 48 kB."""
    from citeloom.operators import leakage

    sizes = []
    for n in (12, 24):
        df = spark.createDataFrame(_near_copies(n, 6000), "id long, text string, split string").repartition(4).cache()
        df.count()
        sizes.append(moved(spark, lambda: sizes.append(leakage.fuzzy_leaks(df, 0.8).count()))[0])
        df.unpersist()
    assert sizes[0] == 12**2 and sizes[2] == 24**2, sizes
    assert sizes[3] < 3 * sizes[1] and sizes[3] < 12_000_000, sizes


def test_shingles_out_of_prefixes_are_not_moved(spark):
    from citeloom.operators import leakage

    rows = [(k, " ".join(f"w{k}v{i}" for i in range(5000)), "ab"[k % 2]) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, split string").repartition(4).cache()
    df.count()
    size, n = moved(spark, lambda: leakage.fuzzy_leaks(df, 0.8).count())
    df.unpersist()
    assert n < 0.25 * 200_000 and size < 8 * 200_000


def test_words_have_codes_of_their_own():
    import pyarrow as pa

    from citeloom.operators import leakage

    texts = ["a b\x0bab  aé\x85 ", "", " \t", "12345678 123456789 1234567 12345678a 12345678b", "a" * 16 + " " + "a" * 17 + "\na a\x00", "b" * 400]
    words = [t.encode().split() for t in texts]
    code, first = leakage._word_codes(pa.array(["?", *texts]).slice(1))
    assert np.diff(first).tolist() == list(map(len, words))
    of = dict(zip(sum(words, []), code.tolist()))
    assert len(set(of.values())) == len(of) and [of[w] for w in sum(words, [])] == code.tolist()


def test_counts_by_the_first_bits_of_hashes(spark):
    from citeloom.operators import leakage

    chance = np.random.default_rng(5)
    for n in (1, 3, 5000):
        slots = np.sort(chance.integers(0, 1 << leakage.BLOCK_BITS, n))
        assert leakage._slots(leakage._steps(slots)).tolist() == slots.tolist()
    rows = [(k, f"a b c d e {k}", "x") for k in range(8)] + [(9, "é f g h i", "y"), (10, None, "y"), (11, "a b", "y")]
    df = spark.createDataFrame(rows, "id long, text string, split string").repartition(3)
    common = leakage._commonness(leakage._summaries(df, 5))
    assert sorted(common[common > 0].tolist()) == [36] and len(common) == 1 << leakage.BLOCK_BITS


@pytest.fixture
def copies(spark, monkeypatch):
    """300 copies of a text in one split, 300 of one near it in another; for queries on split documents."""
    from citeloom.plans import corpus_queries

    texts = [" ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(1, 61))]
    rows = [(2 * k + x, texts[x], "ab"[x]) for k in range(300) for x in (0, 1)]
    df = spark.createDataFrame(rows, "id long, text string, split string").repartition(2)
    monkeypatch.setattr(corpus_queries.B, "split_documents", lambda *_: df)


def test_top_leaks_do_not_tell_all_copies_apart(spark, no_broadcast, copies):
    got = []
    _, n = moved(spark, lambda: got.extend(catalogue.QUERIES["h5_top_leaks"](spark, "").collect()))
    assert [(r.split1, r.split2, r.id1, r.id2) for r in sorted(got)] == [("a", "b", 0, k) for k in range(1, 21, 2)]
    assert n < 40_000


def test_a_verdict_does_not_tell_copies_apart(spark, no_broadcast, copies):
    got = []
    _, n = moved(spark, lambda: got.extend(catalogue.QUERIES["h6_leak_verdict"](spark, "").collect()))
    assert [tuple(r) for r in got] == [(False, True, True)] and n < 40_000


def test_top_leaks_are_those_of_all_leaks(spark):
    """Copies, ties of similarity, and texts that only differ in blanks."""
    import random

    from citeloom.operators import leakage

    chance = random.Random(23)
    rows = []
    for k in range(12):
        words = [f"w{k}v{i}" for i in range(30)]
        for _ in range(12):
            changed = [*words[: chance.choice((30, 30, 29, 28))], *("x" for _ in range(chance.choice((0, 0, 1))))]
            rows.append((chance.choice((" ", "  ")).join(changed), chance.choice("abc")))
    chance.shuffle(rows)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, split string").cache()
    every = leakage.fuzzy_leaks(df, 0.8)
    for k in (1, 10, 40):
        want = leakage.top_leaks(every, k).collect()
        assert len(want) == k and leakage.top_fuzzy_leaks(df, 0.8, k=k).orderBy(F.desc("similarity"), "id1", "id2").collect() == want
    assert leakage.top_fuzzy_leaks(df.limit(0), 0.8).count() == 0
    df.unpersist()
