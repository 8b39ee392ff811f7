"""Rows that share ids, copies, runs of blanks, and a plain forward pass: cases that went wrong once."""

import time
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeloom.llm import gru_language, kneser_ney_quality, pattern_packing, pii_sanitise, shared
from citeloom.llm.queries import tokenizer


@pytest.fixture
def few_steps(monkeypatch):
    monkeypatch.setattr(gru_language, "STEPS", 3)
    train = gru_language.Network.train
    monkeypatch.setattr(gru_language.Network, "train", lambda self, w, t: train(self, w, t, 3))


def test_no_language_is_lost_where_rows_share_a_doc_id(spark, few_steps):
    many = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("some english text "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    few = spark.range(398).select("id", F.concat(F.lit("etwas deutscher Text "), F.col("id")).alias("text"), F.lit("de").alias("lang"))
    copies = spark.range(9000).select(F.lit(None).cast("long"), F.lit("un seul texte"), F.lit("fr"))
    one = spark.createDataFrame([(3, "solo uno", "es")], "doc_id long, text string, lang string")
    assert gru_language.learn(many.union(few).union(copies).union(one)).languages == ["de", "en", "es", "fr"]


def pooled_by_hand(network, text):
    """Position by position: 64 bytes at a time, gates as published, the mean over the bytes of letters."""
    data = text.encode()
    letter = [x for c in text for x in [unicodedata.category(c)[0] == "L"] * len(c.encode())]
    w, h, total, n = network.w, network.hidden, np.zeros(len(network.languages)), 0
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for at in range(0, len(data), gru_language.SPAN):
        window = data[at : at + gru_language.SPAN].ljust(gru_language.SPAN, b" ")
        states = {}
        for d, order in (("f", range(gru_language.SPAN)), ("b", range(gru_language.SPAN - 1, -1, -1))):
            state = np.zeros(h)
            for t in order:
                gates = w[f"zr{d}"][window[t]] + state @ w[f"uzr{d}"]
                # Gates are stored for tanh: sigmoid(2x) = (tanh(x) + 1) / 2; r enters doubled.
                z, r = sigmoid(2 * gates[:h]), 2 * sigmoid(2 * gates[h:])
                new = np.tanh(w[f"n{d}"][window[t]] + r * (state @ w[f"un{d}"]))
                state = (1 - z) * new + z * state
                states[d, t] = state
        for t in range(min(gru_language.SPAN, len(data) - at)):
            if letter[at + t]:
                logits = np.concatenate([states["f", t], states["b", t]]) @ w["out"] + w["bias"]
                p = np.exp(logits - logits.max())
                total, n = total + p / p.sum(), n + 1
    return total / max(n, 1), n


def test_forward_pass_and_pooling_by_hand(monkeypatch):
    network = gru_language.Network(["a", "b", "c"])
    rng = np.random.default_rng(3)
    for k in network.w:
        network.w[k] = (network.w[k] + rng.normal(0, 0.3, network.w[k].shape)).astype(np.float32)
    texts = ["", "a", "x" * 63, "é" * 32, "wörd " * 13, "日本語 text " * 40, "12 -- ", "z" * 64, "q" * 65, "ab\n" * 200]
    for group in (3, 2048):
        p, letters = network.pooled(pa.array(texts), group)
        for k, text in enumerate(texts):
            want, n = pooled_by_hand(network, text)
            assert letters[k] == n and np.allclose(p[k], want, atol=2e-5), text


def test_ids_of_blanks_in_linear_time():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    encode, library = pattern_packing.Encoder(path), Tokenizer.from_file(path)
    for blank in " \n\t　\x85":
        for n in (1, 15, 16, 17, 33, 100):
            for text in (blank * n, f"a{blank * n}b", f"a{blank * n}", f"{blank * n}<|endoftext|>{blank * n}!", f"x{blank * n} é"):
                assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    began = time.time()
    encode((" " * 9999 + "a") * 100)
    assert time.time() - began < 5


def test_copies_of_a_piece_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(pattern_packing, "GROUP", 8)
    df = spark.range(900).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    rows = pattern_packing.pack(df, tokenizer("byte_bpe_50k.json"), capacity=32).collect()
    assert len(rows) == 900 and len({(r.sequence_id, r.offset) for r in rows}) == 900
    size = rows[0].length
    assert max(r.offset for r in rows) + size <= 32 and len({r.sequence_id for r in rows}) == -(-900 // (32 // size))


def test_perplexities_of_rows_without_a_doc_id(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney_quality, "BLOCK_BYTES", 400)
    texts = [f"plain words of some length {k:03}" for k in range(60)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)] + [(None, t, "en") for t in texts], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    rows = kneser_ney_quality.perplexities(docs, labels).collect()
    one, two = (sorted(round(r.perplexity, 4) for r in rows if (r.doc_id is None) == none) for none in (False, True))
    assert len(rows) == 120 and one == two


def test_a_row_of_many_parts_is_linked_in_little_time(spark):
    from citeloom.llm import secret_scan

    text = "user: admin " + "".join(f"{k:032x} https://h{k}.example.org/x " for k in range(8000))
    df = spark.createDataFrame([(1, text, 5), (2, "plain", 6)], "doc_id long, text string, id int")
    began = time.time()
    rows = {r.doc_id: r for r in secret_scan.secrets(df).collect()}
    assert rows[1].n_hex == 8000 and rows[1].n_linked >= 8000 and rows[2].spans == ""
    assert time.time() - began < 60


def test_repetitive_texts_are_compared_in_little_time(spark):
    from citeloom.llm import seed_decontamination

    docs = spark.createDataFrame([(1, "same " * 20_000), (2, "a b " * 3000), (3, "something else entirely " * 30)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "same " * 200), (2, "a b " * 50), (3, "same same b a same b")], "item_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.item_ids, r.matched) for r in seed_decontamination.decontaminate(docs, items).collect()}
    assert got[1][0] == "1" and got[1][1] == 200 and got[2] == ("2", 100) and got[3] == ("", 0)
    assert time.time() - began < 60


def test_shifts_between_places():
    from citeloom.llm import seed_decontamination

    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 40, rng.integers(1, 12))) for _ in range(2))
        assert seed_decontamination.shifts_between(a, b).tolist() in ([*sorted({int(x - y) for x in a for y in b})], [*sorted({int(x - y) for x in a for y in b}, reverse=True)])


def test_every_span_of_a_kind_counts(docs):
    texts = ["a@b.co c@d.org, 1.2.3.4 and 10.20.30.40 or +49 30 1234567", "+1 555 123 4567 +1 555 123 4568 x@y.de z@y.de w@y.de 4111 1111 1111 1111", "", None, "9.9.9.9 8.8.8.8 7.7.7.7"]
    rows = {r["doc_id"]: r for r in pii_sanitise.report(docs(*texts)).collect()}
    counts = [tuple(rows[i][f"n_{kind}"] for kind in ("email", "ip", "card", "phone")) for i in range(5)]
    assert counts == [(2, 2, 0, 1), (3, 0, 1, 2), (0, 0, 0, 0), (0, 0, 0, 0), (0, 3, 0, 0)]


@pytest.mark.parametrize("n", [0, 1, 3000, 50_000])
def test_bit_tables_follow_their_keys(spark, n):
    table = shared.bit_table(spark.range(n).select(F.xxhash64("id").alias("place")), "place")
    assert 64 * len(table) >= max(1 << shared.LEAST_BITS, 0.9 * shared.PER_KEY * n)
    asked = spark.range(2 * n + 1000).select("id", F.xxhash64("id").alias("place")).toPandas()
    there = shared.in_table(asked["place"].to_numpy().view(np.uint64), table)
    assert there[:n].all() and there[n:].mean() < 0.01


def test_bit_tables_reach_the_driver_packed(spark, monkeypatch):
    """A few values of some KB, not a row a word, which took the driver hundreds of MB."""
    sent = []
    for name in ("toPandas", "toArrow"):
        plain = getattr(type(spark.range(1)), name)
        monkeypatch.setattr(type(spark.range(1)), name, lambda df, plain=plain: sent.append(plain(df)) or sent[-1])
    table = shared.bit_table(spark.range(50_000).select(F.xxhash64("id").alias("place")), "place")
    assert [len(x) for x in sent] == [len(table) // shared.BLOCK]


def test_bits_stay_in_bounds():
    assert shared.bits_for(0) == shared.bits_for(1) == 1 << shared.LEAST_BITS
    assert shared.bits_for(1 << 20) == shared.PER_KEY << 20
    assert shared.bits_for(1 << 30) == shared.bits_for(1 << 40) == 1 << shared.MOST_BITS


def test_pages_of_many_addresses_and_terms_pair_classes(spark, monkeypatch):
    """Five pages list the same 300 addresses and 300 rare terms, in other orders: 90,000 pairs a page, one of classes."""
    rng, rows = np.random.default_rng(3), []
    names, terms = [f"user{i}@host{i}.org" for i in range(300)], [f"rareword{i}" for i in range(300)]
    for page in range(5):
        a, b = rng.permutation(300), rng.permutation(300)
        rows.append((page, " ".join(f"{names[i]} {terms[j]}" for i, j in zip(a, b))))
    rows += [(100 + i, f"plain text number{i} of other documents") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    monkeypatch.setattr(pii_sanitise, "stored", lambda df: made.append(shared.stored(df)) or made[-1])
    got = pii_sanitise.report(docs).where("doc_id < 100").toPandas()
    assert (got["n_email"] == 300).all() and (got["n_term"] == 300).all()
    [pairs] = [t for t in made if {"entity_class", "term_class"} <= set(t.columns)]
    assert pairs.count() == 1
