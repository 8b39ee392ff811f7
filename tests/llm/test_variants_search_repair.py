"""Spelling variants, exact top-k search and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import conversation_repair, spelling_variants, top_k_search

# Spelling variants


def variants_by_hand(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    of = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in of[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(of[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=str)


def random_texts(seed, texts, letters="abé", least=4, most=6, words=80):
    rng = random.Random(seed)
    pool = ["".join(rng.choices(letters, k=rng.randint(least, most))) for _ in range(words)]
    return [" ".join(rng.choice((str, str.upper, str.title))(rng.choice(pool)) for _ in range(80)) for _ in range(texts)]


@pytest.mark.parametrize("cell", [2048, 3])
def test_variants_by_hand(spark, docs, monkeypatch, cell):
    monkeypatch.setattr(spelling_variants, "CELL", cell)  # small cells: words meet in parts
    texts = [*random_texts(1, 12), None, "", "日本 123", "ÀÉÎ×÷ÿ " * 4, "x" * 300 + " " + "x" * 299 + " " + "x" * 300]
    rows = list(enumerate(texts)) + [(len(texts) - 1, texts[-1])] * 2
    df = spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows] + [(None, texts[0], "x", 1.5)], "doc_id long, text string, word string, n double")
    got = sorted((tuple(r) for r in spelling_variants.variants(df).collect()), key=str)
    assert got == variants_by_hand([*rows, (None, texts[0])])
    assert any(r[1] for r in got) and any(r[4] > 3 for r in got)


def test_variants_follow_chains_of_any_length(spark, docs):
    word, texts = "abcdefghij", []
    for k in range(10):  # each form twice as frequent as the one before
        texts.append(f"{word} " * (3 << k))
        word = word[:k] + "z" + word[k + 1 :]
    df = docs(*texts)
    want = variants_by_hand(list(enumerate(texts)))
    got = sorted((tuple(r) for r in spelling_variants.variants(df).collect()), key=str)
    assert got == want and len({r[2] for r in got}) < len(got)


def test_long_texts_are_split_between_runs(monkeypatch):
    text = " ".join(random_texts(3, 20))
    whole = spelling_variants.words_in(7, text)
    monkeypatch.setattr(spelling_variants, "PIECE", 11)
    assert spelling_variants.words_in(7, text) == whole


def test_no_words_no_rows(spark, docs):
    for df in (docs(), docs(None, "", "one two"), docs("words once each here")):
        assert spelling_variants.variants(df).collect() == []


# Exact top-k search


def best_by_hand(rows, k=20, every=20):
    whole = [(i, v, [int(np.floor(64 * float(c))) for c in x]) for i, (v, x) in enumerate(rows) if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for i, v, x in whole:
        if v is not None and v % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), w is None, w or 0) for j, w, y in whole if i != j and len(x) == len(y))
            out += [(v, r, None if none else w, -s) for r, (s, none, w) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(v, x, 7, 1.0) for v, x in rows], "vec_id long, embedding array<double>, row int, score double")


@pytest.mark.parametrize("blocks", [(1024, 8192, 8), (5, 17, 2)])
def test_top_k_by_hand(spark, monkeypatch, blocks):
    for name, n in zip(("QUERIES", "CANDIDATES", "CELL"), blocks):
        monkeypatch.setattr(top_k_search, name, n)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 40).tolist()) for i in range(130)]
    rows += [(i, rows[3][1]) for i in range(130, 190)]  # a vector that stands often
    rows += [(40, rows[40][1]), (40, rows[41][1]), (None, rows[3][1]), (None, rows[5][1])]
    rows += [(200, None), (220, [0.1, None]), (240, [float("nan")] * 40), (260, [float("inf")] * 40), (280, []), (281, []), (300, [0.5, -0.25]), (301, [0.1, 0.1])]
    got = sorted((tuple(r) for r in top_k_search.top_k(vectors(spark, rows)).collect()), key=str)
    assert got == best_by_hand(rows)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(6)
    for scale in (10.0, 1e4, 3e6):  # sums beyond what float32 and float64 hold exactly
        rows = [(i, (rng.normal(0, scale, 24)).tolist()) for i in range(60)]
        got = sorted((tuple(r) for r in top_k_search.top_k(vectors(spark, rows)).collect()), key=str)
        assert got == best_by_hand(rows)


def test_few_rows_and_none(spark):
    assert top_k_search.top_k(vectors(spark, [])).collect() == []
    assert top_k_search.top_k(vectors(spark, [(20, [1.0])])).collect() == []
    assert [tuple(r) for r in top_k_search.top_k(vectors(spark, [(20, [1.0]), (1, [-1.0])])).collect()] == [(20, 1, 1, -4096)]


def test_pruning_drops_no_pair_within_a_tile():
    rng = np.random.default_rng(8)
    q, c = rng.integers(-40, 40, (64, 70)), rng.integers(-40, 40, (64, 900))
    best = top_k_search.Best(70, 5)
    for at in range(0, 900, 300):
        of = slice(at, at + 300)
        top_k_search.search(best, q, np.arange(70) - 1000, c[:, of], np.arange(900)[of], np.arange(900)[of])
    scores = q.T @ c
    for i in range(70):
        want = sorted((-s, j) for j, s in enumerate(scores[i]))[:5]
        mine = best.query == i
        assert sorted(zip((-best.score[mine]).tolist(), best.id[mine].tolist())) == want


# Conversation repair

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, repaired) by a table over all rows and states, audits compared as strings; rows are
    (role, text, gone, cut)."""

    def put(table, state, cost, audit, lines):
        if state not in table or (cost, audit) < table[state][:2]:
            table[state] = (cost, audit, lines)

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                for c in "ua":
                    if (state, c) in NEXT:
                        put(table, c, cost + 2, audit + "I", (lines, FULL[c] + ":"))
        return table

    table = inserted({"": (0, "", None)})
    for role, text, gone, cut in rows:
        new = {}
        for state, (cost, audit, lines) in table.items():
            put(new, state, cost + 3, audit + "D", lines)
            if not gone:
                if (state, role[:1]) in NEXT:
                    put(new, NEXT[state, role[:1]], cost + cut, audit + "K", (lines, f"{role}:{text}"))
                for c in "ua":
                    if (state, c) in NEXT:
                        put(new, c, cost + 2 + cut, audit + "R", (lines, f"{FULL[c]}:{text}"))
        table = inserted(new)
    cost, audit, lines = min((table[s] for s in ("", "a") if s in table), key=lambda x: x[:2])
    out = []
    while lines:
        lines, line = lines
        out.append(line)
    return cost, audit, "\n".join(reversed(out))


def repaired_by_hand(rows):
    told = lambda x: " " if x is None else str(x)
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text, k = told(role), told(text), zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        of[conv]  # noqa: B018
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            of[conv] += [(turn is not None, turn or 0, "user" if k == 4 else role, hashlib.md5(text.encode()).hexdigest(), text)] * (2 if k == 3 else 1)
    out = []
    for conv, some in of.items():
        seen, faults, rows = set(), Counter(), []
        for _, _, role, _, text in sorted(some):
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            rows.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        turns = [t for known, t, *_ in some if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, text = cheapest(rows)
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 3, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, audit string")


def some_rows(seed, conv, n, turns=None):
    rng = random.Random(seed)
    texts = ["Yes.", "No?", "well", "", " \n", "Good. ", "cut off", None, "日本!"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "universal"]
    weights = [9, 9, 2, 1, 1, 1, 1, 1]
    return [(conv, rng.choice([None, k, k, k]) if turns is None else turns(k), rng.choices(roles, weights)[0], rng.choice([*texts, f"Text {k}.", f"Text {k}.", f"text {k}"])) for k in range(n)]


def test_repairs_by_hand(spark):
    rows = [r for conv in range(120) for r in some_rows(conv, conv, conv % 14 + 1)] + some_rows(500, None, 9)
    rows += rows[30:60]  # repeated rows
    got = sorted((tuple(r) for r in conversation_repair.repair(conversations(spark, rows)).collect()), key=str)
    assert got == repaired_by_hand(rows)


def test_a_conversation_of_many_segments(spark):
    rows = some_rows(1, 5, 9000, lambda k: k // 2 - 100) + some_rows(2, 6, 40)
    got = sorted((tuple(r) for r in conversation_repair.repair(conversations(spark, rows).repartition(5)).collect()), key=str)
    assert got == repaired_by_hand(rows)


def test_no_rows_after_damage_and_none_at_all(spark):
    dropped = [t for t in range(200) if zlib.crc32(f"3:{t}".encode()) % 20 == 0]
    rows = [(3, t, "user", "Hello.") for t in dropped]
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in conversation_repair.repair(conversations(spark, rows)).collect()] == [(3, 0, 0, 0, 0, 0, 0, "", empty)]
    assert conversation_repair.repair(conversations(spark, [])).collect() == []


def test_tables_agree_with_single_steps():
    t = conversation_repair.tables()
    assert len(t.vectors) < 40 and (t.vectors.min(1) == 0).all()
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 4, 11):
        symbols = rng.integers(0, conversation_repair.SYMBOLS, n).astype(np.uint8)
        at, more = conversation_repair.segment_map(symbols)
        for v, vector in enumerate(t.vectors.tolist()):
            want = tuple(vector)
            for s in symbols[::-1]:
                want = conversation_repair._before(int(s), want)
            assert (t.vectors[at[v]] + more[v]).tolist() == list(want)
