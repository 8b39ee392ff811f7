"""Spelling variants: blocked Gram matrices of letter counts, edits verified, forms followed to their roots.

A word's letters are split into CLASSES classes of about equal weight; its block is given by how many letters it has
of each class, and so by its length. An inserted letter leads to a block with one more of one class. Two words of
one length that differ by a replaced letter both lead to a block that way. So every word goes to its own cell as a
whole word and, for each class, to the cell with one letter more; near words meet in exactly one cell, or, where
the replaced letters are of one class, in the cell of each class, of which the first counts.

In a cell the product of letter-count matrices gives squared distances of all words at once: pairs at most two
apart are kept and verified letter by letter. A cell of more than CELL words (or CELL_LETTERS letters) is cut
into parts by a hash of the word, and each two parts meet on their own, so no task holds more than two parts.

The words of whole texts are counted inside tasks first. A run's deletion depends on doc_id and the run only. Null
texts have no words; a null doc_id counts as an empty one; rows that repeat count again. No words, no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from citeloom.llm.shared import bound_batches, stored

LEAST_LETTERS, LEAST_COUNT, RARE, TIMES = 5, 3, 97, 2
CLASSES, CELL, CELL_LETTERS = 8, 2048, 1 << 20
#: Words that a task counts before it hands them on, and letters of a text that are split at once.
HELD, PIECE = 200_000, 1 << 20
_RUN, _NOT = re.compile(rb"[A-Za-z\xc0-\xff]+"), re.compile(rb"[^A-Za-z\xc0-\xff]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Letters of words as columns of a count matrix: a-z and U+00C0 to U+00FF.
_COLUMN = np.full(256, -1, np.int16)
_COLUMN[[*range(97, 123), *range(0xC0, 0x100)]] = np.arange(90)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"[A-Za-zÀ-ÿ]+"


def words_in(doc_id: int | None, text: str) -> Counter:
    """The words of one text, as Latin-1 bytes, with their deletions, and how often each stands there."""
    data, runs, at = text.encode("latin-1", "replace").translate(_LOWER), Counter(), 0
    while at < len(data):
        gap = _NOT.search(data, at + PIECE)
        to = gap.start() if gap else len(data)
        runs.update(_RUN.findall(data, at, to))
        at = to
    start, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % RARE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LETTERS:
            out[run] += n
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def told() -> pa.RecordBatch:
        out = pa.record_batch({"word": pa.array([w.decode("latin-1") for w in held], pa.string()), "n": pa.array(list(held.values()), pa.int64())})
        held.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            if text.is_valid:
                held.update(words_in(doc_id, text.as_py()))
            if len(held) >= HELD:
                yield told()
    yield told()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the words that stand LEAST_COUNT times or more in all texts together."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_classes(words: DataFrame) -> np.ndarray:
    """A class of 0 to CLASSES - 1 for each letter, such that the classes have about as many letters of words."""

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer("".join(batch.column("word").to_pylist()).encode("latin-1"), np.uint8), minlength=256)
        yield pa.record_batch({"letter": pa.array(np.arange(256)), "n": pa.array(total)})

    rows = words.select("word").mapInArrow(tallied, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()  # 256 rows
    out, load = np.zeros(256, np.int64), [0] * CLASSES
    for n, letter in sorted(((-x["n"], x["letter"]) for x in rows)):
        out[letter] = load.index(min(load))
        load[out[letter]] -= n
    return out


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latin-1 letters of all words in a row, the word of each, and the lengths."""
    listed = [w.encode("latin-1") for w in words.to_pylist()]
    size = np.array([len(w) for w in listed], np.int64)
    return np.frombuffer(b"".join(listed), np.uint8), np.repeat(np.arange(len(listed)), size), size


def _celled(batches: Iterator[pa.RecordBatch], classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each word CLASSES + 1 times: role is the class of the letter that its cell has more, or CLASSES."""
    rng = np.random.default_rng(11)
    odd = (rng.integers(1, 2**63, CLASSES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            letters, of, size = _flat(part.column("word"))
            n, key = part.num_rows, np.zeros(part.num_rows, np.uint64)
            with np.errstate(over="ignore"):
                np.add.at(key, of, odd[classes[letters]])
                cells = np.append(key[:, None] + odd[None, :], key[:, None], axis=1)
            again = np.repeat(np.arange(n), CLASSES + 1)
            columns = {"cell": pa.array(cells.view(np.int64).ravel()), "role": pa.array(np.tile(np.arange(CLASSES + 1, dtype=np.int8), n))}
            # Words of another length don't meet, whatever their hashes.
            columns["size"] = pa.array((size[:, None] + (np.arange(CLASSES + 1) < CLASSES)).ravel())
            yield pa.record_batch(columns | {c: part.column(c).take(pa.array(again)) for c in ("word", "n")})


def near_pairs(words: list[bytes], whole: np.ndarray, role: np.ndarray, part: np.ndarray, first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near words of one cell, as places in words: those with a letter less (not whole) among themselves, and
    with whole ones, where one is of part ``first`` and the other of part ``second``."""
    order = np.argsort(whole, kind="stable")
    short = int((~whole).sum())
    if not short or len(words) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = len(words[order[0]])
    letters = np.frombuffer(b"".join(words[i] for i in order[:short]), np.uint8).reshape(short, size)
    longer = np.frombuffer(b"".join(words[i] for i in order[short:]), np.uint8).reshape(len(words) - short, size + 1)
    counts, square = np.zeros((len(words), 90), np.float32 if size < 2000 else np.float64), None
    for x, at in ((letters, 0), (longer, short)):
        if len(x):
            np.add.at(counts, (at + np.repeat(np.arange(len(x)), x.shape[1]), _COLUMN[x.ravel()]), 1)
    square = np.square(counts).sum(1)
    found = []
    for at in range(0, short, 512):
        to = min(at + 512, short)
        distance = square[at:to, None] + square[None, at:] - 2 * (counts[at:to] @ counts[at:].T)
        i, j = np.nonzero(distance <= 2)
        i, j = i + at, j + at
        a, b = order[i], order[j]
        fit = (i < j) & ((role[a] != role[b]) | (role[a] == 0)) & ((part[a] == first) & (part[b] == second) | (part[a] == second) & (part[b] == first))
        i, j = i[fit], j[fit]
        for k in range(0, len(i), max(1, (1 << 22) // (size + 1))):
            x, y = i[k : k + max(1, (1 << 22) // (size + 1))], j[k : k + max(1, (1 << 22) // (size + 1))]
            same = y < short
            p, q = x[same], y[same]
            one = (letters[p] != letters[q]).sum(1) == 1
            r, t = x[~same], y[~same] - short
            # One letter more: what both begin with and what both end with cover the shorter word.
            head, tail = letters[r] == longer[t, :-1], letters[r] == longer[t, 1:]
            begin = np.where(head.all(1), size, head.argmin(1))
            end = np.where(tail.all(1), size, tail[:, ::-1].argmin(1))
            more = begin + end >= size
            found += [(order[p[one]], order[q[one]]), (order[r[more]], order[t[more] + short])]
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.asarray(batch.column("members").offsets)
        flat = batch.column("members").flatten()
        words, role, part, n = (flat.field(k) for k in range(4))
        listed = [w.encode("latin-1") for w in words.to_pylist()]
        role, part = np.asarray(role), np.asarray(part)
        base, out = ends[0], []
        for k, (first, second) in enumerate(zip(batch.column("first").to_pylist(), batch.column("second").to_pylist())):
            of = slice(ends[k] - base, ends[k + 1] - base)
            a, b = near_pairs(listed[of], role[of] == CLASSES, role[of], part[of], first, second)
            if len(a):
                out.append((a + of.start, b + of.start))
        a, b = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        one, two = pa.array(np.append(a, b)), pa.array(np.append(b, a))
        yield pa.record_batch({"word": words.take(one), "near": words.take(two), "near_n": n.take(two)})


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: each two words of words (word, n) that differ by one letter, in both directions."""
    classes = letter_classes(words)
    members = words.select("word", "n").mapInArrow(lambda it: _celled(it, classes), "cell long, role byte, size long, word string, n long")
    members = stored(members)
    key = ["cell", "size"]
    # The few cells of more than one part are joined to their words; the others need no number.
    sizes = members.groupBy(*key).agg(F.count("*").alias("m"), F.sum("size").alias("letters"), F.min("role").alias("least"))
    parts = F.greatest(F.ceil(F.col("m") / CELL), F.ceil(F.col("letters") / CELL_LETTERS)).cast("int")
    sizes = sizes.where((F.col("m") > 1) & (F.col("least") < CLASSES)).select(*key, parts.alias("parts"))
    placed = members.join(sizes.hint("merge"), key).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    other = F.explode(F.expr("sequence(0, parts - 1)"))
    placed = placed.withColumn("other", other).withColumn("first", F.least("part", "other")).withColumn("second", F.greatest("part", "other"))
    cells = placed.groupBy(*key, "first", "second").agg(F.collect_list(F.struct("word", "role", "part", "n")).alias("members"))
    return cells.select("first", "second", "members").mapInArrow(_compared, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last; each round follows twice as many."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = now.join(step.hint("merge"), "root", "left")
        after = stored(after.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): word, form, root, n, n_near, form_n for each word."""
    words = stored(vocabulary(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    each = words.join(near.hint("merge"), "word", "left").withColumn("form_n", -F.col("best.less"))
    enough = F.col("form_n") >= TIMES * F.col("n")
    each = each.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    each = stored(each)
    out = each.join(roots(each.where("form is not null")).hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql(crc32) -> str:
    """DuckDB SQL of the same; crc32 turns an SQL text expression into one of its checksum."""
    return rf"""WITH runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{LETTERS}')) AS run FROM documents),
each AS (SELECT d, run, count(*) AS m FROM runs GROUP BY ALL),
hashed AS (SELECT run, m, {crc32("d || ':' || run")} AS h FROM each),
damaged AS (SELECT CASE WHEN h % {RARE} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, m FROM hashed),
words AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM damaged WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(m) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(generate_series(1, length(word))) AS k FROM words),
masks AS (SELECT word, n, word[:k - 1] || '*' || word[k + 1:] AS mask, word[:k - 1] || word[k + 1:] AS less FROM places),
shorter AS (SELECT DISTINCT m.word AS a, m.n AS an, w.word AS b, w.n AS bn FROM masks m JOIN words w ON w.word = m.less),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM masks a JOIN masks b ON a.mask = b.mask AND a.word <> b.word UNION ALL SELECT a, b, bn FROM shorter UNION ALL SELECT b, a, an FROM shorter),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {TIMES} * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.other_n = most) END AS form, CASE WHEN most >= {TIMES} * w.n THEN most END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (WITH RECURSIVE steps AS (SELECT word, word AS place, form AS next FROM forms UNION ALL SELECT s.word, s.next, f.form FROM steps s JOIN forms f ON f.word = s.next) SELECT word, place AS root FROM steps WHERE next IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN walk USING (word)"""
