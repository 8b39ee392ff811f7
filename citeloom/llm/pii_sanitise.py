"""Personal data: patterns, and the terms around them that give them away.

Emails, IP addresses, payment cards and telephone numbers are found by pattern. Removing them can leave terms
that still reveal them. How much a term t tells of an entity e is their pointwise mutual information as a
share of the entity's information content, log(p(e,t) / (p(e) p(t))) / -log p(e), estimated over all
documents: 1 when t stands nowhere but in documents of e. A term counts as together with every entity of its
document. Those that reach DISCLOSURE, in at least SUPPORT documents and SUPPORT different contexts (the terms
within WINDOW words of the entity, so that copies of one document prove nothing), become spans of kind ``term``
wherever they stand, in documents without the entity as well; in a sanitised text they are generalised to their
shape, or removed at REMOVAL and above. What is left of such a term: other spellings of it, and the term as a
part of a longer word. Words of fewer than SHORTEST bytes are never terms.

The frequency of every term is counted over every document first. With n documents, an entity in n_e of them
can't be disclosed by a term in more than n**(1 - DISCLOSURE) * n_e**DISCLOSURE: only terms that are rare enough
for some entity are looked for in the documents of entities, by a bit table whose hits are then
joined exactly, and each is paired only with the entities that it's rare enough for.

Offsets are code points, end exclusive. Null texts are empty. Every row is a document of the estimates, so are
repeated rows and rows without a doc_id; equal rows give equal results each. Columns but doc_id and text are left
alone. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from citeloom.llm import arrays as A
from citeloom.llm.shared import bit_table, in_table, stored

WINDOW, SUPPORT, DISCLOSURE, REMOVAL, SHORTEST = 6, 3, 0.8, 0.97, 4
KINDS = ("email", "ip", "card", "phone", "term")
U = np.uint64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits can only match from its first digit on: what follows the run is the same for all of it.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain.domain: the local part is the longest run before an @, so only the
    surroundings of each @ are looked at."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all matches that pass their kind's test, by kind and start."""
    out = [(0, s, e) for s, e in emails(text)]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15]
    return out


def _terms(texts: pa.Array) -> tuple[A.Words, np.ndarray, np.ndarray]:
    """Words without ASCII punctuation, A-Z lower-cased; their hashes, and which are long enough for a term."""
    words = A.words_of(texts, A.PLAIN)
    return words, A.span_hashes(words.data, words.start, words.end), words.end - words.start >= SHORTEST


def _free(words: A.Words, long: np.ndarray, j: int, spans: list, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of text j, in code points, and which of them are terms outside all spans."""
    low, high = words.first[j], words.first[j + 1]
    base = points[words.text_at[j]]
    start, end = points[words.start[low:high]] - base, points[words.end[low:high]] - base
    free = long[low:high].copy()
    for _, s, e in spans:
        free[np.searchsorted(end, s, "right") : np.searchsorted(start, e)] = False
    return start, end, free


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans, and of each entity of a text the terms around all its occurrences, as one hash."""
    entity = pa.struct([("entity", pa.int64()), ("context", pa.int64())])
    span = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
    for batch in A.slices(batches, "text"):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        spans = [base_spans(t) for t in texts]
        entities: list[list] = [[] for _ in texts]
        full = [i for i, s in enumerate(spans) if s]
        if full:
            words, hashes, long = _terms(pa.array([texts[i] for i in full]))
            points = A.code_points(words.data)
            names = pa.array([texts[i][s:e].lower() for i in full for _, s, e in spans[i]])
            data, at = A.text_bytes(names)
            kinds = np.array([k for i in full for k, _, _ in spans[i]], U)
            keys = iter(A.mix(A.span_hashes(data, at[:-1], at[1:]) + kinds).view(np.int64).tolist())
            for j, i in enumerate(full):
                start, end, free = _free(words, long, j, spans[i], points)
                context: dict[int, int] = {}
                for _, s, e in spans[i]:
                    left, right = int(np.searchsorted(end, s, "right")), int(np.searchsorted(start, e))
                    near = np.concatenate([np.arange(max(0, left - WINDOW), left), np.arange(right, min(len(start), right + WINDOW))])
                    h = hashes[words.first[j] + near[free[near]]]
                    with np.errstate(over="ignore"):
                        where = int(A.mix(h * np.arange(1, len(h) + 1, dtype=U)).sum(dtype=U)) if len(h) else 0
                    key = next(keys)
                    context[key] = (context.get(key, 0) + where) % (1 << 64)
                entities[i] = [{"entity": k, "context": x - (x >> 63 << 64)} for k, x in context.items()]
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "row": batch.column("row"),
                "base": pa.array([[{"k": k, "s": s, "e": e} for k, s, e in x] for x in spans], pa.list_(span)),
                "entities": pa.array(entities, pa.list_(entity)),
            }
        )


def _placed(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Terms outside base spans, with their places; of terms in the bit table only, if there is one."""
    for batch in A.slices(batches, "text"):
        words, hashes, long = _terms(batch.column("text"))
        if bits is not None:
            long &= in_table(hashes, bits)
        points = A.code_points(words.data)
        at, starts, ends, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j in np.unique(words.text[long]):
            start, end, free = _free(words, long, j, base_spans(batch.column("text")[int(j)].as_py()), points)
            free = np.flatnonzero(free)
            at.append(words.first[j] + free)
            starts.append(start[free])
            ends.append(end[free])
            of.append(np.full(len(free), j))
        rows = batch.select(["doc_id", "row"]).take(pa.array(np.concatenate(of).astype(np.int64)))
        term = hashes[np.concatenate(at).astype(np.int64)].view(np.int64)
        yield pa.record_batch([rows.column("doc_id"), rows.column("row"), pa.array(term), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, ends))], ["doc_id", "row", "term", "s", "e"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each term: in how many texts of a batch it stands."""
    for batch in batches:
        each = [np.zeros(0, U)]
        for part in A.slices(iter([batch]), "text"):
            words, hashes, long = _terms(part.column("text"))
            hashes, text = hashes[long], words.text[long]
            _, first = np.unique(A.keyed(hashes, text), return_index=True)
            each.append(hashes[first])
        terms, n = np.unique(np.concatenate(each), return_counts=True)
        yield pa.record_batch({"term": pa.array(terms.view(np.int64)), "n": pa.array(n.astype(np.int64))})


def _standing(batches: Iterator[pa.RecordBatch], bits: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The different terms of each text, outside base spans, that have a bit in the table, of rows that have one."""
    there = lambda batch: batch.filter(pa.array(in_table(np.asarray(batch.column("place")).view(U), rows)))
    for batch in _placed(map(there, batches), bits):
        places = pa.table([batch.column("row"), batch.column("term")], ["row", "term"])
        yield from places.group_by(["row", "term"]).aggregate([]).to_batches()


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


_PLACES = "doc_id long, row long, term long, s int, e int"


def _classes(rows: DataFrame, name: str, n: str) -> DataFrame:
    """name, class: values of equal n that stand in the same rows share a class. rows (row, name, n): each pair once.

    Values of fewer than SUPPORT rows can't have SUPPORT contexts and are left out.
    """
    same = [F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"), F.count("*").alias("rows")]
    return rows.groupBy(name, n).agg(*same).where(f"rows >= {SUPPORT}").select(name, F.xxhash64("x", "y", "rows", n).alias(f"{name}_class"))


def _disclosing(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """entity, term_class, n_entity, n_term, n_both, disclosure; and term, term_class. None: no entity has support.

    A page of many addresses and many rare terms would pair each with each. Copied lists and boilerplate stand in the
    same rows, so classes are paired, and the contexts of single entities are counted for the pairs that reach DISCLOSURE.
    """
    spark = docs.sparkSession
    seen = found.where("size(entities) > 0").select("row", F.explode("entities").alias("c")).select("row", "c.*")
    seen = seen.groupBy("row", "entity", "context").agg(F.count("*").alias("copies"))
    # An entity needs as much support as any of its terms.
    several = seen.select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("n")).where(f"n >= {SUPPORT}").select("entity")
    of_entity = seen.groupBy("entity").agg(F.sum("copies").alias("n_entity")).where(f"n_entity >= {SUPPORT}").join(several, "entity")
    seen = stored(seen.join(of_entity, "entity"))
    most, total = seen.agg(F.max("n_entity")).first()[0], docs.count()
    if not most:
        return None
    rarity = lambda n: F.pow(F.lit(float(total)), F.lit(1 - DISCLOSURE)) * F.pow(n, F.lit(DISCLOSURE)) * (1 + 1e-9)
    counts = docs.select("text").mapInArrow(_counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    rare = stored(counts.where(F.col("n_term").between(F.lit(SUPPORT), rarity(F.lit(float(most))))))
    bits = spark.sparkContext.broadcast(bit_table(rare, "term"))
    rows = spark.sparkContext.broadcast(bit_table(seen.select(F.xxhash64("row").alias("place")), "place"))
    texts = docs.select("doc_id", "row", "text", F.xxhash64("row").alias("place"))
    terms = texts.mapInArrow(lambda it: _standing(it, bits.value, rows.value), "row long, term long").distinct().join(rare.hint("merge"), "term")
    terms = stored(terms.join(seen.select("row").distinct().hint("merge"), "row", "left_semi"))
    of_term = stored(_classes(terms, "term", "n_term"))
    seen = stored(seen.join(_classes(seen, "entity", "n_entity").hint("merge"), "entity"))
    terms = stored(terms.join(of_term.hint("merge"), "term").select("row", "term_class", "n_term").distinct())
    listed = seen.select("row", "entity_class", "n_entity", "copies").distinct()
    both = terms.join(listed.hint("merge"), "row").where(F.col("n_term") <= rarity(F.col("n_entity")))
    both = both.groupBy("entity_class", "term_class", "n_entity", "n_term").agg(F.sum("copies").alias("n_both"), F.count("*").alias("rows")).where(f"rows >= {SUPPORT}")
    info = F.log(F.lit(float(total)) / F.col("n_entity"))
    told = F.log(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term"))) / info
    both = stored(both.where(F.col("n_entity") < total).withColumn("disclosure", told).where(F.col("disclosure") >= DISCLOSURE - 1e-9))
    places = both.join(terms.select("row", "term_class").hint("merge"), "term_class").join(seen.select("row", "entity_class", "entity", "context").hint("merge"), ["row", "entity_class"])
    known = ["entity", "term_class", "n_entity", "n_term", "n_both", "disclosure"]
    return places.groupBy(*known).agg(F.countDistinct("context").alias("contexts")).where(f"contexts >= {SUPPORT}").select(*known), of_term


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """entity, term, n_entity, n_term, n_both, disclosure: the terms that give an entity away. found: see find()."""
    told = _disclosing(docs, found)
    if told is None:
        return docs.sparkSession.createDataFrame([], "entity long, term long, n_entity long, n_term long, n_both long, disclosure double")
    return told[0].join(told[1].hint("merge"), "term_class").select("entity", "term", "n_entity", "n_term", "n_both", "disclosure")


def _telling(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """term and how much it tells of the entity that it tells most of."""
    told = _disclosing(docs, found)
    if told is None:
        return None
    return told[0].groupBy("term_class").agg(F.max("disclosure").alias("disclosure")).join(told[1].hint("merge"), "term_class").select("term", "disclosure")


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, row, base and all spans (kind number k, s, e), disclosure of the terms."""
    docs = _identified(docs)
    found = stored(docs.mapInArrow(_found, "doc_id long, row long, base array<struct<k:int,s:int,e:int>>, entities array<struct<entity:long,context:long>>"))
    empty = F.expr("cast(array() as array<struct<s:int,e:int,disclosure:double>>)")
    telling = _telling(docs, found)
    telling = None if telling is None else stored(telling)
    if telling is None or telling.isEmpty():
        return found.select("doc_id", "row", "base", empty.alias("terms"))
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(telling, "term"))
    places = docs.select("doc_id", "row", "text").mapInArrow(lambda it: _placed(it, shared.value), _PLACES).join(telling, "term")
    places = places.select("doc_id", "row", "s", "e", "disclosure").distinct()
    terms = places.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("s", "e", "disclosure"))).alias("terms"))
    terms = terms.select(F.col("doc_id").alias("id"), F.col("row").alias("of"), "terms")
    both = found.join(terms, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("of")), "left")
    return both.select("doc_id", "row", "base", F.coalesce("terms", empty).alias("terms"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term; one row a row of docs."""
    name = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"], x["e"])), ",")
    terms = F.transform("terms", lambda x: F.struct(F.lit(len(KINDS) - 1).alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    of_kind = lambda k: lambda x: x == k
    counts = [F.size(F.filter(F.col("base")["k"], of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:-1])]
    found = find(docs)
    return found.select("doc_id", *counts, F.sha2(text(F.sort_array("base")), 256).alias("base_sha256"), text(F.concat(F.sort_array("base"), terms)).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def shape(term: str) -> str:
    """The class that stands for a generalised term: its kind, and for numbers how many digits."""
    if term.isdigit():
        return f"[NUMBER {len(term)}]"
    if any(c.isdigit() for c in term):
        return "[CODE]"
    if term.isupper() and len(term) > 1:
        return "[ACRONYM]"
    return "[NAME]" if term[:1].isupper() else "[WORD]"


def replaced(text: str, base: list, terms: list) -> str:
    """text with a mark for each span: its kind, the shape of a generalised term, nothing for a removed one."""
    marks = [(x["s"], x["e"], f"[{KINDS[x['k']].upper()}]") for x in base]
    marks += [(x["s"], x["e"], "[]" if x["disclosure"] >= REMOVAL else shape(text[x["s"] : x["e"]])) for x in terms]
    out, at = [], 0
    for s, e, mark in sorted(marks):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("text", "__base", "__terms")))
        new = [t if t is None or not (b or x) else replaced(t, b or [], x or []) for t, b, x in rows]
        yield batch.drop_columns(["__base", "__terms"]).set_column(batch.schema.get_field_index("text"), "text", pa.array(new, pa.string()))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with every span replaced in text; all columns and rows."""
    found = find(docs).where("size(base) > 0 or size(terms) > 0").dropDuplicates(["doc_id", "row"])
    row = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    keys = docs.withColumn("__row", row).withColumn("__id", F.col("doc_id").cast("long"))
    found = found.select(F.col("doc_id").alias("__found"), F.col("row").alias("__of"), F.col("base").alias("__base"), F.col("terms").alias("__terms"))
    both = keys.join(found, F.col("__id").eqNullSafe(F.col("__found")) & (F.col("__row") == F.col("__of")), "left")
    both = both.select(*docs.columns, "__base", "__terms")
    return both.mapInArrow(_replaced, docs.schema)
