"""Labels from markers, entities from labels, labels from a user's predictor.

Scans that carry state along a document are windows over (doc_id, pos): the latest marker decides a label,
gaps and islands make entities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.functions import labels as L, markup
from citeloom.functions.arrays import tile_offsets
from citeloom.operators import tokens as T
from citeloom.sources.storage import bound_batches


def _doc():
    """The rows of a document in order."""
    return Window.partitionBy("doc_id").orderBy("pos")


def _so_far():
    return _doc().rowsBetween(Window.unboundedPreceding, 0)


MARKER = r"^\s*\[(BIBL|QUOTE|CIT)_(START|END)\]$"


def bio_labels(tokens: DataFrame) -> DataFrame:
    """tokens with label ('' on markers): after a START the first token is B-, the next I-; after an END O."""
    type_, side = F.regexp_extract("token", MARKER, 1), F.regexp_extract("token", MARKER, 2)
    rows = tokens.withColumn("marker", F.when(side == "START", type_).when(side == "END", F.lit("")))
    rows = rows.withColumn("state", F.last("marker", ignorenulls=True).over(_so_far())).withColumn("group", F.count("marker").over(_so_far()))
    rank = F.row_number().over(Window.partitionBy("doc_id", "group", F.col("marker").isNull()).orderBy("pos"))
    inside = F.col("state") != ""
    label = F.when(F.col("marker").isNotNull(), "").when(inside & (rank == 1), F.concat(F.lit("B-"), "state")).when(inside, F.concat(F.lit("I-"), "state")).otherwise("O")
    return rows.withColumn("label", label).select(*tokens.columns, "label")


def drop_markers(labelled: DataFrame) -> DataFrame:
    """Marker tokens out, positions counted anew; labels stay with their tokens."""
    rows = labelled.where("label <> ''")
    return rows.withColumn("pos", F.row_number().over(_doc()) - 1)


def labelled_arrays(docs: DataFrame, markers: dict | None = None) -> DataFrame:
    """doc_id, labelled: the tokens of a marked-up text without its markers, array<struct<start, end, token, label>>.

    The same as drop_markers(bio_labels(...)) of its tokens, inside a row: nothing is shuffled.
    """
    marked = _marked(docs, markers)
    schema = marked.select("doc_id", F.lit(None).cast("array<struct<start:int,end:int,token:string,label:string>>").alias("labelled")).schema
    return marked.mapInArrow(_labelled, schema)


def labelled_tokens(docs: DataFrame, markers: dict | None = None) -> DataFrame:
    """doc_id, pos, start, end, token, label of labelled_arrays, a row a token."""
    marked = _marked(docs, markers)
    schema = marked.select("doc_id", *(F.lit(None).cast(kind).alias(c) for c, kind in (("pos", "int"), ("start", "int"), ("end", "int"), ("token", "string"), ("label", "string")))).schema
    return marked.mapInArrow(lambda batches: map(_unnested, _labelled(batches)), schema)


def _marked(docs: DataFrame, markers: dict | None) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.where("text is not null").select("doc_id", F.regexp_extract_all(markup.to_markers(F.col("text"), markers or markup.MARKERS), F.lit(T.MARKED), F.lit(0)).alias("x"))


def _unnested(batch: pa.RecordBatch) -> pa.RecordBatch:
    held = batch.column("labelled")
    bounds, rows = np.asarray(held.offsets), held.flatten()
    n = np.diff(bounds)
    pos = np.arange(len(rows)) - np.repeat(bounds[:-1], n)
    ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), n)))
    return pa.record_batch([ids, pa.array(pos.astype(np.int32)), *(rows.field(c) for c in ("start", "end", "token", "label"))], ["doc_id", "pos", "start", "end", "token", "label"])


_STATES = ["", "BIBL", "QUOTE", "CIT"]
_NAMES = pa.array(["O", *(f"{side}-{kind}" for kind in _STATES[1:] for side in "BI")])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Tokens tile the text.
        tokens, bounds, start, end = tile_offsets(batch.column("x"))
        found = pc.extract_regex(tokens, r"^\s*\[(?P<kind>BIBL|QUOTE|CIT)_(?P<side>START|END)\]$")
        marker = np.asarray(found.is_valid())
        state = np.zeros(len(tokens), np.int64)
        at = np.flatnonzero(marker)
        state[at] = [_STATES.index(m["kind"]) if m["side"] == "START" else 0 for m in found.filter(pa.array(marker)).to_pylist()]
        # The latest marker of the document decides; the token after it begins.
        place = np.arange(len(tokens))
        latest = np.maximum.accumulate(np.where(marker, place, -1))
        inside = latest >= np.repeat(bounds[:-1], np.diff(bounds))
        kind = np.where(inside, state[np.maximum(latest, 0)], 0)
        label = np.where(kind > 0, 2 * kind - (latest == place - 1), 0)
        kept = np.flatnonzero(~marker)
        placed = lambda x: pa.array(x[kept].astype(np.int32))
        rows = pa.StructArray.from_arrays([placed(start), placed(end), tokens.take(pa.array(kept)), _NAMES.take(pa.array(label[kept]))], ["start", "end", "token", "label"])
        offsets = pa.array(np.searchsorted(kept, bounds).astype(np.int32))
        yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, rows)], ["doc_id", "labelled"])


def extraction_dataset(docs: DataFrame, max_length: int = 512, markers: dict | None = None) -> DataFrame:
    """One row a document: tokens, label_ids and attention_mask of max_length each; marked text in, no marker out."""
    wide = labelled_arrays(docs, markers).select("doc_id", F.slice("labelled", 1, max_length).alias("x")).where("size(x) > 0")
    ids = F.transform("x", lambda x: L.label_id(x["label"]))
    tokens = F.transform("x", lambda x: x["token"])
    return wide.select("doc_id", L.fit_length(tokens, max_length, "").alias("tokens"), L.fit_length(ids, max_length, L.IGNORED).alias("label_ids"), L.attention(tokens, max_length).alias("attention_mask"))


def argmax_labels(scores: DataFrame, column: str = "scores") -> DataFrame:
    return scores.withColumn("label_id", L.argmax(F.col(column)))


def label_windows(windows: DataFrame, predictor: Callable[[], Callable[[pd.Series], Iterable[Sequence[str]]]], size: int = 512) -> DataFrame:
    """windows (see tokens.windows) as a row a token: doc_id, window_idx, n, pos, start, end, token, label.

    predictor() is called once a task and gives a function from windows, a Series with the list of tokens of each,
    to their labels, a sequence for each window: windows are always whole. More than ``size`` tokens in a window are
    an error, as is another number of labels than tokens.
    """
    fine = F.assert_true(F.size("tokens") <= size, f"a window has more than {size} tokens")
    rows = windows.withColumn("fine", fine).where("fine is null").select("doc_id", "window_idx", "n", "first", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor()
        for batch in batches:
            held = batch.column("tokens")
            bounds, each = np.asarray(held.offsets) - held.offsets[0].as_py(), held.flatten()
            whole = lambda name: batch.column(name).to_numpy()
            start, end = (each.field(c).to_numpy() for c in ("start", "end"))
            for w, row, i, labels in _predicted(predict, each.field("token"), bounds[:-1], np.diff(bounds)):
                yield _label_rows(batch.column("doc_id"), w, whole("window_idx")[w], whole("n")[w], whole("first")[w] + i, start[row], end[row], each.field("token"), row, labels)

    bound_batches(windows.sparkSession)
    return rows.mapInArrow(run, _label_schema(rows))


def label_texts(docs: DataFrame, predictor: Callable[[], Callable[[pd.Series], Iterable[Sequence[str]]]], size: int = 512, stride: int = 256) -> DataFrame:
    """label_windows of the windows of whole texts (doc_id, text), cut and labelled in one pass: a token goes to its task once, not once
    a window."""
    if not 0 < stride <= size:
        raise ValueError("0 < stride <= size is needed")
    rows = docs.select("doc_id", F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0)).alias("x")).where("x is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor()
        for batch in batches:
            tokens, bounds, start, end = tile_offsets(batch.column("x"))
            n = np.diff(bounds)
            doc, idx, at, length = _windows_of(bounds, size, stride)
            for w, row, i, labels in _predicted(predict, tokens, at, length):
                d = doc[w]
                yield _label_rows(batch.column("doc_id"), d, idx[w], n[d], row - bounds[d], start[row], end[row], tokens, row, labels)

    bound_batches(docs.sparkSession)
    return rows.mapInArrow(run, _label_schema(rows))


#: Tokens of the windows that a predictor sees at once, but for one longer window.
AT_ONCE = 1 << 16


def _windows_of(bounds: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of lists with these bounds: its list, its number there, its first place, and how long it is."""
    n = np.diff(bounds)
    k = -(-n // stride)
    doc = np.repeat(np.arange(len(n)), k)
    idx = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
    return doc, idx, bounds[doc] + idx * stride, np.minimum(size, n[doc] - idx * stride)


def _predicted(predict: Callable, tokens: pa.Array, at: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """Windows that begin at places of tokens, some at a time: of each of their tokens its window, its place, its number in the
    window, and the label."""
    words = tokens.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(length) // AT_ONCE)) + 1
    for some in np.split(np.arange(len(at)), cuts):
        if not len(some):
            continue
        windows = np.empty(len(some), object)
        for k, w in enumerate(some):
            windows[k] = words[at[w] : at[w] + length[w]]
        labels = [list(x) for x in predict(pd.Series(windows))]
        if [len(x) for x in labels] != length[some].tolist():
            raise ValueError("a predictor must give each token of a window a label")
        w = np.repeat(some, length[some])
        i = np.arange(len(w)) - np.repeat(np.cumsum(length[some]) - length[some], length[some])
        yield w, at[w] + i, i, list(chain.from_iterable(labels))


_LABEL_COLUMNS = {"window_idx": "int", "n": "int", "pos": "int", "start": "int", "end": "int", "token": "string", "label": "string"}


def _label_schema(rows: DataFrame):
    return rows.select("doc_id", *(F.lit(None).cast(kind).alias(c) for c, kind in _LABEL_COLUMNS.items())).schema


def _label_rows(ids: pa.Array, mine: np.ndarray, window_idx, n, pos, start, end, tokens: pa.Array, row: np.ndarray, labels: list) -> pa.RecordBatch:
    whole = [pa.array(x.astype(np.int32)) for x in (window_idx, n, pos, start, end)]
    return pa.record_batch([ids.take(pa.array(mine)), *whole, tokens.take(pa.array(row)), pa.array(labels, pa.string())], ["doc_id", *_LABEL_COLUMNS])


def decode_entities(labelled: DataFrame, mode: str = "insert") -> DataFrame:
    """doc_id, start, end, type of the entities in (doc_id, pos, start, end, label).

    B- opens; I- extends the open entity and opens one if none is. mode "chunk": a type that changes opens a new
    entity too; mode "insert": I- extends whatever is open, and the first label gives the type.
    """
    before = F.lag("label", 1, "O").over(_doc())
    opens = (L.prefix(F.col("label")) == "B") | (L.prefix(before) == "O")
    if mode == "chunk":
        opens |= L.kind(before) != L.kind(F.col("label"))
    rows = labelled.withColumn("opens", (opens & (F.col("label") != "O")).cast("int"))
    rows = rows.withColumn("island", F.sum("opens").over(_so_far())).where("label <> 'O'")
    out = rows.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(L.kind(F.col("label")), "pos").alias("type"))
    return out.drop("island")


def resolve_against_existing(predicted: DataFrame, existing: DataFrame) -> DataFrame:
    """predicted (doc_id, pos, start, end, label) with label O where an existing span (doc_id, start, end, type) wins.

    A token that overlaps a span is dropped, so is one that follows a span of its own type at once, and with a
    dropped B- its I- tail. Spans are spread over blocks, so a token meets only those near it.
    """
    block = 256
    spans = existing.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), "type").distinct()
    spans = spans.withColumn("block", F.explode(F.expr(f"sequence(s div {block}, e div {block})")))
    near = predicted.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, greatest(end - 1, start) div {block})"))).join(spans, ["doc_id", "block"])
    hit = near.where((F.expr("s < end and start < e")) | ((F.col("e") == F.col("start")) & (F.col("type") == L.kind(F.col("label")))))
    hit = hit.where("label <> 'O'").select("doc_id", "pos").distinct().withColumn("hit", F.lit(1))
    rows = predicted.join(hit, ["doc_id", "pos"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    # A dropped B- starts the skipping of I-; any kept B- or O ends it.
    state = F.when((L.prefix(F.col("label")) == "B") & (F.col("hit") == 1), 1).when(L.prefix(F.col("label")) != "I", 0)
    rows = rows.withColumn("skip", F.coalesce(F.last(state, ignorenulls=True).over(_so_far()), F.lit(0)))
    gone = (F.col("hit") == 1) | ((F.col("skip") == 1) & (L.prefix(F.col("label")) == "I"))
    return rows.withColumn("label", F.when(gone, "O").otherwise(F.col("label"))).select(*predicted.columns)


def resolve_arrays(rows: DataFrame) -> DataFrame:
    """resolve_against_existing inside rows: of (doc_id, tokens: array of strings that tile a text; labels: array of strings; spans: array of
    structs start, end, type) doc_id, pos, start, end, label. Nothing is shuffled."""
    schema = rows.select("doc_id", *(F.lit(None).cast(_LABEL_COLUMNS[c]).alias(c) for c in ("pos", "start", "end", "label"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, bounds, start, end = tile_offsets(batch.column("tokens"))
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            codes, names = pd.factorize(batch.column("labels").flatten().to_numpy(zero_copy_only=False))
            names, codes = _resolved(doc, start, end, codes, names, batch.column("spans"))
            whole = [pa.array(x.astype(np.int32)) for x in (np.arange(len(doc)) - bounds[doc], start, end)]
            yield pa.record_batch([batch.column("doc_id").take(pa.array(doc)), *whole, pa.array(names, pa.string()).take(pa.array(codes))], schema.names)

    bound_batches(rows.sparkSession)
    return rows.select("doc_id", "tokens", "labels", "spans").where("tokens is not null").mapInArrow(run, schema)


def _resolved(doc: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray, names: np.ndarray, spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Labels, as codes of names, of the tokens of documents that stand one after the other, where spans of the documents win."""
    names = np.append(np.asarray(names, object), "O")
    prefix, kind = (np.array([x[cut] for x in names], object) for cut in (slice(0, 1), slice(2, 18)))
    bounds, each = np.asarray(spans.offsets) - spans.offsets[0].as_py(), spans.flatten()
    of = np.repeat(np.arange(len(spans)), np.diff(bounds))
    # Documents one behind the other on one axis: a span meets tokens that stand side by side.
    far = lambda doc, x: doc * (1 << 32) + x
    s, e = (far(of, each.field(c).to_numpy().astype(np.int64)) for c in ("start", "end"))
    left, right = far(doc, start), far(doc, end)
    first, last = np.searchsorted(right, s, "right"), np.searchsorted(left, e, "left")
    meets = first < last
    covered = np.zeros(len(doc) + 1, np.int64)
    np.add.at(covered, first[meets], 1)
    np.add.at(covered, last[meets], -1)
    hit = np.cumsum(covered[:-1]) > 0
    # One that follows a span of its own type at once.
    after = np.flatnonzero((last < len(doc)) & (np.append(left, -1)[np.minimum(last, len(doc))] == e))
    same = kind[codes[last[after]]] == each.field("type").to_numpy(zero_copy_only=False)[after]
    hit[last[after][same]] = True
    hit &= names[codes] != "O"
    # A dropped B- starts the skipping of I-; any kept B- or O ends it, and the document's start.
    side = prefix[codes]
    place = np.arange(len(doc))
    begins = np.maximum.accumulate(np.where(np.append(True, doc[1:] != doc[:-1])[: len(doc)], place, 0))
    told = np.maximum.accumulate(np.where((side == "B") & hit | (side != "I"), place, -1))
    skip = (told >= begins) & (hit & (side == "B"))[np.maximum(told, 0)]
    return names, np.where(hit | skip & (side == "I"), len(names) - 1, codes)


def find_entities(rows: DataFrame, predictor: Callable[[], Callable[[pd.Series], Iterable[Sequence[str]]]], size: int = 512, stride: int = 256) -> DataFrame:
    """doc_id, start, end, type of the entities that a predictor finds in (doc_id, x: see lexing.tiles, spans: array of structs start,
    end, type), shrunk past blanks; blank ones are left out.

    The same as label_windows of what stands between markup, merge_window_labels, resolve_against_existing, decode_entities
    ("insert") and trim_spans, inside a row: nothing is shuffled, no token leaves its task.
    """
    schema = rows.select("doc_id", *(F.lit(None).cast(kind).alias(c) for c, kind in (("start", "int"), ("end", "int"), ("type", "string")))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor()
        for batch in batches:
            strings, bounds, start, end = tile_offsets(batch.column("x"))
            kept = np.flatnonzero(~pc.starts_with(strings, "<").to_numpy(zero_copy_only=False))
            tokens, bounds, start, end = strings.take(pa.array(kept)), np.searchsorted(kept, bounds), start[kept], end[kept]
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            labels = np.full(len(tokens), None, object)
            mine, idx, at, length = _windows_of(bounds, size, stride)
            for w, row, _, found in _predicted(predict, tokens, at, length):
                d = mine[w]
                own = np.flatnonzero(idx[w] == _owner(row - bounds[d], np.diff(bounds)[d], size, stride))
                labels[row[own]] = np.fromiter(found, object, len(found))[own]
            names, codes = _resolved(doc, start, end, *pd.factorize(labels), batch.column("spans"))
            s, e, kind, d = _entities(doc, start, end, tokens.to_numpy(zero_copy_only=False), names, codes)
            yield pa.record_batch([batch.column("doc_id").take(pa.array(d)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(kind, pa.string())], schema.names)

    bound_batches(rows.sparkSession)
    return rows.select("doc_id", "x", "spans").where("x is not null").mapInArrow(run, schema)


def _owner(pos: np.ndarray, n: np.ndarray, size: int, stride: int) -> np.ndarray:
    """tokens.owner."""
    h = (size - stride) // 2
    short = np.where(n < size, 0, (n - size) // stride + 1)
    return np.where(short == 0, 0, np.where(pos >= stride * short + h, short, np.maximum(0, (pos - h) // stride)))


def _entities(doc: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray, names: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """decode_entities ("insert") and trim_spans of the tokens of documents that stand one after the other."""
    side, outside = np.array([x[:1] for x in names], object)[codes], (names == "O")[codes]
    before = np.append("O", side[:-1])[: len(side)]
    before[np.append(True, doc[1:] != doc[:-1])[: len(doc)]] = "O"
    opens = ~outside & ((side == "B") | (before == "O"))
    first, inside = np.flatnonzero(opens), np.flatnonzero(~outside)
    last = inside[np.searchsorted(np.cumsum(opens)[inside], np.arange(1, len(first) + 1), "right") - 1]
    blank = " \t\n\x0b\x0c\r"
    s = start[first] + np.array([len(x) - len(x.lstrip(blank)) for x in words[first]], np.int64)
    # Only a token at the end of a text, or before markup, is all blank.
    e = np.where(np.array([not x.strip(blank) for x in words[last]], bool), start[last], end[last])
    full = s < e
    return s[full], e[full], [names[k][2:18] for k in codes[first[full]]], doc[first[full]]


def render(docs: DataFrame, spans: DataFrame, tags: dict[str, str] | None = None) -> DataFrame:
    """doc_id, text with a tag pair for each span (doc_id, start, end, type[, attrs]).

    Events at one offset: inner ends before outer, then empty spans, then outer starts before inner. tags:
    type -> element name, lower-case type by default. Crossing spans give crossing tags (see drop_crossing).
    """
    names = F.lower("type") if tags is None else F.element_at(F.create_map(*(F.lit(x) for pair in tags.items() for x in pair)), F.col("type"))
    attrs = F.col("attrs") if "attrs" in spans.columns else F.lit("")
    spans = spans.select("doc_id", "start", "end", names.alias("name"), F.coalesce(attrs, F.lit("")).alias("attrs"))
    empty = F.col("start") == F.col("end")
    opening, closing = F.concat(F.lit("<"), "name", "attrs", F.lit(">")), F.concat(F.lit("</"), "name", F.lit(">"))
    starts = spans.select("doc_id", F.col("start").alias("at"), F.when(empty, 1).otherwise(2).alias("turn"), (-F.col("end")).alias("inner"), "name", F.when(empty, F.concat(opening, closing)).otherwise(opening).alias("tag"))
    ends = spans.where(~empty).select("doc_id", F.col("end").alias("at"), F.lit(0).alias("turn"), (-F.col("start")).alias("inner"), F.col("name"), closing.alias("tag"))
    # Equal spans nest by name, so they must close the other way round.
    order = F.struct("turn", "inner", F.when(F.col("turn") == 0, F.translate("name", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba")).otherwise(F.col("name")).alias("nested"), "tag")
    at = starts.union(ends).groupBy("doc_id", "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["tag"]), "").alias("tags"))
    cuts = at.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "tags"))).alias("cuts"))
    rows = docs.select("doc_id", "text").join(cuts, "doc_id", "left")
    first = F.coalesce(F.get(F.col("cuts"), F.lit(0))["at"], F.length("text"))

    def piece(x: Column, i: Column) -> Column:
        following = F.coalesce(F.get(F.col("cuts"), i + 1)["at"], F.length("text"))
        return F.concat(x["tags"], F.substring(F.col("text"), x["at"] + 1, following - x["at"]))

    body = F.coalesce(F.array_join(F.transform("cuts", piece), ""), F.lit(""))
    return rows.select("doc_id", F.concat(F.substring(F.col("text"), F.lit(1), first), body).alias("text"))


def trim_spans(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans shrunk past leading and trailing blanks; blank ones end up empty at their old end."""
    both = spans.join(docs.select("doc_id", "text"), "doc_id")
    s, e = markup.trimmed_start(F.col("text"), F.col("start"), F.col("end")), markup.trimmed_end(F.col("text"), F.col("start"), F.col("end"))
    return both.withColumns({"start": s, "end": e}).select(*spans.columns)


def insert_tags(docs: DataFrame, spans: DataFrame, tags: dict[str, str] | None = None) -> DataFrame:
    """Spans are trimmed first; those of blanks alone are left out."""
    kept = spans.where("start = end").union(trim_spans(spans.where("start < end"), docs).where("start < end"))
    return render(docs, kept, tags)


def align_arrays(rows: DataFrame) -> DataFrame:
    """rows (tokens: array of structs with pos, start, end, ...; predicted: array of structs start, end, label; others) with
    labels, an array: one for each token, in their order. Both arrays tile the same text.

    A token takes the label of the predicted token that shares most characters with it (ties: the first), 'O' where
    none does. Where several tokens share one predicted token, the first of them by pos begins its entity and the others
    go on with it. All is done inside a row: nothing is shuffled.
    """
    schema = rows.select("*", F.lit(None).cast("array<string>").alias("labels")).schema
    return rows.mapInArrow(_aligned, schema)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = []
        for tokens, predicted in zip(batch.column("tokens"), batch.column("predicted")):
            places = [tokens.values.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "start", "end")] if tokens.is_valid else None
            other = [predicted.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end", "label")] if predicted.is_valid else [None] * 3
            labels.append(None if places is None else _labels_of(*places, *other))
        yield pa.record_batch([*batch.columns, pa.array(labels, pa.list_(pa.string()))], [*batch.schema.names, "labels"])


def _labels_of(pos: np.ndarray, start: np.ndarray, end: np.ndarray, s: np.ndarray | None, e: np.ndarray | None, label: np.ndarray | None) -> np.ndarray:
    out = np.full(len(pos), "O", object)
    if s is None:
        return out
    full = np.flatnonzero(s < e)
    full = full[np.lexsort((e[full], s[full]))]
    s, e, label = s[full], e[full], label[full]
    # The predicted tokens that a token meets stand side by side.
    first, last = np.searchsorted(e, start, "right"), np.searchsorted(s, end, "left")
    n = np.where(start < end, np.maximum(last - first, 0), 0)
    mine = np.repeat(np.arange(len(pos)), n)
    other = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    shared = np.minimum(end[mine], e[other]) - np.maximum(start[mine], s[other])
    order = np.lexsort((other, -shared, mine))
    met, at = np.unique(mine[order], return_index=True)
    best = other[order][at]
    out[met] = label[best]
    in_order = np.argsort(pos[met], kind="stable")
    again = np.ones(len(met), bool)
    again[in_order[np.unique(best[in_order], return_index=True)[1]]] = False
    for i in met[again]:
        if out[i] is not None and out[i].startswith("B-"):
            out[i] = "I-" + out[i][2:]
    return out


def align_predictions(tokens: DataFrame, predicted: DataFrame) -> DataFrame:
    """tokens (doc_id, pos, start, end, ...) with label, from predicted (doc_id, start, end, label), made with other bounds:
    see align_arrays. Each table is brought together once, by its documents."""
    held = lambda of, columns, name: of.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias(name))
    more = [c for c in tokens.columns if c not in ("doc_id", "label")]
    both = held(tokens, more, "tokens").join(held(predicted, ("start", "end", "label"), "predicted"), "doc_id", "left")
    rows = align_arrays(both).select("doc_id", F.explode(F.arrays_zip("tokens", "labels")).alias("x"))
    return rows.select("doc_id", *(F.col(f"x.tokens.{c}").alias(c) for c in more), F.coalesce("x.labels", F.lit("O")).alias("label"))
