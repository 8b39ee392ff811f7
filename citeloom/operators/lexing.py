"""Markup as rows: pieces that tile a document, spans of named elements, rebuilt text.

A total pattern cuts a document into pieces; offsets are running sums of lengths inside the document's row, in
code points, so nothing is shuffled for them. Nothing is parsed or re-serialised, so every operator keeps the source text as it is, and unbalanced
markup is no error. Input: (doc_id, text); a null text has no piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.functions import markup
from citeloom.functions.arrays import let, running_ends, tile_offsets, tiled
from citeloom.operators.tokens import token_array
from citeloom.sources.storage import bound_batches

#: comment | CDATA | instruction | script | style | tag | text | a lone bracket
PIECE = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>|[^<]+|<"
NAME = r"^</?([A-Za-z_][A-Za-z0-9_.:-]*)"


def _doc():
    """The rows of a document in order."""
    return Window.partitionBy("doc_id").orderBy("pos")


def kind_of(piece: Column) -> Column:
    """comment, cdata, instruction, raw (script, style), open, close, selfclose or text."""
    tag = piece.rlike(r"^</?[A-Za-z_]")
    return (
        F.when(piece.startswith("<!--"), "comment")
        .when(piece.startswith("<![CDATA["), "cdata")
        .when(piece.startswith("<?") | piece.rlike("^<!"), "instruction")
        .when(piece.rlike(r"^<(?:script|style)\b") & (F.length(piece) - F.length(F.replace(piece, F.lit("<"), F.lit(""))) > 1), "raw")
        .when(tag & piece.startswith("</"), "close")
        .when(tag & piece.endswith("/>"), "selfclose")
        .when(tag & piece.endswith(">"), "open")
        .otherwise("text")
    )


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def piece_array(text: Column) -> Column:
    """array<struct<start, end, piece>> of a text."""
    placed = lambda piece, end: F.struct((end - F.length(piece)).alias("start"), end.alias("end"), piece.alias("piece"))
    return let(pieces(text), lambda x: F.zip_with(x, running_ends(F.transform(x, F.length)), placed))


def markup_events(docs: DataFrame) -> DataFrame:
    """doc_id, pos, start, end, kind, name ('' but for tags; lower case), piece."""
    rows = tiled(docs, pieces(F.col("text")), "piece").withColumn("kind", kind_of(F.col("piece")))
    tag = F.col("kind").isin("open", "close", "selfclose")
    name = F.when(tag, F.lower(F.regexp_extract("piece", NAME, 1))).otherwise("")
    return rows.select("doc_id", "pos", "start", "end", "kind", name.alias("name"), "piece")


def without_tags(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """doc_id, text without the tags of these elements."""
    name = lambda x: F.lower(F.regexp_extract(x, NAME, 1))
    kept = F.filter("x", lambda x: ~x.startswith("<") | ~name(x).isin(*names) | (kind_of(x) == "raw"))
    return docs.select("doc_id", pieces(F.col("text")).alias("x")).where("size(x) > 0").select("doc_id", F.array_join(kept, "").alias("text"))


def paired(tags: DataFrame, *keep: str) -> DataFrame:
    """tags (doc_id, pos, kind, name, ...) with twin, for closing tags the columns keep of the opening tag that they
    pair with.

    A closing tag pairs with the nearest open one of its name that is unpaired: the two stand next to each other
    among the tags of one name and depth. Unpaired tags are left out, so are opening ones.
    """
    step = F.when(F.col("kind") == "open", 1).otherwise(-1)
    by_name = Window.partitionBy("doc_id", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tags = tags.where("kind in ('open', 'close')").withColumn("level", F.sum(step).over(by_name) + F.when(F.col("kind") == "close", 1).otherwise(0))
    twin = F.lag(F.struct("kind", *keep)).over(Window.partitionBy("doc_id", "name", "level").orderBy("pos"))
    return tags.withColumn("twin", twin).where("kind = 'close' and twin.kind = 'open'").drop("level")


def spans_of(events: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """doc_id, start, end, type, attrs of these elements, in offsets of the text without their tags.

    Unpaired tags give no span (see paired), self-closing ones an empty span. Only these tags are shuffled.
    """
    kinds = F.create_map(*(F.lit(x) for pair in types.items() for x in pair))
    tags = events.where(F.col("name").isin(*types)).withColumn("type", F.element_at(kinds, F.col("name")))
    gone = F.sum(F.length("piece")).over(_doc().rowsBetween(Window.unboundedPreceding, -1))
    tags = tags.withColumn("at", (F.col("start") - F.coalesce(gone, F.lit(0))).cast("int"))
    both = paired(tags, "at", "piece").select("doc_id", F.col("twin.at").alias("start"), F.col("at").alias("end"), "type", markup.attributes(F.col("twin.piece")).alias("attrs"))
    alone = tags.where("kind = 'selfclose'").select("doc_id", F.col("at").alias("start"), F.col("at").alias("end"), "type", markup.attributes(F.col("piece")).alias("attrs"))
    return both.union(alone)


def spans_in_rows(docs: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """doc_id, text without the tags of these elements, spans: array<struct<start, end, type, attrs>> as spans_of gives them.

    Markup is looked at once, inside a document's row: nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", pieces(F.col("text")).alias("x")).where("size(x) > 0")
    schema = rows.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<struct<start:int,end:int,type:string,attrs:string>>").alias("spans")).schema
    cased = lambda name: "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c) for c in name)
    tag = rf"^</?(?:{'|'.join(map(cased, types))})(?:[^A-Za-z0-9_.:-]|$)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings, bounds, start, _ = tile_offsets(batch.column("x"))
            words = strings.to_numpy(zero_copy_only=False)
            raw = lambda x: x.count("<") > 1 and re.match(r"<(?:script|style)\b", x)
            tags = [i for i in np.flatnonzero(pc.match_substring_regex(strings, tag).to_numpy(zero_copy_only=False)) if not raw(words[i])]
            mine = np.split(np.array(tags, np.int64), np.searchsorted(tags, bounds[1:-1]))
            spans = [_spans_of_tags([(start[i], words[i]) for i in x], types) for x in mine]
            words[tags] = ""
            text = pa.array(["".join(words[a:z]) for a, z in zip(bounds[:-1], bounds[1:])], pa.string())
            each = list(zip(*chain.from_iterable(spans))) or [()] * 4
            columns = [pa.array(x, kind) for x, kind in zip(each, (pa.int32(), pa.int32(), pa.string(), pa.string()))]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in spans])]).astype(np.int32))
            held = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["start", "end", "type", "attrs"]))
            yield pa.record_batch([batch.column("doc_id"), text, held], schema.names)

    return rows.mapInArrow(run, schema)


_ATTRS = re.compile(r"<[A-Za-z_][A-Za-z0-9_.:-]*(\s.*?)?\s*/?>\Z", re.S | re.A)


def _spans_of_tags(tags: Sequence[tuple[int, str]], types: Mapping[str, str]) -> list[tuple[int, int, str, str]]:
    """Spans of a document's tags (start, piece) that are taken out of it; see paired."""
    attrs = lambda piece: (m.group(1) or "") if (m := _ATTRS.match(piece)) else ""
    out, gone, waiting = [], 0, {}
    for start, piece in tags:
        name = re.match(NAME, piece).group(1).lower()
        at = int(start) - gone
        gone += len(piece)
        if piece.startswith("</"):
            if waiting.get(name):
                before, opening = waiting[name].pop()
                out.append((before, at, types[name], attrs(opening)))
        elif piece.endswith("/>"):
            out.append((at, at, types[name], attrs(piece)))
        else:
            waiting.setdefault(name, []).append((at, piece))
    return out


def strip_with_spans(docs: DataFrame, types: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text without these tags) and their spans."""
    rows = spans_in_rows(docs, types)
    return rows.select("doc_id", "text"), rows.select("doc_id", F.inline("spans"))


def drop_splitting(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """spans (of the text of docs) without those that hold one tag of an element and not the other.

    The join is by document and block of code points: a span is in all blocks that it covers, a tag in one.
    """
    block = 512
    tags = paired(markup_events(docs), "start").select("doc_id", F.col("twin.start").alias("a"), F.col("start").alias("z"))
    tags = tags.select("doc_id", F.col("a").alias("at"), F.col("z").alias("other")).union(tags.select("doc_id", "z", "a")).withColumn("block", F.expr(f"at div {block}"))
    rows = spans.withColumn("sid", F.xxhash64("doc_id", "start", "end", "type"))
    look = rows.where("start < end").select("doc_id", "sid", "start", "end", F.explode(F.expr(f"sequence(start div {block}, (end - 1) div {block})")).alias("block"))
    bad = look.join(tags, ["doc_id", "block"]).where("start <= at and at < end and not (start <= other and other < end)").select("doc_id", "sid").distinct()
    return rows.join(bad, ["doc_id", "sid"], "left_anti").select(*spans.columns)


def tiles(text: Column, pattern: str) -> Column:
    """Strings that tile a text: pieces of markup, which begin with <, and the tokens of what stands between."""
    each = lambda x: F.when(x.startswith("<"), F.array(x)).otherwise(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)))
    return F.flatten(F.transform(pieces(text), each))


def text_tokens(text: Column, pattern: str) -> Column:
    """array<struct<start, end, token>> of what stands between markup: no token is, or reaches into, a piece of it."""
    none = F.expr("cast(array() as array<struct<start: int, end: int, token: string>>)")
    each = lambda x: F.when(x["piece"].startswith("<"), none).otherwise(token_array(x["piece"], pattern, x["start"]))
    return F.flatten(F.transform(piece_array(text), each))


def snap_spans(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Span ends that lie inside markup moved out of it, inwards; spans that vanish are dropped.

    The join is by document and block of BLOCK code points: each piece of markup is put in the blocks that it
    touches, so a span's end meets the pieces of one block only.
    """
    block = 256
    tags = markup_events(docs).where("kind <> 'text'").select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"))
    tags = tags.withColumn("block", F.explode(F.expr(f"sequence(s div {block}, (e - 1) div {block})")))
    spans = spans.withColumn("sid", F.xxhash64("doc_id", "start", "end", "type"))
    # An end is exclusive: its last character is what may lie inside markup.
    starts = spans.withColumn("block", F.expr(f"start div {block}")).join(tags, ["doc_id", "block"], "left")
    starts = starts.groupBy("doc_id", "sid", "start", "end", "type").agg(F.max(F.when(F.expr("s < start and start < e"), F.col("e"))).alias("to"))
    ends = starts.withColumn("block", F.expr(f"greatest(end - 1, 0) div {block}")).join(tags, ["doc_id", "block"], "left")
    ends = ends.groupBy("doc_id", "sid", "start", "end", "type", "to").agg(F.min(F.when(F.expr("s < end and end < e"), F.col("s"))).alias("back"))
    out = ends.select("doc_id", F.coalesce("to", "start").alias("start"), F.coalesce("back", "end").alias("end"), "type")
    return out.where("start < end")
