"""Neighbouring, paired and crossing spans; whole corpora tagged. Spans: (doc_id, start, end, type, attrs)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.functions import markup
from citeloom.operators import labelling, lexing, tokens as T
from citeloom.sources.storage import bound_batches, stored


def _with_joins(rows: DataFrame, docs: DataFrame, max_gap: int | None) -> DataFrame:
    """rows (doc_id, start, before, ...) with joins: nothing, or blanks alone, stand in the text from before to start.

    A text goes to its document's gaps, all of them in one row, not to each span.
    """
    rows = stored(rows)
    gap = F.col("start") - F.col("before")
    near = gap >= 0 if max_gap is None else (gap >= 0) & (gap <= max_gap)
    asked = rows.where(near & (gap > 0)).groupBy("doc_id").agg(F.collect_set(F.struct("before", "start")).alias("gaps"))
    blank = lambda x: markup.slice_text(F.col("text"), x["before"], x["start"]).rlike(rf"^{markup.BLANK}*$")
    blanks = asked.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.inline(F.filter("gaps", blank))).withColumn("blank", F.lit(True))
    found = rows.join(blanks, ["doc_id", "before", "start"], "left")
    return found.withColumn("joins", F.coalesce(near & ((gap == 0) | F.col("blank")), F.lit(False))).drop("blank")


def merge_adjacent(spans: DataFrame, docs: DataFrame, max_gap: int | None = None) -> DataFrame:
    """Neighbours of one type with blanks alone between become one span, again and again; it takes the first's
    attributes and covers the gaps. Spans of one type must not overlap."""
    by = Window.partitionBy("doc_id", "type").orderBy("start", "end")
    rows = _with_joins(spans.withColumn("before", F.lag("end").over(by)), docs, max_gap)
    rows = rows.withColumn("island", F.sum((~F.col("joins")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("doc_id", "type", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("attrs", F.struct("start", "end")).alias("attrs"))
    return out.select("doc_id", "start", "end", "type", "attrs")


def wrap_pairs(spans: DataFrame, docs: DataFrame, pair: tuple[str, str] = ("BIBL", "QUOTE"), outer: str = "CIT", max_gap: int | None = None) -> DataFrame:
    """The new outer spans: around two neighbours, one of each type, with blanks alone between, taken greedily from
    the left, unless an outer span is around either already.

    In a run of neighbours that alternate, the 1st takes the 2nd, the 3rd the 4th, and so on.
    """
    covers = spans.where(F.col("type") == outer).select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"))
    inner = spans.where(F.col("type").isin(*pair)).withColumn("sid", F.struct("start", "end", "type"))
    block = 256
    covers = covers.withColumn("block", F.explode(F.expr(f"sequence(s div {block}, e div {block})")))
    taken = inner.withColumn("block", F.expr(f"start div {block}")).join(covers, ["doc_id", "block"]).where("s <= start and end <= e").select("doc_id", "sid").distinct()
    free = inner.join(taken, ["doc_id", "sid"], "left_anti").drop("sid")
    by = Window.partitionBy("doc_id").orderBy("start", "end", "type")
    rows = _with_joins(free.withColumn("before", F.lag("end").over(by)).withColumn("other", F.lag("type").over(by)), docs, max_gap)
    goes_on = F.col("joins") & F.coalesce(F.col("other") != F.col("type"), F.lit(False))
    rows = rows.withColumn("run", F.sum((~goes_on).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("turn", F.expr("(row_number() over (partition by doc_id, run order by start, end, type) - 1) div 2"))
    out = rows.groupBy("doc_id", "run", "turn").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).where("n = 2")
    return out.select("doc_id", "start", "end", F.lit(outer).alias("type"), F.lit("").alias("attrs"))


def nested_arrays(rows: DataFrame) -> DataFrame:
    """rows (doc_id, spans: array of structs start, end, type, ...) without the spans that cross a kept one before them, in order of
    start, then the longer, then type. Nothing is shuffled.

    Kept spans are nested, so of those that are open at a start the last ends first: if it ends inside the span, the
    span crosses.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("spans")
            bounds, each = np.asarray(held.offsets) - held.offsets[0].as_py(), held.flatten()
            start, end = (each.field(c).to_numpy().astype(np.int64) for c in ("start", "end"))
            kind = pd.factorize(each.field("type").to_numpy(zero_copy_only=False), sort=True)[0]
            doc = np.repeat(np.arange(len(held)), np.diff(bounds))
            order = np.lexsort((kind, -end, start, doc))
            keep, last, ends = [], -1, []
            for i, d, s, e in zip(order.tolist(), doc[order].tolist(), start[order].tolist(), end[order].tolist()):
                if d != last:
                    last, ends = d, []
                while ends and ends[-1] <= s:
                    ends.pop()
                if not ends or ends[-1] >= e:
                    ends.append(e)
                    keep.append(i)
            offsets = pa.array(np.searchsorted(doc[keep], np.arange(len(held) + 1)).astype(np.int32))
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, each.take(pa.array(keep, pa.int64())))], ["doc_id", "spans"])

    bound_batches(rows.sparkSession)
    rows = rows.select("doc_id", "spans")
    return rows.mapInArrow(run, rows.schema)


def _nested(spans: DataFrame) -> DataFrame:
    """spans without those that nested_arrays drops. A document's spans are brought together once."""
    each = [c for c in spans.columns if c != "doc_id"]
    held = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*each)).alias("spans"))
    return nested_arrays(held).select("doc_id", F.inline("spans")).select(*spans.columns)


def drop_crossing(spans: DataFrame, first: str | None = None) -> DataFrame:
    """spans without those that cross (s1 < s2 < e1 < e2) one that is kept and comes before them.

    They're decided in order: those that have ``first`` (a column of booleans), then by start, then the longer, then
    type. A span that was dropped drops no other.
    """
    spans = spans.withColumns({c: F.col(c).cast("int") for c in ("start", "end")})
    if first is None:
        return _nested(spans)
    before = stored(_nested(spans.where(F.col(first))))
    # A span crosses another if just one end of either lies inside the other; ends are looked up by blocks.
    block = 512
    rows = spans.where(~F.coalesce(F.col(first), F.lit(False))).withColumn("sid", F.xxhash64("doc_id", "start", "end", "type"))
    ends = before.where("start < end").select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"))
    ends = ends.select("doc_id", "s", "e", F.explode(F.array("s", "e")).alias("at")).withColumn("block", F.expr(f"at div {block}"))
    look = rows.where("start < end").select("doc_id", "sid", "start", "end").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, end div {block})")))
    crosses = "s < start and start < e and e < end or start < s and s < end and end < e"
    bad = look.join(ends, ["doc_id", "block"]).where(crosses).select("doc_id", "sid").distinct()
    return before.unionByName(_nested(rows.join(bad, ["doc_id", "sid"], "left_anti").select(*spans.columns)))


def post_process(docs: DataFrame, spans: DataFrame, first: str | None = None) -> DataFrame:
    """Crossing spans out (see drop_crossing), neighbours merged, pairs wrapped: all spans of the result."""
    merged = stored(merge_adjacent(drop_crossing(spans, first), docs))
    return merged.unionByName(wrap_pairs(merged, docs))


def tag_corpus(docs: DataFrame, predictor: Callable, types: Mapping[str, str], preserve_existing: bool = True, size: int = 512, stride: int = 256) -> DataFrame:
    """doc_id, text with the tags that the predictor's labels give, in every document.

    Existing tags of these elements are taken out first; with preserve_existing their spans come back and win. The
    predictor sees what stands between other markup, so declarations, comments and attributes are never tagged, and
    a new span that would hold one tag of another element without its twin is dropped: no tag stands in a tag,
    and elements stay as well paired as they were.
    """
    rows = stored(lexing.spans_in_rows(docs, types))
    text, existing = rows.select("doc_id", "text"), rows.select("doc_id", F.inline("spans"))
    known = F.col("spans") if preserve_existing else F.slice("spans", 1, 0)
    tiles = rows.select("doc_id", lexing.tiles(F.col("text"), T.TOKEN).alias("x"), known.alias("spans"))
    new = stored(labelling.find_entities(tiles, predictor, size, stride))
    new = lexing.drop_splitting(new, text).withColumn("attrs", F.lit(""))
    spans = stored(new.withColumn("existing", F.lit(False)).unionByName(existing.withColumn("existing", F.lit(True))) if preserve_existing else new)
    names = {t: n for n, t in types.items()}
    return labelling.render(text, post_process(text, spans, "existing" if preserve_existing else None), names | ({} if "CIT" in names else {"CIT": "cit"}))


def roundtrip_corpus(docs: DataFrame, tags=markup.TAGS) -> DataFrame:
    """doc_id, without_attributes, without_tags."""
    return docs.select("doc_id", markup.drop_attributes(F.col("text"), tags).alias("without_attributes"), markup.strip_tags(F.col("text"), tags).alias("without_tags"))
