"""Documents as trees: nesting, the first error, namespaces in scope. Input: (doc_id, text), or their markup events.

Depths are running sums over a document's tags, so tags alone are shuffled, never texts. A tag's partner is its
neighbour among the document's tags of one depth, whatever their names: up to the first error that is the top of the
stack of open elements.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.functions import markup
from citeloom.operators import lexing

#: Elements that HTML never closes.
VOID = ("br", "meta", "img", "hr", "link", "input")
#: The entities that every document knows.
ENTITIES = ("amp", "lt", "gt", "quot", "apos")
_ATTRIBUTE = r"""([A-Za-z_:][A-Za-z0-9_.:-]*)\s*=\s*("[^<"]*"|'[^<']*')"""
ATTRIBUTES = rf"^(?:\s+{_ATTRIBUTE})*\s*$"


def reference(entities: Sequence[str] = ENTITIES) -> str:
    return rf"&(?:{'|'.join(entities)}|#[0-9]+|#x[0-9A-Fa-f]+);"


def attribute_names(attrs: Column) -> Column:
    return F.regexp_extract_all(attrs, F.lit(_ATTRIBUTE), F.lit(1))


def attribute_values(attrs: Column) -> Column:
    """Values without their quotes, references as they are written."""
    return F.transform(F.regexp_extract_all(attrs, F.lit(_ATTRIBUTE), F.lit(2)), lambda v: F.substring(v, F.lit(2), F.length(v) - 2))


def depths(tags: DataFrame) -> DataFrame:
    """tags (doc_id, pos, kind, ...) with depth: how many elements are open around a tag, itself not counted. Closing
    tags have the depth of the opening one; below 0, where more were closed than opened."""
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    by = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return tags.withColumn("depth", (F.sum(step).over(by) - F.when(F.col("kind") == "open", 1).otherwise(0)).cast("int"))


def _partner(*keep: str) -> tuple[Column, Column]:
    """What the tags before and after one have, among the opening and closing tags of one depth."""
    by = Window.partitionBy("doc_id", "depth").orderBy("pos")
    return F.lag(F.struct(*keep)).over(by), F.lead(F.struct(*keep)).over(by)


def elements(events: DataFrame, void: Sequence[str] = ()) -> DataFrame:
    """doc_id, pos, end_pos (of its closing tag; its own, if it's empty), start, end (offsets, both tags included), depth,
    parent (pos; null for a root), name, piece: a row for each element that is closed by a tag of its name."""
    tags = depths(events.where(F.col("kind").isin("open", "close", "selfclose") & ~F.col("name").isin(*void)))
    _, after = _partner("kind", "name", "pos", "end")
    pairs = tags.where("kind <> 'selfclose'").withColumn("next", after).where("kind = 'open' and next.kind = 'close' and next.name = name")
    every = pairs.select("doc_id", "pos", F.col("next.pos").alias("end_pos"), "start", F.col("next.end").alias("end"), "depth", "name", "piece")
    every = every.union(tags.where("kind = 'selfclose'").select("doc_id", "pos", "pos", "start", "end", "depth", "name", "piece"))
    # The parent is the last element that opened one level up, whether it's closed or not.
    none = lambda c: F.lit(None).cast(every.schema[c].dataType).alias(c)
    opened = tags.where("kind = 'open'").select("doc_id", "pos", *(none(c) for c in every.columns[2:]), F.col("depth").alias("level"), F.col("pos").alias("up"))
    asked = every.withColumn("level", F.col("depth") - 1).withColumn("up", F.lit(None).cast("int")).union(opened)
    by = Window.partitionBy("doc_id", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return asked.withColumn("parent", F.last("up", ignorenulls=True).over(by)).where("up is null").select("doc_id", "pos", "end_pos", "start", "end", "depth", "parent", "name", "piece")


def errors(docs: DataFrame, void: Sequence[str] = VOID, entities: Sequence[str] = ENTITIES) -> DataFrame:
    """doc_id, at, error of everything in a document that breaks a rule of well-formed markup, by the place where it
    stands; the first of a document is what a parser would report, later ones may follow from it.

    tag: a bracket that begins no tag; attribute: broken, or twice in a tag; reference: an ampersand that begins none,
    or of an unknown entity; close: a closing tag that isn't the innermost open element's; root: a second root, or text
    outside it; at the end of the text open: an element was left open, or root: there is none.
    """
    events = lexing.markup_events(docs)
    piece, kind = F.col("piece"), F.col("kind")
    tag = kind.isin("open", "close", "selfclose")
    inside = F.regexp_replace(F.regexp_replace(piece, r"^</?[A-Za-z_][A-Za-z0-9_.:-]*", ""), r"/?>$", "")
    names = attribute_names(inside)
    bad = (
        F.when((kind == "text") & piece.startswith("<"), "tag")
        .when(tag & ~inside.rlike(ATTRIBUTES) | (kind == "close") & (F.trim(inside) != "") | tag & (F.size(F.array_distinct(names)) < F.size(names)), "attribute")
        .when((tag | (kind == "text")) & F.regexp_replace(piece, reference(entities), "").contains("&"), "reference")
    )
    alone = events.where(bad.isNotNull()).select("doc_id", F.col("start").alias("at"), bad.alias("error"))
    # Nesting: tags, raw elements (scripts) as empty ones, and text that isn't blank.
    shown = events.where((tag | (kind == "raw") | (kind == "cdata") | (kind == "text") & piece.rlike(r"[^\x20\x09-\x0D]")) & ~F.col("name").isin(*void))
    shown = depths(shown.select("doc_id", "pos", "start", "kind", "name")).withColumn("nested", F.col("kind").isin("open", "close"))
    by = Window.partitionBy("doc_id", "depth", "nested").orderBy("pos")
    shown = shown.withColumn("before", F.lag(F.struct("kind", "name")).over(by)).withColumn("after", F.lead("kind").over(by))
    top = Window.partitionBy("doc_id", "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    roots = F.sum(F.col("kind").isin("open", "selfclose", "raw").cast("int")).over(top)
    shown = shown.withColumn("roots", F.coalesce(roots, F.lit(0)))
    wrong = (
        F.when((F.col("kind") == "close") & ~F.coalesce((F.col("before.kind") == "open") & (F.col("before.name") == F.col("name")), F.lit(False)), "close")
        .when((F.col("depth") <= 0) & F.col("kind").isin("open", "selfclose", "raw") & (F.col("roots") > 0), "root")
        .when((F.col("depth") <= 0) & F.col("kind").isin("text", "cdata"), "root")
    )
    order = shown.where(wrong.isNotNull()).select("doc_id", F.col("start").alias("at"), wrong.alias("error"))
    left = shown.groupBy("doc_id").agg(F.max((F.col("kind").isin("open", "selfclose", "raw")).cast("int")).alias("any"), F.max(((F.col("kind") == "open") & F.col("after").isNull()).cast("int")).alias("open"))
    ends = docs.where("text is not null").select("doc_id", F.length("text").alias("at")).join(left, "doc_id", "left")
    last = F.when(F.col("open") == 1, "open").when(F.coalesce("any", F.lit(0)) == 0, "root")
    ends = ends.where(last.isNotNull()).select("doc_id", "at", last.alias("error"))
    return alone.unionByName(order).unionByName(ends)


def parse_status(docs: DataFrame, void: Sequence[str] = VOID, entities: Sequence[str] = ENTITIES) -> DataFrame:
    """doc_id, n_open, n_close, balanced (tags nest, all are closed), well_formed, error and error_at of the first error.

    Never an error itself; a null text has no root. void: elements whose tags aren't looked at.
    """
    found = errors(docs, void, entities).groupBy("doc_id").agg(F.min(F.struct("at", "error")).alias("first"), F.max(F.col("error").isin("open", "close").cast("int")).alias("loose"))
    here = lambda kind: F.count_if((F.col("kind") == kind) & ~F.col("name").isin(*void)).alias(f"n_{kind}")
    counts = lexing.markup_events(docs).groupBy("doc_id").agg(here("open"), here("close"))
    out = docs.select("doc_id", F.col("text").isNull().alias("none")).join(counts, "doc_id", "left").join(found, "doc_id", "left")
    zero, none = F.lit(0).cast("long"), F.col("none")
    columns = [F.coalesce("n_open", zero).alias("n_open"), F.coalesce("n_close", zero).alias("n_close"), (F.coalesce("loose", F.lit(0)) == 0).alias("balanced")]
    return out.select("doc_id", *columns, (F.col("first").isNull() & ~none).alias("well_formed"), F.when(none, "root").otherwise(F.col("first.error")).alias("error"), F.when(none, 0).otherwise(F.col("first.at")).alias("error_at"))


def declarations(events: DataFrame, void: Sequence[str] = VOID) -> DataFrame:
    """doc_id, prefix ('' for the default), pos, end_pos, uri: namespaces that elements declare; end_pos is null, where the
    element is never closed."""
    tags = depths(events.where(F.col("kind").isin("open", "close", "selfclose") & ~F.col("name").isin(*void)))
    _, after = _partner("kind", "pos")
    rows = tags.where("kind <> 'selfclose'").withColumn("next", after).where("kind = 'open'")
    rows = rows.select("doc_id", "pos", F.when(F.col("next.kind") == "close", F.col("next.pos")).alias("end_pos"), "piece")
    rows = rows.union(tags.where("kind = 'selfclose'").select("doc_id", "pos", "pos", "piece")).where(F.col("piece").contains("xmlns"))
    attrs = markup.attributes(F.col("piece"))
    rows = rows.select("doc_id", "pos", "end_pos", F.inline(F.arrays_zip(attribute_names(attrs).alias("k"), attribute_values(attrs).alias("uri"))))
    return rows.where("k = 'xmlns' or k like 'xmlns:%'").select("doc_id", F.lower(F.regexp_replace("k", "^xmlns:?", "")).alias("prefix"), "pos", "end_pos", "uri")


def in_scope(declared: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (doc_id, prefix, pos, tag) with uri: what its prefix stands for at its place; null for nothing.

    A declaration holds from its element's opening tag to its closing tag. By document and prefix, all that ask
    and the ends of declarations are put in order: the running count of open declarations is a level, and the one
    that holds is the last that reached the level.
    """
    tag, text = F.lit(None).cast(asked.schema["tag"].dataType), F.lit(None).cast("string")
    # At one tag declarations come first, then the tag itself, then their ends.
    steps = declared.select("doc_id", "prefix", "pos", F.lit(0).alias("turn"), F.lit(1).alias("step"), "uri", tag.alias("tag"))
    steps = steps.union(declared.where("end_pos is not null").select("doc_id", "prefix", "end_pos", F.lit(2), F.lit(-1), text, tag))
    steps = steps.union(asked.select("doc_id", "prefix", "pos", F.lit(1), F.lit(0), text, "tag"))
    by = Window.partitionBy("doc_id", "prefix").orderBy("pos", "turn").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("level", F.sum("step").over(by)).where("turn < 2")
    by = Window.partitionBy("doc_id", "prefix", "level").orderBy("pos", "turn").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("turn") == 0, F.struct("uri")), ignorenulls=True).over(by)
    steps = steps.withColumn("uri", F.when(F.col("level") > 0, held["uri"])).where("turn = 1")
    return steps.select("doc_id", "prefix", "pos", "tag", F.when(F.col("uri") != "", F.col("uri")).alias("uri"))


def _split(name: Column) -> tuple[Column, Column]:
    """prefix ('' for none) and local name."""
    return F.lower(F.regexp_extract(name, "^([^:]*):", 1)), F.regexp_replace(name, "^[^:]*:", "")


def namespaced(events: DataFrame, void: Sequence[str] = VOID) -> DataFrame:
    """doc_id, pos, kind, name, prefix, local, uri of the tags of events; uri is null without a namespace."""
    prefix, local = _split(F.col("name"))
    tags = events.where(F.col("kind").isin("open", "close", "selfclose"))
    asked = tags.select("doc_id", prefix.alias("prefix"), "pos", F.struct("kind", "name", local.alias("local")).alias("tag"))
    return in_scope(declarations(events, void), asked).select("doc_id", "pos", "tag.kind", "tag.name", "prefix", "tag.local", "uri")


def strip_elements(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """doc_id, text without the tags of these elements, where they're of the root's namespace; content stays.

    A document without a declaration has no namespace: names count as they're written, with any prefix. Those are
    done inside their rows; of the others the tags are shuffled, and the text once. Names are compared in lower case.
    """
    declared = F.coalesce(F.col("text").contains("xmlns"), F.lit(False))
    plain = lexing.without_tags(docs.where(~declared), names)
    tags = namespaced(lexing.markup_events(docs.where(declared)))
    root = F.first("uri").over(Window.partitionBy("doc_id").orderBy("pos"))
    tags = tags.withColumn("root", root).where(F.col("uri").eqNullSafe(F.col("root")))
    # Without a namespace a prefix is a part of the name.
    named = F.when(F.col("uri").isNull(), F.col("name")).otherwise(F.col("local"))
    gone = tags.where(named.isin(*names)).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.lit(True)))).alias("gone"))
    rows = docs.where(declared).select("doc_id", "text").join(gone, "doc_id", "left")
    kept = F.filter(lexing.pieces(F.col("text")), lambda x, i: F.col("gone").isNull() | ~F.map_contains_key("gone", i))
    return plain.unionByName(rows.select("doc_id", F.array_join(kept, "").alias("text")))


def attribute_rows(events: DataFrame, void: Sequence[str] = VOID) -> DataFrame:
    """doc_id, pos, k, prefix, local, uri, value of each attribute of an opening or empty tag but for declarations.

    A prefix stands for the namespace in scope at the tag (xml always does); an attribute without one has none.
    """
    tags = events.where(F.col("kind").isin("open", "selfclose"))
    attrs = markup.attributes(F.col("piece"))
    pairs = F.transform(F.arrays_zip(attribute_names(attrs).alias("key"), attribute_values(attrs).alias("value")), lambda x, i: F.struct(i.alias("k"), x["key"].alias("key"), x["value"].alias("value")))
    rows = tags.select("doc_id", "pos", F.inline(pairs)).where("key <> 'xmlns' and key not like 'xmlns:%'")
    prefix, local = _split(F.col("key"))
    asked = rows.select("doc_id", prefix.alias("prefix"), "pos", F.struct("k", local.alias("local"), "value").alias("tag"))
    found = in_scope(declarations(events, void).where("prefix <> ''"), asked)
    uri = F.when(F.col("prefix") == "xml", "http://www.w3.org/XML/1998/namespace").otherwise(F.col("uri"))
    return found.select("doc_id", "pos", "tag.k", "prefix", "tag.local", uri.alias("uri"), "tag.value")
