"""Character data: what a reader of a document gets, and where each character of it stands in the source.

A document's source is cut into runs: plain text, whose characters stand for themselves, and atoms, which stand for one
character (a reference, a line's end) or none (tags, comments, brackets of CDATA). Runs tile the source and, with
their own offsets, the decoded text, so spans can be given in either. Offsets are sums inside a document's row.
Entities other than the five that every document knows stay as they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citeloom.functions.arrays import let, running_ends
from citeloom.operators import lexing

#: Entities and their characters.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
REFERENCE = r"&(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});"
BREAK = r"\r\n?"
_PART = rf"(?s){REFERENCE}|{BREAK}|[^&\r]+|&"
_BLOCK = 512


def _visible(piece: Column) -> Column:
    return lexing.kind_of(piece).isin("text", "cdata")


def _code(part: Column) -> Column:
    """The code point of a numeric reference."""
    digits = F.regexp_extract(part, "^&#x?([0-9A-Fa-f]+);", 1)
    return F.when(part.startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")


def _character(code: Column) -> Column:
    """The character of a code point, by its bytes in UTF-8; the replacement character for what is none."""
    low = lambda c, shift: F.shiftright(c, shift).bitwiseAND(F.lit(63)) + 128
    octet = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    of = F.when(code < 0x80, octet(code)).when(code < 0x800, F.concat(octet(F.shiftright(code, 6) + 192), octet(low(code, 0))))
    of = of.when(code < 0x10000, F.concat(octet(F.shiftright(code, 12) + 224), octet(low(code, 6)), octet(low(code, 0))))
    of = of.otherwise(F.concat(octet(F.shiftright(code, 18) + 240), octet(low(code, 12)), octet(low(code, 6)), octet(low(code, 0))))
    none = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(none, "�").otherwise(F.decode(F.unhex(of), "UTF-8"))


def decoded_part(part: Column) -> Column:
    """What a part of character data stands for."""
    known = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))
    return F.when(part.rlike(rf"^{BREAK}$"), "\n").when(part.rlike(rf"^{REFERENCE}$"), F.coalesce(F.element_at(known, part), _character(_code(part)))).otherwise(part)


def decoded_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, rf"{REFERENCE}|{BREAK}", "x"))


def _inside(pieces: Column) -> Column:
    """The visible pieces but for blanks before the first tag and after the last."""
    def kept(pieces: Column, tag: Column) -> Column:
        ends = F.struct(F.array_position(tag, True).alias("first"), (F.size(tag) - F.array_position(F.reverse(tag), True) + 1).alias("last"))
        outer = lambda b, i: (b["first"] > 0) & ((i + 1 < b["first"]) | (i + 1 > b["last"]))
        blank = lambda p: p.rlike(r"^[\x20\x09-\x0D]*$")
        return let(ends, lambda b: F.filter(pieces, lambda p, i: _visible(p) & ~(outer(b, i) & blank(p))))

    is_tag = lambda p: lexing.kind_of(p).isin("open", "close", "selfclose", "raw")
    return let(pieces, lambda x: let(F.transform(x, is_tag), lambda tag: kept(x, tag)))


def inner_length(pieces: Column) -> Column:
    """Characters of a document's character data; null for null."""
    size = lambda p: F.when(p.startswith("<![CDATA["), F.length(F.regexp_replace(F.substring(p, F.lit(10), F.length(p) - 12), BREAK, "x"))).otherwise(decoded_length(p))
    return F.aggregate(F.transform(_inside(pieces), size), F.lit(0), lambda a, n: a + n)


def _parts(piece: Column) -> Column:
    """array<struct<raw, out>> of a piece: the source of each run, and what it stands for."""
    pair = lambda raw, out: F.struct(raw.alias("raw"), out.alias("out"))
    data = F.array(pair(F.lit("<![CDATA["), F.lit("")), pair(F.substring(piece, F.lit(10), F.length(piece) - 12), F.substring(piece, F.lit(10), F.length(piece) - 12)), pair(F.lit("]]>"), F.lit("")))
    breaks = lambda x: F.flatten(F.transform(x, lambda p: F.transform(F.regexp_extract_all(p["raw"], F.lit(rf"(?s){BREAK}|[^\r]+"), F.lit(0)), lambda r: pair(r, F.when(p["out"] == "", "").when(r.rlike(rf"^{BREAK}$"), "\n").otherwise(r)))))
    text = F.transform(F.regexp_extract_all(piece, F.lit(_PART), F.lit(0)), lambda r: pair(r, decoded_part(r)))
    return F.when(piece.startswith("<![CDATA["), breaks(data)).when(_visible(piece), text).otherwise(F.array(pair(piece, F.lit(""))))


def decoded(docs: DataFrame) -> DataFrame:
    """doc_id, text (its character data), runs: array<struct<s, e, at, to>>, source [s, e) for text [at, to)."""
    parts = docs.select("doc_id", F.flatten(F.transform(lexing.pieces(F.col("text")), _parts)).alias("x")).where("x is not null")
    out = F.array_join(F.transform("x", lambda p: p["out"]), "").alias("text")
    ends = lambda c: running_ends(F.transform("x", lambda p: F.length(p[c])))
    both = F.zip_with(ends("raw"), ends("out"), lambda e, to: F.struct(e.alias("e"), to.alias("to")))
    run = lambda every: lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.get(every, i - 1)["e"]).alias("s"), x["e"].alias("e"), F.when(i == 0, 0).otherwise(F.get(every, i - 1)["to"]).alias("at"), x["to"].alias("to"))
    return parts.select("doc_id", out, let(both, lambda every: F.transform(every, run(every))).alias("runs"))


def run_rows(decoded: DataFrame) -> DataFrame:
    """doc_id, s, e, at, to."""
    return decoded.select("doc_id", F.inline("runs"))


def _moved(spans: DataFrame, runs: DataFrame, low: str, high: str, start, end) -> DataFrame:
    """spans with start and end looked up in runs by blocks of [low, high): what start and end make of a run."""
    rows = spans.withColumn("sid", F.struct("start", "end"))
    placed = runs.where(f"{low} < {high}").withColumn("block", F.explode(F.expr(f"sequence({low} div {_BLOCK}, ({high} - 1) div {_BLOCK})")))
    ends = rows.select("doc_id", F.explode(F.array(F.struct(F.col("start").alias("p"), F.lit(True).alias("first")), F.struct((F.col("end") - 1).alias("p"), F.lit(False).alias("first")))).alias("x")).select("doc_id", "x.*").distinct()
    found = ends.withColumn("block", F.expr(f"p div {_BLOCK}")).join(placed, ["doc_id", "block"]).where(f"{low} <= p and p < {high}")
    found = found.select("doc_id", "p", "first", F.when(F.col("first"), start).otherwise(end).alias("q"))
    one = found.where("first").select("doc_id", F.col("p").alias("start"), F.col("q").alias("new_start"))
    two = found.where("not first").select("doc_id", (F.col("p") + 1).alias("end"), F.col("q").alias("new_end"))
    out = rows.where("start < end").join(one, ["doc_id", "start"]).join(two, ["doc_id", "end"])
    keep = [c for c in spans.columns if c not in ("doc_id", "start", "end")]
    return out.select("doc_id", F.col("new_start").alias("start"), F.col("new_end").alias("end"), *keep)


def to_source(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """Spans of the decoded text as spans of the source: from where the first character begins to where the last ends.
    Empty spans are left out."""
    plain = F.expr("e - s = to - at")
    return _moved(spans, runs, "at", "to", F.when(plain, F.expr("s + p - at")).otherwise(F.col("s")), F.when(plain, F.expr("s + p + 1 - at")).otherwise(F.col("e")))


def to_decoded(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """Spans of the source as spans of the decoded text: all characters of which the source has a part in the span.
    Spans that hold none are empty."""
    plain = F.expr("e - s = to - at")
    return _moved(spans, runs, "s", "e", F.when(plain, F.expr("at + p - s")).otherwise(F.col("at")), F.when(plain, F.expr("at + p + 1 - s")).otherwise(F.col("to")))
