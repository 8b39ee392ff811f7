"""Tokens with offsets and overlapping windows over them. Input: (doc_id, text).

Offsets are made inside a document's row, so nothing is shuffled to number or place its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.functions.arrays import let, running_ends, tiled

TOKEN = r"\s*(?:[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s])|\s+$"
#: The same, where a boundary marker is one token.
MARKED = r"\s*(?:\[(?:BIBL|QUOTE|CIT)_(?:START|END)\]|[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s])|\s+$"


def token_array(text: Column, pattern: str = TOKEN, offset: Column | int = 0) -> Column:
    """array<struct<start, end, token>>: tokens tile the text, leading blanks belong to the token."""
    placed = lambda token, end: F.struct((end - F.length(token) + offset).alias("start"), (end + offset).alias("end"), token.alias("token"))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.zip_with(x, running_ends(F.transform(x, F.length)), placed))


def tokenize_with_offsets(docs: DataFrame, pattern: str = TOKEN, counted: bool = False) -> DataFrame:
    """doc_id, pos, start, end, token; counted: and n, how many tokens the document has."""
    return tiled(docs, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), "token", counted)


def sliding_windows(tokens: DataFrame, size: int = 512, stride: int = 256) -> DataFrame:
    """tokens with window_idx: a row for each window that a token is in, at most ceil(size / stride).

    Windows start at 0, stride, ... below the number of tokens.
    """
    if not 0 < stride <= size:
        raise ValueError("0 < stride <= size is needed")
    first = F.expr(f"greatest(0, (pos - {size} + {stride}) div {stride})")
    return tokens.withColumn("window_idx", F.explode(F.sequence(first.cast("int"), F.expr(f"cast(pos div {stride} as int)"))))


def windows(docs: DataFrame, size: int = 512, stride: int = 256, tokens: Column | None = None) -> DataFrame:
    """doc_id, window_idx, n, first, tokens: the same windows, one a row with all its tokens as an array.

    n: tokens of the document; first: position of the window's first token.
    """
    if not 0 < stride <= size:
        raise ValueError("0 < stride <= size is needed")
    rows = docs.select("doc_id", (token_array(F.col("text")) if tokens is None else tokens).alias("x")).where("size(x) > 0")
    each = lambda i: F.struct((i / stride).cast("int").alias("window_idx"), i.alias("first"), F.slice("x", i + 1, F.lit(size)).alias("tokens"))
    every = F.transform(F.sequence(F.lit(0), F.size("x") - 1, F.lit(stride)), each)
    rows = rows.select("doc_id", F.size("x").alias("n"), F.explode(every).alias("w"))
    return rows.select("doc_id", "w.window_idx", "n", "w.first", "w.tokens")


def window_bounds(windows: DataFrame, *more: Column) -> DataFrame:
    """doc_id, window_idx, window_start, window_end (offsets), n_tokens, and further columns."""
    start, end = F.element_at("tokens", 1)["start"], F.element_at("tokens", -1)["end"]
    return windows.select("doc_id", "window_idx", start.alias("window_start"), end.alias("window_end"), F.size("tokens").cast("long").alias("n_tokens"), *more)


def window_text(windows: DataFrame) -> DataFrame:
    """Each window's bounds and its slice of the source text, which its tokens tile."""
    return window_bounds(windows, F.array_join(F.transform("tokens", lambda x: x["token"]), "").alias("window_text"))


def owner(pos: Column, n: Column, size: int = 512, stride: int = 256) -> Column:
    """The window whose label counts for the token at pos, of n: the one that has it farthest from its edges.

    Window 0 owns the tokens below stride + (size - stride) / 2, each full window the next stride tokens, the
    first short window the rest. With h = (size - stride) / 2 and k the first short window, it's k from
    k * stride + h on, and (pos - h) / stride before, at least 0.
    """
    h = (size - stride) // 2
    short = F.when(n < size, 0).otherwise(F.floor((n - size) / stride) + 1)
    before = F.greatest(F.lit(0), F.floor((pos - h) / stride))
    return F.when(short == 0, 0).when(pos >= stride * short + h, short).otherwise(before).cast("int")


def reliable_center(tokens: DataFrame, size: int = 512, stride: int = 256) -> DataFrame:
    """tokens with owner: every token has exactly one. Without a column n the tokens of a document are counted."""
    if "n" not in tokens.columns:
        tokens = tokens.withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    return tokens.withColumn("owner", owner(F.col("pos"), F.col("n"), size, stride)).drop("n")


def merge_window_labels(labelled: DataFrame, size: int = 512, stride: int = 256) -> DataFrame:
    """labelled (doc_id, window_idx, n, pos, label, ...): each token's row of its owning window."""
    return labelled.where(F.col("window_idx") == owner(F.col("pos"), F.col("n"), size, stride))


def clip_spans_to_windows(spans: DataFrame, size: int = 512, stride: int = 256) -> DataFrame:
    """doc_id, window_idx, start, end, type: spans cut at windows of size code points, relative to them.

    A span names the windows that it can overlap, so no join is needed.
    """
    first = F.expr(f"greatest(0, (start - {size}) div {stride})").cast("int")
    rows = spans.withColumn("window_idx", F.explode(F.sequence(first, F.expr(f"greatest(end - 1, 0) div {stride}").cast("int"))))
    base = F.col("window_idx") * stride
    rows = rows.withColumn("s", F.greatest(F.col("start"), base)).withColumn("e", F.least(F.col("end"), base + size)).where("s < e")
    return rows.select("doc_id", "window_idx", (F.col("s") - base).alias("start"), (F.col("e") - base).alias("end"), "type")
