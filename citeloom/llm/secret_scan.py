"""Secrets in texts, and weak credential parts that only count together. DataFrame functions alone.

Strong kinds: ``assign`` (a password-like name given a value), ``access`` (access key identifiers) and ``hex``
(long lower-case hex strings). Weak kinds are too common to report alone: ``ident`` (a user or client name
given a value), ``opaque`` (a long mixed string) and ``endpoint`` (a URL). A weak part is reported when, by an
interval join over the spans of one text, at most SCOPE code points lie between it and a complementary part:
a secret beside an identifier or endpoint, however long the parts are. The join is by (row, block of SCOPE code
points): each span is in the blocks that it touches, and meets the spans of those and of their neighbours only.

Offsets are code points, end exclusive. Matches are leftmost and do not overlap within a kind; a match that
fails its kind's test is dropped without a retry. Null texts are empty. Rows with equal doc_id and text give
equal results each, rows without a doc_id are rows like others. Columns but doc_id and text are left alone; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from citeloom.llm.shared import stored

SCOPE = 256
STRONG, WEAK = ("assign", "access", "hex"), ("ident", "opaque", "endpoint")
_KIND = {k: i for i, k in enumerate(STRONG + WEAK)}
VALUE = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = rf"(?i:password|passwd|secret|token|api_?key){VALUE}([A-Za-z0-9+/_.=-]+)"
PATTERNS = {
    "assign": ASSIGN,
    "access": "AKIA[A-Z0-9]{12,}",
    "hex": "[0-9a-f]{32,}",
    "ident": rf"(?i:user|username|login|account|client_?id|access_?key_?id){VALUE}[A-Za-z0-9_.@-]{{3,}}",
    "opaque": "[A-Za-z0-9+/_-]{24,}",
    "endpoint": r"""https?://[^\x20\x09-\x0D"'<>]+""",
}
#: A cheaper test that every match of the pattern meets.
HINTS = {"assign": rf"(?i:word|passwd|secret|token|key){VALUE}[A-Za-z0-9+/_.=-]", "ident": rf"(?i:user|name|login|account|id){VALUE}[A-Za-z0-9_.@-]{{3}}"}
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def spans(text: Column, pattern: str, hint: str | None = None) -> Column:
    """array<struct<s, e, hit>> of the pattern's matches, leftmost first; null if there is none.

    What lies between matches comes from ``split``, so a start is a sum of lengths; sums of BLOCK matches and of
    BLOCK such sums are kept, so a start adds few numbers in long lists of matches too.
    """

    def sums(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / BLOCK).cast("int")), lambda b: _sum(F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))

    def placed(hits: Column, gap: Column, hit: Column, both: Column, blocks: Column, above: Column) -> Column:
        def at(i: Column) -> Column:
            block = (i / BLOCK).cast("int")
            top = (block / BLOCK).cast("int")
            before = _sum(F.slice(above, F.lit(1), top)) + _sum(F.slice(blocks, top * BLOCK + 1, block - top * BLOCK))
            start = before + _sum(F.slice(both, block * BLOCK + 1, i - block * BLOCK)) + F.get(gap, i)
            return let(start, lambda s: F.struct(s.alias("s"), (s + F.get(hit, i)).alias("e"), F.get(hits, i).alias("hit")))

        return F.transform(F.sequence(F.lit(0), F.size(hits) - 1), at)

    def of(hits: Column) -> Column:
        return let(
            F.transform(F.split(text, pattern, -1), F.length),
            lambda gap: let(
                F.transform(hits, F.length),
                lambda hit: let(
                    F.zip_with(F.slice(gap, F.lit(1), F.size(hit)), hit, lambda a, b: a + b),
                    lambda both: let(sums(both), lambda blocks: let(sums(blocks), lambda above: placed(hits, gap, hit, both, blocks, above))),
                ),
            ),
        )

    return F.when(text.rlike(hint or pattern) & text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of))


def _kept(kind: str, found: Column) -> Column:
    if kind == "assign":
        return F.filter(found, lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 1)) >= 8)
    if kind == "opaque":
        return F.filter(found, lambda x: x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Z]") & x["hit"].rlike("[a-z]"))
    return found


def find_parts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, row (hash of the row) and per kind array<struct<s, e>>."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    bare = lambda kind, found: F.transform(_kept(kind, found), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    empty = F.expr("cast(array() as array<struct<s: int, e: int>>)")
    columns = [F.coalesce(bare(k, spans(F.col("text"), p, HINTS.get(k))), empty).alias(k) for k, p in PATTERNS.items()]
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), *columns)


def _tagged(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), F.lit(_KIND[kind]).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def link_parts(parts: DataFrame) -> DataFrame:
    """Weak parts with a complementary part in scope: id (doc_id, 0 for none), row, linked (array of tagged spans)."""
    parts = parts.where(" or ".join(f"size({k}) > 0" for k in WEAK)).select(F.coalesce("doc_id", F.lit(0)).alias("id"), "row", *PATTERNS)
    every = parts.select("id", "row", F.explode(F.concat(*(_tagged(k) for k in PATTERNS))).alias("p")).distinct()
    touched = F.expr(f"sequence(p.s div {SCOPE}, (p.e - 1) div {SCOPE})")
    # A weak part that overlaps a strong one is that one: they meet by blocks too.
    block = every.select("id", "row", "p", F.explode(touched).alias("block"))
    strong = block.where(F.col("p.kind").isin(*STRONG)).withColumnRenamed("p", "b")
    taken = block.where(F.col("p.kind").isin(*WEAK)).join(strong, ["id", "row", "block"]).where("b.s < p.e and p.s < b.e").select("id", "row", "p").distinct()
    every = every.join(taken, ["id", "row", "p"], "left_anti")
    role = F.when(F.col("p.kind").isin("access", "ident"), "identifier").when(F.col("p.kind") == "endpoint", "endpoint").otherwise("secret")
    every = every.withColumn("role", role)
    near = F.expr(f"sequence(greatest(p.s - {SCOPE}, 0) div {SCOPE}, (p.e + {SCOPE}) div {SCOPE})")
    weak = every.where(F.col("p.kind").isin(*WEAK)).select("id", "row", "p", "role", F.explode(near).alias("block"))
    other = every.select("id", "row", F.col("p").alias("q"), F.col("role").alias("q_role"), F.explode(touched).alias("block"))
    pairs = weak.join(other, ["id", "row", "block"]).where(f"q.s - p.e <= {SCOPE} and p.s - q.e <= {SCOPE} and role <> q_role and (role = 'secret' or q_role = 'secret')")
    return pairs.groupBy("id", "row").agg(F.collect_set("p").alias("linked"))


def secrets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked; a row each."""
    parts = stored(find_parts(docs)).withColumn("id", F.coalesce("doc_id", F.lit(0)))
    both = parts.join(link_parts(parts.drop("id")), ["id", "row"], "left")
    base = F.concat(*(_tagged(k) for k in STRONG))
    every = F.concat(base, F.coalesce("linked", F.expr("cast(array() as array<struct<s: int, k: int, e: int, kind: string>>)")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in STRONG]
    return both.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(every).alias("spans"), F.coalesce(F.size("linked"), F.lit(0)).cast("long").alias("n_linked"))
