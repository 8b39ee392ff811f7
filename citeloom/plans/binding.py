"""How the operators bind to the given tables, in Spark and as DuckDB table expressions.

Pages are the marked-up documents (two maps from element to span type), documents the plain ones, and citation
records are derived from documents.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from citeloom.functions import markup
from citeloom.operators import lexing, tokens as T
from citeloom.sources.storage import table

#: Element -> span type. NESTED has attributes and nesting, ADJACENT neighbours and unbalanced tags, PAIRED neighbours of two types.
NESTED = {"a": "BIBL", "li": "CIT"}
ADJACENT = {"h1": "BIBL", "p": "QUOTE"}
PAIRED = {"div": "BIBL", "article": "QUOTE"}
SIZE, STRIDE = 128, 64
MARKERS = {"a": markup.MARKERS["bibl"], "li": markup.MARKERS["cit"]}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(spark, sf_dir) as a query, with the SQL of its result; names of TABLES in it are spelled out."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = spelled(sql)
        return f

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Integers as long and doubles to 6 places, so that engines can be compared."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append(c.cast("long").alias(name) if kind in ("int", "smallint", "tinyint") else F.round(c.cast("double"), 6).alias(name) if kind in ("double", "float") else c)
    return df.select(*out)


def spelled(sql: str) -> str:
    """sql with a WITH clause of the tables that it names, directly or through others."""
    import re

    words = lambda s: set(re.findall(r"\bt_\w+", s))
    need, todo = [], list(words(sql))
    while todo:
        name = todo.pop()
        if name in need:
            need.remove(name)
        need.append(name)
        todo += [w for w in words(TABLES[name])]
    return f"WITH {', '.join(f'{n} AS ({TABLES[n]})' for n in reversed(need))} {sql}" if need else sql


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: Sentences end here; each two of a text make a citation.
_ENDS = r"[.!?\n]+"
_MOST = 10_000_000


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, bibl, quote, filename, lang, urn, doc_id: the sentences of every document, two by two; every eighth row is
    unresolved."""
    sentences = F.filter(F.split("text", _ENDS, -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = documents(spark, sf_dir).select("doc_id", "lang", "source", sentences.alias("s"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("s") - 1, F.lit(2)), lambda i: F.struct(F.get("s", i).alias("bibl"), F.coalesce(F.get("s", i + 1), F.lit("")).alias("quote")))
    rows = d.where("size(s) > 0").select("doc_id", "lang", "source", F.posexplode(pairs).alias("i", "x"))
    urn = F.expr("case when (doc_id + i) % 8 = 0 then '' else concat('urn:cts:', lang, 'Lit:', source, '.w', (doc_id + i) % 7, '.', lang, '1:', doc_id, '.', i) end")
    return rows.select((F.col("doc_id") * _MOST + F.col("i")).alias("id"), "x.bibl", "x.quote", F.concat("source", F.lit(".xml")).alias("filename"), "lang", urn.alias("urn"), "doc_id")


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, split by the first digit of md5(doc_id)."""
    digit = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)
    split = F.when(digit.isin("0", "1"), "test").when(digit.isin("2", "3"), "val").otherwise("train")
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", split.alias("split"))


_CHANCE = {d: "B-BIBL" if d == "0" else "I-BIBL" if d in "12" else "B-QUOTE" if d == "3" else "I-QUOTE" if d in "45" else "O" for d in "0123456789abcdef"}


def chance_label(*parts: str):
    """A label that md5 of some columns gives; the same in both engines."""
    return chance_label_of(*map(F.col, parts))


def chance_label_of(*parts):
    digit = F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 1)
    # Looked at once: inside a lambda every name of it would make it anew.
    return F.element_at(F.create_map(*(F.lit(x) for pair in _CHANCE.items() for x in pair)), digit)


def chance_label_sql(*parts: str) -> str:
    digit = f"substring(md5(concat_ws(':', {', '.join(parts)})), 1, 1)"
    return f"CASE WHEN {digit} = '0' THEN 'B-BIBL' WHEN {digit} IN ('1', '2') THEN 'I-BIBL' WHEN {digit} = '3' THEN 'B-QUOTE' WHEN {digit} IN ('4', '5') THEN 'I-QUOTE' ELSE 'O' END"


def token_table(source: str, pattern: str) -> str:
    return f"""SELECT doc_id, pos, e - length(token) AS start, e AS "end", token FROM (SELECT *, CAST(sum(length(token)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS e
    FROM (SELECT doc_id, unnest(x) AS token, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, {literal(pattern)}) AS x FROM {source})))"""


def case(column: str, types: Mapping[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in types.items()) + " END"


def span_tables(key: str, types: Mapping[str, str]) -> None:
    TABLES[f"t_marked_{key}"] = f"""SELECT *, CAST(coalesce(sum(CASE WHEN type IS NULL THEN length(piece) ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
    FROM (SELECT *, {case("name", types)} AS type FROM t_events)"""
    TABLES[f"t_level_{key}"] = f"""SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id, name ORDER BY pos) + CASE kind WHEN 'close' THEN 1 ELSE 0 END AS level
    FROM t_marked_{key} WHERE type IS NOT NULL"""
    attrs = r"coalesce(regexp_extract({}, '(?s)^<[A-Za-z_][A-Za-z0-9_.:-]*(\s.*?)?\s*/?>$', 1), '')"
    TABLES[f"t_spans_{key}"] = f"""SELECT doc_id, twin_off AS start, off AS "end", type, {attrs.format("twin_piece")} AS attrs FROM
    (SELECT *, lag(kind) OVER w AS twin_kind, lag(off) OVER w AS twin_off, lag(piece) OVER w AS twin_piece FROM t_level_{key} WHERE kind <> 'selfclose' WINDOW w AS (PARTITION BY doc_id, name, level ORDER BY pos))
    WHERE kind = 'close' AND twin_kind = 'open' UNION ALL SELECT doc_id, off, off, type, {attrs.format("piece")} FROM t_level_{key} WHERE kind = 'selfclose'"""
    TABLES[f"t_text_{key}"] = f"SELECT doc_id, string_agg(piece, '' ORDER BY pos) AS text FROM t_marked_{key} WHERE type IS NULL GROUP BY doc_id"


TABLES["t_pages"] = "SELECT page_id AS doc_id, html AS text FROM pages"
def events_sql(source: str) -> str:
    """The pieces of a table's texts, with offset, kind and name."""
    return rf"""SELECT doc_id, pos, start, "end", kind, CASE WHEN kind IN ('open', 'close', 'selfclose') THEN lower(regexp_extract(piece, {literal(lexing.NAME)}, 1)) ELSE '' END AS name, piece FROM
    (SELECT doc_id, pos, e - length(piece) AS start, e AS "end", piece,
      CASE WHEN starts_with(piece, '<!--') THEN 'comment' WHEN starts_with(piece, '<![CDATA[') THEN 'cdata' WHEN starts_with(piece, '<?') OR starts_with(piece, '<!') THEN 'instruction'
      WHEN regexp_matches(piece, '^<(?:script|style)\b') AND length(piece) - length(replace(piece, '<', '')) > 1 THEN 'raw'
      WHEN regexp_matches(piece, '^</?[A-Za-z_]') AND starts_with(piece, '</') THEN 'close' WHEN regexp_matches(piece, '^</?[A-Za-z_]') AND ends_with(piece, '/>') THEN 'selfclose'
      WHEN regexp_matches(piece, '^</?[A-Za-z_]') AND ends_with(piece, '>') THEN 'open' ELSE 'text' END AS kind FROM
      (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS e FROM
        (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, {literal(lexing.PIECE)}) AS x FROM {source}))))"""


TABLES["t_events"] = events_sql("t_pages")
span_tables("n", NESTED)
span_tables("a", ADJACENT)
span_tables("p", PAIRED)
TABLES["t_tokens"] = token_table("documents", T.TOKEN)
TABLES["t_page_tokens"] = token_table("t_text_n", T.TOKEN)
TABLES["t_windows"] = f"""SELECT t.*, w.k AS window_idx FROM t_tokens t, LATERAL (SELECT unnest(generate_series(greatest(0, (pos - {SIZE} + {STRIDE}) // {STRIDE}), pos // {STRIDE})) AS k) w"""
TABLES["t_bounds"] = """SELECT doc_id, window_idx, min(start) AS window_start, max("end") AS window_end, count(*) AS n_tokens FROM t_windows GROUP BY ALL"""
_H = (SIZE - STRIDE) // 2
TABLES["t_owned"] = f"""SELECT *, CAST(CASE WHEN ks = 0 THEN 0 WHEN pos >= {STRIDE} * ks + {_H} THEN ks ELSE greatest(0, floor((pos - {_H}) / {STRIDE})) END AS BIGINT) AS owner
    FROM (SELECT *, CASE WHEN n < {SIZE} THEN 0 ELSE floor((n - {SIZE}) / {STRIDE}) + 1 END AS ks FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM t_tokens))"""
TABLES["t_sentences"] = rf"""SELECT doc_id, lang, source, x AS s FROM (SELECT *, list_filter(regexp_split_to_array(text, '{_ENDS}'), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS x FROM documents) WHERE len(x) > 0"""
TABLES["t_cites"] = f"""SELECT doc_id * {_MOST} + i AS id, s[2 * i + 1] AS bibl, coalesce(s[2 * i + 2], '') AS quote, concat(source, '.xml') AS filename, lang,
    CASE WHEN (doc_id + i) % 8 = 0 THEN '' ELSE concat('urn:cts:', lang, 'Lit:', source, '.w', (doc_id + i) % 7, '.', lang, '1:', doc_id, '.', i) END AS urn, doc_id
    FROM t_sentences, LATERAL (SELECT unnest(generate_series(0, (len(s) - 1) // 2)) AS i)"""


def parse_sql(urn: str, prefix: str = "") -> str:
    """Columns namespace, author, work, edition, passage of a urn column; all null if it's malformed."""
    part = lambda s, sep, i: f"nullif(list_extract(string_split({s}, '{sep}'), {i}), '')"
    dotted = f"list_extract(string_split({urn}, ':'), 4)"
    author, work = part(dotted, ".", 1), part(dotted, ".", 2)
    fine = f"(starts_with({urn}, 'urn:cts:') AND {part(urn, ':', 3)} IS NOT NULL AND {author} IS NOT NULL)"
    columns = {"namespace": part(urn, ":", 3), "author": author, "work": f"({author} || '.' || {work})", "edition": part(dotted, ".", 3), "passage": part(urn, ":", 5)}
    return ", ".join(f"CASE WHEN {fine} THEN {c} END AS {prefix}{n}" for n, c in columns.items())


TABLES["t_parsed"] = f"SELECT * FROM (SELECT *, {parse_sql('urn')} FROM t_cites) WHERE author IS NOT NULL"
TABLES["t_split"] = """SELECT doc_id AS id, text, CASE WHEN substring(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '1') THEN 'test' WHEN substring(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('2', '3') THEN 'val' ELSE 'train' END AS split FROM documents"""


#: Length of a piece of character data once it is decoded.
_DECODED = r"""CASE WHEN kind = 'cdata' THEN length(regexp_replace(substring(piece, 10, length(piece) - 12), '\r\n?', 'x', 'g')) ELSE length(regexp_replace(piece, '&(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});|\r\n?', 'x', 'g')) END"""
TABLES["t_outer"] = """SELECT doc_id, min(pos) AS first_tag, max(pos) AS last_tag FROM t_events WHERE kind IN ('open', 'close', 'selfclose', 'raw') GROUP BY doc_id"""
TABLES["t_data"] = rf"""SELECT e.doc_id, pos, start, "end", piece, {_DECODED} AS n_out, coalesce(pos BETWEEN first_tag AND last_tag OR regexp_matches(piece, '[^\x20\x09-\x0D]'), true) AS inner_
    FROM t_events e LEFT JOIN t_outer o ON o.doc_id = e.doc_id WHERE kind IN ('text', 'cdata')"""


def counts_sql(tags) -> str:
    cols = ", ".join(f"count(*) FILTER (e.kind IN ('open', 'selfclose') AND e.name = '{t}') AS n_{t}" for t in tags)
    return f"""SELECT p.doc_id, {cols}, CAST((SELECT coalesce(sum(n_out), 0) FROM t_data d WHERE d.doc_id = p.doc_id AND inner_) AS BIGINT) AS n_chars
    FROM t_pages p LEFT JOIN t_events e ON e.doc_id = p.doc_id WHERE text IS NOT NULL GROUP BY p.doc_id"""


PROFILE_TAGS = ("a", "li", "p")
TABLES["t_counts"] = f"SELECT *, {' + '.join(f'n_{t}' for t in PROFILE_TAGS)} AS n_tags FROM ({counts_sql(PROFILE_TAGS)})"
_TO_MARKERS = r"regexp_replace(regexp_replace(text, '<(?:a|li)(?:\s[^>]*)?/>', '', 'g'), '<(a|li)\s[^>]*>', '<\1>', 'g')"
for _tag, (_start, _end) in MARKERS.items():
    _TO_MARKERS = f"replace(replace({_TO_MARKERS}, '<{_tag}>', '{_start}'), '</{_tag}>', '{_end}')"
TABLES["t_markers"] = f"SELECT doc_id, {_TO_MARKERS} AS text FROM t_pages"
