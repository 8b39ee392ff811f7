"""Queries of the column functions, the lexer, profiles and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import labels as L, markup, urn as U
from citeloom.operators import chardata, evaluation, lexing, profiling, structure, tokens as T, wellformed
from citeloom.plans import binding as B
from citeloom.plans.binding import query
from citeloom.sources.storage import stored


@query("b1_strip_tags", r"SELECT doc_id, regexp_replace(text, '</?(?:a|li)(?:\s[^>]*)?/?>', '', 'g') AS text FROM t_pages")
def strip_tags(spark, sf):
    return B.pages(spark, sf).select("doc_id", markup.strip_tags(F.col("text"), ("a", "li")).alias("text"))


@query("b2_extract_citations", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '(?s)<a(?:\s[^>]*)?>(.*?)</a>', 1), '|') AS bibl, array_to_string(regexp_extract_all(text, '(?s)<li(?:\s[^>]*)?>(.*?)</li>', 1), '|') AS quote FROM t_pages")
def extract_citations(spark, sf):
    found = B.pages(spark, sf).select("doc_id", markup.extract_citations(F.col("text"), "a", "li").alias("x"))
    return found.select("doc_id", F.array_join("x.bibl", "|").alias("bibl"), F.array_join("x.quote", "|").alias("quote"))


@query("b3_drop_tag_attributes", r"SELECT doc_id, regexp_replace(text, '<(a|li|div)\s[^>]*?(/?)>', '<\1\2>', 'g') AS text FROM t_pages")
def drop_attributes(spark, sf):
    return B.pages(spark, sf).select("doc_id", markup.drop_attributes(F.col("text"), ("a", "li", "div")).alias("text"))


@query("b4_tags_to_markers", "SELECT * FROM t_markers")
def tags_to_markers(spark, sf):
    return B.pages(spark, sf).select("doc_id", markup.to_markers(F.col("text"), B.MARKERS).alias("text"))


@query("b5_split_preamble", r"SELECT doc_id, p AS preamble, md5(substring(text, length(p) + 1)) AS rest FROM (SELECT *, regexp_extract(text, '(?s)^((?:\s*<[?!][^>]*>)*\s*)', 1) AS p FROM t_pages)")
def split_preamble(spark, sf):
    return B.pages(spark, sf).select("doc_id", markup.preamble(F.col("text")).alias("preamble"), F.md5(markup.after_preamble(F.col("text"))).alias("rest"))


@query("b6_markup_events", 'SELECT doc_id, pos, start, "end", kind, name, piece FROM t_events')
def markup_events(spark, sf):
    return lexing.markup_events(B.pages(spark, sf))


@query("b7_strip_with_spans", """SELECT s.*, substring(t.text, s.start + 1, s."end" - s.start) AS content FROM t_spans_n s JOIN t_text_n t USING (doc_id)""")
def strip_with_spans(spark, sf):
    text, spans = lexing.strip_with_spans(B.pages(spark, sf), B.NESTED)
    return spans.join(text, "doc_id").select("doc_id", "start", "end", "type", "attrs", markup.slice_text(F.col("text"), F.col("start"), F.col("end")).alias("content"))


@query("b7_strip_with_spans_unbalanced", "SELECT * FROM t_spans_a")
def strip_with_spans_unbalanced(spark, sf):
    return lexing.strip_with_spans(B.pages(spark, sf), B.ADJACENT)[1]


@query("b8_strip_elements", "SELECT doc_id, string_agg(piece, '' ORDER BY pos) AS text FROM t_events WHERE name NOT IN ('div', 'b', 'nav') GROUP BY doc_id")
def strip_elements(spark, sf):
    return wellformed.strip_elements(B.pages(spark, sf), ("div", "b", "nav"))


@query("b9_attrs_text", r"SELECT doc_id, pos, coalesce(regexp_extract(piece, '(?s)^<[A-Za-z_][A-Za-z0-9_.:-]*(\s.*?)?\s*/?>$', 1), '') AS attrs FROM t_events WHERE kind = 'open'")
def attrs_text(spark, sf):
    return lexing.markup_events(B.pages(spark, sf)).where("kind = 'open'").select("doc_id", "pos", markup.attributes(F.col("piece")).alias("attrs"))


@query(
    "b10_trim_span",
    r"""SELECT doc_id, pos, start + length(inner_) - length(regexp_replace(inner_, '^[\x20\x09-\x0D]+', '')) AS s, CASE WHEN trim_ = '' THEN "end" ELSE start + length(trim_) END AS e
    FROM (SELECT *, regexp_replace(inner_, '[\x20\x09-\x0D]+$', '') AS trim_ FROM (SELECT t.*, substring(d.text, start + 1, "end" - start) AS inner_ FROM t_tokens t JOIN documents d USING (doc_id)))""",
)
def trim_span(spark, sf):
    # A token is the text between its bounds, so its own characters are trimmed, not cut out of the whole text again.
    inner = (F.col("token"), F.lit(0), F.length("token"))
    moved = lambda by: (F.col("start") + by)
    return T.tokenize_with_offsets(B.documents(spark, sf)).select("doc_id", "pos", moved(markup.trimmed_start(*inner)).alias("s"), moved(markup.trimmed_end(*inner)).alias("e"))


B.TABLES["t_rough"] = """SELECT DISTINCT doc_id, start, least(start + 40, n) AS "end", 'BIBL' AS type FROM (SELECT e.doc_id, e.start + (e.pos * 7) % 11 AS start, length(t.text) AS n FROM t_events e JOIN t_pages t USING (doc_id)) WHERE start < n"""


@query(
    "b11_snap_span",
    """SELECT DISTINCT doc_id, s AS start, e AS "end", type FROM (SELECT r.doc_id, coalesce(max(CASE WHEN t.start < r.start AND r.start < t."end" THEN t."end" END), r.start) AS s,
    coalesce(min(CASE WHEN t.start < r."end" AND r."end" < t."end" THEN t.start END), r."end") AS e, r.type
    FROM t_rough r LEFT JOIN (SELECT * FROM t_events WHERE kind <> 'text') t ON t.doc_id = r.doc_id AND ((t.start < r.start AND r.start < t."end") OR (t.start < r."end" AND r."end" < t."end")) GROUP BY r.doc_id, r.start, r."end", r.type) WHERE s < e""",
)
def snap_span(spark, sf):
    docs = B.pages(spark, sf)
    n = docs.select("doc_id", F.length("text").alias("n"))
    rough = lexing.markup_events(docs).join(n, "doc_id").select("doc_id", (F.col("start") + (F.col("pos") * 7) % 11).alias("start"), "n").where("start < n")
    rough = rough.select("doc_id", "start", F.least(F.col("start") + 40, F.col("n")).alias("end"), F.lit("BIBL").alias("type")).distinct()
    return lexing.snap_spans(rough, docs).distinct()


@query("b12_span_text", """SELECT b.doc_id, b.window_idx, md5(substring(d.text, window_start + 1, window_end - window_start)) AS digest FROM t_bounds b JOIN documents d USING (doc_id)""")
def span_text(spark, sf):
    docs = B.documents(spark, sf).select("doc_id", "text")
    bounds = T.window_bounds(T.windows(docs, B.SIZE, B.STRIDE)).join(docs, "doc_id")
    return bounds.select("doc_id", "window_idx", F.md5(markup.slice_text(F.col("text"), F.col("window_start"), F.col("window_end"))).alias("digest"))


_LABELLED = B.chance_label_sql("doc_id", "pos")
B.TABLES["t_labelled"] = f"SELECT doc_id, pos, {_LABELLED} AS label FROM t_tokens"


@query("b13_label_ids", "SELECT label, list_position(['O', 'B-BIBL', 'I-BIBL', 'B-QUOTE', 'I-QUOTE', 'B-CIT', 'I-CIT'], label) - 1 AS label_id, label AS back, count(*) AS n FROM t_labelled GROUP BY ALL")
def label_ids(spark, sf):
    rows = T.tokenize_with_offsets(B.documents(spark, sf)).select(B.chance_label("doc_id", "pos").alias("label"))
    rows = rows.withColumn("label_id", L.label_id(F.col("label")))
    return rows.withColumn("back", L.id_label(F.col("label_id"))).groupBy("label", "label_id", "back").agg(F.count("*").alias("n"))


@query("b14_drop_ignored", "SELECT doc_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS positions FROM t_labelled WHERE pos % 5 <> 0 GROUP BY doc_id")
def drop_ignored(spark, sf):
    rows = T.tokenize_with_offsets(B.documents(spark, sf)).select("doc_id", "pos", F.when(F.col("pos") % 5 == 0, L.IGNORED).otherwise(0).alias("truth"))
    return evaluation.drop_ignored(rows).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))


@query("b15_parse_urn", f"SELECT id, {B.parse_sql('urn')} FROM t_cites")
def parse_urn(spark, sf):
    return B.citations(spark, sf).select("id", U.parse(F.col("urn")).alias("p")).select("id", "p.namespace", "p.author", "p.work", "p.edition", "p.passage")


@query("c1_tokenize_with_offsets", "SELECT * FROM t_tokens")
def tokenize(spark, sf):
    return T.tokenize_with_offsets(B.documents(spark, sf))


@query(
    "c2_fit_length",
    """SELECT doc_id, array_to_string(list_resize(x[:64], 64, '-'), '') AS fitted, CAST(least(len(x), 64) AS BIGINT) AS attended FROM (SELECT doc_id, list(token ORDER BY pos) AS x FROM t_tokens GROUP BY doc_id)""",
)
def fit_length(spark, sf):
    wide = B.documents(spark, sf).where("text <> ''").select("doc_id", F.transform(T.token_array(F.col("text")), lambda x: x["token"]).alias("x"))
    attended = F.aggregate(L.attention(F.col("x"), 64), F.lit(0), lambda a, b: a + b)
    return wide.select("doc_id", F.array_join(L.fit_length(F.col("x"), 64, "-"), "").alias("fitted"), attended.alias("attended"))


@query("c3_sliding_windows", "SELECT * FROM t_bounds")
def sliding_windows(spark, sf):
    return T.window_bounds(T.windows(B.documents(spark, sf), B.SIZE, B.STRIDE))


@query("c4_window_text", "SELECT b.*, substring(d.text, window_start + 1, window_end - window_start) AS window_text FROM t_bounds b JOIN documents d USING (doc_id)")
def window_text(spark, sf):
    return T.window_text(T.windows(B.documents(spark, sf), B.SIZE, B.STRIDE))


@query("c5_reliable_center", "SELECT doc_id, owner, count(*) AS n, min(pos) AS first, max(pos) AS last FROM t_owned GROUP BY ALL")
def reliable_center(spark, sf):
    owned = T.reliable_center(T.tokenize_with_offsets(B.documents(spark, sf), counted=True), B.SIZE, B.STRIDE)
    return owned.groupBy("doc_id", "owner").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query("c6_merge_window_labels", f"SELECT doc_id, pos, {B.chance_label_sql('doc_id', 'owner', 'pos')} AS label FROM t_owned")
def merge_window_labels(spark, sf):
    windows = T.sliding_windows(T.tokenize_with_offsets(B.documents(spark, sf), counted=True), B.SIZE, B.STRIDE)
    labelled = windows.select("doc_id", "window_idx", "n", "pos", B.chance_label("doc_id", "window_idx", "pos").alias("label"))
    return T.merge_window_labels(labelled, B.SIZE, B.STRIDE).select("doc_id", "pos", "label")


@query(
    "c7_clip_spans_to_windows",
    """SELECT doc_id, k AS window_idx, greatest(start, k * 300) - k * 300 AS start, least("end", k * 300 + 600) - k * 300 AS "end", type
    FROM t_spans_a, LATERAL (SELECT unnest(generate_series(0, "end" // 300)) AS k) WHERE greatest(start, k * 300) < least("end", k * 300 + 600)""",
)
def clip_spans(spark, sf):
    return T.clip_spans_to_windows(lexing.strip_with_spans(B.pages(spark, sf), B.ADJACENT)[1], 600, 300)


@query("f1_tag_counts", "SELECT coalesce(CAST(doc_id AS VARCHAR), 'all') AS doc_id, CAST(sum(n_a) AS BIGINT) AS n_a, CAST(sum(n_li) AS BIGINT) AS n_li, CAST(sum(n_p) AS BIGINT) AS n_p, CAST(sum(n_tags) AS BIGINT) AS n_tags, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM t_counts GROUP BY ROLLUP (t_counts.doc_id)")
def tag_counts(spark, sf):
    totals = profiling.tag_totals(profiling.tag_counts(B.pages(spark, sf), B.PROFILE_TAGS), B.PROFILE_TAGS)
    return totals.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("all")))


@query("f2_select_documents", "SELECT * FROM t_counts WHERE n_tags >= 15")
def select_documents(spark, sf):
    return profiling.select_documents(profiling.tag_counts(B.pages(spark, sf), B.PROFILE_TAGS), 15)


_AREA = r"regexp_replace(regexp_replace(piece, '^</?[A-Za-z_][A-Za-z0-9_.:-]*', ''), '/?>$', '')"
_KEYS = rf"regexp_extract_all({_AREA}, {B.literal(wellformed._ATTRIBUTE)}, 1)"
_VALUES = rf"regexp_extract_all({_AREA}, {B.literal(wellformed._ATTRIBUTE)}, 2)"
_IS_TAG = "kind IN ('open', 'close', 'selfclose')"
_VOID = "(" + ", ".join(f"'{x}'" for x in wellformed.VOID) + ")"
B.TABLES["t_odd"] = rf"""SELECT doc_id, start AS place, CASE WHEN kind = 'text' AND starts_with(piece, '<') THEN 'tag'
    WHEN {_IS_TAG} AND NOT regexp_full_match({_AREA}, {B.literal("(?:" + chr(92) + "s+" + wellformed._ATTRIBUTE + ")*" + chr(92) + "s*")}) OR kind = 'close' AND trim({_AREA}) <> '' OR {_IS_TAG} AND len(list_distinct({_KEYS})) < len({_KEYS}) THEN 'attribute'
    WHEN ({_IS_TAG} OR kind = 'text') AND contains(regexp_replace(piece, {B.literal(wellformed.reference())}, '', 'g'), '&') THEN 'reference' END AS error FROM t_events"""
B.TABLES["t_shown"] = rf"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM t_events WHERE ({_IS_TAG} OR kind IN ('raw', 'cdata') OR kind = 'text' AND regexp_matches(piece, '[^\x20\x09-\x0D]')) AND name NOT IN {_VOID}"""
#: A stack of open elements, tag by tag, until a closing tag doesn't fit.
B.TABLES["t_walk"] = """SELECT doc_id, arg_max({'stack': len(stack), 'roots': roots, 'place': place, 'error': error, 'loose': loose, 'closed': start}, i) AS x FROM (WITH RECURSIVE walk AS
    (SELECT doc_id, 0 AS i, CAST([] AS VARCHAR[]) AS stack, 0 AS roots, CAST(NULL AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS error, false AS loose, CAST(NULL AS BIGINT) AS start FROM t_pages WHERE text IS NOT NULL UNION ALL
    SELECT doc_id, i, CASE WHEN kind = 'open' THEN list_append(stack, name) WHEN kind = 'close' THEN stack[:len(stack) - 1] ELSE stack END, roots + CASE WHEN top AND kind IN ('open', 'selfclose', 'raw') THEN 1 ELSE 0 END,
      coalesce(place, CASE WHEN wrong IS NOT NULL THEN start END), coalesce(error, wrong), wrong IS NOT DISTINCT FROM 'close', start FROM
      (SELECT w.*, s.kind, s.name, s.start, len(stack) = 0 AS top, CASE WHEN kind = 'close' AND (len(stack) = 0 OR stack[len(stack)] <> s.name) THEN 'close' WHEN len(stack) = 0 AND (kind IN ('text', 'cdata') OR kind IN ('open', 'selfclose', 'raw') AND roots > 0) THEN 'root' END AS wrong
       FROM (SELECT doc_id, i + 1 AS i, stack, roots, place, error FROM walk WHERE NOT loose) w JOIN t_shown s ON s.doc_id = w.doc_id AND s.i = w.i))
    SELECT * FROM walk) GROUP BY doc_id"""
B.TABLES["t_errors"] = """SELECT * FROM t_odd WHERE error IS NOT NULL UNION ALL SELECT doc_id, x.place, x.error FROM t_walk WHERE x.error IS NOT NULL UNION ALL SELECT doc_id, x.closed, 'close' FROM t_walk WHERE x.error = 'root' AND x.loose
    UNION ALL SELECT w.doc_id, length(text), CASE WHEN x.stack > 0 THEN 'open' ELSE 'root' END FROM t_walk w JOIN t_pages p ON p.doc_id = w.doc_id WHERE NOT x.loose AND (x.stack > 0 OR x.roots = 0)"""


@query(
    "f3_parse_status",
    f"""SELECT p.doc_id, (SELECT count(*) FROM t_events e WHERE e.doc_id = p.doc_id AND kind = 'open' AND name NOT IN {_VOID}) AS n_open, (SELECT count(*) FROM t_events e WHERE e.doc_id = p.doc_id AND kind = 'close' AND name NOT IN {_VOID}) AS n_close,
    NOT x.loose AND x.stack = 0 AS balanced, f.place IS NULL AS well_formed, f.error, f.place AS error_at FROM t_pages p JOIN t_walk w ON w.doc_id = p.doc_id
    LEFT JOIN (SELECT doc_id, place, min(error) AS error FROM t_errors e WHERE place = (SELECT min(place) FROM t_errors m WHERE m.doc_id = e.doc_id) GROUP BY ALL) f ON f.doc_id = p.doc_id""",
)
def parse_status(spark, sf):
    return wellformed.parse_status(B.pages(spark, sf))


@query("b9_attribute_rows", f"""SELECT doc_id, pos, unnest(range(len(k))) AS k, '' AS prefix, unnest(k) AS local, CAST(NULL AS VARCHAR) AS uri, unnest(list_transform(v, lambda x: substring(x, 2, length(x) - 2))) AS value FROM (SELECT doc_id, pos, {_KEYS} AS k, {_VALUES} AS v FROM t_events WHERE kind IN ('open', 'selfclose'))""")
def attribute_rows(spark, sf):
    return wellformed.attribute_rows(lexing.markup_events(B.pages(spark, sf)))


#: Pages with a default namespace, in which list items are of another one.
B.TABLES["t_spaced"] = """SELECT doc_id, '<tei xmlns="urn:main" xmlns:o="urn:other">' || replace(replace(text, '<li', '<o:li'), '</li', '</o:li') || '</tei>' AS text FROM t_pages"""
B.TABLES["t_spaced_events"] = B.events_sql("t_spaced")


def _spaced(spark, sf):
    other = F.replace(F.replace("text", F.lit("<li"), F.lit("<o:li")), F.lit("</li"), F.lit("</o:li"))
    return B.pages(spark, sf).select("doc_id", F.concat(F.lit('<tei xmlns="urn:main" xmlns:o="urn:other">'), other, F.lit("</tei>")).alias("text"))


@query("b8_strip_namespaced", "SELECT doc_id, string_agg(piece, '' ORDER BY pos) AS text FROM t_spaced_events WHERE name NOT IN ('p', 'li') GROUP BY doc_id")
def strip_namespaced(spark, sf):
    return wellformed.strip_elements(_spaced(spark, sf), ("p", "li"))


@query(
    "b8_element_tree",
    f"""SELECT * FROM (WITH RECURSIVE tags AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM t_events WHERE {_IS_TAG} AND name NOT IN {_VOID}),
    walk AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(name VARCHAR, pos BIGINT)[]) AS stack, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS end_pos, CAST(NULL AS BIGINT) AS parent, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS "end" FROM t_pages UNION ALL
      SELECT t.doc_id, t.i, CASE kind WHEN 'open' THEN list_append(stack, {{'name': t.name, 'pos': t.pos}}) WHEN 'close' THEN stack[:len(stack) - 1] ELSE stack END,
        CASE kind WHEN 'close' THEN stack[len(stack)].pos WHEN 'selfclose' THEN t.pos END, CASE WHEN kind <> 'open' THEN t.pos END, CASE kind WHEN 'close' THEN stack[len(stack) - 1].pos WHEN 'selfclose' THEN stack[len(stack)].pos END, t.name, t."end"
      FROM walk w JOIN tags t ON t.doc_id = w.doc_id AND t.i = w.i + 1)
    SELECT w.doc_id, pos, end_pos, parent, name FROM walk w LEFT JOIN t_errors x ON x.doc_id = w.doc_id AND x.error = 'close' WHERE end_pos IS NOT NULL AND "end" <= coalesce(x.place, "end"))""",
)
def element_tree(spark, sf):
    docs = B.pages(spark, sf)
    first = wellformed.errors(docs).where("error = 'close'").groupBy("doc_id").agg(F.min("at").alias("at"))
    tree = wellformed.elements(lexing.markup_events(docs), wellformed.VOID).join(first, "doc_id", "left")
    return tree.where("end <= coalesce(at, end)").select("doc_id", "pos", "end_pos", "parent", "name")


@query(
    "f1_character_spans",
    """SELECT doc_id, pos, start, "end", to_ - n_out AS decoded_start, to_ AS decoded_end, md5(replace(replace(replace(replace(replace(piece, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&')) AS digest
    FROM (SELECT *, CAST(sum(n_out) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS to_ FROM t_data)""",
)
def character_spans(spark, sf):
    docs = B.pages(spark, sf)
    decoded = stored(chardata.decoded(docs))
    runs = stored(chardata.run_rows(decoded))
    source = lexing.markup_events(docs).where("kind in ('text', 'cdata')").select("doc_id", "pos", "start", "end", F.col("start").alias("s"), F.col("end").alias("e"))
    moved = stored(chardata.to_decoded(source, runs))
    back = chardata.to_source(moved.select("doc_id", "start", "end").distinct(), runs).select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"))
    both = moved.join(back, ["doc_id", "s", "e"]).join(decoded.select("doc_id", "text"), "doc_id")
    return both.select("doc_id", "pos", F.col("s").alias("start"), F.col("e").alias("end"), F.col("start").alias("decoded_start"), F.col("end").alias("decoded_end"), F.md5(markup.slice_text(F.col("text"), F.col("start"), F.col("end"))).alias("digest"))


@query("f4_tag_proportions", "SELECT *, round(n_a / nullif(n_tags, 0), 6) AS p_a, round(n_li / nullif(n_tags, 0), 6) AS p_li, round(n_p / nullif(n_tags, 0), 6) AS p_p FROM t_counts")
def tag_proportions(spark, sf):
    return profiling.tag_proportions(profiling.tag_counts(B.pages(spark, sf), B.PROFILE_TAGS), B.PROFILE_TAGS)


def _profile_sql(tags, least: int) -> str:
    def stats(x: str, name: str, total: bool, whole: bool) -> list[str]:
        end = lambda f: f"{f}({x})" if whole else f"round({f}({x}), 6)"
        return ([f"CAST(sum({x}) AS BIGINT) AS {name}_total"] if total else []) + [f"round(avg({x}), 6) AS {name}_mean", f"round(quantile_cont({x}, 0.5), 6) AS {name}_median", f"{end('min')} AS {name}_min", f"{end('max')} AS {name}_max"]

    columns = [f"CAST(sum(CASE WHEN n_tags >= {least} THEN 1 ELSE 0 END) AS BIGINT) AS n_included", f"CAST(sum(CASE WHEN n_tags < {least} THEN 1 ELSE 0 END) AS BIGINT) AS n_excluded", f"CAST({least} AS BIGINT) AS min_tags"]
    kept = lambda c: f"(CASE WHEN n_tags >= {least} THEN {c} END)"
    columns += [*stats(kept("n_tags"), "tags", True, True), f"round(stddev_pop{kept('n_tags')}, 6) AS tags_stddev"]
    for t in tags:
        columns += [*stats(kept(f"n_{t}"), t, True, True), *stats(kept(f"n_{t} / nullif(n_tags, 0)"), f"{t}_share", False, False)]
    return f"SELECT {', '.join(columns)} FROM t_counts"


PROFILE_SQL = _profile_sql(B.PROFILE_TAGS, 15)


@query("f5_corpus_profile", PROFILE_SQL)
def corpus_profile(spark, sf):
    return profiling.corpus_profile(profiling.tag_counts(B.pages(spark, sf), B.PROFILE_TAGS), B.PROFILE_TAGS, 15)


@query("f6_char_weighted_proportions", "SELECT " + ", ".join(f"round(sum(n_{t} / n_tags * n_chars) / sum(n_chars), 6) AS {t}_weighted" for t in B.PROFILE_TAGS) + " FROM t_counts WHERE n_tags >= 15")
def char_weighted(spark, sf):
    return profiling.char_weighted_proportions(profiling.tag_counts(B.pages(spark, sf), B.PROFILE_TAGS), B.PROFILE_TAGS, 15)


@query("e6_roundtrip_corpus", r"SELECT doc_id, regexp_replace(text, '<(a|li)\s[^>]*?(/?)>', '<\1\2>', 'g') AS without_attributes, regexp_replace(text, '</?(?:a|li)(?:\s[^>]*)?/?>', '', 'g') AS without_tags FROM t_pages")
def roundtrip(spark, sf):
    return structure.roundtrip_corpus(B.pages(spark, sf), ("a", "li"))


