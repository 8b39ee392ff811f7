"""DuckDB SQL of the queries that SQL can express; ``documents`` and ``benchmark`` are views of the tables."""

from __future__ import annotations

from citeloom.llm import repetition_rules, secret_scan, seed_decontamination

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
WORD = r"[^\x20\x09-\x0D]+"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of an SQL text expression's UTF-8 bytes, bit by bit (polynomial 0xEDB88320);
    of characters up to U+07FF."""
    code = "unicode(c)"
    octets = f"list_transform(string_split({text}, ''), lambda c: CASE WHEN c = '' THEN [] WHEN {code} < 128 THEN [CAST({code} AS BIGINT)] ELSE [192 + CAST({code} AS BIGINT) // 64, 128 + CAST({code} AS BIGINT) % 64] END)"
    steps = f"flatten(list_transform(flatten({octets}), lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(4294967295, {steps}), lambda c, x: xor(xor(c, x) // 2, 3988292384 * (xor(c, x) % 2))), 4294967295)"


def near_duplicates(width: int = 2, percent: int = 80) -> str:
    return f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + {width - 1}], ' ') AS g FROM words, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - {width - 1}, 1))) AS k) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= {percent} * (x.n + y.n - m)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
low AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN low l ON l.node = d.doc_id"""


def repetition() -> str:
    lengths = list(repetition_rules.LIMITS)
    leads = lambda n: ", ".join(f"lead(word, {k}) OVER d" for k in range(n))
    grams = ", ".join(f"CASE WHEN pos + {n} <= count(*) OVER (PARTITION BY doc_id) THEN concat_ws(' ', {leads(n)}) END AS g{n}" for n in lengths)
    twice = ", ".join(f"CASE WHEN g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 THEN 1 ELSE 0 END AS t{n}" for n in lengths)
    inside = ", ".join(f"max(t{n}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS in{n}" for n in lengths)
    sums = ", ".join(f"CAST(sum(in{n} * length(word)) AS BIGINT) AS dup{n}_chars" for n in lengths)
    zero = ", ".join(f"coalesce(dup{n}_chars, 0) AS dup{n}_chars" for n in lengths)
    fine = " AND ".join([f"100 * dup_line_chars <= {repetition_rules.LINE_LIMIT} * word_chars", *(f"100 * dup{n}_chars <= {most} * word_chars" for n, most in repetition_rules.LIMITS.items())])
    failed = f"(n_words < {repetition_rules.LEAST_WORDS} OR 100 * n_repeat_words > {repetition_rules.BASE_PERCENT} * n_words)"
    return rf"""WITH listed AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM listed),
grams AS (SELECT *, {grams} FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
inside AS (SELECT *, {inside} FROM (SELECT *, {twice} FROM grams)),
summed AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, CAST(sum(in5) AS BIGINT) AS n_repeat_words, {sums} FROM inside GROUP BY doc_id),
lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM listed)) WHERE regexp_matches(line, '{WORD}')),
again AS (SELECT doc_id, count(*) AS n_dup_lines, CAST(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS BIGINT) AS dup_line_chars FROM lines WHERE r > 1 GROUP BY doc_id),
counted AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {zero} FROM listed LEFT JOIN summed USING (doc_id) LEFT JOIN again USING (doc_id))
SELECT *, {failed} AS base_failed, NOT {failed} AND {fine} AS kept FROM counted"""


def secrets() -> str:
    def pattern(kind: str) -> str:
        out = secret_scan.PATTERNS[kind]
        if out.startswith("(?i:"):  # one engine folds beyond ASCII
            names, rest = out[4:].split(")", 1)
            out = "(?:" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in names) + ")" + rest
        return _quoted(out)

    def found(kind: str, k: int) -> str:
        tests = {"assign": f"length(regexp_extract(hit, {pattern(kind)}, 1)) >= 8", "opaque": "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]')"}
        return f"""SELECT doc_id, '{kind}' AS kind, {k} AS k, CAST(e - length(hit) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM
  (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM
    (SELECT doc_id, regexp_extract_all(text, {pattern(kind)}) AS hits, string_split_regex(text, {pattern(kind)}) AS gaps FROM texts))) WHERE {tests.get(kind, 'true')}"""

    strong = " UNION ALL ".join(found(kind, k) for k, kind in enumerate(secret_scan.STRONG))
    weak = " UNION ALL ".join(found(kind, k + len(secret_scan.STRONG)) for k, kind in enumerate(secret_scan.WEAK))
    role = "CASE WHEN kind IN ('access', 'ident') THEN 'identifier' WHEN kind = 'endpoint' THEN 'endpoint' ELSE 'secret' END"
    text = "string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, k, e)"
    counts = ", ".join(f"(SELECT count(*) FROM strong x WHERE x.doc_id = t.doc_id AND kind = '{kind}') AS n_{kind}" for kind in secret_scan.STRONG)
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
strong AS ({strong}), loose AS ({weak}),
weak AS (SELECT * FROM loose w WHERE NOT EXISTS (SELECT 1 FROM strong b WHERE b.doc_id = w.doc_id AND b.s < w.e AND w.s < b.e)),
parts AS (SELECT *, {role} AS role FROM (SELECT * FROM strong UNION ALL SELECT * FROM weak)),
linked AS (SELECT doc_id, kind, k, s, e FROM parts w WHERE kind IN ('ident', 'opaque', 'endpoint') AND EXISTS (SELECT 1 FROM parts q WHERE q.doc_id = w.doc_id AND q.s - w.e <= {secret_scan.SCOPE} AND w.s - q.e <= {secret_scan.SCOPE} AND q.role <> w.role AND (q.role = 'secret' OR w.role = 'secret'))),
base AS (SELECT doc_id, {text} AS x FROM strong GROUP BY doc_id),
every AS (SELECT doc_id, {text} AS x FROM (SELECT * FROM strong UNION ALL SELECT * FROM linked) GROUP BY doc_id)
SELECT t.doc_id, {counts}, sha256(coalesce(b.x, '')) AS base_sha256, coalesce(a.x, '') AS spans, (SELECT count(*) FROM linked x WHERE x.doc_id = t.doc_id) AS n_linked FROM texts t LEFT JOIN base b USING (doc_id) LEFT JOIN every a USING (doc_id)"""


def decontamination() -> str:
    window, agree, token = seed_decontamination.WINDOW, seed_decontamination.AGREE, r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+"
    listed = lambda table, key: f"SELECT {key}, unnest(x) AS token, generate_subscripts(x, 1) AS pos, len(x) AS n FROM (SELECT {key}, regexp_extract_all({LOWERED}, '{token}') AS x FROM {table})"
    return f"""WITH d AS ({listed("documents", "doc_id")}), b AS ({listed("benchmark", "item_id")}),
same AS (SELECT doc_id, item_id, b.n, d.pos - b.pos AS shift, b.pos AS q, least(b.n, d.n - d.pos + b.pos) - greatest(1, b.pos - d.pos + 1) + 1 AS span FROM d JOIN b USING (token)),
windows AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q RANGE BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS m FROM same WHERE span >= least({window}, n)),
shifts AS (SELECT doc_id, item_id, shift, max(m) AS m, count(*) AS agree FROM windows GROUP BY ALL HAVING 100 * max(m) >= {agree} * least({window}, max(n))),
best AS (SELECT doc_id, item_id, arg_max(agree, m * 1000000 + agree) AS matched FROM shifts GROUP BY ALL),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, max(matched) AS matched FROM best GROUP BY doc_id)
SELECT doc_id, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, coalesce(matched, 0) AS matched, n_items IS NULL AS kept FROM documents LEFT JOIN found USING (doc_id)"""
