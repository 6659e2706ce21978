"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from tidewell.llm import collocations, fim, licenses, secret_scan, sharding

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lower-cases A-Z only.
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_sql() -> str:
    values = ", ".join(
        f"({n}, '{label}', '{label.split('-')[0]}', {str(exact).lower()}, string_split('{text}', ' '))"
        for n, (exact, label, text) in enumerate(
            [(True, *x) for x in licenses.PHRASES] + [(False, *x) for x in licenses.NOTICES]
        )
    )
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_WORDS}') AS w FROM documents),
t(template, label, family, exact, w) AS (VALUES {values}),
g AS (SELECT template, unnest(range(len(w) - 1)) AS t_pos, w FROM t),
grams AS (SELECT template, t_pos, w[t_pos + 1] AS one, w[t_pos + 2] AS two FROM g),
p AS (SELECT doc_id, unnest(range(len(w) - 1)) AS pos, w FROM d WHERE len(w) > 1),
pairs AS (SELECT doc_id, pos, w[pos + 1] AS one, w[pos + 2] AS two FROM p),
hits AS (SELECT doc_id, template, pos - t_pos AS diagonal, t_pos FROM pairs JOIN grams USING (one, two)),
bands AS (SELECT h.*, t.label, t.family, t.exact, len(t.w) - 1 AS n_grams,
  unnest(CASE WHEN t.exact THEN [diagonal] ELSE list_transform(range(least({licenses.SLACK}, (len(t.w) - 1) // 4) + 1), lambda i: diagonal - i) END) AS anchor FROM hits h JOIN t USING (template)),
firsts AS (SELECT doc_id, template, label, family, exact, n_grams, anchor, t_pos, min(t_pos + diagonal) AS pos, bool_or(diagonal = anchor) AS own FROM bands GROUP BY ALL),
walked AS (SELECT *, pos > coalesce(max(pos) OVER (PARTITION BY doc_id, template, anchor ORDER BY t_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS later FROM firsts),
spans AS (SELECT doc_id, template, label, family, exact, n_grams, anchor, count(*) FILTER (later) AS votes, min(pos) FILTER (later) AS start_
  FROM walked GROUP BY ALL HAVING bool_or(own)),
tops AS (SELECT *, max(votes * 1099511627776 - anchor) OVER (PARTITION BY doc_id, template ORDER BY anchor
  RANGE BETWEEN {licenses.SLACK} PRECEDING AND {licenses.SLACK} FOLLOWING) AS top FROM spans),
ranked AS (SELECT *, votes / n_grams AS coverage,
  row_number() OVER (PARTITION BY doc_id, exact, family, start_ ORDER BY votes / n_grams DESC, template) AS place
  FROM tops WHERE exact OR votes * 1099511627776 - anchor = top),
found AS (SELECT *, CASE WHEN exact THEN votes = n_grams ELSE coverage >= {licenses.COVERAGE} AND place = 1 END AS kept FROM ranked),
summed AS (SELECT doc_id, count(*) FILTER (kept AND exact) AS n_base,
  min(start_) FILTER (kept AND exact) AS first_word, max(start_) FILTER (kept AND exact) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kept AND exact) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kept) AS labels,
  round(max(coverage), 6) AS score, count(*) FILTER (kept AND NOT exact) AS n_notices FROM found GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0) AS score, coalesce(n_notices, 0) AS n_notices
FROM d LEFT JOIN summed USING (doc_id)"""


_CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, contains(text, '\\') OR contains(text, '\<') OR contains(text, '<turn ') OR contains(text, '</turn>')
  OR suffix(text, '\') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + 16 + CASE WHEN escaped
    THEN length(replace(replace(replace(text, '\', '\\'), '<turn ', '\<turn '), '</turn>', '\</turn>')) ELSE length(text) END)::BIGINT AS formatted_chars,
  count(*) FILTER (escaped) AS n_escaped
FROM e GROUP BY conv_id"""

_DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLDED}, '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLDED}, '{_WORDS}') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, w, unnest(range(greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS t FROM bw),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, w, unnest(range(len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n),
spots AS (SELECT r, n, s, array_to_string(w[s + 1 : s + n], ' ') AS t FROM dw),
hits AS (SELECT r, n, s, item_id FROM spots JOIN win USING (n, t)),
places AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)"""

_TIERS = " + ".join(f"(n_bytes > {sharding.TIER_BYTES * sharding.TIER_BASE**i})::INT" for i in range(16))


def _sharding_plan(name: str, shards: str) -> str:
    """CTEs that plan a compaction of ``shards``: {name}_runs (shard, n_bytes, run, alone) and {name} (the shards after it)."""
    return f"""
{name}_small AS (SELECT *, {_TIERS} AS tier, (shard % {sharding.VERSION}) // {sharding.BLOCK * sharding.PARTS} AS block FROM {shards} WHERE n_bytes * 2 < {sharding.TARGET_BYTES}),
{name}_parts AS (SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY tier, block ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  // {sharding.TARGET_BYTES} AS portion FROM {name}_small),
{name}_runs AS (SELECT shard, n_docs, n_bytes, min(shard) OVER (PARTITION BY tier, block, portion) AS run FROM {name}_parts
  UNION ALL SELECT shard, n_docs, n_bytes, shard FROM {shards} WHERE n_bytes * 2 >= {sharding.TARGET_BYTES}),
{name} AS (SELECT run AS shard, sum(n_docs)::BIGINT AS n_docs, sum(n_bytes)::BIGINT AS n_bytes, count(*) AS merged FROM {name}_runs GROUP BY run)"""


#: Appends are versions 1, 2 and, after the first compaction if it merges anything, the next one.
_SHARDING = f"""
WITH arrived AS (SELECT *, coalesce(floor(doc_id / {sharding.ARRIVAL_IDS}), -1)::BIGINT AS arrival FROM documents),
d AS (SELECT *, ((arrival % 3) + 3) % 3 AS delivery FROM arrived),
early AS (SELECT (delivery + 1) * {sharding.VERSION} + (arrival + 1) * {sharding.PARTS} AS shard, arrival, count(*) AS n_docs,
  coalesce(sum(strlen(text)), 0)::BIGINT AS n_bytes FROM d WHERE delivery < 2 GROUP BY delivery, arrival),{_sharding_plan("one", "early")},
late AS (SELECT (3 + (SELECT coalesce(max(merged) > 1, false)::INT FROM one)) * {sharding.VERSION} + (arrival + 1) * {sharding.PARTS} AS shard, arrival, count(*) AS n_docs,
  coalesce(sum(strlen(text)), 0)::BIGINT AS n_bytes FROM d WHERE delivery = 2 GROUP BY arrival),
both_ AS (SELECT shard, n_docs, n_bytes FROM one UNION ALL SELECT shard, n_docs, n_bytes FROM late),{_sharding_plan("two", "both_")},
first_of AS (SELECT arrival, run AS shard FROM early JOIN one_runs USING (shard) UNION ALL SELECT arrival, shard FROM late),
last_of AS (SELECT arrival, run AS shard FROM first_of JOIN two_runs USING (shard))
SELECT doc_id, md5(text) AS text_md5, source, shard, n_docs AS shard_docs, n_bytes AS shard_bytes,
  (3 + (SELECT coalesce(max(merged) > 1, false)::INT FROM one) + (SELECT coalesce(max(merged) > 1, false)::INT FROM two))::BIGINT AS version
FROM d JOIN last_of USING (arrival) JOIN two USING (shard)"""


def _matches(name: str, source: str, key: str, text: str, pattern: str) -> str:
    """CTE {name} (the columns of ``key``, m, start_): matches of a pattern in a text, with the code points before them."""
    p = pattern.replace("'", "''")
    return f"""
{name}_cut AS (SELECT {key}, regexp_extract_all({text}, '{p}') AS ms, regexp_split_to_array({text}, '{p}') AS gaps FROM {source} WHERE regexp_matches({text}, '{p}')),
{name}_at AS (SELECT *, unnest(range(len(ms))) AS i FROM {name}_cut),
{name} AS (SELECT {key}, ms[i + 1] AS m, (list_sum(list_transform(gaps[1 : i + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1 : i], lambda g: length(g))), 0))::BIGINT AS start_ FROM {name}_at)"""


def _secrets_sql() -> str:
    scan = secret_scan
    allowed = " OR ".join(f"regexp_matches(m, '{p}')" for p in scan.ALLOWED)
    weights = "[" + ", ".join(map(str, scan.WEIGHTS)) + "]"
    parts, kinds = [], []
    for number, (kind, letters, bits) in enumerate(scan.CLASSES, 3):
        run = f"[{letters}]{{{scan.WINDOW},}}"
        parts.append(
            _matches(f"r{number}", "cands", "doc_id, r, off", "text", run)
            + f""",
w{number} AS (SELECT r, doc_id, off + start_ AS run, m, unnest(range(length(m) - {scan.WINDOW} + 1)) AS i FROM r{number}),
h{number} AS (SELECT r, doc_id, run, i FROM w{number} WHERE
  list_sum(list_transform(map_values(list_aggregate(string_split(substr(m, i + 1, {scan.WINDOW}), ''), 'histogram')), lambda c: {weights}[c::INT + 1])) <= {scan.most_weight(bits)}),
j{number} AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY r, run ORDER BY i) + {scan.WINDOW}, true) AS head FROM h{number}),
k{number} AS (SELECT *, sum(head::INT) OVER (PARTITION BY r, run ORDER BY i) AS island FROM j{number})"""
        )
        kinds.append(f"SELECT r, {number} AS k, '{kind}' AS kind, run + min(i) AS a, run + max(i) + {scan.WINDOW} AS b FROM k{number} GROUP BY r, run, island")
    tail = scan.ASSIGN.replace("'", "''")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),{_matches("s", "d", "doc_id, r", "text", scan.ASSIGN)},{_matches("c", "d", "doc_id, r", "text", scan.ACCESS)},{_matches("x", "d", "doc_id, r", "text", scan.HEX)},{_matches("cand", "d", "doc_id, r", "text", scan.CANDIDATE)},
cands AS (SELECT doc_id, r, start_ AS off, m AS text FROM cand WHERE NOT ({allowed})),{",".join(parts)},
spans AS (
  SELECT r, 0 AS k, 'assign' AS kind, start_ AS a, start_ + length(m) AS b FROM s WHERE length(regexp_extract(m, '{tail}', 2)) >= {scan.LEAST_ASSIGN}
  UNION ALL SELECT r, 1, 'access', start_, start_ + length(m) FROM c WHERE length(m) >= {scan.LEAST_ACCESS}
  UNION ALL SELECT r, 2, 'hex', start_, start_ + length(m) FROM x WHERE length(m) >= {scan.LEAST_HEX}
  UNION ALL {" UNION ALL ".join(kinds)}),
told AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) FILTER (k < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (r)"""


_C = collocations
_COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, '{_C.UNKNOWN}') AS lang, unnest(regexp_split_to_array({_FOLDED}, '[.,;:!?
-]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
g AS ({" UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i + 1 : i + {k}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(len(w) - {k - 1})) AS i FROM w WHERE len(w) >= {k})" for k in range(1, _C.LONGEST + 1))}),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {_C.LEAST}),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT *, array_to_string(w[1 : cut], ' ') AS one, array_to_string(w[cut + 1 :], ' ') AS two FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
scored AS (SELECT cuts.*, l.a AS l, r.a AS r, ({_C.SCALE}::HUGEINT * cuts.a) // (l.a + r.a) AS score FROM cuts
  JOIN f l ON l.lang = cuts.lang AND l.phrase = one JOIN f r ON r.lang = cuts.lang AND r.phrase = two),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, a, array_to_string(w[s : s + size - 1], ' ') AS phrase FROM
  (SELECT *, unnest(range(1, k - size + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS size FROM c))),
most AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
kept AS (SELECT least.* FROM least LEFT JOIN most USING (lang, phrase) WHERE coalesce(100::HUGEINT * longer < {_C.ABSORBED}::HUGEINT * a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {_C.TOP}"""


def _fim_sql() -> str:
    draws = ", ".join(f"list_reduce(list_transform(string_split(h[{8 * i + 1} : {8 * i + 8}], ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT), lambda x, y: x * 16 + y) AS h{i + 1}" for i in range(4))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{fim.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, {draws} FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS one, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS two FROM u),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '{fim.PREFIX}') OR contains(text, '{fim.SUFFIX}') OR contains(text, '{fim.MIDDLE}') OR h3 % 100 >= {fim.FIM_PERCENT} THEN 'plain'
  WHEN h4 % 100 < {fim.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1 : one], '') AS p, array_to_string(u[one + 1 : two], '') AS m, array_to_string(u[two + 1 :], '') AS s FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{fim.PREFIX}' || p || '{fim.SUFFIX}' || s || '{fim.MIDDLE}' || m
  ELSE '{fim.SUFFIX}' || s || '{fim.PREFIX}' || p || '{fim.MIDDLE}' || m END AS output FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o"""


ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": _license_sql(),
    "op2_chat_format": _CHAT,
    "op3_sharding": _SHARDING,
    "op4_decontaminate": _DECONTAMINATE,
    "op11_secret_scan": _secrets_sql(),
    "op12_collocations": _COLLOCATIONS,
    "op13_fill_in_middle": _fim_sql(),
}
