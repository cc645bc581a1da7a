"""DuckDB statements for the operators that SQL can express, written from their definitions.

Quality rules, packing, pieces and the classifier have none: they need zstandard, tokenizers or a
fitted model, and are tested against brute force, round trips and held-out rows.
"""

from __future__ import annotations

from tickerloom.llm.chat import CLOSE, CONTROLS, OPEN
from tickerloom.llm.line_dedup import LineRules
from tickerloom.llm.secrets import EntropyRules

_WHITE = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{_WHITE}'), lambda w: w <> '')"

_EXACT = rf"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WHITE}', ' ', 'g') AS n FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM t JOIN g USING (n)
"""

_NEAR = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WHITE}'), lambda w: w <> '') AS w
    FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
        WHEN len(w) = 1 THEN [w[1]]
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS inter
    FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
        AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
link AS (SELECT a, b FROM shared WHERE 100 * inter >= 80 * (na + nb - inter)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS node, a AS r FROM edge UNION SELECT edge.b, reach.r FROM reach JOIN edge ON edge.a = reach.node),
c AS (SELECT node, min(r) AS c FROM reach GROUP BY node)
SELECT doc_id, len(s) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM s LEFT JOIN c ON node = doc_id
"""

_REPEATS = rf"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM t WHERE len(w) >= 20),
k AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS k FROM v),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE r > 1),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
m AS (SELECT t.doc_id, w, coalesce(gone, []) AS gone FROM t LEFT JOIN g USING (doc_id)),
p AS (SELECT doc_id, w, gone, unnest(range(1, len(w) + 1)) AS i FROM m),
f AS (SELECT doc_id, string_agg(w[i], ' ' ORDER BY i) AS kept FROM
    (SELECT p.doc_id, p.w, p.i FROM p ANTI JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i) GROUP BY doc_id)
SELECT m.doc_id, len(w) AS n_words, len(gone) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM m LEFT JOIN f USING (doc_id)
"""


def _secret_spans() -> str:
    rules = EntropyRules()
    assign = (
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
        r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    )
    kinds = (
        (0, "assign", assign, f"length(regexp_extract(m, '{assign}', 2)) >= 8"),
        (1, "access", "AKIA[A-Z0-9]+", "length(m) >= 16"),
        (2, "hex", "[0-9a-f]+", "length(m) >= 32"),
        (3, "entropy", f"[A-Za-z0-9+/_=-]{{{rules.shortest},}}", "true"),
    )
    parts = []
    for k, name, pattern, test in kinds:
        parts.append(
            f"""SELECT doc_id, {k} AS k, '{name}' AS kind, m, i,
            len(array_to_string(gaps[1:i], '')) + len(array_to_string(found[1:i - 1], '')) AS a
            FROM (SELECT doc_id, unnest(found) AS m, unnest(range(1, len(found) + 1)) AS i, found, gaps
                FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found,
                    string_split_regex(text, '{pattern}') AS gaps FROM t)) WHERE {test}"""
        )
    allowed = " OR ".join(f"regexp_matches(m, '{p}')" for p in rules.allowed)
    window = " ".join(f"WHEN regexp_matches(m, '{c.pattern}') THEN {c.window}" for c in rules.classes)
    least = " ".join(f"WHEN regexp_matches(m, '{c.pattern}') THEN {c.least_bits}" for c in rules.classes)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(parts)}),
judged AS (SELECT DISTINCT m, CASE {window} END AS size, CASE {least} END AS least FROM found
    WHERE k = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT ({allowed})),
win AS (SELECT m, least, substring(m, unnest(range(1, greatest(length(m) - size, 0) + 2)), size) AS v FROM judged),
chars AS (SELECT m, least, v, unnest(string_split(v, '')) AS c FROM (SELECT DISTINCT * FROM win)),
bits AS (SELECT m, least, v, round(entropy(c), 9) AS h FROM chars GROUP BY m, least, v),
random AS (SELECT m FROM bits GROUP BY m, least HAVING max(h) >= least),
span AS (SELECT doc_id, k, kind, a, a + length(m) AS z FROM found WHERE k < 3 OR m IN (SELECT m FROM random)),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
    count(*) FILTER (k = 3) AS n3,
    string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) AS spans,
    string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) FILTER (k < 3) AS base FROM span GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
    coalesce(n3, 0) AS n_entropy, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""


def _chat() -> str:
    escaped = r"replace(text, '\', '\\')"
    for c in CONTROLS:
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\{c[1:]}')"
    marks = len(OPEN) + len(CLOSE) + 2
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum({marks} + length(role) + length({escaped}))::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def _lines() -> str:
    least = LineRules().least_words
    return rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
o AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS no FROM d),
w AS (SELECT doc_id, no, list_filter(string_split_regex(line, '{_WHITE}'), lambda w: w <> '') AS w FROM o),
c AS (SELECT doc_id, no, array_to_string(w, ' ') AS line, w FROM w WHERE len(w) >= {least}),
u AS (SELECT line, any_value(w) AS w, min((doc_id, no)) AS first FROM c GROUP BY line),
v AS (SELECT line, first, i, sha256(array_to_string(w[1:i - 1] || w[i + 1:], ' ')) AS v
    FROM (SELECT line, first, w, unnest(range(1, len(w) + 1)) AS i FROM u)),
z AS (SELECT line, first, sha256(line) AS v FROM u),
near AS (SELECT a.line FROM v a JOIN (SELECT v, i, min(first) AS f FROM v GROUP BY v, i) b ON a.v = b.v AND a.i = b.i AND b.f < a.first
    UNION SELECT a.line FROM v a JOIN z b ON a.v = b.v AND b.first < a.first
    UNION SELECT a.line FROM z a JOIN v b ON a.v = b.v AND b.first < a.first),
gone AS (SELECT doc_id, no FROM c JOIN u USING (line)
    WHERE (doc_id, no) > first OR line IN (SELECT line FROM near)),
kept AS (SELECT o.doc_id, string_agg(line, chr(10) ORDER BY o.no) AS kept, count(*) AS n
    FROM o ANTI JOIN gone ON gone.doc_id = o.doc_id AND gone.no = o.no GROUP BY o.doc_id)
SELECT d.doc_id, len(l) AS n_lines, len(l) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def _lines_short() -> str:
    """Equal lines of one word and more, edited lines as in the other statement."""
    long = f"WHERE len(w) >= {LineRules().least_words}"
    edited = _lines().replace("AS i FROM u))", f"AS i FROM u {long}))").replace("AS v FROM u)", f"AS v FROM u {long})")
    return edited.replace(f"FROM w {long})", "FROM w WHERE len(w) >= 1)")


_LEAKS = r"""
WITH s AS (SELECT 0 AS side, doc_id, '' AS item_id, text FROM documents
    UNION ALL SELECT 1, 0, CAST(item_id AS VARCHAR), text FROM benchmark),
w AS (SELECT side, doc_id, item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM s),
b AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
    FROM w WHERE side = 1 AND len(w) > 0),
win AS (SELECT DISTINCT n, array_to_string(w[i:i + n - 1], ' ') AS k, item_id FROM b),
p AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM win)
    WHERE side = 0 AND len(w) >= n),
hit AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM p) JOIN win USING (n, k)),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hit) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
    FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id) WHERE side = 0
"""


_PHRASES = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM t),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
o AS (SELECT lang, 1 AS k, unnest(w) AS g FROM p
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p),
f AS (SELECT lang, k, g, count(*) AS f FROM o GROUP BY lang, k, g HAVING count(*) >= 10),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1),
u AS (SELECT lang, k, g, a, w, i, array_to_string(w[1:i], ' ') AS lg, array_to_string(w[i + 1:], ' ') AS rg
    FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
s AS (SELECT u.*, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM u JOIN f l ON l.lang = u.lang AND l.g = lg AND l.k = i JOIN f r ON r.lang = u.lang AND r.g = rg AND r.k = u.k - i),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1),
h AS (SELECT lang, g, max(f) AS f FROM (SELECT lang, w[1] || ' ' || w[2] AS g, a AS f FROM c WHERE k = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY lang, g),
z AS (SELECT b.lang, b.g AS phrase, a, l, r, score FROM b LEFT JOIN h ON h.lang = b.lang AND h.g = b.g
    WHERE h.f IS NULL OR 100 * h.f < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM z JOIN n USING (lang) QUALIFY rank <= 2000
"""


#: The remainder of the CRC by the bits of a decimal's digits: a number of 0 and more is a byte, -1 a shift.
_TRIE = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER
    (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
    FROM conversations WHERE conv_id IS NOT NULL),
x AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS v FROM o),
k AS (SELECT c, c - c % 20 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(v, ''),
    lambda b: [unicode(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h FROM x),
r AS (SELECT c, 0 AS part, p, role, text FROM k JOIN o ON conv_id = base AND p <= h
    UNION ALL SELECT c, 1, p, role, text FROM k JOIN o ON conv_id = c AND p > h),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, sha256(length(role) || ':' || role || text) AS id,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM r),
l AS (SELECT c, list(id ORDER BY d) AS ids, list(w ORDER BY d) AS ws FROM t GROUP BY c),
s AS (SELECT k.c, coalesce(ids, []) AS ids, coalesce(ws, []) AS ws FROM k LEFT JOIN l USING (c)),
m AS (SELECT c, d, array_to_string(ids[1:d], '') AS key, ws[d] AS w, len(ids) = d AS ended
    FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM s)),
n AS (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(w), 0) AS w,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ended), '') AS ends FROM m GROUP BY d, key),
u AS (SELECT d - 1 AS d, substring(key, 1, 64 * (d - 1)) AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN u USING (d, key)),
b AS (SELECT e AS d, substring(key, 1, 64 * e) AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
    sum((n_convs - 1) * w) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM a) GROUP BY ALL)
SELECT a.conv_id, a.d AS depth, q.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves::BIGINT AS n_leaves,
    saved::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM a JOIN b USING (d, key) LEFT JOIN n q ON q.d = a.d - 1 AND q.key = substring(a.key, 1, 64 * (a.d - 1))
"""


def llm_oracle_sql() -> dict[str, str]:
    return {
        "op2_chat": _chat(),
        "op3_near_dedup": _NEAR,
        "op4_secrets": _secret_spans(),
        "op6_exact_dedup": _EXACT,
        "op8_substring_dedup": _REPEATS,
        "op9_line_dedup": _lines_short(),
        "op9_line_dedup_long": _lines(),
        "op11_phrases": _PHRASES,
        "op12_prefix_trie": _TRIE,
        "op13_decontaminate": _LEAKS,
    }
