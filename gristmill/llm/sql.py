"""DuckDB SQL for those queries that SQL can express.

The others: op1 needs a tokenizer, op3 iterates to an estimate, op4 is approximate, op5 compares all strings of 400 bytes and of 51 words, op6 and op9 learn;
tests hold them against brute force.
"""

from __future__ import annotations

from gristmill.llm import licences, reputation

_RULE = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{rule}'"
    for rule, h, p in ((r, *r.split("/", 1)) for _, r in sorted(reputation.RULES, key=lambda x: -len(x[1])))
) + " END"
_VERDICT = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in reputation.RULES) + " END"
_STRENGTH = "(SELECT 1 / least(greatest(coalesce(sum((bad - n * mean) ** 2 - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0), 0.5), 0.001), 0.999) - 1 FROM {0})"

URL_FILTERS = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
k AS (SELECT *, regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', '') AS key FROM p),
l AS (SELECT *, regexp_extract(key, '[^.]*(\\.[^.]*)?$') AS domain FROM k),
m AS (SELECT *, regexp_extract(domain, '[^.]*$') AS suffix FROM l),
o AS (SELECT key, domain, suffix, count(*) AS n, sum((quality = 0 OR toxic = 1)::INT) AS bad FROM m JOIN labels ON doc_id = page_id WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY ALL),
w AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS mean FROM o),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT mean FROM w) AS mean FROM o GROUP BY suffix),
sp AS (SELECT suffix, (bad + {_STRENGTH.format("s")} * mean) / (n + {_STRENGTH.format("s")}) AS mean FROM s),
d AS (SELECT domain, suffix, sum(o.n) AS n, sum(o.bad) AS bad, any_value(sp.mean) AS mean FROM o JOIN sp USING (suffix) GROUP BY domain, suffix),
dp AS (SELECT domain, (bad + {_STRENGTH.format("d")} * mean) / (n + {_STRENGTH.format("d")}) AS mean FROM d),
r AS (SELECT key, n, bad, dp.mean FROM o JOIN dp USING (domain)), st AS (SELECT {_STRENGTH.format("r")} AS s),
ab AS (SELECT m.page_id, m.host, m.path, coalesce(st.s * r.mean + r.bad, st.s * dp.mean, st.s * sp.mean) AS a, coalesce(st.s * (1 - r.mean) + r.n - r.bad, st.s * (1 - dp.mean), st.s * (1 - sp.mean)) AS b
 FROM m CROSS JOIN st LEFT JOIN r USING (key) LEFT JOIN dp USING (domain) LEFT JOIN sp USING (suffix)),
v AS (SELECT page_id, host, path, {_RULE} AS rule, CASE WHEN a + b > 0 AND a / (a + b) - {reputation.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {reputation.THRESHOLD} THEN 'block' ELSE 'allow' END AS method FROM ab)
SELECT page_id, host, path, rule, coalesce({_VERDICT}, method) AS verdict FROM v"""

_ESCAPED = "replace(replace(replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'), '<<SYS>>', '<\\<SYS>>'), '<</SYS>>', '<\\</SYS>>')"

CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
(3 + sum(17 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})))::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""


def _canonical(x: str) -> str:
    x = f"regexp_replace(lower({x}), '{licences.COPYRIGHT_LINE}', '\\1', 'g')"
    x = f"' ' || trim(regexp_replace({x}, '{licences.OTHER}', ' ', 'g')) || ' '"
    for a, b in licences.SPELLINGS:
        x = f"replace({x}, ' {a} ', ' {b} ')"
    return f"trim({x})"


def _values(texts: dict[str, tuple[str, ...]]) -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return ", ".join(f"({quoted(t)}, '{name}')" for name, variants in texts.items() for t in variants)


LICENSES = f"""
WITH nt(t, name) AS (VALUES {_values(licences.NOTICES)}), n AS (SELECT DISTINCT sha256({_canonical("t")}) AS d, name FROM nt),
wt(t, name) AS (VALUES {_values(licences.NOTICES)}, {_values(licences.LICENCES)}), w AS (SELECT DISTINCT sha256({_canonical("t")}) AS d, name FROM wt UNION SELECT * FROM (VALUES {", ".join(f"('{d}', '{name}')" for name, own in licences.DIGESTS.items() for d in own)})),
c AS (SELECT doc_id, text, {_canonical("text")} AS c FROM documents), g AS (SELECT doc_id, CASE WHEN c <> '' THEN sha256(c) END AS digest FROM c),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE regexp_matches(lower(text), '{licences.NOTICE_WORDS}')),
f AS (SELECT doc_id, name FROM (SELECT doc_id, sha256({_canonical("line")}) AS d FROM l WHERE regexp_matches(lower(line), '{licences.NOTICE_WORDS}')) JOIN n USING (d)),
k AS (SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM f GROUP BY doc_id)
SELECT g.doc_id, g.digest, w.name AS licence, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices FROM g LEFT JOIN w ON w.d = g.digest LEFT JOIN k USING (doc_id)"""

JACCARD = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
d AS (SELECT s, min(doc_id) AS rep FROM s WHERE len(s) > 0 GROUP BY s), e AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM d),
c AS (SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
k AS (SELECT x, y FROM c WHERE 100 * shared >= 80 * (nx + ny - shared)), t AS (SELECT x, y FROM k UNION SELECT y, x FROM k),
r(node, root) AS (SELECT rep, rep FROM d UNION SELECT t.y, r.root FROM r JOIN t ON t.x = r.node WHERE r.root < t.y), m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.root, s.doc_id) AS component_id FROM s LEFT JOIN d ON d.s = s.s LEFT JOIN m ON m.node = d.rep"""

ORACLE: dict[str, str] = {"op2_url_filters": URL_FILTERS, "op7_chat_formatting": CHAT, "op8_license_scans": LICENSES, "op10_ngram_jaccard": JACCARD}
