"""DuckDB SQL for the rows of those corpus queries that SQL can express."""

from __future__ import annotations

from roadloom.llm.quality import CUTOFFS, RULES, SYMBOLS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1 = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) l FROM v),
k AS (SELECT a.vec_id a, b.vec_id b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.9 * a.l * b.l),
r(s, t) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.s, k.b FROM r JOIN k ON k.a = r.t),
c AS (SELECT s vec_id, min(t) component_id FROM r GROUP BY 1), d AS (SELECT a vec_id, count(*) n FROM k GROUP BY 1)
SELECT c.vec_id, coalesce(d.n, 0) n_links, c.component_id, c.vec_id = c.component_id kept FROM c LEFT JOIN d USING (vec_id)"""

_RATIO = {
    "repeats": "n_repeat_words, n_words",
    "symbols": "n_symbols, n_words",
    "capitals": "n_capitals, word_chars",
    "dup_lines": "n_dup_lines, n_lines",
    "exclaims": "n_exclaims, n_words",
}
_RATIOS = " UNION ALL ".join(
    f"SELECT doc_id, lang, '{r}' AS rule, CAST(floor(1000.0 * {_RATIO[r].split(', ')[0]} / greatest({_RATIO[r].split(', ')[1]}, 1)) AS BIGINT) ratio FROM f" for r in RULES
)
OP5 = f"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') t, {WORDS.format("coalesce(text, '')")} w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) p, w FROM w WHERE len(w) >= 8),
h AS (SELECT doc_id, p, array_to_string(w[p:p+7], ' ') s FROM g),
tw AS (SELECT doc_id, p FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cv AS (SELECT doc_id, count(DISTINCT p + o) n FROM tw, range(0, 8) x(o) GROUP BY 1),
li AS (SELECT doc_id, count(*) n, count(*) - count(DISTINCT l) d FROM (SELECT doc_id, unnest(string_split(t, chr(10))) l FROM w) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
f AS (SELECT w.doc_id, lang, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) n_symbols, coalesce(li.d, 0) n_dup_lines, coalesce(cv.n, 0) n_repeat_words,
  length(t) - length(translate(t, '{UPPER}', '')) n_capitals, length(t) - length(replace(t, '!', '')) n_exclaims, coalesce(li.n, 0) n_lines FROM w LEFT JOIN li USING (doc_id) LEFT JOIN cv USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed FROM f),
ra AS ({_RATIOS}),
lb AS (SELECT doc_id, min(quality) good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
cu AS (SELECT unnest(range(0, {len(CUTOFFS)})) j, unnest({list(CUTOFFS)}) cut),
ct AS (SELECT ra.lang, rule, j, cut, count(*) FILTER (good = 1) n, count(*) FILTER (good = 1 AND ratio > cut) k, count(*) FILTER (good = 0 AND ratio > cut) caught
  FROM ra JOIN b USING (doc_id) JOIN lb USING (doc_id), cu WHERE NOT base_failed GROUP BY 1, 2, 3, 4),
st AS (SELECT count(DISTINCT lang) s FROM ct),
pv AS (SELECT ct.*, CASE WHEN k >= n * 0.004 THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(0.004) + (n - i) * ln(0.996)))) END p FROM ct),
ok AS (SELECT *, max(p) OVER (PARTITION BY lang, rule ORDER BY j DESC) worst FROM pv),
be AS (SELECT lang, rule, arg_max(cut, (caught - 10 * k) * 1000 + j) cut FROM ok, st WHERE worst <= 0.05 / 5 / s AND caught - 10 * k > 0 GROUP BY 1, 2),
rj AS (SELECT DISTINCT doc_id FROM ra JOIN be ON ra.lang IS NOT DISTINCT FROM be.lang AND ra.rule = be.rule AND ratio > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rj) kept FROM b"""

OP9 = """WITH p AS (SELECT page_id, coalesce(html, '') h, sha1(coalesce(html, '')) s FROM pages),
m AS (SELECT s, max(page_id) top FROM p GROUP BY 1),
q AS (SELECT p.page_id, strlen(h) n, s, top, list_aggregate(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', substr(s, i, 1))]), 'string_agg', '') bits FROM p JOIN m USING (s))
SELECT page_id, n payload_bytes, list_aggregate(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5*j+1, 1) AS INT) + 8 * CAST(substr(bits, 5*j+2, 1) AS INT) + 4 * CAST(substr(bits, 5*j+3, 1) AS INT) + 2 * CAST(substr(bits, 5*j+4, 1) AS INT) + CAST(substr(bits, 5*j+5, 1) AS INT), 1)), 'string_agg', '') payload_digest,
CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id <> top THEN top END refers_to FROM q"""

OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} w FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) s FROM w)),
n AS (SELECT doc_id, count(*) n FROM g GROUP BY 1),
i AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(s, t) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.s, l.b FROM r JOIN l ON l.a = r.t),
c AS (SELECT s doc_id, min(t) component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0) n_shingles, component_id, c.doc_id = component_id kept FROM c LEFT JOIN n USING (doc_id)"""

SQL = {"op1_sorted_projection_dedup": OP1, "op5_risk_controlled_quality": OP5, "op9_splittable_warc": OP9, "op10_minhash_near_dedup": OP10}
