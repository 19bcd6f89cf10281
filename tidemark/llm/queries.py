"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import langid, leaks, lines, merkle, near, neighbours, packing, periods, quality, secrets, spans, suffixes, urls

QUERIES = {
    "op1_substring_dedup": spans.op1_substring_dedup,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_packing": packing.op3_packing,
    "op4_near_dedup": near.op4_near_dedup,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_url_filter": urls.op7_url_filter,
    "op8_language_id": langid.op8_language_id,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_decontamination": leaks.op10_decontamination,
    "op11_quality_classifier": neighbours.op11_quality_classifier,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_periodic_runs": periods.op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT win, min(doc_id) AS f FROM win GROUP BY 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN f USING (win) WHERE f < doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE e AS (SELECT doc_id, lang, text, concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
 CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
 xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM documents),
t AS (SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM e),
d AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf, sha256(head || CASE WHEN changed IS NULL THEN '-' ELSE strlen(changed) || ':' || changed END) AS received FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
lv(g, lvl, i, h) AS (SELECT g, 0, pos, leaf FROM p UNION ALL SELECT g, any_value(lvl) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM lv) WHERE n > 1 GROUP BY g, i // 8),
top AS (SELECT g, max(lvl) AS top FROM lv GROUP BY g),
sub AS (SELECT g, h AS subroot FROM lv JOIN top USING (g) WHERE lvl = top),
up(lvl, i, h) AS (SELECT 0, g, subroot FROM sub UNION ALL SELECT any_value(lvl) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM up) WHERE n > 1 GROUP BY i // 8),
root AS (SELECT arg_max(h, lvl) AS root, max(lvl) AS top FROM up),
pairs AS (SELECT p.g, pos, s.l, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < pos >> (3 * s.l)), '') AS b, coalesce(string_agg(h, '' ORDER BY i) FILTER (i > pos >> (3 * s.l)), '') AS a
 FROM p JOIN top USING (g), unnest(range(top)) AS s(l) JOIN lv ON lv.g = p.g AND lv.lvl = s.l AND lv.i // 8 = pos >> (3 * s.l + 3) GROUP BY ALL),
uppairs AS (SELECT sub.g, s.l, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < sub.g >> (3 * s.l)), '') AS b, coalesce(string_agg(h, '' ORDER BY i) FILTER (i > sub.g >> (3 * s.l)), '') AS a
 FROM sub, root, unnest(range(top)) AS s(l) JOIN up ON up.lvl = s.l AND up.i // 8 = sub.g >> (3 * s.l + 3) GROUP BY ALL),
lp AS (SELECT g, pos, list({'b': b, 'a': a} ORDER BY l) AS levels FROM pairs GROUP BY ALL),
tp AS (SELECT g, list({'b': b, 'a': a} ORDER BY l) AS levels FROM uppairs GROUP BY ALL),
q AS (SELECT doc_id, leaf, received, subroot, root, list_concat(coalesce(lp.levels, []), coalesce(tp.levels, [])) AS proof FROM p JOIN sub USING (g) LEFT JOIN lp USING (g, pos) LEFT JOIN tp USING (g), root),
f AS (SELECT *, list_reduce(list_prepend({'b': received, 'a': ''}, proof), lambda x, s: {'b': sha256(s.b || x.b || s.a), 'a': ''}).b AS folded_root FROM q)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda s: s.b || s.a), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f""",
}
