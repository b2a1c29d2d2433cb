"""Registry of the training-data queries and of their SQL."""

from __future__ import annotations

from .codes import op13_vector_codes
from .collocations import op12_phrase_collocations
from .decontaminate import op2_decontaminate
from .exactdup import op11_exact_dedup
from .extraction import op3_html_extraction
from .idcoder import op9_token_ids
from .licenses import op7_license_scan
from .lmscore import op6_lm_score
from .neardup import op5_minhash_dedup
from .packing import op1_packing
from .pii import op10_pii
from .quality import op8_quality_rules
from .warc import op4_warc

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATED = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN ns ON len(w) >= n)),
hit AS (SELECT doc_id, dw.n AS n, i, item FROM dw JOIN bw ON bw.n = dw.n AND bw.g = dw.g),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN spots ON spots.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""
PIECES = r"regexp_extract_all(" + LOWER + r", '[^\x20\x09-\x0D]+')"
DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, {PIECES} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT c.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""

PHRASES = f"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM t),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT cuts.lang AS lang, cuts.k AS k, cuts.g AS g, a, cut, x.f AS l, y.f AS r, 1000000 * CAST(a AS HUGEINT) * a // (CAST(x.f AS HUGEINT) * y.f) AS score FROM cuts
JOIN f x ON x.lang = cuts.lang AND x.g = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = cuts.lang AND y.g = array_to_string(w[cut + 1:cuts.k], ' ')),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS i FROM s),
cover AS (SELECT lang, g, max(a) AS a FROM (SELECT lang, a, array_to_string(w[i:i + 1], ' ') AS g FROM (SELECT lang, a, w, unnest([1, 2]) AS i FROM c WHERE k = 3)) GROUP BY ALL),
kept AS (SELECT m.* FROM lowest m LEFT JOIN cover v ON v.lang = m.lang AND v.g = m.g WHERE i = 1 AND coalesce(100 * v.a < 50 * m.a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1)
SELECT ranked.lang AS lang, rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000"""



def codes_sql(rounds: int = 2) -> str:
    """Lloyd's rounds as a chain of tables: ``c0`` the first codebooks, ``a0`` what is nearest."""
    nearest = "SELECT i, part, entry, d, x FROM (SELECT i, part, entry, d, x, row_number() OVER (PARTITION BY i, part ORDER BY d, entry) AS place FROM (SELECT i, p.part AS part, entry, p.x AS x, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{k} c ON c.part = p.part)) WHERE place = 1"
    means = "SELECT c.part AS part, c.entry AS entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT part, entry, list(v ORDER BY j) AS x FROM (SELECT part, entry, j, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS j FROM a{k}) GROUP BY ALL) GROUP BY ALL) m ON m.part = c.part AND m.entry = c.entry"
    steps = ", ".join(f"a{k} AS ({nearest.format(k=k)}), c{k + 1} AS ({means.format(k=k)})" for k in range(rounds))
    return f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT i, part, x[part * w + 1:(part + 1) * w] AS x FROM (SELECT i, x, len(x) // 16 AS w, unnest(range(16)) AS part FROM v)),
c0 AS (SELECT part, i - 1 AS entry, x FROM p WHERE i <= 64), {steps}, last AS ({nearest.format(k=rounds)}),
each AS (SELECT i, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY 1),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN each ON each.i = v.i, digest"""


QUERIES = {"op13_vector_codes": op13_vector_codes, "op12_phrase_collocations": op12_phrase_collocations, "op11_exact_dedup": op11_exact_dedup, "op7_license_scan": op7_license_scan, "op6_lm_score": op6_lm_score, "op9_token_ids": op9_token_ids, "op10_pii": op10_pii, "op4_warc": op4_warc, "op5_minhash_dedup": op5_minhash_dedup, "op3_html_extraction": op3_html_extraction, "op1_packing": op1_packing, "op2_decontaminate": op2_decontaminate, "op8_quality_rules": op8_quality_rules}
ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": CONTAMINATED,
    "op5_minhash_dedup": DUPLICATES,
    "op12_phrase_collocations": PHRASES,
    "op13_vector_codes": codes_sql(),
    "op11_exact_dedup": r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op4_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS sha FROM pages),
o AS (SELECT sha, n, max(page_id) AS owner FROM p WHERE n >= 1000 GROUP BY 1, 2)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.sha AS payload_digest, CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN owner <> page_id THEN owner END AS refers_to FROM p LEFT JOIN o ON o.sha = p.sha AND o.n = p.n""",
}
