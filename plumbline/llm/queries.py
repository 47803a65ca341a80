"""The registered queries of this subpackage and the SQL of those that SQL can express.

Token ids, hashes with a seed, fitted models and packings have no SQL; tests compare those with brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op8_chat
from .decontam import op7_decontam
from .embedding_dedup import op4_embeddings
from .langid import op9_language
from .packing import op6_packing
from .quality import op3_quality
from .secrets import op1_secrets
from .simhash import op5_simhash
from .spelling import op12_spelling
from .suffix_dedup import op11_suffix_dedup
from .token_store import op2_token_ids
from .toxicity import op10_toxicity
from .vector_codes import op13_vector_codes

EMBEDDINGS_SQL = """WITH RECURSIVE
n AS MATERIALIZED (SELECT row_number() OVER () i, * FROM embeddings),
u AS (SELECT i, vec_id, "label", embedding::DOUBLE[] e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) norm FROM n
  WHERE vec_id IS NOT NULL AND "label" IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT * FROM u WHERE norm > 0),
l AS (SELECT a.i, a.vec_id a, b.vec_id b FROM v a JOIN v b ON a."label" = b."label" AND a.i <> b.i AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(c) c FROM r GROUP BY 1), m AS (SELECT i, count(*) links FROM l GROUP BY 1)
SELECT vec_id, coalesce(links, 0)::BIGINT n_links, c component_id, vec_id = c kept FROM n LEFT JOIN c ON id = vec_id LEFT JOIN m USING (i)"""

DECONTAM_SQL = r"""WITH
lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM lowered),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
k AS (SELECT item_id, w, least(13, len(w)) k FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) p FROM k)),
dw AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) p FROM d, (SELECT DISTINCT k FROM iw))),
h AS (SELECT doc_id, p, dw.k, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.k = iw.k),
n AS (SELECT doc_id, count(DISTINCT place) n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) place FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(items, '')) items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

CHAT_SQL = r"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') t FROM conversations
UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, length('### ' || role || ': ' || replace(replace(replace(t, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') || '</turn>') + 1 n FROM c)
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) turns_sha256,
coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) loss_sha256,
sum(n)::BIGINT formatted_chars, count(*) FILTER (role = 'assistant') n_examples FROM f GROUP BY 1"""

REPEATS_SQL = """WITH
b AS MATERIALIZED (SELECT row_number() OVER () r, doc_id, coalesce(doc_id, -9223372036854775808) place, encode(coalesce(text, '')) b FROM documents),
w AS (SELECT r, place, b[p:p + 99] g, p FROM (SELECT *, unnest(range(1, octet_length(b) - 98)) p FROM b)),
again AS (SELECT r, p FROM (SELECT r, p, place, min(place) OVER (PARTITION BY g) "first", min(p) OVER (PARTITION BY g, r) own FROM w) WHERE place > "first" OR p > own),
island AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) k FROM (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 100 THEN 0 ELSE 1 END fresh FROM again)),
span AS (SELECT r, min(p) s, max(p) + 100 e FROM island GROUP BY r, k),
kept AS (SELECT r, e s, lead(s, 1, 2147483647) OVER (PARTITION BY r ORDER BY e) e FROM (SELECT r, s, e FROM span UNION ALL SELECT r, 0, 1 FROM b)),
text AS (SELECT r, sha256(unhex(string_agg(hex(b[s:e - 1]), '' ORDER BY s))) kept_sha256 FROM kept JOIN b USING (r) GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT n_bytes, coalesce(n_removed, 0)::BIGINT n_removed, coalesce(n_spans, 0) n_spans, kept_sha256
FROM b JOIN text USING (r) LEFT JOIN (SELECT r, sum(e - s) n_removed, count(*) n_spans FROM span GROUP BY r) USING (r)"""

SPELLING_SQL = r"""WITH RECURSIVE
k AS (SELECT list(c ORDER BY i) k FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) c FROM range(256) r(i))),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run s, run, count(*) n FROM (SELECT doc_id,
  unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END)) b FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, k[xor(c, x) % 256 + 1])), 4294967295) h FROM bytes, k),
w AS (SELECT word, sum(n)::BIGINT n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cut AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) v FROM (SELECT word, unnest(range(1, length(word) + 1))::INT i FROM w)),
pairs AS (SELECT a.word a, b.word b FROM cut a JOIN cut b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
  UNION SELECT word, v FROM cut WHERE v IN (SELECT word FROM w) UNION SELECT v, word FROM cut WHERE v IN (SELECT word FROM w)),
near AS (SELECT a, count(*) n_near, first(b ORDER BY n DESC, b) form, max(n) form_n FROM pairs JOIN w ON word = b GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) n_near, CASE WHEN form_n >= 5 * n THEN form END form, CASE WHEN form_n >= 5 * n THEN form_n END form_n FROM w LEFT JOIN near ON a = word),
path AS (SELECT word, word "last", form FROM f UNION ALL SELECT p.word, f.word, f.form FROM path p JOIN f ON f.word = p.form)
SELECT f.word, n, n_near, f.form, form_n, "last" root FROM f JOIN path p ON p.word = f.word AND p.form IS NULL"""

_NEAREST = """a{r} AS MATERIALIZED (SELECT i, part, n, w, min(off * 64 + k) best FROM (SELECT d.i, part, n, w, k, list_sum(list_transform(range(1, w + 1), lambda j: (part[j] - entry[j]) * (part[j] - entry[j])))::BIGINT off
  FROM d JOIN c{r} USING (i)) GROUP BY ALL)"""
_ENTRIES = """c{r} AS MATERIALIZED (SELECT i, k, coalesce(moved, entry) entry FROM c{b} LEFT JOIN (SELECT i, k, list(floor(total / n)::BIGINT ORDER BY j) moved FROM
  (SELECT i, best % 64 k, j, sum(part[j] * n) total, sum(n) n FROM a{b}, LATERAL (SELECT unnest(range(1, w + 1)) j) GROUP BY ALL) GROUP BY ALL) USING (i, k))"""
VECTOR_CODES_SQL = f"""WITH
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) r, vec_id, "label", list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, i, len(e) // 16 w, e[i * w + 1:i * w + w] part FROM v, range(16) t(i)),
d AS MATERIALIZED (SELECT i, part, w, count(*) n FROM p GROUP BY ALL),
c0 AS MATERIALIZED (SELECT i, r - 1 k, part entry FROM p WHERE r <= 64),
{_NEAREST.format(r=0)}, {_ENTRIES.format(r=1, b=0)}, {_NEAREST.format(r=1)}, {_ENTRIES.format(r=2, b=1)}, {_NEAREST.format(r=2)},
s AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY i, k)) codebooks_sha256 FROM c2),
o AS (SELECT r, string_agg(lower(lpad(to_hex(best % 64), 2, '0')), '' ORDER BY i) code, sum(best // 64)::BIGINT error FROM p JOIN a2 USING (i, part) GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY "label")::BIGINT label_error, codebooks_sha256 FROM v JOIN o USING (r), s"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_token_ids": op2_token_ids,
        "op3_quality": op3_quality,
        "op4_embeddings": op4_embeddings,
        "op5_simhash": op5_simhash,
        "op6_packing": op6_packing,
        "op7_decontam": op7_decontam,
        "op8_chat": op8_chat,
        "op9_language": op9_language,
        "op10_toxicity": op10_toxicity,
        "op11_suffix_dedup": op11_suffix_dedup,
        "op12_spelling": op12_spelling,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_embeddings": EMBEDDINGS_SQL, "op7_decontam": DECONTAM_SQL, "op8_chat": CHAT_SQL, "op11_suffix_dedup": REPEATS_SQL, "op12_spelling": SPELLING_SQL, "op13_vector_codes": VECTOR_CODES_SQL}
