"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "(chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

def _clusters(rounds: int) -> str:
    """Rounds of nearest centroids and means rounded down, written out."""
    near = ("a{0} AS (SELECT vec_id, r, v, (min([d, k]))[2] AS k, (min([d, k]))[1] AS d FROM (SELECT e.vec_id, e.r, e.v, c.k, "
            "list_sum(list_transform(range(1, 65), lambda i: (e.v[i] - c.v[i]) * (e.v[i] - c.v[i])))::BIGINT AS d FROM e, c{0} c) GROUP BY vec_id, r, v)")
    mean = ("s{0} AS (SELECT k, list(m ORDER BY i) AS v FROM (SELECT k, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m "
            "FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{0}) GROUP BY k, i) GROUP BY k),\n"
            "c{1} AS (SELECT c{0}.k, coalesce(s{0}.v, c{0}.v) AS v FROM c{0} LEFT JOIN s{0} USING (k))")
    steps = ",\n".join(f"{near.format(i)},\n{mean.format(i, i + 1)}" for i in range(rounds))
    return f"""
WITH e AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, v FROM e ORDER BY h, v LIMIT 16)),
{steps},
{near.format(rounds)}
SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k"""


ORACLE = {
    "op12_centroid_clusters": _clusters(3),
    "op2_source_mix": r"""
WITH d AS (SELECT doc_id, source, md5(doc_id::VARCHAR) AS ord,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place
      FROM d GROUP BY source),
c AS (SELECT *, CASE place WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / w AS level, sum(source_size::DOUBLE) OVER () AS total, sum(w) OVER () AS w_all FROM c),
f AS (SELECT *, sum(cap) OVER (ORDER BY level) + level * (w_all - sum(w) OVER (ORDER BY level)) <= total AS capped FROM l),
g AS (SELECT *, total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS rest,
             sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS w_free FROM f),
t AS (SELECT source, source_size, place, CASE WHEN capped THEN cap ELSE coalesce(rest * w / nullif(w_free, 0), 0) END AS target FROM g),
p AS (SELECT d.*, t.source_size, t.target, t.place,
             sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, greatest(least(size, floor(target)::BIGINT - start), 0)
             + greatest(least(size, floor(target)::BIGINT - start - source_size), 0)
             + greatest(least(size, floor(target)::BIGINT - start - 2 * source_size), 0) AS taken,
             coalesce(start::DOUBLE / nullif(target, 0), 0) AS x,
             CASE place WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS u,
             CASE place WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS v FROM p)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN least(size, floor(target)::BIGINT - start) > 0
            THEN round(least(greatest(coalesce(2 * x / nullif(u + sqrt(greatest(u * u + 2 * (v - u) * x, 0)), 0), 0), 0), 1), 6) END AS first_position
FROM e""",
    "op4_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op5_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, trim({_LOWER.format('line')}, {_BLANK}) AS key FROM l),
r AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, r.key IS NOT NULL AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op6_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS k FROM (
    SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
       FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
dw AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT DISTINCT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
