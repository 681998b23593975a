"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from .clustering import CLUSTERS, COMPONENTS, ROUNDS, SALT, SCALE
from .common import WORD
from .licenses import LEAST_SHARE, templates

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str = "text") -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '{WORD}')"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def license_scan() -> str:
    rows = ", ".join(f"('{t['label']}', {str(t['base']).lower()}, {_list(t['words'])}, {_list(t['key'])}, {t['key_at']})" for t in templates())
    return f"""WITH docs AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM (SELECT doc_id, {_words()} AS w FROM documents)),
templates AS (SELECT * FROM (VALUES {rows}) AS v(label, base, words, key, key_at)),
found AS (SELECT doc_id, w, label, base, words, unnest(list_filter(range(len(w)), lambda i: w[i + 1] = key[1] AND w[i + 1 : i + len(key)] = key)) - key_at AS start FROM docs, templates WHERE contains(s, ' ' || array_to_string(key, ' ') || ' ')),
places AS (SELECT doc_id, label, base, start, len(list_filter(range(len(words)), lambda j: start + j >= 0 AND w[greatest(start + j, 0) + 1] IS NOT DISTINCT FROM words[j + 1])) / CAST(len(words) AS DOUBLE) AS share FROM found),
kept AS (SELECT * FROM places WHERE base OR share >= {LEAST_SHARE}),
per AS (SELECT doc_id, CAST(sum(CASE WHEN base THEN 1 ELSE 0 END) AS BIGINT) AS n_base, min(CASE WHEN base THEN start END) AS first_word, max(CASE WHEN base THEN start END) AS last_word,
 string_agg(DISTINCT CASE WHEN base THEN label END, ',' ORDER BY CASE WHEN base THEN label END) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN per USING (doc_id)"""


WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (digest)"""

DECONTAMINATION = f"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words()} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (SELECT DISTINCT item, w[i + 1 : i + least(10, len(w))] AS win, CAST(least(10, len(w)) AS BIGINT) AS size FROM (SELECT *, unnest(range(greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_words()} AS w FROM documents),
places AS (SELECT doc_id, size, i, w[i + 1 : i + size] AS win FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
hits AS (SELECT doc_id, item, i, size FROM places JOIN windows USING (size, win)),
covered AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM hits) GROUP BY doc_id),
who AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN who USING (doc_id)"""

JACCARD = rf"""WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(3, len(w))], ' ') AS s FROM (SELECT *, unnest(range(greatest(1, len(w) - 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets AS a JOIN sets AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes AS x ON a = x.doc_id JOIN sizes AS y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT reached.doc_id, b FROM reached JOIN edges ON other = a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""

SEARCH = f"""WITH docs AS MATERIALIZED (SELECT doc_id, {_words()} AS w FROM documents),
corpus AS MATERIALIZED (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS length FROM docs WHERE len(w) > 0),
occurs AS MATERIALIZED (SELECT doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM docs) GROUP BY ALL),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM occurs, corpus GROUP BY t),
items AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({_words()}) AS t FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
scores AS (SELECT item_id, doc_id, CAST(sum(q * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // length))))) AS BIGINT) AS score
 FROM items JOIN occurs USING (t) JOIN weights USING (t), corpus GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10"""


def clustering() -> str:
    """Each round's assignment and centroids are tables of their own."""
    near = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assigned = f"(SELECT vec_id, v, cluster, CAST({near} AS BIGINT) AS distance FROM vectors, {{}} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"
    parts = [
        f"vectors AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id)) - 1 AS INT) AS cluster, v AS c FROM vectors QUALIFY cluster < {CLUSTERS})",
    ]
    for r in range(ROUNDS):
        parts += [
            f"a{r} AS MATERIALIZED {assigned.format(f'c{r}')}",
            f"m{r} AS (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT cluster, v, unnest(range(1, {COMPONENTS + 1})) AS i FROM a{r}) GROUP BY cluster, i)",
            f"c{r + 1} AS MATERIALIZED (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM m{r} GROUP BY cluster UNION ALL SELECT cluster, c FROM c{r} WHERE cluster NOT IN (SELECT cluster FROM a{r}))",
        ]
    return f"""WITH {", ".join(parts)}, found AS MATERIALIZED {assigned.format(f"c{ROUNDS}")}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c, ',')) AS centroid_sha256 FROM found JOIN c{ROUNDS} USING (cluster)"""


ORACLE_SQL = {
    "op3_license_scan": license_scan(), "op5_warc_archives": WARC, "op6_benchmark_decontamination": DECONTAMINATION,
    "op11_jaccard_join": JACCARD, "op12_ranked_search": SEARCH, "op13_centroid_clustering": clustering(),
}
