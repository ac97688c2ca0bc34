"""DuckDB SQL for the rows of the queries that SQL can express; the others are tested against brute force."""

from strata.llm.queries import LEAF_COLUMNS, URL_RULES

Q: dict[str, str] = {}

Q["op4_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), g AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)
), again AS (
  SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), repeated AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, unnest([0, 1, 2]) AS o(k) GROUP BY r
), l AS (
  SELECT r, doc_id, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS normal
  FROM (SELECT r, doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d)
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE n > 0 GROUP BY r
), own AS (
  SELECT r, doc_id, host, normal, sum(n) AS n FROM l WHERE n > 0 GROUP BY ALL
), content AS (
  SELECT r, list_sort(list(normal)) AS content FROM own GROUP BY r
), frequent AS (
  SELECT host, normal, min(doc_id) AS first FROM own JOIN content USING (r)
  GROUP BY ALL HAVING count(DISTINCT content) > 100
), lost AS (
  SELECT r, sum(n) AS n FROM own JOIN frequent USING (host, normal) WHERE doc_id <> first GROUP BY r
), counts AS (
  SELECT d.r, doc_id, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lost.n, 0)::BIGINT AS lost_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r) LEFT JOIN lost USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * (n_words - lost_words) >= 30 * n_words AS kept, lost_words
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
"""

Q["op9_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

Q["op10_url_rules"] = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES %s), u AS (
  SELECT row_number() OVER () AS r, page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
)
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(r_verdict, 'allow') AS verdict
FROM u LEFT JOIN rules
  ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) = 1
""" % ", ".join(map(repr, URL_RULES))

Q["op12_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^ \t]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), g AS MATERIALIZED (
  SELECT lang, k AS width, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM p, unnest([1, 2, 3, 4, 5]) AS s(k), unnest(range(1, len(w) - k + 2)) AS u(i) GROUP BY ALL
), total AS (
  SELECT lang, sum(a)::BIGINT AS n FROM g WHERE width = 1 GROUP BY lang
), frequent AS (
  SELECT *, string_split(phrase, ' ') AS w FROM g WHERE width > 1 AND a >= 100
), cut AS (
  SELECT c.lang, c.phrase, c.width, c.w, c.a, l.a AS l, r.a AS r, n, k,
         ((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, width)) AS k FROM frequent) c JOIN total USING (lang)
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, a AS longer
  FROM frequent, unnest(range(2, width)) AS s(k), unnest(range(1, width - k + 2)) AS u(i)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase::BLOB) AS rank
  FROM cut WHERE NOT EXISTS (
    SELECT 1 FROM inside WHERE inside.lang = cut.lang AND inside.phrase = cut.phrase AND 100 * longer >= 100 * cut.a)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def _climb(leaves: str, levels: int) -> tuple[str, str]:
    """SQL of the tables that climb a forest of (tree, i, own, fold) by ``levels`` levels, and the last one's name.

    Each row keeps its node ``own``, its siblings so far and the digest ``fold`` that its claim gives.
    """
    out, last = "", leaves
    for k in range(levels):
        name = f"{leaves}_{k}"
        out += f"""
, {name}_node AS MATERIALIZED (SELECT DISTINCT tree, i, own FROM {last})
, {name}_run AS MATERIALIZED (
  SELECT *, max(p) OVER (PARTITION BY tree) AS top_p, max(len(hs)) OVER (PARTITION BY tree) AS top_n
  FROM (SELECT tree, i // 3 AS p, list(own ORDER BY i) AS hs FROM {name}_node GROUP BY tree, i // 3))
, {name} AS MATERIALIZED (
  SELECT x.* EXCLUDE (i, own, fold, sib), i // 3 AS i,
         CASE WHEN top_p + top_n = 1 THEN own ELSE sha256(array_to_string(hs, '')) END AS own,
         CASE WHEN top_p + top_n = 1 THEN fold
              ELSE sha256(array_to_string(hs[:i % 3], '') || fold || array_to_string(hs[i % 3 + 2:], '')) END AS fold,
         sib || array_to_string(hs[:i % 3], '') || array_to_string(hs[i % 3 + 2:], '') AS sib
  FROM {last} x JOIN {name}_run USING (tree) WHERE i // 3 = p)"""
        last = name
    return out, last


def _leaf(text: str) -> str:
    parts = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in LEAF_COLUMNS]
    return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"


#: The crc32 of the id is even if its lowest bit is; -1 stands for a shift by one bit.
_EVEN = """list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) % 2 = 1"""

_rows, _top = _climb("leafs", 14)
_groups, _root = _climb("subs", 9)
Q["op13_merkle"] = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_EVEN} THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS claim
  FROM documents
), leafs AS MATERIALIZED (
  SELECT doc_id, leaf, leaf AS own, claim AS fold, '' AS sib,
         dense_rank() OVER (ORDER BY source::BLOB NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS i
  FROM d
){_rows}
, subs AS MATERIALIZED (
  SELECT doc_id, leaf, own AS subroot, own, fold, sib, 0 AS tree, tree AS i FROM {_top}
){_groups}
SELECT doc_id, leaf, subroot, own AS root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = own AS verified FROM {_root}
"""
