"""DuckDB SQL for those queries of this subpackage that SQL can express on whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP10 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS gram
  FROM i, unnest(generate_series(1, greatest(1, len(w) - 12))) AS t(k) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM windows
), grams AS (
  SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS gram
  FROM d, sizes, unnest(generate_series(1, greatest(0, len(w) - size + 1))) AS t(k)
), found AS (SELECT doc_id, k, size, item_id FROM grams JOIN windows USING (size, gram)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + size - 1)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
), runs AS (
  SELECT doc_id, string_agg(CAST(a AS VARCHAR) || ':' || CAST(b AS VARCHAR), ',' ORDER BY a) AS spans
  FROM (SELECT doc_id, min(p) - 1 AS a, max(p) AS b
        FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g
              FROM (SELECT DISTINCT doc_id, unnest(generate_series(k, k + size - 1)) AS p FROM found))
        GROUP BY doc_id, g) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(digest, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN runs USING (doc_id)
"""


def op6() -> str:
    from lamina.llm import licenses

    rows = ", ".join("('{}', [{}])".format(k, ", ".join(f"'{x}'" for x in licenses.bigrams(t))) for k, t in sorted(licenses.TEMPLATES.items()))
    low = licenses.THRESHOLD / (2 - licenses.THRESHOLD)
    return rf"""
WITH template(name, t) AS (VALUES {rows}
), unit AS (
  SELECT doc_id, 0 AS unit, coalesce(text, '') AS u FROM documents UNION ALL
  SELECT doc_id, unnest(generate_series(1, len(l))) AS unit, unnest(l) AS u FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), word AS (
  SELECT doc_id, unit, string_split(trim(regexp_replace(translate(u, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM unit
), gram AS (
  SELECT doc_id, unit, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM word WHERE len(w) > 1
), scored AS (
  SELECT doc_id, unit, name, len(list_intersect(list_distinct(g), t)) * 2e0 / (len(g) + len(t)) AS dice
  FROM gram JOIN template ON len(g) >= len(t) * {low!r} - 1e-9 AND len(g) <= len(t) / {low!r} + 1e-9
), best AS (
  SELECT doc_id, unit, name, dice FROM scored WHERE dice >= {licenses.THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, name) = 1
), per AS (
  SELECT doc_id, count(*) AS n_units, first(name ORDER BY dice DESC, name) AS license, max(dice) AS dice,
         string_agg(CAST(unit AS VARCHAR) || ':' || name, ',' ORDER BY unit) AS matches
  FROM best GROUP BY doc_id
)
SELECT doc_id, coalesce(n_units, 0) AS n_units, license, dice, coalesce(matches, '') AS matches FROM documents LEFT JOIN per USING (doc_id)
"""


OP3 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS g FROM d, unnest(generate_series(1, greatest(1, len(w) - 2))) AS t(k) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id, doc_id AS root FROM n UNION SELECT edge.y, reach.root FROM reach JOIN edge ON edge.x = reach.doc_id
), least AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.root, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""


def op7() -> str:
    """Positions are summed from the texts between and in the matches."""
    from lamina.llm import secrets

    def kind(place: int, name: str, pattern: str, group: int) -> str:
        p = pattern.replace("'", "''")
        return rf"""
  SELECT doc_id, owner, repo, '{name}' AS kind, {place} AS place, unnest(generate_series(1, len(whole))) AS i, gaps, whole, value
  FROM (SELECT doc_id, owner, repo, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS whole, regexp_extract_all(t, '{p}', {group}) AS value FROM doc)"""

    # RE2 takes leftmost longest runs without possessive signs and looking behind
    hexes, bare = secrets.HEX.rstrip("+"), secrets.BARE.split(")", 1)[1].rstrip("+")
    found = " UNION ALL ".join((kind(1, "assign", secrets.ASSIGN, 1), kind(2, "access", secrets.ACCESS, 0), kind(3, "hex", hexes, 0), kind(4, "bare", bare, 0)))
    return rf"""
WITH doc AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo, coalesce(text, '') AS t FROM documents
), found AS ({found}
), span AS (
  SELECT doc_id, owner, repo, kind, place, value[i] AS v,
         CAST(list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS a,
         length(whole[i]) AS size FROM found
), good AS (
  SELECT *, a + size AS b FROM span
  WHERE kind = 'assign' AND length(v) >= 8 OR kind = 'access' AND size >= 16 OR kind = 'hex' OR kind = 'bare' AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
), verdict AS (
  SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos,
         count(DISTINCT owner) <= {secrets.MAX_OWNERS} AND count(DISTINCT repo) <= {secrets.MAX_REPOS} AND len(list_distinct(string_split(v, ''))) >= {secrets.MIN_DISTINCT} AND NOT regexp_matches(v, '{secrets.EXAMPLE}') AS live
  FROM good WHERE kind <> 'bare' GROUP BY v
), judged AS (
  SELECT DISTINCT doc_id, kind, place, a, b, live, owners, repos FROM good JOIN verdict USING (v) WHERE kind <> 'bare' OR live
), fresh AS (
  SELECT * FROM judged j WHERE kind <> 'bare' OR NOT EXISTS (SELECT 1 FROM judged k WHERE k.doc_id = j.doc_id AND k.kind <> 'bare' AND k.a < j.b AND j.a < k.b)
), per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) FILTER (kind <> 'bare') AS base,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, max(owners) AS most_owners, max(repos) AS most_repos FROM fresh GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos FROM documents LEFT JOIN per USING (doc_id)
"""
