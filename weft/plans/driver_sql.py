"""SQL for the queries of driver_queries, written on its own: DuckDB runs it on the same tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

_PATH = """(CASE page_id % 10 WHEN 0 THEN 'sections/p' || page_id || '.liquid' WHEN 1 THEN 'sections/g' || page_id || '.json'
 WHEN 2 THEN 'snippets/s' || page_id || '.liquid' WHEN 3 THEN 'blocks/b' || page_id || '.liquid' WHEN 4 THEN 'templates/t' || page_id || '.json'
 WHEN 5 THEN 'templates/customers/c' || page_id || '.liquid' WHEN 6 THEN 'layout/l' || page_id || '.liquid' WHEN 7 THEN 'locales/x' || page_id || '.json'
 WHEN 8 THEN 'assets/a' || page_id || '.css' ELSE 'components/c' || page_id || '.nz.liquid' END)"""

SQL["role_classify"] = f"""
SELECT page_id, path,
  CASE page_id % 10 WHEN 0 THEN 'section' WHEN 1 THEN 'sectionGroup' WHEN 2 THEN 'snippet' WHEN 3 THEN 'themeBlock' WHEN 4 THEN 'templateJson'
    WHEN 5 THEN 'templateLiquid' WHEN 6 THEN 'layout' WHEN 7 THEN 'locale' WHEN 8 THEN 'asset' ELSE 'component' END AS role,
  CASE page_id % 10 WHEN 0 THEN 'section' WHEN 1 THEN 'other' WHEN 2 THEN 'snippet' WHEN 3 THEN 'themeBlock' WHEN 4 THEN 'templateJson'
    WHEN 5 THEN 'templateLiquid' WHEN 6 THEN 'layout' WHEN 7 THEN 'locale' WHEN 8 THEN 'asset' ELSE 'component' END AS kind,
  CASE page_id % 10 WHEN 8 THEN 'a' || page_id || '.css' ELSE substr('pgsbtclx?c', (page_id % 10 + 1)::INT, 1) || page_id END AS name,
  regexp_replace(path, '/[^/]*$', '') AS folder
FROM (SELECT page_id, {_PATH} AS path FROM pages)
"""

SQL["route_projection"] = """
SELECT page_id, CASE page_id % 10 WHEN 4 THEN '/t' || page_id ELSE '/customers/c' || page_id END AS route FROM pages WHERE page_id % 10 IN (4, 5)
"""

SQL["file_fingerprint"] = """
SELECT doc_id, sha256(length(lang) || ':' || lang || length(source) || ':' || source || length(text) || ':' || text) AS fingerprint FROM documents
"""

SQL["glob_filter"] = """
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, starts_with(path, 'en/') OR ends_with(path, '.html') OR regexp_matches(path, '^de/1[^/][^/]$') AS excluded FROM p
"""

SQL["path_normalize"] = """
WITH p AS (SELECT page_id, rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '/') AS path FROM pages)
SELECT page_id, 'a/' || path || '/y.css' AS path, 'one/a/' || path || '/y.css' AS imported FROM p
"""

SQL["snake_slug"] = """
WITH p AS (SELECT *, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
  lower(regexp_replace(regexp_replace(p_type, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[-\\s]+', '_', 'g')) AS snake,
  regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '--' ||
  regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS story,
  replace(p_type, ' ', '') AS t FROM part)
SELECT p_partkey, snake, upper(substr(snake, 1, 1)) || replace(substr(snake, 2), '_', ' ') AS label, slug, story,
  'data--' || lower(t) AS attribute, 'nz-' || slug || '__root' AS scoped FROM p
"""

SQL["html_escape"] = """
SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped,
  length(html)::BIGINT AS n FROM pages
"""

SQL["html_hooks"] = """
WITH h AS (
  SELECT page_id, 'class' AS hook, unnest(string_split(v, ' ')) AS name FROM (SELECT page_id, unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS v FROM pages)
  UNION ALL SELECT page_id, 'tag', unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) FROM pages
  UNION ALL SELECT page_id, 'attribute', unnest(regexp_extract_all(html, ' (href|lang|charset)="', 1)) FROM pages)
SELECT page_id, hook, name, count(*) AS n FROM h WHERE name <> '' GROUP BY ALL
"""

SQL["html_links_resolve"] = """
WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS name FROM pages),
d AS (SELECT regexp_extract(html, '<h1>([^ <]*)', 1) AS name, count(DISTINCT page_id) AS n FROM pages GROUP BY 1),
j AS (SELECT CASE WHEN r.name = '' THEN 'dynamic' WHEN d.n IS NULL THEN 'missing' WHEN d.n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
  CASE WHEN r.name = '' THEN 0 ELSE coalesce(d.n, 0) END AS n FROM r LEFT JOIN d USING (name))
SELECT status, count(*) AS n, sum(n)::BIGINT AS targets FROM j GROUP BY status
"""

SQL["json_flatten"] = """
SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)
"""

SQL["doc_params"] = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
SELECT doc_id, line::BIGINT AS line, regexp_extract(body, '^([A-Z][a-z]+) ([a-z]+)', 1) AS name, regexp_extract(body, '^([A-Z][a-z]+) ([a-z]+)', 2) AS kind
FROM l WHERE regexp_extract(body, '^([A-Z][a-z]+) ([a-z]+)', 1) <> ''
"""

SQL["offset_to_linecol"] = """
WITH t AS (SELECT doc_id, text, strpos(text, ' the ') - 1 AS pos FROM documents)
SELECT doc_id, pos::BIGINT AS pos, (length(left(text, pos::INT)) - length(replace(left(text, pos::INT), chr(10), '')) + 1)::BIGINT AS line,
  (length(string_split(left(text, pos::INT), chr(10))[-1]) + 1)::BIGINT AS col FROM t WHERE pos >= 0
"""

SQL["utf16_lengths"] = """
WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN chr(128512) ELSE '' END AS t FROM documents)
SELECT doc_id, (length(t) + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS units, length(t)::BIGINT AS points, strlen(t)::BIGINT AS bytes FROM t
"""

SQL["money_format"] = """SELECT o_orderkey, '$' || printf('%.2f', round(o_totalprice * 100)::BIGINT / 100.0) || ' USD' AS price FROM orders"""

SQL["literal_range"] = """
WITH x AS (SELECT l_quantity AS q, round(l_discount * 100) AS s FROM lineitem)
SELECT CASE WHEN q < 5 THEN 'below' WHEN q > 45 THEN 'above' WHEN abs((q - 5) % 5) > 1e-9 AND abs(abs((q - 5) % 5) - 5) > 1e-9 THEN 'step' ELSE 'ok' END AS quantity,
  CASE WHEN s < 1 THEN 'below' WHEN s > 8 THEN 'above' WHEN abs((s - 1) % 2) > 1e-9 AND abs(abs((s - 1) % 2) - 2) > 1e-9 THEN 'step' ELSE 'ok' END AS discount,
  count(*) AS n FROM x GROUP BY 1, 2
"""

SQL["assignable"] = """
WITH k AS (SELECT unnest(['string', 'string-literal', 'url', 'color', 'number', 'number-literal', 'money', 'boolean', 'handle', 'nil', 'unknown']) AS k)
SELECT a.k AS source, b.k AS target, a.k = b.k OR a.k = 'unknown' OR b.k = 'unknown' OR (a.k = 'string-literal' AND b.k IN ('string', 'url', 'color', 'handle'))
  OR (a.k = 'number-literal' AND b.k = 'number') AS fits FROM k a, k b
"""

SQL["literal_validators"] = """
WITH p AS (SELECT p_partkey, p_name, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS s FROM part)
SELECT p_partkey, regexp_full_match(s, '[a-z0-9]+(-[a-z0-9]+)*') AS handle, regexp_full_match(p_name, '[a-z0-9]+(-[a-z0-9]+)*') AS raw_handle,
  p_partkey % 9 IN (3, 4, 6, 8) AS color FROM p
"""

SQL["settings_reads_unknown"] = """
SELECT DISTINCT user_id AS owner, event_type AS name FROM events WHERE NOT (event_type IN ('signup', 'view') OR (event_type = 'click' AND user_id % 2 = 0))
"""

_DECLS = "(SELECT p_partkey % 1500 AS symbol, p_partkey AS target FROM part WHERE p_partkey % 7 <> 0)"

SQL["ref_resolution"] = f"""
WITH d AS (SELECT symbol, count(*) AS n FROM {_DECLS} GROUP BY symbol)
SELECT l_orderkey || ':' || l_linenumber AS ref,
  CASE WHEN l_linenumber >= 6 THEN 'dynamic' WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
  CASE WHEN l_linenumber >= 6 THEN 0 ELSE coalesce(n, 0) END::BIGINT AS n_targets FROM lineitem LEFT JOIN d ON symbol = l_partkey
"""

SQL["dependency_index"] = f"""
SELECT l_orderkey || ':' || l_linenumber AS ref, l_orderkey AS src, target AS dst, 'line' AS kind
FROM lineitem JOIN {_DECLS} ON symbol = l_partkey WHERE target = 10
"""

SQL["behavior_connections"] = """
WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (WHERE event_type IN ('signup', 'purchase')))) AS p,
  list_sort(list_distinct(list(event_type) FILTER (WHERE event_type NOT IN ('signup', 'purchase')))) AS c FROM events GROUP BY user_id)
SELECT user_id, array_to_string(p, ',') AS producers, array_to_string(c, ',') AS consumers FROM s WHERE len(p) > 0 AND len(c) > 0
"""

SQL["behavior_index"] = """
SELECT user_id, count(*) AS evidence, count(*) FILTER (WHERE event_type = 'purchase') AS records FROM events
WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY user_id
"""

SQL["metafield_index"] = "SELECT source, count(*) AS evidence FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'de') GROUP BY source"

SQL["evidence_union"] = """
WITH k AS (SELECT c_custkey AS owner, 'configurable' AS c FROM customer WHERE c_acctbal < 0
  UNION SELECT o_custkey, 'data-driven' FROM orders WHERE o_orderstatus = 'F'
  UNION SELECT o_custkey, 'interactive' FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION SELECT c_custkey, 'composed' FROM customer WHERE c_nationkey % 5 = 0)
SELECT c_custkey AS owner, coalesce(string_agg(c, ',' ORDER BY c), 'static') AS classes FROM customer LEFT JOIN k ON owner = c_custkey GROUP BY c_custkey
"""

SQL["evidence_capabilities"] = """
WITH k AS (SELECT 'role' AS kind FROM customer UNION ALL SELECT 'schema' FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'metafield-read' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'behavior' FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT 'render-reference' FROM customer WHERE c_nationkey % 5 = 0)
SELECT kind, CASE kind WHEN 'schema' THEN 'theme.schema' WHEN 'metafield-read' THEN 'theme.metafields' WHEN 'behavior' THEN 'browser.behavior'
  WHEN 'render-reference' THEN 'theme.render' ELSE 'none' END AS capability, count(*) AS n FROM k GROUP BY 1, 2
"""

SQL["duplicate_flags"] = "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS duplicate FROM documents"

SQL["ir_merge"] = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size % 4 DESC, p_brand) AS n FROM part)
SELECT p_name, max(p_brand) FILTER (WHERE n = 1) AS p_brand, array_to_string(list_sort(list_distinct(list(p_type))), '|') AS declarations FROM r GROUP BY p_name
"""

_EDGES = """e AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders)"""
_NODES = """n AS (SELECT 'region:' || r_regionkey AS node, 'region' AS kind FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer' FROM customer UNION ALL SELECT 'order:' || o_orderkey, 'order' FROM orders)"""

SQL["impact"] = f"""
WITH RECURSIVE {_EDGES}, i AS (SELECT 'region:1' AS node, 0 AS depth UNION ALL SELECT e.src, i.depth + 1 FROM i JOIN e ON e.dst = i.node)
SELECT node, depth::BIGINT AS depth FROM i
"""

SQL["impact_reasons"] = f"""
WITH RECURSIVE {_EDGES}, i AS (SELECT 'region:2' AS node, 0 AS depth, '' AS reason UNION ALL SELECT e.src, i.depth + 1, e.src || '>' || e.dst FROM i JOIN e ON e.dst = i.node)
SELECT node, depth::BIGINT AS depth, reason FROM i
"""

SQL["affected_pages"] = """
SELECT 'order:' || o_orderkey AS node FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 3
"""

SQL["unused_nodes"] = f"""
WITH {_EDGES}, {_NODES}, u AS (SELECT dst FROM e WHERE src NOT LIKE 'order:%' OR src IN (SELECT 'order:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'))
SELECT node FROM n WHERE kind <> 'order' AND node NOT IN (SELECT dst FROM u)
"""

SQL["forward_closure"] = f"""
WITH RECURSIVE {_EDGES}, i AS (SELECT 'order:' || o_orderkey AS node, 0 AS depth FROM orders
  UNION SELECT e.dst, i.depth + 1 FROM i JOIN e ON e.src = i.node)
SELECT node, depth::BIGINT AS depth FROM i
"""

SQL["render_tree"] = f"""
WITH RECURSIVE {_EDGES}, i AS (SELECT 'nation:' || n_nationkey AS root, 'nation:' || n_nationkey AS node, 0 AS depth FROM nation WHERE n_nationkey < 6
  UNION SELECT i.root, e.src, i.depth + 1 FROM i JOIN e ON e.dst = i.node)
SELECT root, count(*) AS nodes, max(depth)::BIGINT AS depth FROM i GROUP BY root
"""

_SCC = """e AS (SELECT p_partkey AS src, CASE WHEN p_partkey % 7 = 6 THEN p_partkey - 6 ELSE p_partkey + 1 END AS dst FROM part
  UNION ALL SELECT p_partkey, -p_partkey - 1 FROM part WHERE p_partkey % 3 = 0),
p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON e.src = p.dst),
m AS (SELECT a.src AS node, min(a.dst) AS scc FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
s AS (SELECT p_partkey AS node, coalesce(scc, p_partkey)::BIGINT AS scc, scc IS NOT NULL AS on_cycle FROM part LEFT JOIN m ON node = p_partkey)"""

SQL["scc"] = f"""
WITH RECURSIVE {_SCC} SELECT node, scc, count(*) OVER (PARTITION BY scc) AS size, bool_or(on_cycle) OVER (PARTITION BY scc) AS cyclic FROM s
"""

SQL["scc_dataflow"] = f"""
WITH RECURSIVE {_SCC} SELECT DISTINCT a.node, p_brand AS read FROM s a JOIN s b ON a.scc = b.scc JOIN part ON p_partkey = b.node
"""

SQL["file_impact"] = f"""
WITH {_EDGES}, {_NODES}, o AS (SELECT src, count(*) AS c FROM e GROUP BY src), i AS (SELECT dst, count(*) AS c FROM e GROUP BY dst)
SELECT node, coalesce(o.c, 0) AS dependencies, coalesce(i.c, 0) AS dependents, CASE WHEN i.c > 0 OR kind = 'order' THEN 'used' ELSE 'unused' END AS usage
FROM n LEFT JOIN o ON o.src = node LEFT JOIN i ON i.dst = node
"""

SQL["endpoint_integrity"] = f"""
WITH {_EDGES}, {_NODES}, k AS (SELECT node FROM n WHERE NOT (kind = 'customer' AND node LIKE '%7') AND NOT (kind = 'order' AND node LIKE '%99'))
SELECT src, dst, 'src' AS missing FROM e WHERE src NOT IN (SELECT node FROM k) UNION ALL SELECT src, dst, 'dst' FROM e WHERE dst NOT IN (SELECT node FROM k)
"""

SQL["summary"] = f"WITH {_EDGES}, {_NODES} SELECT * FROM (SELECT count(*) AS nodes, count(DISTINCT kind) AS kinds FROM n), (SELECT count(*) AS edges, count(DISTINCT dst) AS targets FROM e)"

SQL["cardinality_check"] = "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) <> 4"


def _spans(kind: str, seconds: int) -> str:
    return f"(SELECT user_id, event_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + {seconds} AS b, event_id % 3 AS depth FROM events WHERE event_type = '{kind}')"


SQL["local_reads"] = f"""
SELECT event_id, EXISTS (SELECT 1 FROM {_spans('view', 86400)} r WHERE r.user_id = p.user_id AND epoch_us(p.ts) // 1000000 BETWEEN r.a AND r.b) AS local
FROM events p WHERE event_type = 'click'
"""

SQL["innermost_scope"] = f"""
WITH j AS (SELECT p.event_id, s.event_id AS sid, rank() OVER (PARTITION BY p.event_id ORDER BY s.depth DESC NULLS LAST) AS r
  FROM events p LEFT JOIN {_spans('view', 864000)} s ON s.user_id = p.user_id AND epoch_us(p.ts) // 1000000 BETWEEN s.a AND s.b WHERE p.event_type = 'error')
SELECT event_id, CASE WHEN count(*) = 1 THEN min(sid) END AS scope FROM j WHERE r = 1 GROUP BY event_id
"""

SQL["merge_ranges"] = f"""
WITH x AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {_spans('view', 172800)}),
y AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM x)
SELECT user_id, min(a) AS start, max(b) AS "end" FROM y GROUP BY user_id, island
"""

SQL["debounce"] = """
WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM x)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM y GROUP BY user_id, burst
"""

SQL["coalesce_changes"] = """
WITH g AS (SELECT user_id, list(CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' ELSE 'changed' END ORDER BY ts, event_id) AS k FROM events GROUP BY user_id),
f AS (SELECT user_id, list_reduce(list_prepend('none', k), lambda a, x: CASE WHEN a = 'added' AND x = 'removed' THEN 'none' WHEN a = 'added' AND x = 'changed' THEN 'added'
  WHEN a = 'removed' AND x = 'added' THEN 'changed' ELSE x END) AS kind FROM g)
SELECT user_id, kind FROM f WHERE kind <> 'none'
"""

SQL["snapshot_diff_moves"] = """
WITH o AS (SELECT doc_id, text AS h FROM documents WHERE doc_id % 3 <> 0),
n AS (SELECT doc_id, text || CASE WHEN doc_id % 30 = 2 THEN '!' ELSE '' END AS h FROM documents WHERE doc_id % 3 <> 1),
r AS (SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)), a AS (SELECT * FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o)),
m AS (SELECT x.doc_id AS old_id, y.doc_id AS new_id FROM (SELECT h, min(doc_id) AS doc_id FROM r GROUP BY h HAVING count(*) = 1) x
  JOIN (SELECT h, min(doc_id) AS doc_id FROM a GROUP BY h HAVING count(*) = 1) y USING (h))
SELECT doc_id, 'removed' AS change, NULL::BIGINT AS from_key FROM r WHERE doc_id NOT IN (SELECT old_id FROM m)
UNION ALL SELECT doc_id, 'added', NULL FROM a WHERE doc_id NOT IN (SELECT new_id FROM m)
UNION ALL SELECT new_id, 'moved', old_id FROM m
UNION ALL SELECT o.doc_id, 'changed', NULL FROM o JOIN n USING (doc_id) WHERE o.h <> n.h
"""

SQL["latest_wins"] = """
SELECT user_id, us, event_id, event_type FROM (SELECT user_id, epoch_us(ts) AS us, event_id, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
"""

_LOCK = "o AS (SELECT p_brand AS section, CASE WHEN p_partkey % 4 = 0 THEN 'block' ELSE 'setting' END AS kind, 'id:' || p_partkey AS id, p_type AS type, p_partkey, p_size FROM part)"

SQL["schema_drift"] = f"""
WITH {_LOCK} SELECT DISTINCT section, 'section' AS kind, '' AS id, 'SECTION_REMOVED' AS drift FROM o WHERE section = 'Brand#11'
UNION ALL SELECT section, kind, id, CASE WHEN p_partkey % 9 = 0 THEN CASE kind WHEN 'setting' THEN 'SETTING_REMOVED' ELSE 'BLOCK_REMOVED' END ELSE 'SETTING_RETYPED' END
FROM o WHERE section <> 'Brand#11' AND (p_partkey % 9 = 0 OR (kind = 'setting' AND p_size % 10 = 0 AND type <> 'other'))
"""

SQL["migrations"] = f"""
WITH {_LOCK}, a AS (SELECT CASE section WHEN 'Brand#11' THEN 'Brand#11-new' ELSE section END AS section, kind, id, type FROM o)
SELECT section, kind, CASE WHEN section = 'Brand#12' AND kind = 'setting' AND id = 'id:2' THEN 'id:two' WHEN section = 'Brand#11-new' AND kind = 'block' AND id = 'id:4' THEN 'id:four' ELSE id END AS id, type
FROM a WHERE NOT (section = 'Brand#11-new' AND kind = 'setting' AND id = 'id:1')
"""

SQL["migrations_pending"] = "SELECT 'm:' || p_partkey AS id FROM part WHERE p_partkey % 3 <> 0"

SQL["merge3"] = """
WITH x AS (SELECT o_orderkey AS k, CASE WHEN k % 5 <> 0 THEN o_orderpriority END AS b,
  CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 3 = 0 THEN 'source' ELSE o_orderpriority END END AS s,
  CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 4 = 0 THEN 'merchant' ELSE o_orderpriority END END AS m FROM orders),
y AS (SELECT k, b, s, m,
  CASE WHEN b IS NULL AND m IS NOT NULL THEN m WHEN b IS NULL THEN s WHEN m IS NULL THEN s WHEN s IS NULL AND m = b THEN NULL WHEN s IS NULL THEN m
    WHEN m = b THEN s WHEN s = b THEN m WHEN s = m THEN s ELSE m END AS v,
  CASE WHEN b IS NULL OR m IS NULL THEN false WHEN s IS NULL THEN m <> b WHEN m = b OR s = b OR s = m THEN false ELSE true END AS conflict FROM x)
SELECT k AS o_orderkey, v, conflict FROM y WHERE v IS NOT NULL
"""

_OUT = """x AS (SELECT 'out:' || o_orderkey AS path, CASE WHEN o_orderkey % 5 <> 0 THEN 'h' || (o_orderkey % 3) END AS w,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'h' || (o_orderkey % 2) END AS o, CASE WHEN o_orderkey % 3 <> 0 THEN 'h' || (o_orderkey % 6) END AS e FROM orders)"""

SQL["ownership_conflicts"] = f"""
WITH {_OUT} SELECT path, CASE
  WHEN w IS NOT NULL AND e IS NULL THEN 'write' WHEN w IS NOT NULL AND e = w THEN 'keep'
  WHEN w IS NOT NULL AND o IS NULL THEN 'conflict:NOT_OWNED' WHEN w IS NOT NULL AND e <> o THEN 'conflict:OWNED_MODIFIED' WHEN w IS NOT NULL THEN 'write'
  WHEN e IS NULL THEN 'forget' WHEN e <> o THEN 'conflict:STALE_MODIFIED' ELSE 'delete' END AS action FROM x WHERE w IS NOT NULL OR o IS NOT NULL
"""

SQL["component_diff"] = f"""
WITH {_OUT} SELECT path, CASE WHEN w IS NULL THEN 'added' WHEN o IS NULL THEN 'removed' WHEN w = o THEN 'unchanged' ELSE 'changed' END AS change,
  CASE WHEN e IS NULL THEN 'missing' WHEN e = w THEN 'clean' WHEN e = o THEN 'current' ELSE 'edited' END AS local FROM x WHERE w IS NOT NULL OR o IS NOT NULL
"""

SQL["collision_check"] = """
SELECT regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS path, count(DISTINCT p_brand) AS owners, count(DISTINCT p_name) AS contents
FROM part GROUP BY 1 HAVING owners > 1 OR contents > 1
"""

SQL["semver_latest"] = """
WITH v AS (SELECT p_brand, p_size AS a, p_partkey % 13 AS b, length(p_name) AS c, p_size || '.' || (p_partkey % 13) || '.' || length(p_name) AS version FROM part)
SELECT p_brand, (list(version ORDER BY a DESC, b DESC, c DESC))[1] AS latest, count(DISTINCT version) AS versions FROM v GROUP BY p_brand
"""

SQL["insert_if_absent"] = """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 2 = 0
UNION ALL SELECT l_orderkey, l_linenumber, min(-l_partkey) FROM lineitem WHERE l_linenumber <= 2 AND (l_orderkey, l_linenumber) NOT IN
  (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_orderkey % 2 = 0) GROUP BY 1, 2
"""

SQL["install_closure"] = """
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey // 3 FROM part),
c AS (SELECT max(p_partkey) AS node FROM part UNION SELECT e.dst FROM c JOIN e ON e.src = c.node)
SELECT node FROM c
"""

SQL["agreement_score"] = """
SELECT count(*) AS compared, count(*) FILTER (WHERE quality = 1 AND n_chars >= 500) AS both, count(*) FILTER (WHERE quality = 1 AND n_chars < 500) AS declared_only,
  count(*) FILTER (WHERE quality <> 1 AND n_chars >= 500) AS inferred_only, count(*) FILTER (WHERE quality <> 1 AND n_chars < 500) AS neither
FROM labels JOIN documents USING (doc_id)
"""

SQL["precision_stats"] = """
SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.95), 4) AS p95,
  round(min(o_totalprice), 4) AS least, round(max(o_totalprice), 4) AS most FROM orders GROUP BY o_orderpriority
"""

SQL["scale_clone"] = "SELECT n_name AS name FROM nation UNION ALL SELECT n_name || '-x' || i FROM nation, range(1, 16) t(i)"

SQL["story_validation"] = """
WITH r AS (SELECT p_partkey, 'size' AS name, CASE WHEN p_size < 10 THEN 'range-below' WHEN p_size > 40 THEN 'range-above' END AS issue FROM part
  UNION ALL SELECT p_partkey, 'extra', 'unknown-prop' FROM part WHERE p_partkey % 5 = 0)
SELECT p_partkey, name, issue FROM r WHERE issue IS NOT NULL
"""

SQL["story_defaults"] = """
SELECT p_partkey, 'tone' AS name, 'plain' AS value FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part
UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part WHERE p_size > 25
"""

SQL["severity_gate"] = """
SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'click') AS warnings,
  count(*) FILTER (WHERE event_type = 'error') = 0 AS can_emit FROM events GROUP BY user_id
"""

SQL["first_per_key"] = """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1
"""

SQL["contract_targets"] = """
SELECT l_orderkey || ':' || l_linenumber AS site, l_partkey AS target, CASE WHEN p_size < 10 THEN 'TARGET_NOT_SNIPPET' ELSE 'CONTRACT_UNRESOLVED' END AS code
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10 OR p_size >= 40
"""

SQL["migration_problems"] = """
WITH m AS (SELECT CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey // 2)::VARCHAR END AS id, p_partkey AS k FROM part)
SELECT coalesce(id, '') AS id, CASE WHEN id IS NULL THEN 'no-id' WHEN k % 5 = 4 THEN 'unknown-op' ELSE 'missing-field' END AS problem FROM m
WHERE id IS NULL OR k % 5 = 4 OR (k % 5 IN (0, 1, 3) AND k % 3 = 0) OR (k % 5 = 2 AND k % 4 = 0)
UNION ALL SELECT id, 'duplicate-id' FROM m WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1
"""

SQL["snapshot_replace"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END AS step, CASE WHEN o_orderkey % 4 = 0 THEN 'remove' ELSE 'update' END AS change
FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderkey % 3 <> 0
"""

SQL["invalidated"] = f"""
WITH RECURSIVE {_EDGES}, i AS (SELECT 'region:0' AS node, 0 AS depth UNION SELECT e.src, i.depth + 1 FROM i JOIN e ON e.dst = i.node)
SELECT node, depth::BIGINT AS depth FROM i WHERE depth > 0
"""

SQL["import_cycles"] = """
SELECT p_partkey AS node, p_partkey - p_partkey % 7 AS cycle FROM part WHERE (SELECT max(p_partkey) FROM part) >= p_partkey - p_partkey % 7 + 6
"""

SQL["versions_ascending"] = """
WITH v AS (SELECT DISTINCT p_brand, p_size AS a, p_partkey % 13 AS b FROM part)
SELECT p_brand, string_agg(a || '.' || b || '.0', ',' ORDER BY a, b) AS versions FROM v GROUP BY p_brand
"""

SQL["linecol_to_offset"] = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) >= 2 THEN length(l[1]) + 1 + least(4, length(l[2])) END AS pos FROM l
"""

SQL["graphql_owners"] = """
SELECT * FROM (VALUES ('companies', 'company'), ('Company-Location', 'company_location'), ('productVariant', 'variant'), ('cart', NULL), ('orders', 'order'),
  ('', NULL), ('shop', 'shop'), ('Pages', 'page'), ('checkout', NULL)) AS t(name, owner)
"""

SQL["metafield_identity"] = """
SELECT p_partkey, CASE WHEN ok THEN 'product' END AS owner, CASE WHEN ok THEN p_brand END AS namespace, CASE WHEN ok THEN trim(p_name) END AS key
FROM (SELECT *, p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_name NOT LIKE '%.%' AND p_brand NOT LIKE '%.%' AS ok FROM part)
"""

SQL["dependency_names"] = """
WITH n AS (SELECT p_partkey, p_partkey % 4 AS kind, CASE p_partkey % 7 WHEN 0 THEN 'must be a non-empty trimmed name'
    WHEN 1 THEN 'must not contain traversal or absolute paths' WHEN 2 THEN 'must not contain path separators' WHEN 3 THEN 'must omit theme file extensions' END AS problem,
  CASE WHEN p_partkey % 7 = 4 THEN 'none' ELSE 'c-' || p_partkey END AS name FROM part)
SELECT p_partkey, problem, CASE WHEN problem IS NOT NULL OR (kind = 3 AND name = 'none') THEN NULL WHEN kind = 0 THEN 'snippets/' || name || '.liquid'
  WHEN kind = 1 THEN 'sections/' || name || '.liquid' WHEN kind = 2 THEN 'sections/' || name || '.json' ELSE 'layout/' || name || '.liquid' END AS file FROM n
"""

SQL["merchant_paths"] = """
SELECT page_id, page_id % 10 IN (1, 4) AS data, page_id % 10 = 7 AS locale, page_id % 10 IN (1, 4, 7) AS owned FROM pages
"""

SQL["text_edits"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 40 AS a FROM documents)
SELECT doc_id, sha256(substr(text, 1, 10) || 'new' || substr(text, 21)) AS sha, (CASE WHEN a + 5 <= 10 THEN a WHEN a >= 20 THEN a - 7 ELSE least(a, 10) END)::BIGINT AS start,
  (CASE WHEN a + 5 <= 10 THEN a + 5 WHEN a >= 20 THEN a - 2 ELSE greatest(13, a - 2) END)::BIGINT AS "end" FROM t
"""

SQL["template_literals"] = """
WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '" | append: ''"'' | append: ''"'' | append: "' || p_type || '"' ELSE p_brand || p_type || '"' END AS tail FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '"" | append: ''"'' | append: "' || tail ELSE '"' || tail END AS literal FROM v
"""

SQL["render_calls"] = r"""
WITH a AS (SELECT p_partkey, '{% render ''' || p_brand || '''' AS head, list_filter([CASE WHEN p_partkey % 5 <> 0 THEN 'size: ' || p_size END,
    CASE WHEN p_partkey % 5 <> 0 THEN 'title: ''' || p_name || '\''s''' END, CASE WHEN p_partkey % 2 = 1 THEN 'part: part' END], lambda x: x IS NOT NULL) AS given FROM part),
c AS (SELECT *, head || ', ' || array_to_string(given, ', ') || ' %}' AS short FROM a)
SELECT p_partkey, CASE WHEN len(given) = 0 THEN head || ' %}' WHEN length(short) <= 72 THEN short
  ELSE head || ',' || chr(10) || '  ' || array_to_string(given, ',' || chr(10) || '  ') || chr(10) || '%}' END AS call FROM c
"""

SQL["type_bindings"] = """
SELECT p_partkey, t.binding, t.optional, t.checked, t.control, t.options FROM part JOIN (VALUES (0, 'string', false, true, 'text', NULL), (1, 'number', false, true, 'number', NULL),
  (2, 'boolean', true, true, 'boolean', NULL), (3, 'string', false, true, 'select', 'a,b'), (4, 'string', false, false, 'text', NULL), (5, 'string', false, true, 'number', NULL),
  (6, 'string', false, false, 'text', NULL)) AS t(k, binding, optional, checked, control, options) ON p_partkey % 7 = t.k
"""

SQL["schema_problems"] = """
SELECT p_partkey::VARCHAR AS path, CASE WHEN t.k = 0 THEN 'SCHEMA_INVALID_JSON' ELSE 'SCHEMA_INVALID_SHAPE' END AS code, t.name FROM part JOIN (VALUES (0, 'invalid JSON'),
  (1, 'root must be an object'), (2, '"settings" must be an array'), (3, 'settings[1] must be an object'), (4, 'settings[0].id must be a string'), (5, '"blocks" must be an array'),
  (6, 'blocks[0] must be an object'), (7, 'blocks[0].type must be a string'), (8, 'blocks[0].settings must be an array'), (9, 'blocks[1].settings[0].id must be a string')) AS t(k, name) ON p_partkey % 21 = t.k
"""

SQL["schema_setting_reads"] = """
WITH r AS (SELECT DISTINCT l_partkey AS k, l_linenumber % 2 = 0 AS section, CASE l_linenumber % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE 'on' END AS name, p_brand, p_type
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT k::VARCHAR AS path, 'SETTING_READ_UNKNOWN' AS code, name FROM r WHERE k % 21 >= 10 AND ((section AND name <> p_brand AND name <> 'on') OR (NOT section AND k % 2 = 1 AND name <> p_type))
"""

SQL["schema_controls"] = """
SELECT p_partkey::VARCHAR AS path, p_brand AS name, p_brand AS label, 'number' AS kind, 1.0::DOUBLE AS least, 9.0::DOUBLE AS most FROM part WHERE p_partkey % 21 >= 10
UNION ALL SELECT p_partkey::VARCHAR, 'on', 'On', 'boolean', NULL, NULL FROM part WHERE p_partkey % 21 >= 10
"""

SQL["setting_projections"] = """
SELECT p_partkey::VARCHAR AS path, 'SETTING_TYPE_UNSUPPORTED' AS code, p_brand AS name FROM part WHERE p_size > 10 AND p_partkey % 3 = 0
"""

SQL["slot_placement"] = """
SELECT l_orderkey AS path, 'PROP_WITHOUT_SETTING' AS code, l_linenumber::VARCHAR AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE l_linenumber % 2 = 1 AND NOT l_quantity > 25 AND o_orderkey % 3 IN (0, 1)
UNION ALL SELECT l_orderkey, 'SLOT_OUTSIDE_SECTION', l_linenumber::VARCHAR FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 3 <> 0
UNION ALL SELECT l_orderkey, 'SLOT_REPEATED', l_linenumber::VARCHAR FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS f FROM lineitem) WHERE l_linenumber > f
"""

SQL["slot_blocks"] = """
SELECT DISTINCT l_orderkey AS path, CASE WHEN p_size IS NULL THEN 'SLOT_BLOCK_UNKNOWN' ELSE 'SLOT_NOT_A_BLOCK' END AS code, l_partkey::VARCHAR AS name
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) p ON p_partkey = l_partkey WHERE p_size IS NULL OR p_size <= 25
"""

SQL["hoisting_conflicts"] = """
WITH s AS (SELECT DISTINCT l_orderkey AS path, l_linenumber AS "at", CASE l_suppkey % 3 WHEN 0 THEN 'itemCard' WHEN 1 THEN 'item' ELSE 'item_card' END AS alias FROM lineitem),
f AS (SELECT *, min("at") OVER (PARTITION BY path, alias) AS first FROM s),
n AS (SELECT path, "at", a.place, alias, CASE alias WHEN 'item' THEN 'item_' ELSE 'item_card_' END || a.argument AS id FROM f, (VALUES ('title', 0), ('size', 1)) AS a(argument, place) WHERE "at" = first),
j AS (SELECT *, row_number() OVER (PARTITION BY path, id ORDER BY "at", place, alias) AS turn FROM n)
SELECT path, 'HOISTED_ALIAS_REUSED' AS code, "at"::VARCHAR AS name FROM f WHERE "at" <> first
UNION ALL SELECT path, 'HOISTED_SETTING_COLLISION', id FROM j WHERE turn > 1 OR (id = 'item_size' AND path % 2 = 0)
"""

SQL["setting_headers"] = """
WITH s AS (SELECT l_orderkey AS path, l_linenumber AS "at", CASE WHEN l_quantity > 25 THEN 'Big lot' ELSE 'Lot' END AS alias, l_partkey::VARCHAR AS id FROM lineitem),
l AS (SELECT *, lag(alias) OVER (PARTITION BY path ORDER BY "at", id, alias) AS before FROM s)
SELECT path, "at", 1 AS part, 'setting' AS type, id AS content FROM l UNION ALL SELECT path, "at", 0, 'header', alias FROM l WHERE before IS DISTINCT FROM alias
"""

SQL["resolution_problems"] = """
WITH t AS (SELECT l_orderkey, count(*) AS n, first(l_suppkey ORDER BY l_linenumber, l_suppkey) AS target FROM lineitem GROUP BY l_orderkey),
b AS (SELECT x.l_orderkey AS path, (l_linenumber % 4)::VARCHAR AS argument, l_suppkey, target, p_partkey, p_size FROM lineitem x JOIN t ON x.l_orderkey = t.l_orderkey LEFT JOIN part ON p_partkey = l_partkey)
SELECT o_custkey AS path, 'RENDER_TARGET_COUNT' AS code, o_orderkey::VARCHAR AS name FROM orders LEFT JOIN t ON o_orderkey = l_orderkey WHERE coalesce(n, 0) <> 1
UNION ALL SELECT path, 'ARGUMENT_AMBIGUOUS', argument FROM b GROUP BY path, argument HAVING count(*) > 1
UNION ALL SELECT path, 'BINDING_TARGET_MISMATCH', argument FROM b WHERE l_suppkey <> target
UNION ALL SELECT path, 'BINDING_NOT_CONTRACT_PROP', argument FROM b WHERE NOT coalesce(p_partkey % 10 = l_suppkey AND p_size > 10, false)
"""

SQL["default_problems"] = """
SELECT p_partkey::VARCHAR AS path, 'DEFAULT_INVALID' AS code, p_brand AS name FROM part WHERE CASE WHEN p_size > 10 THEN p_partkey % 9 > 3 ELSE p_partkey % 9 <> 8 END
"""

SQL["region_references"] = """
SELECT p_partkey::VARCHAR AS path, 'style' AS kind, 'styles' AS binding, CASE p_partkey % 3 WHEN 0 THEN 'c' || p_partkey WHEN 1 THEN 'card' ELSE 'x' END AS name,
  CASE WHEN p_partkey % 3 = 0 THEN 'bare-class' ELSE 'quoted-class' END AS form, 1::BIGINT AS n FROM part
UNION ALL SELECT p_partkey::VARCHAR, 'prop', 'props', 'p' || p_size, 'identifier', 2 FROM part WHERE p_partkey % 3 = 1
"""
