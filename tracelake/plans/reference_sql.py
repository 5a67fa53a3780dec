"""SQL for the queries of reference_queries, in DuckDB's dialect."""

from __future__ import annotations

from tracelake.functions.text import DESIGN_WORDS
from tracelake.operators.matching import TERM_TYPES, WEIGHTS
from tracelake.operators.shred import TERM_FIELDS
from tracelake.plans.reference_queries import SPECS
from tracelake.sources.inventory import EXCLUDED_NAMES, EXCLUDED_PARTS

_HEX = "CASE WHEN sha256 IS NULL THEN NULL ELSE upper(regexp_extract(lower(sha256), '([0-9a-f]{64})', 1)) END"
_DOCS = f"""
docs AS (SELECT snapshot_no, lower(path) AS path_key, path, {_HEX} AS sha256 FROM manifest
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, lower(path) ORDER BY received_at DESC) = 1),
cur AS (SELECT * FROM docs WHERE snapshot_no = 8), old AS (SELECT * FROM docs WHERE snapshot_no = 7),
one_case AS (SELECT DISTINCT * FROM cases),
sourced AS (SELECT c.case_id, c.doc_path, c.validation_status, d.sha256 AS source_sha
  FROM one_case c LEFT JOIN docs d ON d.snapshot_no = 4 AND d.path_key = lower(c.doc_path))
"""
_DELTA = f"""
{_DOCS},
plain AS (
  SELECT coalesce(c.path_key, p.path_key) AS path_key, coalesce(c.path, p.path) AS path, CASE WHEN c.path IS NULL THEN p.sha256 ELSE c.sha256 END AS sha256,
    CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN c.sha256 IS NOT DISTINCT FROM p.sha256 THEN 'unchanged' ELSE 'changed' END AS change_kind
  FROM cur c FULL JOIN old p ON c.path_key = p.path_key),
moves AS (
  SELECT sha256, max(path) FILTER (change_kind = 'removed') AS from_path, max(path) FILTER (change_kind = 'added') AS to_path
  FROM plain WHERE change_kind IN ('added', 'removed') AND sha256 IS NOT NULL GROUP BY 1
  HAVING count(*) FILTER (change_kind = 'added') = 1 AND count(*) FILTER (change_kind = 'removed') = 1),
delta AS (
  SELECT p.path, t.from_path, CASE WHEN t.from_path IS NOT NULL THEN 'moved' ELSE p.change_kind END AS change_kind
  FROM plain p LEFT JOIN moves t ON t.to_path = p.path AND p.change_kind = 'added'
  WHERE NOT (p.change_kind = 'removed' AND p.path IN (SELECT from_path FROM moves)))
"""
#: The delta of each snapshot to the one before it.
_EVERY_DELTA = " UNION ALL ".join(
    f"SELECT * FROM (WITH {_DELTA.replace('snapshot_no = 7', f'snapshot_no = {n - 1}').replace('snapshot_no = 8', f'snapshot_no = {n}')} SELECT {n} AS snapshot_no, path, from_path, change_kind FROM delta)"
    for n in range(2, 9)
)
_LIFE = f"""
{_DOCS},
spread AS (SELECT sha256, count(*) AS n, min(path) AS to_path FROM cur WHERE sha256 IS NOT NULL GROUP BY 1),
life AS (
  SELECT s.case_id, CASE WHEN s.doc_path IS NULL OR s.source_sha IS NULL THEN 'invalid' WHEN c.sha256 = s.source_sha THEN 'active'
      WHEN c.path IS NULL AND x.n = 1 THEN 'moved' WHEN c.path IS NOT NULL THEN 'changed' ELSE 'removed' END AS status, x.to_path
  FROM sourced s LEFT JOIN cur c ON c.path_key = lower(s.doc_path) LEFT JOIN spread x ON x.sha256 = s.source_sha)
"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SPEC_ROWS = ", ".join(
    f"({_q(s)}, {_q(f)}, {i}, {_q(t)})" for s, spec in SPECS.items() for f in WEIGHTS for i, t in enumerate(spec.get(f) or [])
)
_TYPE_ROWS = ", ".join(f"({_q(f)}, {_q(t)}, {w}::DOUBLE)" for (f, t), w in zip(TERM_TYPES.items(), (WEIGHTS[f] for f in TERM_TYPES), strict=True))


def _tokens(x: str) -> str:
    return (
        f"list_distinct(flatten(list_transform(regexp_extract_all({x}, '[a-z0-9]+|[㐀-鿿]+'), lambda r: CASE WHEN regexp_matches(r, '^[㐀-鿿]{{2,}}$') "
        "THEN list_concat([r], list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) ELSE [r] END)))"
    )


def _similar(a: str, b: str, ta: str, tb: str) -> str:
    common = f"len(list_intersect({ta}, {tb}))"
    either = f"(len({ta}) + len({tb}) - {common})"
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE "
        f"WHEN least(length({a}), length({b})) >= 2 AND (contains({a}, {b}) OR contains({b}, {a})) THEN 0.9::DOUBLE "
        f"WHEN {common} = 0 THEN 0.0::DOUBLE ELSE greatest(0.75::DOUBLE * {common} / least(len({ta}), len({tb})), {common}::DOUBLE / {either}) END"
    )


_KIND = (
    "CASE WHEN wanted_key = key THEN 'exact' WHEN least(length(wanted_key), length(key)) >= 2 "
    "AND (contains(wanted_key, key) OR contains(key, wanted_key)) THEN 'contains' ELSE 'lexical' END"
)
_MATCH = f"""
spec AS (SELECT *, lower(display) AS wanted_key, {_tokens('lower(display)')} AS wt FROM (VALUES {_SPEC_ROWS}) v(spec_id, field, pos, display)),
types AS (SELECT * FROM (VALUES {_TYPE_ROWS}) v(field, term_type, weight)),
keys AS (
  SELECT case_id, field, trim(normalized, ' ') AS key, term_id AS actual_pos, trim(term, ' ') AS actual
  FROM case_terms JOIN types USING (term_type) WHERE trim(normalized, ' ') <> ''
  QUALIFY row_number() OVER (PARTITION BY case_id, field, trim(normalized, ' ') ORDER BY term_id, trim(term, ' ')) = 1),
dim AS (SELECT *, {_tokens('key')} AS kt FROM (SELECT DISTINCT field, key FROM keys)),
pairs AS (
  SELECT s.spec_id, s.field, s.pos, s.display AS wanted, wanted_key, key, {_similar('wanted_key', 'key', 'wt', 'kt')} AS score
  FROM spec s JOIN dim USING (field)),
best AS (
  SELECT p.spec_id, k.case_id, p.field, p.pos, p.wanted, k.actual, round(p.score, 4) AS score, {_KIND} AS match_type
  FROM pairs p JOIN keys k USING (field, key) WHERE p.score >= 0.5
  QUALIFY row_number() OVER (PARTITION BY p.spec_id, k.case_id, p.field, p.pos ORDER BY p.score DESC, k.actual_pos) = 1),
fields AS (SELECT spec_id, case_id, field, max(score) AS best, max(score) * any_value(weight) AS part FROM best JOIN types USING (field) GROUP BY ALL),
scores AS (SELECT spec_id, case_id, round(round(sum(part), 8)::DECIMAL(18, 8), 4)::DOUBLE AS score FROM fields GROUP BY ALL),
one_case AS (SELECT DISTINCT * FROM cases),
usable AS (SELECT case_id FROM one_case WHERE knowledge_tier <> 'rejected'),
direct AS (SELECT * FROM scores WHERE score >= 1 AND case_id IN (SELECT case_id FROM usable))
"""
_RANK = "CASE {0} WHEN 'conflict' THEN 0 WHEN 'trusted' THEN 1 WHEN 'candidate' THEN 2 ELSE 3 END"
_TIER = "(['conflict', 'trusted', 'candidate', 'rejected'])[min({0}) + 1]".format(_RANK.format("knowledge_tier"))


_LOW = "lower(trim({0}, ' '))".format
_CHANGES = "chg AS (SELECT DISTINCT * FROM service_changes)"
_SCENES = f"scenes AS (SELECT DISTINCT d.spec_id, {_LOW('s.name')} AS scenario_key, s.* FROM scenarios s JOIN direct d USING (case_id) WHERE s.name IS NOT NULL)"
_TOUCHED = f"touched AS (SELECT DISTINCT d.spec_id, {_LOW('s.service')} AS service_key, s.* FROM chg s JOIN direct d USING (case_id) WHERE s.service IS NOT NULL)"
_COCHANGE = f"""
{_CHANGES},
members AS (SELECT DISTINCT case_id, normalized_service AS s FROM chg WHERE normalized_service <> ''
  AND case_id IN (SELECT case_id FROM cases WHERE knowledge_tier IN ('trusted', 'candidate'))),
pair_cases AS (SELECT a.s AS service_a, b.s AS service_b, a.case_id FROM members a JOIN members b ON a.case_id = b.case_id AND a.s < b.s),
cochange AS (SELECT service_a, service_b, count(*) AS case_count FROM pair_cases GROUP BY ALL)
"""
_CO_SCORE = f"""
{_MATCH}, {_COCHANGE},
strong AS (SELECT * FROM scores WHERE score >= 1 AND case_id IN (SELECT case_id FROM usable)),
direct_services AS (SELECT DISTINCT spec_id, {_LOW('service')} AS service_key FROM chg JOIN strong USING (case_id) WHERE service IS NOT NULL),
kept AS (SELECT DISTINCT spec_id, service_a, service_b, case_count FROM cochange JOIN direct_services ON service_key IN (service_a, service_b)),
parts AS (
  SELECT k.spec_id, k.service_a, k.service_b, k.case_count, least(coalesce(max(s.score), 0) / 3, 1) AS context,
    coalesce(max(o.best), 0) AS business_similarity, coalesce(max(t.best), 0) AS change_similarity,
    least(k.case_count / 3, 1) AS frequency, count(*) FILTER (c.knowledge_tier = 'trusted') / count(*) AS trusted_ratio
  FROM kept k JOIN pair_cases p USING (service_a, service_b) LEFT JOIN one_case c ON c.case_id = p.case_id
    LEFT JOIN scores s ON s.case_id = p.case_id AND s.spec_id = k.spec_id
    LEFT JOIN fields o ON o.case_id = p.case_id AND o.spec_id = k.spec_id AND o.field = 'business_objects'
    LEFT JOIN fields t ON t.case_id = p.case_id AND t.spec_id = k.spec_id AND t.field = 'change_types'
  GROUP BY ALL),
scored AS (
  SELECT spec_id, service_a, service_b, case_count, round(context, 4) AS context, round(business_similarity, 4) AS business_similarity,
    round(change_similarity, 4) AS change_similarity, round(frequency, 4) AS frequency, round(trusted_ratio, 4) AS trusted_ratio,
    round(round(context * 0.35::DOUBLE + business_similarity * 0.15::DOUBLE + change_similarity * 0.15::DOUBLE + frequency * 0.2::DOUBLE + trusted_ratio * 0.15::DOUBLE, 8)::DECIMAL(18, 8), 4)::DOUBLE AS score,
    greatest(business_similarity, change_similarity) AS near
  FROM parts),
rated AS (SELECT * EXCLUDE (near), case_count >= 2 AND score >= 0.6::DOUBLE AND near >= 0.5::DOUBLE AS expanded FROM scored)
"""
_RELS = """
ends AS (SELECT case_id, min(normalized) FILTER (term_type = 'business_object') AS source, min(normalized) FILTER (term_type = 'state') AS target
  FROM case_terms WHERE normalized <> '' GROUP BY 1),
rels AS (SELECT e.*, c.knowledge_tier, (['forward', 'reverse', 'bidirectional', 'none'])[length(source) % 4 + 1] AS propagation
  FROM ends e JOIN one_case c USING (case_id) WHERE source IS NOT NULL AND target IS NOT NULL)
"""


def _hop(n: int, frontier: str) -> str:
    return f"""
near{n} AS (
  SELECT f.spec_id, e.key, max(sim) AS sim FROM (
    SELECT f.spec_id, k.key, {_similar('f.key', 'k.key', 'f.kt', 'k.kt')} AS sim
    FROM (SELECT spec_id, key, {_tokens('key')} AS kt FROM {frontier}) f, (SELECT key, {_tokens('key')} AS kt FROM (SELECT DISTINCT key FROM entries)) k) f
  JOIN (SELECT DISTINCT key FROM entries) e USING (key) WHERE sim >= 0.7::DOUBLE GROUP BY ALL),
hop{n} AS (
  SELECT spec_id, {n} AS depth, case_id, other FROM entries JOIN near{n} USING (key)
  QUALIFY row_number() OVER (PARTITION BY spec_id, case_id ORDER BY sim DESC, side) = 1)"""


_WALK = f"""
{_MATCH}, {_RELS},
entries AS (
  SELECT case_id, 0 AS side, source AS key, target AS other FROM rels WHERE knowledge_tier <> 'rejected' AND propagation IN ('forward', 'bidirectional')
  UNION ALL SELECT case_id, 1, target, source FROM rels WHERE knowledge_tier <> 'rejected' AND propagation IN ('reverse', 'bidirectional')),
front0 AS (SELECT DISTINCT spec_id, wanted_key AS key FROM spec), {_hop(1, 'front0')},
front1 AS (SELECT DISTINCT spec_id, other AS key FROM hop1 EXCEPT SELECT * FROM front0), {_hop(2, 'front1')},
hits AS (SELECT spec_id, depth, case_id FROM hop1 UNION ALL SELECT spec_id, depth, case_id FROM hop2)
"""
_CODE = f"""
edges AS (SELECT DISTINCT least({_LOW('service_a')}, {_LOW('service_b')}) AS a, greatest({_LOW('service_a')}, {_LOW('service_b')}) AS b FROM service_cochange WHERE {_LOW('service_a')} <> {_LOW('service_b')}),
names AS (SELECT a AS entity_id FROM edges UNION SELECT b FROM edges),
entities AS (SELECT entity_id, split_part(entity_id, '-', -1) AS entity_type FROM names WHERE entity_id NOT LIKE '%-audit'),
wanted AS (SELECT unnest(['wallet', 'parcel']) AS w),
seed AS (
  SELECT entity_id, round(max(2.0::DOUBLE * CASE WHEN w = o THEN 1.0::DOUBLE WHEN contains(o, w) OR contains(w, o) THEN 0.9::DOUBLE ELSE 0 END), 4) AS score
  FROM (SELECT entity_id, split_part(entity_id, '-', 1) AS o FROM entities), wanted GROUP BY 1 HAVING score >= 0.8::DOUBLE),
both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
path1 AS (SELECT a, b FROM both_ways WHERE a IN (SELECT entity_id FROM seed)),
reach1 AS (SELECT DISTINCT b AS entity_id FROM path1 WHERE b IN (SELECT entity_id FROM entities) AND b NOT IN (SELECT entity_id FROM seed)),
reach2 AS (SELECT DISTINCT b AS entity_id FROM both_ways WHERE a IN (SELECT entity_id FROM reach1) AND b IN (SELECT entity_id FROM entities)
  AND b NOT IN (SELECT entity_id FROM seed) AND b NOT IN (SELECT entity_id FROM reach1))
"""
_PREDICTED = """
chg AS (SELECT DISTINCT * FROM service_changes),
p AS (SELECT DISTINCT case_id, normalized_service FROM chg WHERE normalized_service <> '' AND asset_types_json LIKE '%api%'),
e AS (SELECT DISTINCT case_id, normalized_service FROM chg WHERE normalized_service <> '' AND knowledge_tier = 'trusted'),
counts AS (
  SELECT coalesce(p.case_id, e.case_id) AS case_id, count(*) FILTER (p.case_id IS NOT NULL AND e.case_id IS NOT NULL) AS tp,
    count(*) FILTER (e.case_id IS NULL) AS fp, count(*) FILTER (p.case_id IS NULL) AS fn
  FROM p FULL JOIN e ON p.case_id = e.case_id AND p.normalized_service = e.normalized_service GROUP BY 1)
"""
_PREC = "(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1 ELSE 0 END)"
_REC = "(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END)"
_F1 = f"(CASE WHEN {_PREC} + {_REC} > 0 THEN 2 * {_PREC} * {_REC} / ({_PREC} + {_REC}) ELSE 0 END)"
_METRICS = f"round({_PREC}, 4) AS precision, round({_REC}, 4) AS recall, round({_F1}, 4) AS f1"
_OVERALL = f"{_PREDICTED}, total AS (SELECT 'services' AS kind, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM counts), rated AS (SELECT *, {_METRICS} FROM total)"
_WORDS = ", ".join(_q(w) for w in DESIGN_WORDS)
_VERSION = r"(?i)(?:^|[\s._-])((?:v|version|版本|版)[\s._-]*(?:\d+(?:[._-]\d+)*|[一二三四五六七八九十]+)|20\d{2}[._-]\d{1,2}(?:[._-]\d{1,2})?)"

SQL = {
    "r_manifest_delta": _EVERY_DELTA,
    "r_delta_counts": f"SELECT snapshot_no, change_kind, count(*) AS n_documents FROM ({_EVERY_DELTA}) GROUP BY ALL",
    "r_case_lifecycle": f"WITH {_LIFE} SELECT case_id, status, CASE WHEN status = 'moved' THEN to_path END AS new_path FROM life",
    "r_lifecycle_counts": f"WITH {_LIFE} SELECT status, count(*) AS n_cases FROM life GROUP BY 1",
    "r_pending_extraction": f"""WITH {_DOCS} SELECT path FROM cur c WHERE sha256 IS NOT NULL AND path NOT LIKE '%.yaml'
      AND NOT EXISTS (SELECT 1 FROM sourced s WHERE lower(s.doc_path) = c.path_key AND s.source_sha = c.sha256)""",
    "r_pending_validation": f"""WITH {_DOCS} SELECT path FROM cur c WHERE EXISTS (SELECT 1 FROM sourced s WHERE lower(s.doc_path) = c.path_key
      AND s.source_sha = c.sha256 AND coalesce(s.validation_status, 'unverified') = 'unverified')""",
    "r_document_index": "SELECT DISTINCT lower(doc_path) AS path_key, case_id FROM cases WHERE doc_path IS NOT NULL",
    "r_documents_first": "SELECT doc_path, title FROM (SELECT DISTINCT * FROM cases) WHERE doc_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_path ORDER BY case_id) = 1",
    "r_discovery": f"""
WITH docs AS (SELECT DISTINCT path, relative_path, extension FROM manifest),
kept AS (SELECT * FROM docs WHERE extension IN ('.md', '.txt', '.html', '.htm', '.json', '.yaml', '.yml', '.docx', '.pdf')
  AND NOT regexp_full_match(relative_path, '(?s)escrow/.*') AND NOT regexp_full_match(relative_path, '(?s).*refund.*\\.pdf')
  AND NOT list_has_any(string_split(lower(relative_path), '/'), [{', '.join(_q(p) for p in EXCLUDED_PARTS)}])
  AND lower(regexp_extract(relative_path, '([^/]*)$', 1)) NOT IN ({', '.join(_q(p) for p in EXCLUDED_NAMES)}))
SELECT path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS extension,
  nullif(regexp_extract(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', ''), '{_VERSION}', 1), '') AS possible_version,
  list_sum(list_transform(string_split(lower(path), '/'), lambda x: CASE WHEN x IN ({_WORDS}) THEN 3 ELSE 0 END
    + CASE WHEN len(list_filter([{_WORDS}], lambda w: contains(x, w))) > 0 THEN 1 ELSE 0 END))::INTEGER AS design_score
FROM kept""",
    "r_multi_root": "SELECT relative_path AS path, root FROM (SELECT DISTINCT root, relative_path FROM manifest) QUALIFY row_number() OVER (PARTITION BY lower(relative_path) ORDER BY root, relative_path) = 1",
    "r_snapshot_states": """
WITH once AS (SELECT name, capture_no, commit_sha FROM repositories QUALIFY row_number() OVER (PARTITION BY name, capture_no ORDER BY received_at DESC, commit_sha DESC) = 1),
near AS (SELECT *, lower(lag(commit_sha) OVER (PARTITION BY name ORDER BY capture_no)) AS before, lower(commit_sha) AS now FROM once)
SELECT name, CASE WHEN before IS NULL OR now IS NULL THEN 'unknown' WHEN starts_with(now, before) OR starts_with(before, now) THEN 'fresh' ELSE 'stale' END AS status
FROM near QUALIFY row_number() OVER (PARTITION BY name ORDER BY capture_no DESC) = 1""",
    "r_term_keys": "SELECT normalized, 'business-term:' || substr(sha256(normalized), 1, 20) AS term_key FROM (SELECT DISTINCT normalized FROM case_terms WHERE normalized <> '')",
    "r_term_tokens": f"SELECT normalized, coalesce(array_to_string(list_sort({_tokens('normalized')}), '|'), '') AS tokens FROM (SELECT DISTINCT normalized FROM case_terms WHERE normalized <> '')",
    "r_relation_ids": f"""WITH one_case AS (SELECT DISTINCT * FROM cases), {_RELS}
      SELECT case_id, 'history-relation:' || substr(sha256(concat_ws('|', case_id, source, 'affects', target, 'forward', propagation)), 1, 24) AS stable_id FROM rels""",
    "r_best_matches": f"WITH {_MATCH} SELECT spec_id, case_id, field, wanted, actual, score, match_type FROM best",
    "r_case_scores": f"WITH {_MATCH} SELECT spec_id, case_id, score FROM scores",
    "r_direct_matches": f"WITH {_MATCH} SELECT spec_id, case_id, score FROM direct",
    "r_scan_counts": f"""WITH {_MATCH} SELECT spec_id, (SELECT count(*) FROM one_case) AS total_cases, count(*) AS matched_cases,
      count(*) AS direct_matches, 0::BIGINT AS relation_propagated_matches FROM direct GROUP BY 1""",
    "r_tier_counts": """SELECT CASE validation_status WHEN 'validated' THEN 'trusted' WHEN 'conflict' THEN 'conflict' WHEN 'rejected' THEN 'rejected' ELSE 'candidate' END AS knowledge_tier,
      count(*) AS n_cases FROM (SELECT DISTINCT case_id, validation_status FROM cases) GROUP BY 1""",
    "r_item_tiers": """SELECT scenario_id, t AS item_tier, t <> 'trusted' AS requires_confirmation FROM (
      SELECT scenario_id, CASE WHEN c.knowledge_tier = 'trusted' AND json_extract_string(evidence_json, '$.kind') = 'inferred' THEN 'candidate' ELSE c.knowledge_tier END AS t
      FROM (SELECT DISTINCT * FROM scenarios) s JOIN (SELECT DISTINCT * FROM cases) c USING (case_id))""",
    "r_scenario_merge": f"""WITH {_MATCH}, {_SCENES} SELECT spec_id, scenario_key, min(name) AS scenario, count(DISTINCT case_id) AS n_cases, count(*) AS n_evidence,
        {_TIER} AS knowledge_tier, {_TIER} <> 'trusted' AS requires_confirmation FROM scenes GROUP BY spec_id, scenario_key""",
    "r_scenario_values": f"""WITH {_MATCH}, {_SCENES},
      flat AS (SELECT *, 'preconditions' AS field, precondition AS value FROM scenes UNION ALL SELECT *, 'triggers', trigger_text FROM scenes
        UNION ALL SELECT *, 'expected_behaviors', expected_behavior FROM scenes UNION ALL SELECT *, 'case_ids', case_id FROM scenes)
      SELECT spec_id, scenario_key, field, value, name AS first_name, case_id AS first_case_id, scenario_id AS first_scenario_id FROM flat WHERE value <> ''
      QUALIFY row_number() OVER (PARTITION BY spec_id, scenario_key, field, value ORDER BY name, case_id, scenario_id) = 1""",
    "r_service_merge": f"""WITH {_MATCH}, {_CHANGES}, {_TOUCHED} SELECT spec_id, service_key, arg_min(service, (normalized_service, case_id, service_change_id)) AS service,
        count(DISTINCT case_id) AS n_cases, count(*) AS n_evidence, {_TIER} AS knowledge_tier, {_TIER} <> 'trusted' AS requires_confirmation FROM touched GROUP BY spec_id, service_key""",
    "r_service_values": f"""WITH {_MATCH}, {_CHANGES}, {_TOUCHED},
      flat AS (SELECT *, 'responsibilities' AS field, responsibility AS value FROM touched UNION ALL SELECT *, 'modifications', modification FROM touched UNION ALL SELECT *, 'case_ids', case_id FROM touched
        UNION ALL SELECT *, 'asset_types', unnest(from_json(asset_types_json, '["VARCHAR"]')) FROM touched)
      SELECT spec_id, service_key, field, value, normalized_service AS first_normalized_service, case_id AS first_case_id, service_change_id AS first_service_change_id FROM flat WHERE value <> ''
      QUALIFY row_number() OVER (PARTITION BY spec_id, service_key, field, value ORDER BY normalized_service, case_id, service_change_id) = 1""",
    "r_all_services": f"""WITH {_MATCH}, {_CHANGES}, {_TOUCHED}, {_CODE},
      h AS (SELECT spec_id, service_key, count(*) AS n_evidence, {_TIER} AS knowledge_tier FROM touched GROUP BY 1, 2),
      c AS (SELECT 'freeze' AS spec_id, entity_id AS service_key FROM entities)
      SELECT coalesce(h.spec_id, c.spec_id) AS spec_id, coalesce(h.service_key, c.service_key) AS service_key, coalesce(n_evidence, 0) + (c.service_key IS NOT NULL)::INT AS n_evidence,
        coalesce(knowledge_tier, 'candidate') AS knowledge_tier, CASE WHEN h.spec_id IS NULL THEN 'offline-code-candidate' ELSE 'matched-history' END AS source, (c.service_key IS NOT NULL)::BIGINT AS n_entities
      FROM h FULL JOIN c ON h.spec_id = c.spec_id AND h.service_key = c.service_key""",
    "r_cochange_build": f"WITH {_COCHANGE} SELECT * FROM cochange",
    "r_cochange_score": f"WITH {_CO_SCORE} SELECT * FROM rated",
    "r_service_expansion": f"""WITH {_CO_SCORE.replace('score >= 1 AND', 'score >= 4 AND')},
      sides AS (SELECT spec_id, score, service_a, service_b, 0 AS side, service_a AS service FROM rated WHERE expanded UNION ALL SELECT spec_id, score, service_a, service_b, 1, service_b FROM rated WHERE expanded)
      SELECT spec_id, service AS service_key, service, score FROM sides s
      WHERE NOT EXISTS (SELECT 1 FROM direct_services x WHERE x.spec_id = s.spec_id AND x.service_key = s.service)
      QUALIFY row_number() OVER (PARTITION BY spec_id, service ORDER BY service_a, service_b, side) = 1""",
    "r_quality_report": """
WITH c AS (SELECT DISTINCT case_id, validation_status, knowledge_tier FROM cases), live AS (SELECT case_id FROM c WHERE knowledge_tier <> 'rejected')
SELECT 'status:' || coalesce(validation_status, 'none') AS metric, count(*) AS value FROM c GROUP BY 1
UNION ALL SELECT 'tier:' || coalesce(knowledge_tier, 'none'), count(*) FROM c GROUP BY 1
UNION ALL SELECT 'cases', count(*) FROM c
UNION ALL SELECT 'scenarios', count(*) FROM (SELECT DISTINCT * FROM scenarios) WHERE case_id IN (SELECT case_id FROM live)
UNION ALL SELECT 'services', count(DISTINCT trim(service, ' ')) FROM service_changes WHERE case_id IN (SELECT case_id FROM live)
UNION ALL SELECT 'conflicts', 0
UNION ALL SELECT 'review_queue', count(*) FROM c WHERE knowledge_tier IN ('candidate', 'conflict')""",
    "r_review_queue": "SELECT case_id, title, validation_status, confidence FROM (SELECT DISTINCT * FROM cases) WHERE knowledge_tier IN ('candidate', 'conflict')",
    "r_relation_walk": f"WITH {_WALK} SELECT spec_id, depth, case_id FROM hits",
    "r_propagated_cases": f"""WITH {_WALK} SELECT spec_id, case_id, count(*) AS n_paths FROM hits h
      WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.spec_id = h.spec_id AND d.case_id = h.case_id) GROUP BY 1, 2""",
    "r_code_seeds": f"WITH {_CODE} SELECT 'code' AS spec_id, entity_id, score FROM seed",
    "r_code_walk": f"""WITH {_CODE} SELECT 'code' AS spec_id, entity_id, 0 AS depth, score, 'offline-code-mapping' AS source FROM seed
      UNION ALL SELECT 'code', entity_id, 1, 0.7, 'offline-code-propagation' FROM reach1 UNION ALL SELECT 'code', entity_id, 2, 0.49, 'offline-code-propagation' FROM reach2""",
    "r_code_paths": f"""WITH {_CODE} SELECT 'code' AS spec_id, 1 AS depth, a AS source_id, b AS target_id FROM path1
      UNION ALL SELECT 'code', 2, a, b FROM both_ways WHERE a IN (SELECT entity_id FROM reach1)""",
    "r_code_services": f"""WITH {_CODE} SELECT 'code' AS spec_id, entity_id AS service_key, entity_id AS service, 1::BIGINT AS n_types, 1::BIGINT AS n_entities
      FROM entities WHERE entity_id IN (SELECT entity_id FROM seed UNION SELECT entity_id FROM reach1 UNION SELECT entity_id FROM reach2)""",
    "r_replay_metrics": f"WITH {_PREDICTED} SELECT case_id, tp, fp, fn, {_METRICS} FROM counts",
    "r_replay_overall": f"WITH {_OVERALL} SELECT * FROM rated",
    "r_threshold_misses": f"""WITH {_OVERALL},
      flat AS (SELECT 'services_precision' AS metric, precision AS value, 0.9::DOUBLE AS threshold FROM rated
        UNION ALL SELECT 'services_recall', recall, 0.1 FROM rated UNION ALL SELECT 'services_f1', f1, 0.99 FROM rated)
      SELECT * FROM flat WHERE value < threshold""",
    "r_replay_differences": f"""WITH {_PREDICTED} SELECT case_id, 'missing' AS kind, normalized_service FROM (SELECT * FROM e EXCEPT SELECT * FROM p)
      UNION ALL SELECT case_id, 'unexpected', normalized_service FROM (SELECT * FROM p EXCEPT SELECT * FROM e)""",
    "r_replay_evidence": """
WITH c AS (SELECT DISTINCT case_id, coalesce(domain, 'none') AS replay_id FROM cases),
s AS (SELECT DISTINCT replay_id, lower(name) AS scenario, case_id, knowledge_tier FROM scenarios JOIN c USING (case_id) WHERE name IS NOT NULL),
p AS (SELECT DISTINCT replay_id, scenario, case_id FROM s WHERE knowledge_tier = 'trusted'),
e AS (SELECT DISTINCT replay_id, scenario, case_id FROM s WHERE knowledge_tier <> 'rejected'),
pp AS (SELECT DISTINCT replay_id, case_id FROM p WHERE (replay_id, scenario) IN (SELECT (replay_id, scenario) FROM e)),
ee AS (SELECT DISTINCT replay_id, case_id FROM e WHERE (replay_id, scenario) IN (SELECT (replay_id, scenario) FROM p))
SELECT coalesce(pp.replay_id, ee.replay_id) AS replay_id, count(*) FILTER (pp.case_id IS NOT NULL AND ee.case_id IS NOT NULL) AS tp,
  count(*) FILTER (ee.case_id IS NULL) AS fp, count(*) FILTER (pp.case_id IS NULL) AS fn
FROM pp FULL JOIN ee ON pp.replay_id = ee.replay_id AND pp.case_id = ee.case_id GROUP BY 1""",
    "r_rule_errors": """
WITH bad AS (
  SELECT snapshot_no, path, 'sha256 is no digest' AS message FROM manifest WHERE sha256 IS NULL OR NOT regexp_full_match(sha256, '[0-9a-fA-F]{64}')
  UNION ALL SELECT snapshot_no, path, 'size is not given' FROM manifest WHERE size IS NULL
  UNION ALL SELECT snapshot_no, path, 'extension is not known' FROM manifest WHERE extension IS NULL OR extension NOT IN ('.md', '.txt', '.html', '.docx', '.pdf'))
SELECT CASE message WHEN 'size is not given' THEN 'size' WHEN 'extension is not known' THEN 'extension' ELSE 'sha256' END AS path, message,
  count(*) AS n_rows, count(DISTINCT (snapshot_no, path)) AS n_objects FROM bad GROUP BY 1, 2""",
    "r_missing_references": f"""WITH {_DOCS}
      SELECT case_id AS object_id, 'cases[].doc_path' AS path, 'not in the manifest: ' || coalesce(doc_path, 'null') AS message FROM one_case
        WHERE doc_path IS NULL OR doc_path NOT IN (SELECT path FROM cur)
      UNION ALL SELECT term_id::VARCHAR, 'case_terms[].case_id', 'no such case: ' || coalesce(case_id, 'null') FROM case_terms WHERE case_id IS NULL OR case_id NOT IN (SELECT case_id FROM cases)""",
    "r_duplicates": """SELECT term_id, first_value(term_id) OVER w AS first_seen FROM case_terms WHERE case_id IS NOT NULL AND term_type IS NOT NULL AND normalized IS NOT NULL
      WINDOW w AS (PARTITION BY case_id, term_type, normalized ORDER BY term_id) QUALIFY row_number() OVER w > 1""",
    "r_unverified": """SELECT service_change_id FROM (SELECT DISTINCT * FROM service_changes) WHERE knowledge_tier = 'trusted'
      AND coalesce(json_extract_string(evidence_json, '$.kind'), '') <> 'explicit'""",
    "r_unproven_mappings": """SELECT service_change_id FROM (SELECT DISTINCT * FROM service_changes) WHERE knowledge_tier = 'trusted'
      AND case_id NOT IN (SELECT case_id FROM cases WHERE validation_status = 'validated' AND confidence = 'high')""",
    "r_snapshot_status": """
SELECT 'all' AS part, CASE WHEN bool_or(path IS NULL) THEN 'stale' WHEN bool_or(commit_sha IS NULL) THEN 'unknown' ELSE 'fresh' END AS status FROM repositories
UNION ALL SELECT 'known', CASE WHEN count(*) = 0 THEN 'unknown' ELSE 'fresh' END FROM repositories WHERE path IS NOT NULL AND commit_sha IS NOT NULL""",
    "r_compiled_rows": f"""
WITH live AS (SELECT DISTINCT case_id FROM cases WHERE validation_status <> 'rejected' OR validation_status IS NULL)
SELECT case_id, term_type AS part, term FROM (
  SELECT * FROM case_terms WHERE case_id IN (SELECT case_id FROM live) AND trim(term) <> '' AND term_type IN ({', '.join(_q(t) for t in TERM_FIELDS.values())})
  QUALIFY row_number() OVER (PARTITION BY case_id, term_type, regexp_replace(lower(trim(term)), '\\s+', ' ', 'g') ORDER BY term_id) = 1)
UNION ALL SELECT case_id, 'scenario', name FROM (SELECT DISTINCT * FROM scenarios) WHERE name <> '' AND case_id IN (SELECT case_id FROM live)""",
    "r_shredded": f"""
WITH c AS (SELECT DISTINCT * FROM cases), live AS (SELECT case_id FROM c WHERE validation_status <> 'rejected' OR validation_status IS NULL)
SELECT case_id, 'cases' AS part, count(*) AS n FROM c GROUP BY 1
UNION ALL SELECT case_id, 'case_terms', count(DISTINCT (term_type, regexp_replace(lower(trim(term)), '\\s+', ' ', 'g'))) FROM case_terms WHERE trim(term) <> '' AND case_id IN (SELECT case_id FROM live)
  AND term_type IN ({', '.join(_q(t) for t in TERM_FIELDS.values())}) GROUP BY 1
UNION ALL SELECT case_id, 'scenarios', count(*) FROM (SELECT DISTINCT * FROM scenarios) WHERE name <> '' AND case_id IN (SELECT case_id FROM live) GROUP BY 1
UNION ALL SELECT case_id, 'service_changes', count(*) FROM (SELECT DISTINCT * FROM service_changes) WHERE service <> '' AND case_id IN (SELECT case_id FROM live) GROUP BY 1""",
}
