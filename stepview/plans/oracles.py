"""The registered queries in plain SQL, to check the Spark results against.

Written for DuckDB, independently of how the operators work: prefixes match by
a theta join, ranks are plain windows, natural order compares lists.
"""

from __future__ import annotations

NATURAL_KEY = """list_transform(regexp_extract_all({0}, '([0-9]+|[^0-9]+)'), lambda t: {{
  'k': CASE WHEN regexp_matches(t, '^[0-9]') THEN 0 ELSE 1 END,
  'n': CASE WHEN regexp_matches(t, '^[0-9]') THEN CAST(t AS HUGEINT) ELSE 0 END,
  's': CASE WHEN regexp_matches(t, '^[0-9]') THEN '' ELSE t END}})"""


def nat(column: str) -> str:
    return NATURAL_KEY.format(column)


RELATIONS = {
    "step_files": """
SELECT DISTINCT 'site' || (l_orderkey % 4) AS source, 'P' || l_orderkey AS participant,
       CAST(l_linenumber AS BIGINT) AS step_num, l_linenumber || '_' || lower(l_returnflag) AS step_dir
FROM lineitem""",
    "qc_files": """
SELECT DISTINCT 'site' || (l_suppkey % 4) AS source,
       'peek_' || lower(l_returnflag) || '/'
       || CASE WHEN l_orderkey % 97 = 0 THEN 'misc' ELSE 'set' || l_linenumber END || '/'
       || CASE l_partkey % 3
            WHEN 0 THEN 'P' || l_suppkey || '-badChan-scalp.png'
            WHEN 1 THEN 'P' || l_suppkey || '-chs' || CAST(l_quantity AS INT) || '-'
                   || (CAST(l_quantity AS INT) + 31) || '.png'
            ELSE 'P' || l_suppkey || '-hist' || l_linenumber || '.png' END AS rel_path
FROM lineitem""",
    "qc_raw": """
SELECT source, rel_path, string_split(rel_path, '/') AS parts, string_split(rel_path, '/')[-1] AS name
FROM qc_files""",
    "qc_people": """
SELECT 'site' || (s_suppkey % 4) AS source, 'P' || s_suppkey AS participant FROM supplier""",
    "qc_classified": f"""
SELECT q.source, p.participant, parts[1] AS root, parts[2] AS set_name, name, rel_path,
       CASE WHEN regexp_matches(name, '^[^-]+-badChan-scalp.png') THEN 'scalp'
            WHEN regexp_matches(name, '^.+-chs[0-9]+-[0-9]+.png') THEN 'chs' ELSE 'rest' END AS item_kind,
       {nat("rel_path")} AS nk
FROM qc_raw q JOIN qc_people p ON q.source = p.source AND starts_with(q.name, p.participant)
WHERE starts_with(parts[2], 'set')""",
    "qc_all": """
SELECT source, participant, root, set_name, item_kind,
       CASE item_kind WHEN 'scalp' THEN regexp_extract(name, '^([^-]+)-badChan-scalp.png', 1)
            WHEN 'chs' THEN regexp_extract(name, '^(.+)-chs([0-9]+)-([0-9]+).png', 1) END AS stem,
       CASE WHEN item_kind = 'chs'
            THEN CAST(regexp_extract(name, '^(.+)-chs([0-9]+)-([0-9]+).png', 2) AS BIGINT) END AS ch_start,
       CASE WHEN item_kind = 'chs'
            THEN CAST(regexp_extract(name, '^(.+)-chs([0-9]+)-([0-9]+).png', 3) AS BIGINT) END AS ch_end,
       name, rel_path,
       row_number() OVER (PARTITION BY source, participant ORDER BY nk, rel_path) AS nat_rank
FROM qc_classified""",
    "qc_bits": """
SELECT *, item_kind = 'rest' AS is_rest, coalesce(stem, name) AS bit FROM qc_all""",
    "qc_set_defaults": """
SELECT source, participant, root, set_name, min(nat_rank) AS first_rank,
       coalesce(arg_min(bit, nat_rank) FILTER (WHERE is_rest), arg_min(bit, nat_rank) FILTER (WHERE NOT is_rest)) AS bit
FROM qc_bits GROUP BY ALL""",
    "qc_root_defaults": """
SELECT source, participant, root, arg_min(set_name, first_rank) AS set_name, arg_min(bit, first_rank) AS bit
FROM qc_set_defaults GROUP BY ALL""",
    "log_files": """
SELECT source || '-' || doc_id || '.log' AS name,
       'logs/' || lang || '/' || source || '-' || doc_id || '.log' AS rel_path, text AS content,
       doc_id, source AS owner, 'site' || (doc_id % 4) AS site
FROM documents""",
    "caches": """
SELECT o_orderkey AS rec, o_orderdate AS base_mtime,
       min(l_shipdate) FILTER (WHERE l_linestatus = 'O') AS raw_mtime,
       min(l_shipdate) FILTER (WHERE l_linestatus = 'F') AS epo_mtime
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate""",
    "statuses": """
SELECT rec, CASE WHEN raw_mtime >= base_mtime THEN 'fresh_raw' WHEN epo_mtime >= base_mtime THEN 'fresh_epochs'
                 WHEN raw_mtime IS NOT NULL OR epo_mtime IS NOT NULL THEN 'stale' ELSE 'missing' END AS status
FROM caches""",
    "signal_long": """
SELECT user_id AS participant, CAST(floor((day(ts) - 1) / 10) AS BIGINT) + 1 AS step_num, event_type AS ch_name,
       CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS INTEGER) - 1 AS ch_idx,
       CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'data' ELSE 'misc' END AS ch_type,
       row_number() OVER (PARTITION BY user_id, CAST(floor((day(ts) - 1) / 10) AS INT), event_type
                          ORDER BY ts, event_id) - 1 AS sample_idx, value
FROM events""",
    "shown": """
SELECT * FROM signal_long WHERE sample_idx >= 5 AND sample_idx < 40""",
    "scales": """
SELECT participant, step_num, ch_type,
       CASE WHEN quantile_cont(value, 0.75) > quantile_cont(value, 0.25)
            THEN 1 / (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) ELSE 1.0 END AS scale
FROM signal_long GROUP BY ALL""",
    "decimated": """
SELECT * FROM shown WHERE (sample_idx - 5) % CASE WHEN ch_type = 'data' THEN 3 ELSE 1 END = 0""",
    "epochs_long": """
SELECT label AS participant, vec_id % 3 + 1 AS step_num,
       dense_rank() OVER (PARTITION BY label, vec_id % 3 ORDER BY vec_id) - 1 AS epoch_idx,
       CAST(floor(i / 16) AS INT) AS ch_idx, CAST(i % 16 AS INT) AS sample_idx, v AS value
FROM (SELECT label, vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings)""",
    "epochs_shown": """
SELECT * FROM epochs_long WHERE epoch_idx >= 2 AND epoch_idx < 6""",
    "pixels": """
SELECT vec_id AS image, CAST(i % 8 AS INT) AS x, CAST(floor(i / 8) AS INT) AS y,
       CASE WHEN v > 0.25 AND i > 0 THEN 1 ELSE 0 END AS v
FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings)""",
    "boxes": """
SELECT image, coalesce(min(x) FILTER (WHERE v = 1), 0) AS x0, coalesce(min(y) FILTER (WHERE v = 1), 0) AS y0,
       coalesce(max(x) FILTER (WHERE v = 1), 7) + 1 AS x1, coalesce(max(y) FILTER (WHERE v = 1), 7) + 1 AS y1
FROM pixels GROUP BY image""",
    "listing": """
SELECT 'site' || (o_custkey % 4) AS source, (o_orderkey % 7) || '_s/P' || o_custkey || '-' || o_orderkey || '.set' AS rel_path,
       o_orderkey AS key FROM orders
UNION SELECT 'site' || (l_suppkey % 4),
  CASE WHEN (l_orderkey * 8 + l_linenumber) % 2 = 0 THEN 'logs/' ELSE 'quality_control/R/set1/' END
  || 'P' || l_suppkey || '-' || l_orderkey || '.' || l_linenumber, l_orderkey * 8 + l_linenumber FROM lineitem""",
    "listing_diff": """
SELECT source, rel_path, CASE WHEN key % 103 = 0 THEN 'added' WHEN key % 101 = 0 THEN 'removed' ELSE 'modified' END AS change
FROM listing WHERE (key % 103 = 0 AND key % 101 <> 0) OR (key % 103 <> 0 AND (key % 101 = 0 OR key % 97 = 0))""",
    "listing_touched": """
SELECT source, split_part(split_part(rel_path, '/', 2), '.set', 1) AS participant FROM listing_diff WHERE rel_path LIKE '%.set'
UNION SELECT d.source, p.participant FROM listing_diff d JOIN qc_people p
  ON d.source = p.source AND starts_with(string_split(rel_path, '/')[-1], p.participant) WHERE rel_path NOT LIKE '%.set'""",
    "file_pixels": """
SELECT vec_id AS image, c, w, CAST(i // c % w AS INT) AS x, CAST(i // c // w AS INT) AS y, i % c AS ch,
       CASE WHEN i % c = c - 1 THEN CASE WHEN v > 0.25 THEN 255 ELSE 0 END
            ELSE CAST(floor(abs(CAST(v AS DOUBLE)) * 1000) AS INT) % 256 END AS byte
FROM (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 4 END AS c, CASE WHEN vec_id % 2 = 0 THEN 8 ELSE 4 END AS w,
             unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings)""",
    "file_marks": """
SELECT image, x, y, max(byte) FILTER (WHERE ch = c - 1) > 0 AS seen,
       bool_or(byte <> corner) FILTER (WHERE ch < c - 1) AS differs
FROM (SELECT *, first_value(byte) OVER (PARTITION BY image, ch ORDER BY y, x) AS corner FROM file_pixels)
GROUP BY image, x, y""",
    "file_boxes": """
SELECT image, w, coalesce(min(x) FILTER (WHERE seen), min(x) FILTER (WHERE differs), 0) AS x0,
       coalesce(min(y) FILTER (WHERE seen), min(y) FILTER (WHERE differs), 0) AS y0,
       coalesce(max(x) FILTER (WHERE seen), max(x) FILTER (WHERE differs), w - 1) + 1 AS x1,
       coalesce(max(y) FILTER (WHERE seen), max(y) FILTER (WHERE differs), 3) + 1 AS y1
FROM file_marks JOIN (SELECT DISTINCT image, w FROM file_pixels) USING (image) GROUP BY image, w""",
    "named": """
SELECT name, directory, CASE WHEN n = 1 THEN name ELSE name || '-' || n END AS unique_name
FROM (SELECT c_mktsegment AS name, '/data/' || c_nationkey AS directory,
             row_number() OVER (PARTITION BY c_mktsegment ORDER BY min(c_custkey)) AS n
      FROM customer GROUP BY c_mktsegment, c_nationkey)""",
    "names_and_people": """
SELECT DISTINCT n.name, p.participant
FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS name FROM orders) n
JOIN (SELECT DISTINCT CAST(user_id AS VARCHAR) AS participant FROM events) p ON starts_with(n.name, p.participant)""",
}

# What a relation above is built on.
USES = {
    "qc_raw": ["qc_files"],
    "qc_classified": ["qc_raw", "qc_people"],
    "qc_all": ["qc_classified"],
    "qc_bits": ["qc_all"],
    "qc_set_defaults": ["qc_bits"],
    "qc_root_defaults": ["qc_set_defaults"],
    "statuses": ["caches"],
    "shown": ["signal_long"],
    "scales": ["signal_long"],
    "decimated": ["shown"],
    "epochs_shown": ["epochs_long"],
    "boxes": ["pixels"],
}


def _sql(select: str, *relations: str) -> str:
    """``select`` with the named relations, and what they use, in front."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for used in USES.get(name, []):
            add(used)
        if name not in wanted:
            wanted.append(name)

    for relation in relations:
        add(relation)
    views = ",\n".join(f"{name} AS ({RELATIONS[name].strip()})" for name in wanted)
    return f"WITH {views}\n{select.strip()}" if views else select.strip()


def _display(y: str, extra: str = "") -> str:
    return f"SELECT participant, step_num, ch_name, sample_idx, round({y}, 6) AS y{extra} FROM shown"


def _band(half: float, ch_idx: str = "ch_idx") -> tuple[str, str]:
    """Edges of the clip band for y limits 4.2 (bottom) and -0.3 (top)."""
    lo = f"greatest({ch_idx} - CAST({half} AS DOUBLE), CAST(-0.3 AS DOUBLE))"
    return lo, f"({lo} + least(CAST({2 * half} AS DOUBLE), CAST(4.2 AS DOUBLE) - {lo}))"


def oracle_sql() -> dict[str, str]:
    lo, hi = _band(0.5)
    thin_lo, thin_hi = _band(0.2, "c.ch_idx")
    scaled = """
SELECT participant, step_num, ch_name, sample_idx, round(ch_idx - value * scale, 6) AS y
FROM shown JOIN scales USING (participant, step_num, ch_type)"""
    window = """
SELECT participant, step_num, ch_name, sample_idx, value FROM shown
WHERE ch_name IN ('click', 'purchase', 'signup', 'view')"""
    decimated = """
SELECT participant, step_num, ch_name, sample_idx, sample_idx / 1.0 + 0.0 AS t, value FROM decimated"""
    y_prev = f"greatest(least(c.ch_idx - p.value * 0.01, {thin_hi}), {thin_lo})"
    return {
        "participants": _sql(
            "SELECT source, participant, count(*) AS n_files FROM step_files GROUP BY ALL", "step_files"
        ),
        "participant_labels": _sql(
            "SELECT source, participant, participant || ' [' || count(*) || ']' AS label FROM step_files GROUP BY source, participant",
            "step_files",
        ),
        "steps": _sql("SELECT DISTINCT source, step_num, step_dir FROM step_files", "step_files"),
        "steps_for_participant": _sql(
            f"""
SELECT source, participant, step_num, step_dir,
       row_number() OVER (PARTITION BY source, participant ORDER BY step_num, {nat("step_dir")}, step_dir) AS pos
FROM step_files""",
            "step_files",
        ),
        "step_dedupe": _sql(
            f"""
SELECT source, participant, step_num, step_dir FROM step_files
QUALIFY row_number() OVER (PARTITION BY source, participant, step_num ORDER BY {nat("step_dir")} DESC, step_dir DESC) = 1""",
            "step_files",
        ),
        "has_prev": _sql(
            """
SELECT DISTINCT s.source, s.participant, s.step_num,
       EXISTS (SELECT 1 FROM step_files p WHERE p.source = s.source AND p.participant = s.participant
               AND p.step_num = s.step_num - 1) AS has_prev
FROM step_files s""",
            "step_files",
        ),
        "step_lookup": _sql(
            f"""
, dirs AS (SELECT source, participant, step_num, step_dir FROM step_files
  QUALIFY row_number() OVER (PARTITION BY source, participant, step_num ORDER BY {nat("step_dir")} DESC, step_dir DESC) = 1),
requests AS (SELECT o_orderkey AS request, 'site' || (o_orderkey % 4) AS source, 'P' || o_orderkey AS participant,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 9 END AS step,
  o_orderkey % 10 <> 0 AND o_orderkey % 13 = 0 AS blank, o_orderkey % 2 = 0 AS asked FROM orders),
answers AS (SELECT r.*, d.step_dir, p.step_dir AS prev_dir,
  p.step_dir IS NOT NULL AND d.step_dir IS NOT NULL AS hp
  FROM requests r
  LEFT JOIN dirs d ON r.source = d.source AND r.participant = d.participant AND r.step = d.step_num
  LEFT JOIN dirs p ON r.source = p.source AND r.participant = p.participant AND r.step - 1 = p.step_num),
graded AS (SELECT *, CASE WHEN blank THEN 'unselected' WHEN step IS NULL THEN 'bad_step' WHEN step_dir IS NULL THEN 'no_step'
  WHEN ends_with(step_dir, '_r') OR (hp AND asked AND ends_with(prev_dir, '_r')) THEN 'no_file' ELSE 'ok' END AS status FROM answers)
SELECT request, status, status = 'ok' AND hp AS has_prev, status = 'ok' AND hp AND asked AS overlay FROM graded""",
            "step_files",
        ).replace("\n, dirs", ",\ndirs"),
        "step_rejects": """
WITH names AS (SELECT DISTINCT 'site' || (l_orderkey % 4) AS source, l_orderkey % 5 < 4 AS is_dir,
  CASE l_orderkey % 5 WHEN 0 THEN l_linenumber || 'abc_' || lower(l_returnflag) WHEN 1 THEN '½_' || lower(l_returnflag)
    WHEN 2 THEN 'step_' || l_linenumber ELSE l_linenumber || '_' || lower(l_returnflag) END AS name FROM lineitem)
SELECT source, name, CASE WHEN NOT is_dir THEN 'not_a_directory' WHEN name[1] = '½' THEN 'not_ascii' ELSE 'not_a_number' END AS reason
FROM names WHERE name[1] = '½' OR contains(name, 'abc_') OR (NOT is_dir AND regexp_matches(name, '^[0-9]'))""",
        "overview": _sql(
            """
, people AS (SELECT source, participant FROM step_files UNION SELECT site, owner FROM log_files)
SELECT source, participant, 'step' AS section, step_dir AS item FROM step_files
UNION ALL
SELECT p.source, p.participant, 'qc', q.rel_path FROM people p JOIN qc_raw q
  ON p.source = q.source AND starts_with(q.name, p.participant)
UNION ALL
SELECT p.source, p.participant, 'log', l.rel_path FROM people p JOIN log_files l
  ON p.source = l.site AND starts_with(l.name, p.participant)""",
            "step_files",
            "qc_raw",
            "log_files",
        ).replace("\n, people", ",\npeople"),
        "natural_sort": f"""
SELECT key, row_number() OVER (ORDER BY {nat("key")}, key) AS rank
FROM (SELECT p_brand AS key FROM part UNION SELECT source FROM documents)""",
        "natural_order_items": _sql(
            f"""
SELECT source, rel_path, row_number() OVER (PARTITION BY source ORDER BY {nat("rel_path")}, rel_path) AS nat_rank
FROM qc_files""",
            "qc_files",
        ),
        "prefix_join": _sql("SELECT participant, name FROM names_and_people", "names_and_people"),
        "prefix_join_longest": _sql(
            "SELECT arg_max(participant, length(participant)) AS participant, name FROM names_and_people GROUP BY name",
            "names_and_people",
        ),
        "logs_for_participant": _sql(
            """
SELECT p.participant, l.rel_path FROM (SELECT DISTINCT source AS participant FROM documents) p
JOIN log_files l ON starts_with(l.name, p.participant)""",
            "log_files",
        ),
        "log_content": _sql(
            """
, asked AS (SELECT CASE WHEN doc_id % 5 = 1 THEN owner || 'x' ELSE owner END AS participant,
  CASE WHEN doc_id % 5 = 0 THEN 'logs/missing-' || doc_id || '.log' ELSE rel_path END AS rel_path FROM log_files)
SELECT a.participant, a.rel_path, md5(l.content) AS content_md5 FROM asked a JOIN log_files l USING (rel_path)
WHERE starts_with(l.name, a.participant) AND a.participant IN (SELECT source FROM documents)""",
            "log_files",
        ).replace("\n, asked", ",\nasked"),
        "content_base64": _sql("SELECT rel_path, to_base64(encode(content)) AS encoded FROM log_files", "log_files"),
        "qc_items": _sql("SELECT * FROM qc_all", "qc_all"),
        "qc_tree": _sql(
            """
SELECT source, participant, root, set_name, is_rest, bit AS stem, item_kind, row_number() OVER (PARTITION BY source, participant,
  root, set_name, bit ORDER BY ch_start, ch_end, name, rel_path) AS pos, rel_path, ch_start, ch_end
FROM qc_bits WHERE item_kind = 'chs'
UNION ALL SELECT source, participant, root, set_name, is_rest, bit, item_kind, 1, arg_max(rel_path, nat_rank), NULL, NULL
FROM qc_bits WHERE item_kind <> 'chs' GROUP BY source, participant, root, set_name, is_rest, bit, item_kind""",
            "qc_bits",
        ),
        "qc_rejects": _sql(
            """
SELECT source, 'outside_set' AS reason, count(*) AS n FROM qc_raw WHERE NOT starts_with(parts[2], 'set') GROUP BY source""",
            "qc_raw",
        ),
        "qc_defaults": _sql("SELECT source, participant, root, set_name, bit FROM qc_root_defaults", "qc_root_defaults"),
        "qc_lookup": _sql(
            """
, asked AS (SELECT o_orderkey AS request, 'site' || (o_custkey % 100 % 4) AS source, 'P' || (o_custkey % 100) AS participant,
  CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'peek_x'
    ELSE 'peek_' || ['a', 'n', 'r'][o_orderkey % 3 + 1] END AS root,
  CASE WHEN o_orderkey % 4 > 0 THEN 'set' || (o_orderkey % 9) END AS set_name,
  CASE o_orderkey % 5 WHEN 1 THEN 'P' || (o_custkey % 100) WHEN 2 THEN 'P' || (o_custkey % 100) || '-hist' || (o_orderkey % 9) || '.png'
    WHEN 3 THEN 'P' || (o_custkey % 100) || '-none.png' END AS bit FROM orders),
filled AS (SELECT a.request, a.source, a.participant, a.root, coalesce(a.set_name, d.set_name) AS set_name, a.bit,
  a.set_name IS NOT NULL AND a.bit IS NOT NULL AS given
  FROM asked a LEFT JOIN qc_root_defaults d USING (source, participant, root)),
chosen AS (SELECT f.request, f.source, f.participant, f.root, f.set_name, coalesce(f.bit, d.bit) AS bit, given
  FROM filled f LEFT JOIN qc_set_defaults d USING (source, participant, root, set_name)),
images AS (SELECT source, participant, root, set_name, bit, 'eeg' AS kind, rel_path FROM qc_bits WHERE item_kind = 'chs'
  UNION ALL SELECT source, participant, root, set_name, bit, 'eeg', arg_max(rel_path, nat_rank) FROM qc_bits
    WHERE item_kind = 'scalp' GROUP BY source, participant, root, set_name, bit
  UNION ALL SELECT source, participant, root, set_name, bit, 'image', arg_max(rel_path, nat_rank) FROM qc_bits
    WHERE item_kind = 'rest' GROUP BY source, participant, root, set_name, bit)
SELECT c.request, CASE WHEN c.root = '' THEN 'unselected' WHEN i.kind IS NOT NULL THEN i.kind
       WHEN given THEN 'not_found' ELSE 'empty' END AS status, i.rel_path
FROM chosen c LEFT JOIN images i USING (source, participant, root, set_name, bit)""",
            "qc_root_defaults",
        ).replace("\n, asked", ",\nasked"),
        "freshness": _sql("SELECT rec, status FROM statuses", "statuses"),
        "freshness_readable": _sql(
            """
, known AS (SELECT *, coalesce(raw_mtime >= base_mtime, FALSE) AS raw, coalesce(epo_mtime >= base_mtime, FALSE) AS epo,
  rec % 4 = 0 OR rec % 3 > 0 AS raw_good, rec % 5 > 0 AS epo_good FROM caches)
SELECT rec, CASE WHEN raw AND raw_good THEN 'fresh_raw' WHEN epo AND epo_good THEN 'fresh_epochs' WHEN raw OR epo THEN 'unreadable'
                 WHEN raw_mtime IS NOT NULL OR epo_mtime IS NOT NULL THEN 'stale' ELSE 'missing' END AS status FROM known""",
            "caches",
        ).replace("\n, known", ",\nknown"),
        "freshness_of_files": _sql(
            """
SELECT 'site' || (rec % 4) AS source, '1_load' AS step_dir, 'P' || rec AS participant, status FROM statuses""",
            "statuses",
        ),
        "conversion_plan": _sql(
            "SELECT rec, CASE WHEN starts_with(status, 'fresh') THEN 'Already cached' ELSE 'Caching' END AS status FROM statuses",
            "statuses",
        ),
        "pending_recordings": """
SELECT o_orderkey AS rec FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= o_orderdate)""",
        "signal_window": _sql(window, "shown"),
        "signal_window_blocks": _sql(window, "shown"),
        "signal_scales": _sql("SELECT participant, step_num, ch_type, round(scale, 6) AS scale FROM scales", "scales"),
        "signal_scaled": _sql(scaled, "shown", "scales"),
        "signal_overdraw": _sql(_display("ch_idx - value"), "shown"),
        "signal_clamped": _sql(
            _display(f"greatest(least(ch_idx - value, {hi}), {lo})", f", round({lo}, 6) AS lo, round({hi}, 6) AS hi"), "shown"
        ),
        "signal_decimated": _sql(decimated, "decimated"),
        "signal_decimated_blocks": _sql(decimated, "decimated"),
        "decimation_factors": """
SELECT DISTINCT user_id AS participant, CAST(CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 3 ELSE 1 END AS BIGINT) AS decim
FROM events""",
        "signal_extent": _sql(
            """
SELECT participant, step_num, min(sample_idx) / 1.0 AS t_first, max(sample_idx) / 1.0 AS t_last
FROM shown GROUP BY participant, step_num""",
            "shown",
        ),
        "overlay": _sql(
            """
SELECT c.participant, c.step_num, c.ch_name, c.sample_idx, c.value, p.value AS prev_value
FROM shown c LEFT JOIN shown p ON c.participant = p.participant AND c.step_num = p.step_num + 1
  AND c.ch_name = p.ch_name AND c.sample_idx = p.sample_idx""",
            "shown",
        ),
        "overlay_blocks": _sql(
            """
, blocks AS (SELECT participant, step_num, ch_name, sample_idx // 16 * 16 AS start_sample, count(*) AS n, max(value) AS highest,
  participant % 2 = 0 AND step_num = 3 AS epoched FROM signal_long GROUP BY ALL)
SELECT c.participant, c.step_num, c.ch_name, c.start_sample, c.n, c.highest,
       CASE WHEN c.epoched = p.epoched THEN p.highest END AS prev_highest,
       CASE WHEN p.epoched IS NULL THEN 'no_previous' WHEN c.epoched = p.epoched THEN 'overlaid' ELSE 'kind_mismatch' END AS status
FROM blocks c LEFT JOIN blocks p ON c.participant = p.participant AND c.step_num = p.step_num + 1
  AND c.ch_name = p.ch_name AND c.start_sample = p.start_sample""",
            "signal_long",
        ).replace("\n, blocks", ",\nblocks"),
        "overlay_overlapping": _sql(
            """
SELECT c.participant, c.step_num, c.ch_name, c.sample_idx, c.value, p.value AS prev_value
FROM signal_long c LEFT JOIN signal_long p ON c.participant = p.participant AND c.step_num = p.step_num + 1
  AND c.ch_name = p.ch_name AND c.sample_idx = p.sample_idx""",
            "signal_long",
        ),
        "stored_view": _sql(
            """
, own AS (SELECT step_num, ch_idx, ch_name, ch_type, sample_idx, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value
  FROM signal_long WHERE participant = 7),
own_scales AS (SELECT ch_type, CASE WHEN quantile_cont(value, 0.75) > quantile_cont(value, 0.25)
  THEN 1 / (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) ELSE 1.0 END AS scale FROM own WHERE step_num = 2 GROUP BY ch_type)
SELECT c.ch_idx, c.ch_name, c.sample_idx, c.sample_idx / 1.0 AS t, c.ch_idx - c.value * scale AS y, c.ch_idx - p.value * scale AS prev_y
FROM own c JOIN own_scales USING (ch_type)
LEFT JOIN own p ON p.step_num = 1 AND c.ch_name = p.ch_name AND c.sample_idx = p.sample_idx
WHERE c.step_num = 2 AND c.sample_idx >= 5 AND c.sample_idx < 40 AND (c.sample_idx - 5) % CASE WHEN c.ch_type = 'data' THEN 3 ELSE 1 END = 0""",
            "signal_long",
        ).replace("\n, own", ",\nown"),
        "overlay_trace": _sql(
            f"""
SELECT c.participant, c.step_num, c.ch_name, c.sample_idx, p.value IS NULL AS missing,
       CASE WHEN p.value IS NOT NULL THEN round({y_prev}, 6) END AS y
FROM decimated c LEFT JOIN shown p ON c.participant = p.participant AND c.step_num = p.step_num + 1
  AND c.ch_name = p.ch_name AND c.sample_idx = p.sample_idx""",
            "decimated",
        ),
        "epoch_window": _sql(
            "SELECT participant, step_num, epoch_idx, ch_idx, sample_idx, value FROM epochs_shown", "epochs_shown"
        ),
        "overlay_epochs": _sql(
            """
SELECT c.participant, c.step_num, c.epoch_idx, c.ch_idx, c.sample_idx, c.value, p.value AS prev_value
FROM epochs_shown c LEFT JOIN epochs_shown p ON c.participant = p.participant AND c.step_num = p.step_num + 1
  AND c.epoch_idx = p.epoch_idx AND c.ch_idx = p.ch_idx AND c.sample_idx = p.sample_idx""",
            "epochs_shown",
        ),
        "epochs_concatenated": _sql(
            """
SELECT participant, step_num, ch_idx, (epoch_idx - 2) * 16 + sample_idx AS sample_idx, value FROM epochs_shown""",
            "epochs_shown",
        ),
        "epoch_traces": _sql(
            """
SELECT participant, step_num, ch_idx, count(*) AS n, arg_max(value, epoch_idx * 16 + sample_idx) AS last_value
FROM epochs_shown GROUP BY participant, step_num, ch_idx""",
            "epochs_shown",
        ),
        "image_bbox": _sql("SELECT * FROM boxes", "boxes"),
        "image_trim": _sql("SELECT *, x1 - x0 AS width, y1 - y0 AS height FROM boxes", "boxes"),
        "listing_changes": _sql(
            """
SELECT source, split_part(rel_path, '/', 1) AS top, change, count(*) AS n, any_value(n_touched) AS n_touched
FROM listing_diff LEFT JOIN (SELECT source, count(*) AS n_touched FROM listing_touched GROUP BY source) USING (source)
GROUP BY source, top, change""",
            "qc_people", "listing", "listing_diff", "listing_touched",
        ),
        "image_decode": _sql(
            """
SELECT image, 'ok' AS status, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1,
       CAST(x1 - x0 AS INT) AS width, CAST(y1 - y0 AS INT) AS height, CAST(c AS INT) AS n_channels,
       string_agg(printf('%02x', byte), '' ORDER BY y, x, CASE WHEN c = 4 AND ch < 3 THEN 2 - ch ELSE ch END) AS pixels
FROM file_pixels JOIN file_boxes b USING (image) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1
GROUP BY image, x0, y0, x1, y1, c""",
            "file_pixels", "file_marks", "file_boxes",
        ),
        "qc_nested": _sql(
            """
SELECT source, participant, root, set_name, is_rest, bit,
  arg_max(name, nat_rank) FILTER (WHERE item_kind <> 'chs') AS name,
  to_base64(encode(arg_max(rel_path, nat_rank) FILTER (WHERE item_kind <> 'chs'))) AS shown,
  coalesce(string_agg(ch_start || ':' || ch_end || ':' || to_base64(encode(rel_path)), ' ' ORDER BY ch_start, ch_end, name, rel_path)
    FILTER (WHERE item_kind = 'chs'), '') AS ranges
FROM qc_bits GROUP BY source, participant, root, set_name, is_rest, bit""",
            "qc_raw", "qc_people", "qc_classified", "qc_all", "qc_bits",
        ),
        "unique_names": _sql("SELECT name, directory, unique_name FROM named", "named"),
        "registry_lookup": _sql(
            """
, asked AS (SELECT o_orderkey AS request,
  CASE WHEN o_custkey % 30 < 2 THEN 'BUILDING' ELSE 'BUILDING-' || (o_custkey % 30) END AS source FROM orders)
SELECT request, source, directory, directory IS NOT NULL AS known FROM asked
LEFT JOIN named ON source = unique_name AND unique_name <> 'BUILDING-2'""",
            "named",
        ).replace("\n, asked", ",\nasked"),
    }
