"""DuckDB SQL giving the result of each query from the same tables."""

from gapweave.operators.keyed import ID_LETTERS
from gapweave.plans.improve import PROMPT_PARTS
from gapweave.schemas import PENALTIES, PROVIDER_TIERS
from workload import tables as t


def _with(*parts: tuple[str, str]) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({body})" for name, body in parts) + " "


# --- catalogue ---------------------------------------------------------------

RAW = (
    "raw",
    "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in t.RAW_COURSE.items())
    + " FROM part LEFT JOIN documents ON p_partkey = doc_id",
)


def _amount(unit):
    low = f"TRY_CAST(regexp_extract(duration, '([0-9]+)-?([0-9]+)?\\s*{unit}', 1) AS DOUBLE)"
    high = f"TRY_CAST(regexp_extract(duration, '([0-9]+)-?([0-9]+)?\\s*{unit}', 2) AS DOUBLE)"
    return f"coalesce(floor(({low} + coalesce({high}, {low})) / 2), 0)"


HOURS = (
    f"CASE WHEN contains(duration, 'On-Demand') THEN 0e0 ELSE {_amount('week')} * 168e0 + {_amount('day')} * 24e0"
    f" + {_amount('hour')} + {_amount('minute')} / 60e0 END"
)
COURSES = (
    "courses",
    "SELECT course_id AS _id, course_name AS name, description, duration, cost AS pricing, course_level AS level, "
    "course_provider AS provider, course_num_rating AS num_rating, "
    "CASE WHEN NOT isnan(course_avg_rating) THEN course_avg_rating END AS avg_rating, rating, language, "
    "course_certificate AS certificate, course_subject AS subject, course_type AS type, "
    f"{HOURS} AS duration_hrs FROM raw",
)
CATALOG = _with(RAW, COURSES)
TIER = (
    "CASE provider "
    + " ".join(f"WHEN '{n}' THEN {tier}" for tier, names in PROVIDER_TIERS.items() for n in names)
    + " ELSE 0 END"
)
QUALITY = f"(({TIER}) / 4e0)"
PREFERRED = "duration_hrs BETWEEN 1 AND 40 AND avg_rating >= 4 AND lower(language) = 'english'"

# --- similarity ----------------------------------------------------------------

SKILLS = (
    "skills",
    "SELECT label AS skill_pos, 'skill_' || label AS skill, list(mean ORDER BY pos) AS vector FROM ("
    "SELECT label, pos, avg(CAST(value AS DOUBLE)) AS mean FROM ("
    "SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS value FROM embeddings"
    ") GROUP BY label, pos) GROUP BY label",
)
COSINES = (
    "cosines",
    "SELECT skill_pos, skill, vec_id AS _id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), vector) AS cos "
    "FROM embeddings, skills",
)
HITS = (
    "hits",
    "SELECT * FROM (SELECT skill, _id, score, CAST(row_number() OVER (PARTITION BY skill ORDER BY score DESC, _id) AS INT)"
    " AS rank FROM (SELECT skill, _id, round((1 + cos) / 2, 6) AS score FROM cosines)) WHERE rank <= 50",
)
REQUESTS = (
    "requests",
    "SELECT source AS request_id, min(vec_id) AS skill_pos, 'skill_' || label AS skill "
    "FROM embeddings JOIN documents ON vec_id = doc_id GROUP BY source, label",
)
UNION = (
    "found",
    "SELECT request_id, _id, min(skill_pos) AS skill_pos, arg_min(score, skill_pos) AS score "
    "FROM requests JOIN hits USING (skill) GROUP BY request_id, _id",
)
RECOMMENDED = (
    "recommended",
    f"SELECT request_id, _id, name, description, level, skill_pos, score, {QUALITY} AS quality_score, "
    f"0.5e0 * score AS weighted_score FROM found JOIN courses USING (_id) WHERE {PREFERRED} AND score > 0.5",
)
SEARCH = _with(RAW, COURSES, SKILLS, COSINES, HITS, REQUESTS, UNION, RECOMMENDED)
MATRIX = _with(SKILLS, COSINES)
TEN = ", ".join(f"max(round(cos, 6)) FILTER (skill_pos = {i}) AS %s{i}" for i in range(10))
NARROW = SEARCH.replace(
    "FROM embeddings, skills", f"FROM embeddings, skills WHERE vec_id IN (SELECT _id FROM courses WHERE {PREFERRED})"
)

# --- gap matrices ----------------------------------------------------------------


def _cells(name, headers, pick):
    """Weighted cells (request_id, row_no, skill, col_no, evidence, raw, score)."""
    kinds = ", ".join(f"({i}, '{kind}', '{header}')" for i, (kind, header) in enumerate(headers.items(), 1))
    weight = "CASE " + " ".join(f"WHEN contains(lower(evidence), '{k}') THEN {w}e0" for k, w in PENALTIES) + " ELSE 1e0 END"
    return (
        (
            f"{name}_rows",
            "SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS INT) AS row_no FROM ("
            "SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)",
        ),
        (
            f"{name}_values",
            f"SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type, "
            f"floor({pick}(value)) AS raw FROM events GROUP BY ALL",
        ),
        (
            name,
            f"SELECT 'src' || r.user_id AS request_id, row_no, 'Skill ' || r.k AS skill, col_no, evidence, raw, "
            f"raw * {weight} AS score FROM {name}_rows r "
            f"CROSS JOIN (VALUES {kinds}) AS kinds(col_no, kind, evidence) "
            f"LEFT JOIN {name}_values v ON v.user_id = r.user_id AND v.k = r.k AND v.event_type = kinds.kind",
        ),
        (
            f"{name}_scores",
            f"SELECT request_id, row_no, skill, coalesce(sum(score), 0) / (count(*) FILTER (score > 0) + 1) AS gap_score "
            f"FROM {name} GROUP BY ALL",
        ),
    )


INITIAL = _cells("initial", t.INITIAL_HEADERS, "max")
IMPROVED = _cells("improved", t.IMPROVED_HEADERS, "min")
GAINS = (
    "gains",
    "SELECT request_id, trim(replace(evidence, '(Certificate)', '')) AS evidence, round(coalesce(sum(score), 0), 6) AS gain "
    "FROM improved WHERE NOT starts_with(evidence, 'Project Name') GROUP BY ALL",
)

# --- records ---------------------------------------------------------------------

JOBS = (
    "jobs",
    f"SELECT o_orderkey AS doc_id, o_custkey, raw, TRY_CAST(CASE WHEN fenced <> '' THEN fenced ELSE raw END AS JSON) AS j "
    f"FROM (SELECT *, regexp_extract(raw, '(?s)```(?:json)?\\s*(.*?)```', 1) AS fenced FROM "
    f"(SELECT *, {t.JOB_RAW} AS raw FROM orders))",
)
JOB_CHECKS = (
    "checked",
    "SELECT *, CASE WHEN j IS NULL THEN 'not json' ELSE concat_ws(',', "
    "CASE WHEN NOT json_exists(j, '$.job_title') THEN 'job_title' END, "
    "CASE WHEN json_extract_string(j, '$.employment_type') NOT IN "
    "('full-time', 'part-time', 'contract', 'internship', 'temporary') THEN 'employment_type' END) END AS errors, "
    "coalesce(list_transform(CAST(json_extract(j, '$.must_have_skills') AS JSON[]), "
    "lambda x: coalesce(json_extract_string(x, '$.skill'), json_extract_string(x, '$'))), []) AS skills FROM jobs",
)
JOB = _with(JOBS, JOB_CHECKS)
RESUMES = (
    "resumes",
    f"SELECT c_custkey, c_name, c_nationkey, lower(c_mktsegment) AS segment, {t.RESUME_YEAR} AS year, "
    "'title: ' || c_name || ', description: in ' || lower(c_mktsegment) || ', type: no-mention; "
    "title: Side, description: None, type: personal' AS projects, "
    "'name: Cert ' || c_nationkey || ', organization: None' AS certifications, "
    f"'title: On sales, journal: J, year: ' || {t.RESUME_YEAR} AS publications, "
    "'title: Prize, related_skills: [''sql'', ''python'']' AS academic_awards FROM customer",
)


def _prompt() -> str:
    values = {
        "role": "json_extract_string(j, '$.job_title')",
        "must_have_skills": "array_to_string(skills, ', ')",
        "projects": "projects",
        "certifications": "certifications",
        "publications": "publications",
        "awards": "academic_awards",
    }
    text = "'" + "".join(PROMPT_PARTS).replace("'", "''") + "'"
    for name, sql in values.items():
        text = f"replace({text}, '{{{name}}}', {sql})"
    return text


# --- keyed tables ----------------------------------------------------------------

DOCS = "SELECT doc_id AS _id, lang, source, n_chars FROM documents"
LAST_ORDER = (
    "SELECT o_custkey AS _id, arg_max(o_orderstatus, o_orderkey) AS status, arg_min(o_orderstatus, o_orderkey) AS first_status "
    "FROM orders GROUP BY 1"
)
GENERATED = " || ".join(
    f"substr('{ID_LETTERS}', CAST(CAST('0x' || substr(h, {4 * i + 1}, 4) AS INT) % {len(ID_LETTERS)} + 1 AS INT), 1)"
    for i in range(10)
)

# --- clustering --------------------------------------------------------------------

NEAR = (
    "near",
    "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE round(1 - list_cosine_similarity("
    "CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) <= 0.6",
)

ITEMS = (
    "items",
    "SELECT request_id, 'courses' AS section, CAST(_id AS VARCHAR) AS item, row_number() OVER "
    "(PARTITION BY request_id ORDER BY weighted_score DESC, _id) AS rank FROM recommended "
    "UNION ALL SELECT request_id, 'gains', evidence, row_number() OVER (PARTITION BY request_id ORDER BY gain DESC, evidence) "
    "FROM gains UNION ALL SELECT request_id, 'initial', skill, row_number() OVER "
    "(PARTITION BY request_id ORDER BY round(gap_score, 6), row_no) FROM initial_scores "
    "UNION ALL SELECT request_id, 'improved', skill, row_number() OVER "
    "(PARTITION BY request_id ORDER BY round(gap_score, 6), row_no) FROM improved_scores "
    "UNION ALL SELECT request_id, 'cells', '', row_number() OVER (PARTITION BY request_id ORDER BY row_no, col_no) FROM initial",
)
RECORDS = (
    "records",
    "SELECT request_id, CAST((rank - 1) // 1000 AS BIGINT) AS part, "
    + ", ".join(
        f"coalesce(string_agg(item, '|' ORDER BY rank) FILTER (section = '{s}'), '') AS {s}" for s in ("courses", "gains", "initial", "improved")
    )
    + ", CAST(count(*) FILTER (section = 'cells') AS INT) AS n_cells FROM items GROUP BY 1, 2",
)
PARSED_JD = (
    "'{\"job_title\":' || json_extract(j, '$.job_title') || ',\"employment_type\":' || "
    "json_extract(j, '$.employment_type') || ',\"key_responsibilities\":[],\"qualifications\":[],\"education_requirements\":"
    "[{\"degree\":\"BSc\",\"field_of_study\":null}],\"must_have_skills\":[\"' || array_to_string(skills, '\",\"') || "
    "'\"],\"bonus_skills\":[]}'"
)
PARSED_RESUME = (
    "'{\"skills\":[\"sql\",\"' || segment || '\"],\"certifications\":[{\"name\":\"Cert ' || c_nationkey || '\",\"organization\":null}],"
    "\"projects\":[{\"title\":\"' || c_name || '\",\"description\":\"in ' || segment || '\",\"type\":\"no-mention\"},"
    "{\"title\":\"Side\",\"description\":null,\"type\":\"personal\"}],\"publications\":[{\"title\":\"On sales\",\"journal\":\"J\",\"year\":' "
    "|| year || '}],\"academic_awards\":[{\"title\":\"Prize\",\"related_skills\":[\"sql\",\"python\"]}]}'"
)

ORACLE = {
    "catalog_load": CATALOG + "SELECT * FROM courses WHERE language = 'English'",
    "duration_hours": CATALOG + "SELECT _id AS course_id, duration, duration_hrs FROM courses",
    "encode_text": CATALOG
    + "SELECT _id, coalesce(name, 'nan') || chr(9) || coalesce(description, 'nan') AS text FROM courses",
    "distinct_providers": CATALOG + "SELECT DISTINCT provider FROM courses",
    "table_profile": CATALOG
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{kind}' AS type, count({c}) AS non_null, count(*) AS rows FROM courses"
        for i, (c, kind) in enumerate(
            [("_id", "bigint")]
            + [(c, "string") for c in ("name", "description", "duration", "pricing", "level", "provider")]
            + [("num_rating", "bigint"), ("avg_rating", "double")]
            + [(c, "string") for c in ("rating", "language", "certificate", "subject", "type")]
            + [("duration_hrs", "double")]
        )
    ),
    "drop_all_null": CATALOG
    + "SELECT language, num_rating, rating FROM courses WHERE coalesce(language, CAST(num_rating AS VARCHAR), rating) IS NOT NULL",
    "pref_filter": CATALOG + f"SELECT _id, duration_hrs, avg_rating, language FROM courses WHERE {PREFERRED}",
    "quality_score": CATALOG + f"SELECT _id, provider, {QUALITY} AS quality_score FROM courses",
    "weighted_score": CATALOG
    + "SELECT _id, round(0.5e0 * avg_rating / 5, 6) AS weighted_score, round(0.5e0 * avg_rating / 5 + 0.3e0 * avg_rating "
    f"+ 0.2e0 / (duration_hrs + 1) + 0.2e0 * {QUALITY}, 6) AS weighted_score_all FROM courses",
    "doc_ingest": "SELECT doc_id, source AS kind, CASE WHEN trim(text) <> '' THEN text END AS text, "
    "CAST(length(CASE WHEN trim(text) <> '' THEN text END) AS INT) AS n_chars FROM documents",
    "clean_text": "SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM documents",
    "similarity_matrix": MATRIX + "SELECT _id, 0 AS tile, " + TEN.replace("%s", "s") + " FROM cosines GROUP BY _id",
    "similarity_wide": MATRIX + "SELECT _id, " + TEN.replace("%s", "skill_") + " FROM cosines GROUP BY _id",
    "knn_topk": SEARCH
    + "SELECT * FROM hits JOIN courses USING (_id)",
    "knn_floors": MATRIX[:-1] + ", " + HITS[0] + " AS (" + HITS[1] + ") SELECT * FROM hits",
    "knn_quantized_check": "SELECT 'skill_' || label AS skill, least(50, (SELECT count(*) FROM embeddings)) AS hits, 0 AS wrong, "
    "true AS recalled, true AS ranked FROM embeddings GROUP BY label",
    "skill_topn": MATRIX
    + "SELECT * FROM (SELECT skill, _id, score, CAST(row_number() OVER (PARTITION BY skill ORDER BY score DESC, _id) AS INT) "
    "AS rank FROM (SELECT skill, _id, round(cos, 6) AS score FROM cosines)) WHERE rank <= 5",
    "skill_threshold": SEARCH
    + "SELECT _id, skill, round(cos, 6) AS similarity, name, duration_hrs FROM cosines JOIN courses USING (_id) "
    "WHERE round(cos, 6) > 0.1 AND duration_hrs > 1 AND duration_hrs < 14400",
    "knn_union": SEARCH + "SELECT * FROM found",
    "knn_union_max": SEARCH
    + "SELECT request_id, _id, min(skill_pos) AS skill_pos, max(score) AS score "
    "FROM requests JOIN hits USING (skill) GROUP BY request_id, _id",
    "recommend_all": SEARCH + "SELECT * EXCLUDE (description, level) FROM recommended",
    "recommend_per_request": SEARCH
    + "SELECT request_id, _id, score, 0.5e0 * score AS weighted_score FROM found JOIN courses USING (_id) JOIN "
    "(SELECT source AS request_id, CASE WHEN min(doc_id) % 2 = 0 THEN 3.5e0 ELSE 4e0 END AS min_rating, "
    "min(doc_id) % 40 + 10 AS max_duration FROM documents GROUP BY 1) USING (request_id) "
    "WHERE score > 0.5 AND duration_hrs BETWEEN 1 AND max_duration AND avg_rating >= min_rating AND lower(language) = 'english'",
    "recommend_prefilter": NARROW + "SELECT request_id, _id, score, weighted_score FROM recommended",
    "recommend_topn": SEARCH
    + "SELECT * FROM (SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY weighted_score DESC, _id) "
    "AS INT) AS rank, _id, weighted_score FROM recommended) WHERE rank <= 5",
    "cert_records": SEARCH
    + "SELECT request_id, _id, 'name: ' || name || ', description: ' || coalesce(description, 'None') || ', level: ' || level "
    "AS text FROM recommended",
    "markdown_table": _with(*INITIAL) + "SELECT request_id, row_no, skill, col_no, evidence, raw AS score FROM initial",
    "penalize": _with(*INITIAL) + "SELECT request_id, row_no, col_no, evidence, round(score, 6) AS score FROM initial",
    "gap_score": _with(*INITIAL)
    + "SELECT request_id, row_no, skill, round(gap_score, 6) AS gap_score FROM initial_scores",
    "course_gain": _with(*IMPROVED, GAINS) + "SELECT request_id, evidence, gain FROM gains",
    "gap_improvement": _with(*INITIAL, *IMPROVED)
    + "SELECT request_id, skill, round(a.gap_score, 6) AS initial, round(b.gap_score, 6) AS improved, "
    "round(b.gap_score - a.gap_score, 6) + 0e0 AS delta FROM initial_scores a FULL JOIN improved_scores b USING (request_id, skill)",
    "skills_normalize": JOB
    + "SELECT doc_id, CAST(len(skills) AS INT) AS n_skills, array_to_string(skills, '|') AS skills FROM checked",
    "record_parse": JOB
    + "SELECT doc_id, json_extract_string(j, '$.job_title') AS job_title, "
    "json_extract_string(j, '$.employment_type') AS employment_type, array_to_string(skills, '|') AS must_have_skills, "
    "CAST(json_array_length(j, '$.education_requirements') AS INT) AS n_education, 0 AS n_bonus FROM checked WHERE errors = ''",
    "record_quarantine": JOB + "SELECT doc_id, raw, errors FROM checked WHERE errors <> ''",
    "resume_parse": _with(RESUMES)
    + "SELECT c_custkey AS doc_id, CASE WHEN ok THEN '' ELSE 'publications' END AS errors, "
    "CASE WHEN ok THEN CAST(year AS INT) END AS year, CASE WHEN ok THEN 'no-mention' END AS project_type "
    "FROM (SELECT *, year BETWEEN 1900 AND 2100 AS ok FROM resumes)",
    "record_text": _with(RESUMES)
    + "SELECT c_custkey AS doc_id, projects, certifications, publications, academic_awards FROM resumes "
    "WHERE year BETWEEN 1900 AND 2100",
    "record_json": JOB
    + "SELECT doc_id, '{\"job_title\":' || json_extract(j, '$.job_title') || ',\"employment_type\":' || "
    "json_extract(j, '$.employment_type') || ',\"key_responsibilities\":[],\"qualifications\":[],\"education_requirements\":"
    "[{\"degree\":\"BSc\",\"field_of_study\":null}],\"must_have_skills\":[\"' || array_to_string(skills, '\",\"') || "
    "'\"],\"bonus_skills\":[]}' AS parsed_jd FROM checked WHERE errors = ''",
    "job_skills": JOB
    + "SELECT doc_id AS request_id, CAST(unnest(range(len(skills))) AS INT) AS skill_pos, unnest(skills) AS skill "
    "FROM checked WHERE errors = ''",
    "prompt_render": _with(JOBS, JOB_CHECKS, RESUMES)
    + f"SELECT doc_id AS request_id, {_prompt()} AS prompt FROM checked JOIN resumes ON o_custkey = c_custkey "
    "WHERE errors = '' AND year BETWEEN 1900 AND 2100",
    "store_get": f"SELECT * FROM ({DOCS}) WHERE _id IN (SELECT doc_id FROM labels)",
    "store_find": f"SELECT * FROM ({DOCS}) WHERE lang = 'en'",
    "store_insert_absent": "SELECT doc_id AS _id, 'labelled' AS status, NULL AS timestamp, NULL AS datetime FROM labels "
    "UNION ALL SELECT _id, first_status, '1717243200', '2024-06-01 12:00:00.000000' "
    f"FROM ({LAST_ORDER}) WHERE _id NOT IN (SELECT doc_id FROM labels)",
    "store_insert_gen_id": f"SELECT {GENERATED} AS _id, lang, source, n_chars, key FROM "
    f"(SELECT *, _id AS key, sha256('run-1/' || _id) AS h FROM ({DOCS}))",
    "store_update": f"SELECT _id, coalesce(status, lang) AS lang, source, n_chars, "
    "CASE WHEN status IS NOT NULL THEN '1717243200' END AS last_modified, status IS NOT NULL AND status <> lang AS changed "
    f"FROM ({DOCS}) LEFT JOIN ({LAST_ORDER}) USING (_id)",
    "store_update_not_found": "SELECT DISTINCT o_custkey AS _id FROM orders WHERE o_custkey NOT IN (SELECT doc_id FROM documents)",
    "store_upsert": "SELECT coalesce(doc_id, vec_id) AS _id, CASE WHEN vec_id IS NOT NULL THEN label ELSE quality END AS quality, "
    "toxic, CAST(len(embedding) AS INT) AS vector_size FROM labels FULL JOIN embeddings ON doc_id = vec_id",
    "store_delete": f"SELECT * FROM ({DOCS}) WHERE _id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "store_deleted_ids": "SELECT doc_id AS _id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "interaction_record": _with(
        RAW, COURSES, SKILLS, COSINES, HITS, REQUESTS, UNION, RECOMMENDED, *INITIAL, *IMPROVED, GAINS,
        ("items", "SELECT request_id, 'courses' AS section, CAST(_id AS VARCHAR) AS item, row_number() OVER "
         "(PARTITION BY request_id ORDER BY weighted_score DESC, _id) AS rank FROM recommended "
         "UNION ALL SELECT request_id, 'gains', evidence, row_number() OVER (PARTITION BY request_id ORDER BY gain DESC, evidence) "
         "FROM gains UNION ALL SELECT request_id, 'initial', skill, row_number() OVER "
         "(PARTITION BY request_id ORDER BY round(gap_score, 6), row_no) FROM initial_scores "
         "UNION ALL SELECT request_id, 'improved', skill, row_number() OVER "
         "(PARTITION BY request_id ORDER BY round(gap_score, 6), row_no) FROM improved_scores "
         "UNION ALL SELECT request_id, 'cells', '', row_number() OVER (PARTITION BY request_id ORDER BY row_no, col_no) FROM initial"),
    )
    + "SELECT request_id, CAST((rank - 1) // 1000 AS BIGINT) AS part, "
    + ", ".join(
        f"coalesce(string_agg(item, '|' ORDER BY rank) FILTER (section = '{s}'), '') AS {s}" for s in ("courses", "gains", "initial", "improved")
    )
    + ", CAST(count(*) FILTER (section = 'cells') AS INT) AS n_cells FROM items GROUP BY 1, 2",
    "improvement_run": _with(
        RAW, COURSES, SKILLS, COSINES, HITS, REQUESTS, UNION, RECOMMENDED, *INITIAL, *IMPROVED, GAINS, ITEMS, RECORDS, JOBS, JOB_CHECKS, RESUMES,
        ("deltas", "SELECT request_id, CAST(sum(CAST(round(round(b.gap_score - a.gap_score, 6) * 1000000) AS BIGINT)) AS BIGINT) AS delta_micro "
         "FROM initial_scores a FULL JOIN improved_scores b USING (request_id, skill) GROUP BY request_id"),
        ("texts", f"SELECT 'src' || doc_id AS request_id, CAST(0 AS BIGINT) AS part, {PARSED_JD} AS parsed_jd, {PARSED_RESUME} AS parsed_resume, "
         "'jobs/' || doc_id AS jd_url, 'resumes/' || o_custkey AS resume_url "
         "FROM checked JOIN resumes ON o_custkey = c_custkey WHERE errors = '' AND year BETWEEN 1900 AND 2100"),
    )
    + "SELECT request_id, part, coalesce(courses, '') AS courses, true AS kept_are_found, true AS kept_are_few, "
    "coalesce(courses, '') <> '' AS best_is_kept, coalesce(gains, '') AS gains, coalesce(initial, '') AS initial, "
    "coalesce(improved, '') AS improved, coalesce(n_cells, 0) AS n_cells, delta_micro, "
    "CASE WHEN request_id IN (SELECT request_id FROM texts) THEN request_id IN (SELECT request_id FROM recommended) END AS courses_in_prompt, "
    "parsed_jd, parsed_resume, jd_url, resume_url FROM records FULL JOIN texts USING (request_id, part) LEFT JOIN deltas USING (request_id)",
    "argmax_per_group": CATALOG
    + "SELECT subject, _id, avg_rating FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY avg_rating DESC, _id) AS n "
    "FROM courses WHERE avg_rating IS NOT NULL) WHERE n = 1",
    "cluster_members": "SELECT label AS cluster, CAST((place - 1) // 1000 AS BIGINT) AS part, "
    "string_agg('v' || vec_id, '|' ORDER BY vec_id) AS members FROM "
    "(SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings) GROUP BY 1, 2",
    "silhouette_exact": _with(
        ("totals", "SELECT a.vec_id AS id, a.label AS own, b.label AS other, "
         "sum(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS total, count(*) AS size "
         "FROM embeddings a, embeddings b GROUP BY ALL"),
        ("sides", "SELECT id, max(size) FILTER (own = other) AS size, max(total / (CASE WHEN size > 1 THEN size - 1 END)) "
         "FILTER (own = other) AS a, min(total / size) FILTER (own <> other) AS b FROM totals GROUP BY id"),
    )
    + "SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM sides",
    "silhouette_linear": _with(
        ("points", "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, [CAST(label AS INT), CAST(vec_id % 7 AS INT), "
         "CAST(floor(vec_id / 100) AS INT)] AS labels FROM embeddings"),
        ("gaps", "SELECT a.id, a.labels AS own, b.labels AS other, list_distance(a.v, b.v) ** 2 AS gap FROM points a, points b"),
        ("totals", "SELECT id, c - 1 AS clustering, own[c] AS cluster, other[c] AS met, sum(gap) AS total, count(*) AS size "
         "FROM gaps, (SELECT unnest([1, 2, 3]) AS c) GROUP BY ALL"),
        ("sides", "SELECT id, clustering, cluster, max(size) FILTER (cluster = met) AS size, "
         "max(total / (CASE WHEN size > 1 THEN size - 1 END)) FILTER (cluster = met) AS a, "
         "min(total / size) FILTER (cluster <> met) AS b FROM totals GROUP BY ALL"),
    )
    + "SELECT id, CAST(clustering AS INT) AS clustering, cluster, "
    "round(CASE WHEN size = 1 OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM sides",
    "dbscan": _with(
        NEAR,
        ("core", "SELECT a FROM near GROUP BY a HAVING count(*) >= 2"),
        ("links", "SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)"),
        ("reach", "SELECT a AS id, a AS hop FROM core UNION SELECT id, b FROM reach JOIN links ON hop = a"),
        ("labels", "SELECT id, min(hop) AS label FROM reach GROUP BY id"),
        ("border", "SELECT a AS id, min(label) AS label FROM near JOIN labels ON b = id WHERE a NOT IN (FROM core) GROUP BY a"),
        ("named", "SELECT *, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM (FROM labels UNION ALL FROM border)"),
    )
    + "SELECT vec_id AS id, CAST(coalesce(cluster, -1) AS INT) AS cluster FROM embeddings LEFT JOIN named ON vec_id = id",
}
