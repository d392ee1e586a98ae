"""One query per operator, each over the whole given tables."""

import uuid

from pyspark.sql import functions as F

from gapweave.functions.scores import quality_score, weighted_score
from gapweave.functions.text import clean_text, duration_hours, record_text
from gapweave.operators import clustering, dedup, gap, keyed, lloyd, markdown, quantized, records, similarity, ward
from gapweave.operators.lineage import checkpointed, shared_folder
from gapweave.operators.ranking import best_per_group
from gapweave.plans import improve, interactions, recommend
from gapweave.schemas import RESUME_SCHEMA
from gapweave.sources import catalog as catalogs
from gapweave.sources import documents, vectors as encoders
from workload import tables as t

def _run_at():
    return F.lit("2024-06-01 12:00:00").cast("timestamp")


RUN_ID = "run-1"
QUERIES = {}


def query(fn):
    """Register a query under its function name, without a leading ``q_``."""
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def _catalog(spark, sf):
    return catalogs.normalize(t.raw_courses(spark, sf))


def _all_courses(spark, sf):
    return catalogs.normalize(t.raw_courses(spark, sf), language=None)


# --- catalogue -------------------------------------------------------------


@query
def catalog_load(spark, sf):
    return _catalog(spark, sf)


@query
def q_duration_hours(spark, sf):
    raw = t.raw_courses(spark, sf)
    return raw.select("course_id", "duration", duration_hours(F.col("duration")).alias("duration_hrs"))


@query
def encode_text(spark, sf):
    return catalogs.texts_to_encode(_all_courses(spark, sf))


@query
def distinct_providers(spark, sf):
    return catalogs.providers(_all_courses(spark, sf))


@query
def table_profile(spark, sf):
    return catalogs.profile(_all_courses(spark, sf))


@query
def drop_all_null(spark, sf):
    return catalogs.drop_empty_rows(_all_courses(spark, sf).select("language", "num_rating", "rating"))


@query
def pref_filter(spark, sf):
    return recommend.pref_filter(_all_courses(spark, sf)).select("_id", "duration_hrs", "avg_rating", "language")


@query
def q_quality_score(spark, sf):
    return _all_courses(spark, sf).select("_id", "provider", quality_score(F.col("provider")).alias("quality_score"))


@query
def q_weighted_score(spark, sf):
    courses = _all_courses(spark, sf).withColumn("score", F.col("avg_rating") / 5)
    scored = recommend.with_quality(courses)
    everything = weighted_score(
        F.col("score"), F.col("avg_rating"), F.col("duration_hrs"), F.col("quality_score"), terms="all"
    )
    return scored.select(
        "_id",
        F.round(weighted_score(F.col("score")), 6).alias("weighted_score"),
        F.round(everything, 6).alias("weighted_score_all"),
    )


# --- text ------------------------------------------------------------------


@query
def doc_ingest(spark, sf):
    docs = t.table(spark, sf, "documents")
    return documents.ingest(docs, F.col("doc_id"), F.col("source"), F.col("text"))


@query
def q_clean_text(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


# --- similarity and recommendation -----------------------------------------


@query
def similarity_matrix(spark, sf):
    matrix = similarity.similarity_matrix(t.vectors(spark, sf), t.skills(spark, sf))
    return matrix.select("_id", "tile", *[F.col("similarities")[i].alias(f"s{i}") for i in range(10)])


@query
def similarity_wide(spark, sf):
    matrix = similarity.similarity_matrix(t.vectors(spark, sf), t.skills(spark, sf))
    names = [r.skill for r in t.skills(spark, sf).select("skill_pos", "skill").orderBy("skill_pos").collect()]
    return similarity.similarity_wide(matrix, names)


@query
def knn_topk(spark, sf):
    hits = similarity.knn(t.vectors(spark, sf), t.skills(spark, sf))
    return hits.join(_all_courses(spark, sf), "_id")


@query
def knn_approx(spark, sf):
    indexed, centres = similarity.build_index(t.vectors(spark, sf), lists=16)
    return similarity.knn_approx(indexed, centres, t.skills(spark, sf), probes=13)


@query
def knn_floors(spark, sf):
    return similarity.knn(t.vectors(spark, sf), t.skills(spark, sf), floors=True)


def _quantized(spark, sf):
    vectors = t.vectors(spark, sf)
    codes = quantized.fit_codes(vectors, lists=16)
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    indexed = quantized.write_index(quantized.index(vectors, codes), path)
    return quantized.search(indexed, codes, t.skills(spark, sf), probes=16)


@query
def knn_quantized(spark, sf):
    return _quantized(spark, sf)


@query
def knn_quantized_check(spark, sf):
    """What must hold of the approximate search: hits per skill, none with another score than the exact one, recall of 0.95."""
    hits = checkpointed(_quantized(spark, sf).select("skill", "_id", "score", "rank"))
    exact = similarity.knn(t.vectors(spark, sf), t.skills(spark, sf)).select("skill", "_id", F.col("score").alias("exact"))
    met = hits.join(exact, ["skill", "_id"], "full")
    return met.groupBy("skill").agg(
        F.count("score").alias("hits"),
        F.count(F.when(F.abs(F.col("score") - F.col("exact")) > 2e-6, 1)).alias("wrong"),
        (100 * F.count(F.when(F.col("score").isNotNull(), F.col("exact"))) >= 95 * F.count("exact")).alias("recalled"),
        (F.max("rank") == F.count("score")).alias("ranked"),
    )


@query
def skill_topn(spark, sf):
    return similarity.knn(t.vectors(spark, sf), t.skills(spark, sf), k=5, score_mode="cosine")


@query
def skill_threshold(spark, sf):
    hits = similarity.above_threshold(t.vectors(spark, sf), t.skills(spark, sf), threshold=0.1)
    listed = similarity.with_course_facts(hits, _all_courses(spark, sf))
    return listed.orderBy("skill", F.desc("similarity"), "_id")


@query
def knn_union(spark, sf):
    hits = similarity.knn(t.vectors(spark, sf), t.skills(spark, sf))
    return recommend.union_hits(t.requests(spark, sf), hits)


@query
def knn_union_max(spark, sf):
    hits = similarity.knn(t.vectors(spark, sf), t.skills(spark, sf))
    return recommend.union_hits(t.requests(spark, sf), hits, on_duplicate="max")


def _recommended(spark, sf, **options):
    return recommend.recommend(
        t.requests(spark, sf), t.skills(spark, sf), _all_courses(spark, sf), t.vectors(spark, sf), **options
    )


@query
def recommend_all(spark, sf):
    out = recommend.best_first(_recommended(spark, sf))
    return out.select("request_id", "_id", "name", "skill_pos", "score", "quality_score", "weighted_score")


@query
def recommend_prefilter(spark, sf):
    return _recommended(spark, sf, prefilter=True).select("request_id", "_id", "score", "weighted_score")


@query
def recommend_per_request(spark, sf):
    return _recommended(spark, sf, preferences=t.preferences(spark, sf)).select("request_id", "_id", "score", "weighted_score")


@query
def recommend_topn(spark, sf):
    return _recommended(spark, sf, top_n=5).select("request_id", "rank", "_id", "weighted_score")


@query
def dedup_recommendations(spark, sf):
    found = _recommended(spark, sf).join(t.vectors(spark, sf), "_id")
    return dedup.deduplicate(found).select("request_id", "cluster", "_id", "name", "weighted_score")


@query
def cert_records(spark, sf):
    return gap.certificate_records(_recommended(spark, sf)).select("request_id", "_id", "text")


# --- gap matrices ----------------------------------------------------------


@query
def markdown_table(spark, sf):
    return markdown.parse_tables(t.initial_responses(spark, sf))


@query
def penalize(spark, sf):
    cells = improve.response_cells(t.initial_responses(spark, sf))
    return cells.select("request_id", "row_no", "col_no", "evidence", F.round("score", 6).alias("score"))


@query
def gap_score(spark, sf):
    scores = improve.score_responses(t.initial_responses(spark, sf))
    return gap.weakest_first(scores.withColumn("gap_score", F.round("gap_score", 6)))


@query
def course_gain(spark, sf):
    gains = gap.course_gains(improve.response_cells(t.improved_responses(spark, sf)))
    return gap.largest_gain_first(gains.withColumn("gain", F.round("gain", 6)))


@query
def gap_improvement(spark, sf):
    rounds = improve.improvement(
        improve.response_cells(t.initial_responses(spark, sf)), improve.response_cells(t.improved_responses(spark, sf))
    )
    # + 0.0 turns a rounded -0.0 into 0.0.
    return rounds["delta"].select(
        "request_id", "skill", *[(F.round(c, 6) + 0.0).alias(c) for c in ("initial", "improved", "delta")]
    )


# --- records ---------------------------------------------------------------


@query
def skills_normalize(spark, sf):
    skills = records.normalize_skills(t.job_responses(spark, sf))
    return skills.select("doc_id", F.size("skills").alias("n_skills"), F.array_join("skills", "|").alias("skills"))


def _jobs(spark, sf):
    return records.parse_records(t.job_responses(spark, sf), "job")


def _resumes(spark, sf):
    return records.parse_records(t.resume_responses(spark, sf), "resume")


@query
def record_parse(spark, sf):
    return records.valid_records(_jobs(spark, sf)).select(
        "doc_id",
        "record.job_title",
        "record.employment_type",
        F.array_join("record.must_have_skills", "|").alias("must_have_skills"),
        F.size("record.education_requirements").alias("n_education"),
        F.size("record.bonus_skills").alias("n_bonus"),
    )


@query
def record_quarantine(spark, sf):
    return records.quarantine(_jobs(spark, sf)).select("doc_id", "raw", F.array_join("errors", ",").alias("errors"))


@query
def resume_parse(spark, sf):
    parsed = _resumes(spark, sf)
    return parsed.select(
        "doc_id",
        F.array_join("errors", ",").alias("errors"),
        F.col("record.publications")[0]["year"].alias("year"),
        F.col("record.projects")[0]["type"].alias("project_type"),
    )


@query
def q_record_text(spark, sf):
    def text(name):
        return record_text(F.col(f"record.{name}"), RESUME_SCHEMA[name].dataType).alias(name)

    return records.valid_records(_resumes(spark, sf)).select(
        "doc_id", text("projects"), text("certifications"), text("publications"), text("academic_awards")
    )


@query
def record_json(spark, sf):
    return records.valid_records(_jobs(spark, sf)).select(
        "doc_id", records.record_json(F.col("record")).alias("parsed_jd")
    )


def _pairs(spark, sf):
    jobs = records.valid_records(_jobs(spark, sf)).select(
        F.col("doc_id").alias("request_id"), F.col("o_custkey"), F.col("record").alias("job")
    )
    resumes = records.valid_records(_resumes(spark, sf)).select(
        F.col("doc_id").alias("o_custkey"), F.col("record").alias("resume")
    )
    return jobs.join(resumes, "o_custkey")


@query
def job_skills(spark, sf):
    jobs = records.valid_records(_jobs(spark, sf))
    return recommend.wanted_skills(jobs.select(F.col("doc_id").alias("request_id"), F.col("record").alias("job")))


@query
def skill_vectors(spark, sf):
    return recommend.encode_skills(job_skills(spark, sf))


@query
def prompt_render(spark, sf):
    return improve.render_prompts(_pairs(spark, sf))


# --- keyed tables ----------------------------------------------------------


def _documents(spark, sf):
    return t.table(spark, sf, "documents").select(F.col("doc_id").alias("_id"), "lang", "source", "n_chars")


def _labels(spark, sf):
    return t.table(spark, sf, "labels").withColumnRenamed("doc_id", "_id")


@query
def store_get(spark, sf):
    return keyed.get_rows(_documents(spark, sf), _labels(spark, sf))


@query
def store_find(spark, sf):
    return keyed.find_rows(_documents(spark, sf), "lang", "en")


def _order_changes(spark, sf):
    """Orders as changes to customers: many per customer, the order key is the position."""
    return t.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("position")
    )


@query
def store_insert_absent(spark, sf):
    """Customers with orders become rows unless a label has their id; many orders name one id."""
    old = t.table(spark, sf, "labels").select(F.col("doc_id").alias("_id"), F.lit("labelled").alias("status"))
    return keyed.insert_absent(old, _order_changes(spark, sf), "position", _run_at())


@query
def store_insert_gen_id(spark, sf):
    docs = _documents(spark, sf)
    return keyed.insert_generated(docs.withColumn("key", F.col("_id")), "key", RUN_ID)


@query
def store_update(spark, sf):
    """The last order of each customer changes ``lang`` of the document with that id."""
    changes = _order_changes(spark, sf).withColumnRenamed("status", "lang")
    return keyed.update_rows(_documents(spark, sf), changes, "position", _run_at())


@query
def store_update_not_found(spark, sf):
    return keyed.not_found(_documents(spark, sf), _order_changes(spark, sf))


@query
def store_upsert(spark, sf):
    """Vectors into the label table: some ids exist, ``vector_size`` is a new field."""
    old = t.table(spark, sf, "labels").withColumnRenamed("doc_id", "_id")
    new = t.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("_id"), F.col("label").alias("quality"), F.size("embedding").alias("vector_size")
    )
    return keyed.upsert_rows(old, new)


def _toxic(spark, sf):
    return _labels(spark, sf).where("toxic = 1")


@query
def store_delete(spark, sf):
    return keyed.delete_rows(_documents(spark, sf), _toxic(spark, sf))


@query
def store_deleted_ids(spark, sf):
    return keyed.deleted_ids(_documents(spark, sf), _toxic(spark, sf))


@query
def interaction_record(spark, sf):
    # Both rounds' cells feed several sections, so they are stored once.
    initial = checkpointed(improve.response_cells(t.initial_responses(spark, sf)))
    improved = checkpointed(improve.response_cells(t.improved_responses(spark, sf)))
    rounds = improve.improvement(initial, improved)

    def rounded(df, name):
        return df.withColumn(name, F.round(name, 6))

    sections = {
        "all_recommendations": _recommended(spark, sf),
        "courses_filtered_after_dedup": rounded(rounds["courses_filtered_after_dedup"], "gain"),
        "initial_knowledge": rounded(rounds["initial_knowledge"], "gap_score"),
        "score_can_be_improved": rounded(rounds["score_can_be_improved"], "gap_score"),
        "df_gap": initial,
    }
    out = interactions.interaction_records(sections)

    def joined(section, field):
        return F.array_join(F.transform(F.col(section), lambda r: r.getField(field).cast("string")), "|")

    return out.select(
        "request_id",
        "part",
        joined("all_recommendations", "_id").alias("courses"),
        joined("courses_filtered_after_dedup", "evidence").alias("gains"),
        joined("initial_knowledge", "skill").alias("initial"),
        joined("score_can_be_improved", "skill").alias("improved"),
        F.size("df_gap").alias("n_cells"),
    )


def _order_pairs(spark, sf):
    return _pairs(spark, sf).select(F.concat(F.lit("src"), F.col("request_id").cast("string")).alias("request_id"), "o_custkey", "job", "resume")


@query
def improvement_run(spark, sf):
    """The whole chain: recommendations, near-duplicate removal, second prompts, both rounds' scores, the stored record."""
    vectors = t.vectors(spark, sf)
    found = checkpointed(_recommended(spark, sf))
    kept = checkpointed(dedup.deduplicate(found.join(vectors, "_id")).drop("vector"))
    pairs = checkpointed(_order_pairs(spark, sf))
    texts = pairs.select(
        "request_id",
        records.record_json(F.col("job")).alias("parsed_jd"),
        records.record_json(F.col("resume")).alias("parsed_resume"),
        F.concat(F.lit("jobs/"), F.substring("request_id", 4, 20)).alias("jd_url"),
        F.concat(F.lit("resumes/"), F.col("o_custkey").cast("string")).alias("resume_url"),
    )
    run = improve.improvement_run(pairs, found, kept, t.initial_responses(spark, sf), t.improved_responses(spark, sf), texts)
    micro = F.round(F.round("delta", 6) * 1_000_000).cast("bigint")
    delta = run["delta"].groupBy("request_id").agg(F.sum(micro).alias("delta_micro"))
    named = run["prompts"].select("request_id", F.contains("prompt", F.lit("name: ")).alias("courses_in_prompt"))

    def joined(section, field):
        return F.coalesce(F.array_join(F.transform(F.col(section), lambda r: r.getField(field).cast("string")), "|"), F.lit(""))

    ids = lambda section: F.transform(section, lambda r: r.getField("_id"))
    out = run["records"].join(delta, "request_id", "left").join(named, "request_id", "left")
    return out.select(
        "request_id",
        "part",
        joined("all_recommendations", "_id").alias("courses"),
        # near-duplicate removal leaves some of the courses found, ten at most, the best of all among them
        F.coalesce(F.size(F.array_except(ids("dedup_recommendations"), ids("all_recommendations"))) == 0, F.lit(True)).alias("kept_are_found"),
        F.coalesce(F.size("dedup_recommendations") <= 10, F.lit(True)).alias("kept_are_few"),
        F.coalesce(F.array_contains(ids("dedup_recommendations"), F.get(ids("all_recommendations"), F.lit(0))), F.lit(False)).alias("best_is_kept"),
        joined("courses_filtered_after_dedup", "evidence").alias("gains"),
        joined("initial_knowledge", "skill").alias("initial"),
        joined("score_can_be_improved", "skill").alias("improved"),
        F.coalesce(F.size("df_gap"), F.lit(0)).alias("n_cells"),
        "delta_micro",
        "courses_in_prompt",
        "parsed_jd",
        "parsed_resume",
        "jd_url",
        "resume_url",
    )


# --- clustering ------------------------------------------------------------


@query
def argmax_per_group(spark, sf):
    courses = _all_courses(spark, sf).where(F.col("avg_rating").isNotNull()).select("subject", "_id", "avg_rating")
    return best_per_group(courses, ["subject"], "avg_rating", "_id")


@query
def cluster_members(spark, sf):
    named = t.labelled(spark, sf).withColumn("member", F.concat(F.lit("v"), F.col("id").cast("string")))
    lists = clustering.member_lists(named, "member", "id")
    return lists.select("cluster", "part", F.array_join("members", "|").alias("members"))


@query
def silhouette_exact(spark, sf):
    return clustering.silhouette_exact(t.labelled(spark, sf)).select(F.round("silhouette", 6).alias("silhouette"))


@query
def silhouette_fast(spark, sf):
    return clustering.silhouette_fast(t.labelled(spark, sf))


@query
def silhouette_linear(spark, sf):
    """Three clusterings at once: the given labels, remainders and blocks of the ids."""
    labels = F.array(F.col("cluster").cast("int"), (F.col("id") % 7).cast("int"), F.floor(F.col("id") / 100).cast("int"))
    found = lloyd.linear_silhouettes(t.labelled(spark, sf).select("id", "vector", labels.alias("labels")))
    return found.select("id", "clustering", "cluster", F.round("silhouette", 6).alias("silhouette"))


@query
def dbscan(spark, sf):
    return clustering.dbscan(t.points(spark, sf), eps=0.6, min_samples=2)


@query
def kmeans_fixed(spark, sf):
    return clustering.kmeans(t.points(spark, sf), 5, 0).select("id", "cluster")


@query
def hierarchical_clusters(spark, sf):
    return clustering.hierarchical(t.points(spark, sf), 5).select("id", "cluster")


@query
def agglomerative_clusters(spark, sf):
    return ward.ward(t.points(spark, sf), 5)


@query
def spectral_clusters(spark, sf):
    return clustering.spectral(t.points(spark, sf), 5)


@query
def optimal_k(spark, sf):
    scores = clustering.sweep(t.points(spark, sf))
    best = clustering.best_k(scores)
    rows = [(k, float(s), k == best) for k, s in scores]
    return spark.createDataFrame(rows, "k int, silhouette double, chosen boolean")


@query
def cluster_skills(spark, sf):
    names = t.table(spark, sf, "part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("id"))
    skills = encoders.hash_encoder(names).select("id", F.col("text").alias("skill"), "vector")
    return clustering.cluster_skills(skills).select("cluster", "part", F.array_join("members", "|").alias("members"))


@query
def embed_hash(spark, sf):
    texts = t.spread(t.table(spark, sf, "documents")).select(F.col("doc_id").alias("_id"), "text")
    return encoders.hash_encoder(texts).select("_id", "vector")
