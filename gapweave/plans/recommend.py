"""Recommending courses for the skills of many requests in one plan."""

from pyspark.sql import Column, DataFrame, functions as F

from gapweave.functions.scores import quality_score, weighted_score
from gapweave.operators.lineage import checkpointed
from gapweave.operators.ranking import top_k_per_group
from gapweave.operators.similarity import DEFAULT_K, knn
from gapweave.schemas import DEFAULT_PREFERENCES
from gapweave.sources.vectors import hash_encoder

MAX_BROADCAST_HITS = 500_000
SALTS = 32
LIMITS = ("min_duration", "max_duration", "min_rating", "language")


def wanted_skills(records: DataFrame) -> DataFrame:
    """(request_id, skill_pos, skill): the must-have skills of each (request_id, job) record."""
    return records.select("request_id", F.posexplode("job.must_have_skills").alias("skill_pos", "skill"))


def encode_skills(requests: DataFrame, encoder=hash_encoder) -> DataFrame:
    """(skill, vector) of the distinct skills that any request asks for."""
    return encoder(requests.select(F.col("skill").alias("text")).distinct()).select(F.col("text").alias("skill"), "vector")


def pref_filter(courses: DataFrame, preferences: dict | None = None) -> DataFrame:
    """Hours within both limits, rating high enough, language equal without case."""
    p = {**DEFAULT_PREFERENCES, **(preferences or {})}
    return courses.where(_fits({c: F.lit(p[c]) for c in LIMITS}))


def _fits(limit: dict[str, Column]) -> Column:
    return (
        F.col("duration_hrs").between(limit["min_duration"], limit["max_duration"])
        & (F.col("avg_rating") >= limit["min_rating"])
        & (F.lower("language") == F.lower(limit["language"]))
    )


def pref_filter_per_request(found: DataFrame, preferences: DataFrame) -> DataFrame:
    """``pref_filter`` with a row of limits per request_id, which has one row at most.

    A limit that is null, a column that is absent and a request without a row take the default.
    """
    given = [c for c in LIMITS if c in preferences.columns]
    own = preferences.select("request_id", *[F.col(c).alias(f"_{c}") for c in given])
    limits = {c: F.coalesce(f"_{c}", F.lit(DEFAULT_PREFERENCES[c])) if c in given else F.lit(DEFAULT_PREFERENCES[c]) for c in LIMITS}
    return found.join(own, "request_id", "left").where(_fits(limits)).drop(*[f"_{c}" for c in given])


def with_quality(courses: DataFrame) -> DataFrame:
    return courses.withColumn("quality_score", quality_score(F.col("provider")))


def with_weighted_score(courses: DataFrame, terms=("skill",), **weights) -> DataFrame:
    return with_quality(courses).withColumn(
        "weighted_score",
        weighted_score(
            F.col("score"), F.col("avg_rating"), F.col("duration_hrs"), F.col("quality_score"), terms, **weights
        ),
    )


def _spread_join(requests: DataFrame, hits: DataFrame, small: bool) -> DataFrame:
    """Join on the skill. A skill half of all requests name must not be one task:
    a small hit list is broadcast (its size is known), a large one is copied to
    32 salted tasks per skill."""
    if small:
        return requests.join(F.broadcast(hits), "skill")
    salted = requests.withColumn("_salt", F.pmod(F.xxhash64("request_id"), F.lit(SALTS)).cast("int"))
    copies = hits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["skill", "_salt"]).drop("_salt")


def union_hits(
    requests: DataFrame, hits: DataFrame, on_duplicate: str = "first", small: bool = False, facts: tuple[str, ...] = ()
) -> DataFrame:
    """One row per request and course: (request_id, _id, skill_pos, score, facts).

    A course hit by several skills keeps the score of the first skill, or the
    highest with ``on_duplicate="max"``. ``requests`` is (request_id, skill_pos,
    skill). Both choices are partial aggregates. ``facts`` are columns of the hits
    that follow from the course; they are carried along.
    """
    joined = _spread_join(
        requests.select("request_id", "skill_pos", "skill"), hits.select("skill", "_id", "score", *facts), small
    )
    if on_duplicate == "first":
        score = F.min_by("score", "skill_pos")
    elif on_duplicate == "max":
        score = F.max("score")
    else:
        raise ValueError(f"on_duplicate is 'first' or 'max', not {on_duplicate!r}")
    grouped = joined.groupBy("request_id", "_id", *facts)
    return grouped.agg(F.min("skill_pos").alias("skill_pos"), score.alias("score")).select("request_id", "_id", "skill_pos", "score", *facts)


def recommend(
    requests: DataFrame,
    skills: DataFrame,
    catalog: DataFrame,
    vectors: DataFrame,
    preferences: dict | DataFrame | None = None,
    k: int = DEFAULT_K,
    min_score: float = 0.5,
    score_mode: str = "atlas_cosine",
    on_duplicate: str = "first",
    prefilter: bool = False,
    terms=("skill",),
    top_n: int | None = None,
) -> DataFrame:
    """All recommendations: one row per request and course, with its scores.

    Each distinct skill is searched once. Preferences apply after the search, as
    the search knows nothing of them; ``prefilter`` searches only courses that
    meet them. ``preferences`` is one set for all requests, or a table with limits
    for each request_id (see ``pref_filter_per_request``). Add the order with ``best_first`` and the near-duplicate removal
    with ``operators.dedup.deduplicate``.
    """
    per_request = isinstance(preferences, DataFrame)
    if per_request and prefilter:
        raise ValueError("prefilter needs one set of preferences")
    fitting = catalog if per_request else pref_filter(catalog, preferences)
    if prefilter:
        vectors = vectors.join(fitting.select("_id"), "_id", "left_semi")
    # The hits are used twice below; stored, the search runs once and their number is known.
    hits = checkpointed(knn(vectors, skills, k, score_mode))
    small = hits.count() <= MAX_BROADCAST_HITS
    # The score rule needs only the hits, so it runs before requests multiply them.
    # A course below it for its first skill must still lose to that skill, so for
    # "first" the rule is applied after the union.
    # Facts of the courses meet the hits here: the union below fans out on the course, and
    # a course that very many requests find would be one key of a join after it. Hits of other
    # courses go at once, as the rules on a course do not depend on the skill that found it.
    facts = [c for c in fitting.columns if c not in ("_id", "skill", "request_id", "skill_pos", "score", "rank", "vector")]
    courses = fitting.select("_id", F.struct(*facts).alias("_facts"))
    if small:
        # Reduce the catalogue to the courses found in its own scan; what is left is as small as the hits.
        courses = courses.join(F.broadcast(hits.select("_id").distinct()), "_id", "left_semi")
    known = checkpointed(hits.join(courses, "_id"))
    union = union_hits(requests, known, on_duplicate, small, ("_facts",)).where(F.col("score") > min_score)
    found = union.select("request_id", "_id", "skill_pos", "score", "_facts.*")
    if per_request:
        found = pref_filter_per_request(found, preferences)
    scored = with_weighted_score(found, terms)
    if top_n is None:
        return scored
    return top_k_per_group(scored, ["request_id"], [F.desc("weighted_score"), F.asc("_id")], top_n)


def best_first(recommended: DataFrame) -> DataFrame:
    return recommended.orderBy("request_id", F.desc("weighted_score"), "_id")
