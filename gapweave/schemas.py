"""Record shapes and fixed values shared by the whole package."""

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Source column -> catalogue column, in output order.
# ---------------------------------------------------------------------------
CATALOG_COLUMNS = {
    "course_id": "_id",
    "course_name": "name",
    "description": "description",
    "duration": "duration",
    "cost": "pricing",
    "course_level": "level",
    "course_provider": "provider",
    "course_num_rating": "num_rating",
    "course_avg_rating": "avg_rating",
    "rating": "rating",
    "language": "language",
    "course_certificate": "certificate",
    "course_subject": "subject",
    "course_type": "type",
}

RAW_COURSE_SCHEMA = T.StructType(
    [
        T.StructField("course_id", T.LongType()),
        T.StructField("course_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("duration", T.StringType()),
        T.StructField("cost", T.StringType()),
        T.StructField("course_level", T.StringType()),
        T.StructField("course_provider", T.StringType()),
        T.StructField("course_num_rating", T.LongType()),
        T.StructField("course_avg_rating", T.DoubleType()),
        T.StructField("rating", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("course_certificate", T.StringType()),
        T.StructField("course_subject", T.StringType()),
        T.StructField("course_type", T.StringType()),
    ]
)

# ---------------------------------------------------------------------------
# Provider quality tiers, 4 (best) to 1. Unlisted providers are 0.
# ---------------------------------------------------------------------------
PROVIDER_TIERS = {
    4: [
        "edX", "Swayam", "Udacity", "Coursera", "Pluralsight", "LinkedIn Learning",
        "FutureLearn", "MIT OpenCourseWare", "Cisco Networking Academy",
        "AWS Skill Builder", "Microsoft Learn", "The Odin Project", "Kaggle",
        "Exercism", "Google Cloud Skills Boost", "Qwiklabs", "Skillshop",
        "Stanford OpenEdx",
    ],
    3: [
        "freeCodeCamp", "Udemy", "Trailhead", "Codecademy", "Treehouse", "Scrimba",
        "Zero To Mastery", "DataCamp", "Test Automation University", "TryHackMe",
        "PentesterAcademy", "Brilliant", "Jovian",
    ],
    2: [
        "Skillshare", "MasterClass", "Kadenze", "openSAP", "HubSpot Academy",
        "Domestika", "CreativeLive", "SymfonyCasts", "The Great Courses Plus",
        "Wolfram U", "Semrush Academy", "Craftsy", "Designlab",
        "MongoDB University", "Complexity Explorer",
    ],
    1: [
        "OpenLearn", "Cybrary", "YouTube", "Independent", "Saylor Academy",
        "egghead.io", "Frontend Masters", "Study.com",
        "California Community Colleges System", "Cognitive Class", "Edureka",
        "Laracasts", "openHPI", "Open2Study", "iversity",
        "Polimi OPEN KNOWLEDGE", "OpenLearning", "Canvas Network",
    ],
}

# Evidence kind -> weight; the first kind found in a header wins.
PENALTIES = [
    ("award", 0.9),
    ("publication", 0.8),
    ("project", 0.7),
    ("certification", 0.6),
]

# Name of the skill column in a gap matrix.
SKILL_HEADER = "Must-Have Skill"

# Allowed words in parsed records.
EMPLOYMENT_TYPES = ["full-time", "part-time", "contract", "internship", "temporary"]
PROJECT_TYPES = ["personal", "internship", "company", "no-mention", "open-source"]
PROJECT_TYPE_DEFAULT = "no-mention"
PUBLICATION_YEARS = (1900, 2100)

# Preferences used when a request names none.
DEFAULT_PREFERENCES = {
    "min_duration": 1.0,
    "max_duration": 40.0,
    "min_rating": 4.0,
    "language": "English",
    "top_n": 20,
}


def _strings(*names):
    return [T.StructField(name, T.StringType()) for name in names]


def _list_of(*fields):
    return T.ArrayType(T.StructType(list(fields)))


JOB_SCHEMA = T.StructType(
    _strings("job_title", "employment_type")
    + [
        T.StructField("key_responsibilities", _list_of(*_strings("description"))),
        T.StructField("qualifications", _list_of(*_strings("qualification"))),
        T.StructField(
            "education_requirements", _list_of(*_strings("degree", "field_of_study"))
        ),
        T.StructField("must_have_skills", T.ArrayType(T.StringType())),
        T.StructField("bonus_skills", T.ArrayType(T.StringType())),
    ]
)

RESUME_SCHEMA = T.StructType(
    [
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("certifications", _list_of(*_strings("name", "organization"))),
        T.StructField("projects", _list_of(*_strings("title", "description", "type"))),
        T.StructField(
            "publications",
            _list_of(*_strings("title", "journal"), T.StructField("year", T.IntegerType())),
        ),
        T.StructField(
            "academic_awards",
            _list_of(
                *_strings("title"),
                T.StructField("related_skills", T.ArrayType(T.StringType())),
            ),
        ),
    ]
)
