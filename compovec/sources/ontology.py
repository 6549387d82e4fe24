"""The domain ontology: a fixed tree of categories, subcategories and domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Category, subcategory, [(code, id, display name, active in the pilot)].
TREE = [
    ("CO. Core ASD domains", [
        ("Social Communication and Interaction", [
            ("CO1", "social_emotional_reciprocity", "Social-emotional reciprocity", True),
            ("CO2", "nonverbal_communication", "Nonverbal communication", True),
            ("CO3", "relationship_play", "Social relationships", True),
        ]),
        ("Restricted and Repetitive Behaviors", [
            ("CO4", "stereotyped_behavior", "Stereotyped behavior", True),
            ("CO5", "insistence_on_sameness", "Insistence on sameness", True),
            ("CO6", "restricted_interests", "Restricted interests", True),
            ("CO7", "sensory_processing", "Sensory reactivity", True),
        ]),
    ]),
    ("AS. Associated and co-occurring features", [
        ("Emotional and Behavioral Regulation", [
            ("AS1", "externalizing", "Externalizing behaviors", False),
            ("AS2", "internalizing", "Internalizing behaviors", False),
        ]),
        ("Language", [
            ("AS3", "language_skills", "Language skills", False),
        ]),
        ("Physical Function and Life Skills", [
            ("AS4", "physiological_function", "Physiological function", False),
            ("AS5", "adaptive_behavior", "Adaptive behavior", False),
        ]),
        ("Cognitive and Neuropsychological", [
            ("AS6", "intelligence_learning", "Intellectual functioning and learning skills", False),
            ("AS7", "executive_function", "Executive function", False),
        ]),
        ("Development and Environment", [
            ("AS8", "motor_skills", "Motor skills", False),
            ("AS9", "family_environment", "Family environment", False),
        ]),
    ]),
    ("RE. Report elements and other", [
        ("Formal and Other", [
            ("RE1", "test_scores", "Test scores", True),
            ("RE2", "other_general", "Other/general", True),
            ("RE3", "recommendations", "Recommendations", True),
        ]),
    ]),
]
FALLBACK = "other_general"
SECOND_FALLBACK = "other_unclear"

SCHEMA = (
    "category string, subcategories array<struct<subcategory string, "
    "domains array<struct<code string, id string, name string, pilot_active boolean>>>>"
)


def tree_frame(spark: SparkSession, tree=None) -> DataFrame:
    """The nested tree, one row per category."""
    rows = [(c, [(s, list(ds)) for s, ds in subs]) for c, subs in (tree or TREE)]
    return spark.createDataFrame(rows, SCHEMA)


def flatten(tree: DataFrame, pilot: bool = False) -> DataFrame:
    """One row per domain in tree order, optionally the pilot subset only."""
    cats = tree.withColumn("group", F.substring("category", 1, 2))
    subs = cats.select("category", "group", F.inline("subcategories"))
    doms = subs.select("category", "subcategory", "group", F.inline("domains"))
    if pilot:
        doms = doms.filter("pilot_active")
    return doms


def load_domains(spark: SparkSession, pilot: bool = False, tree=None) -> DataFrame:
    """Flat ontology with the tree position ``ord`` of every domain.

    The tree is a configuration of bounded size, so positions come from the
    driver-side literal, not from a window over data.
    """
    order = {d[1]: i for i, d in enumerate(domains(tree=tree, pilot=pilot))}
    flat = flatten(tree_frame(spark, tree), pilot)
    ord_map = F.create_map(*[F.lit(v) for kv in order.items() for v in kv])
    return flat.withColumn("ord", ord_map[F.col("id")].cast("int"))


def domains(tree=None, pilot: bool = False) -> list[tuple]:
    """Driver-side list of (code, id, name, pilot_active) in tree order."""
    return [d for _, subs in (tree or TREE) for _, ds in subs for d in ds if d[3] or not pilot]


def ids(pilot: bool = False) -> list[str]:
    return [d[1] for d in domains(pilot=pilot)]


def codes(pilot: bool = False) -> list[str]:
    return [d[0] for d in domains(pilot=pilot)]


def fallback_id(valid: list[str] | None = None) -> str:
    """The catch-all id, or the second one where an ontology lacks the first."""
    valid = ids() if valid is None else valid
    if FALLBACK not in valid and SECOND_FALLBACK in valid:
        return SECOND_FALLBACK
    return FALLBACK


def code_sort_key(code: Column) -> tuple[Column, Column]:
    """Natural order of codes: prefix, then number; blanks last."""
    blank = F.coalesce(code, F.lit("")) == ""
    prefix = F.when(blank, "Z").otherwise(F.regexp_replace(code, r"\d", ""))
    digits = F.regexp_replace(code, r"\D", "")
    number = F.when(blank, 999).when(digits == "", 0).otherwise(digits.cast("int"))
    return prefix, number
