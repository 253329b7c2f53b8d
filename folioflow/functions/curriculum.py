"""Fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Class, subject, book code and number of chapters.
CURRICULUM = [
    ("9", "Science", "iesc", 13), ("9", "Mathematics", "iemh", 8), ("9", "Social Science", "iest", 9), ("9", "English", "iebe", 8),
    ("9", "Health & Physical Education", "iehp", 6), ("9", "Sanskrit", "ihsh", 16), ("9", "Hindi", "ihga", 12), ("9", "Urdu", "iuju", 12),
    ("9", "Vocational/Language", "iekv", 12), ("9", "Language", "iemr", 12),
    ("10", "Science", "jesc", 13), ("10", "Social Science", "jess", 8), ("10", "Mathematics", "jemh", 8), ("10", "Health & Physical Education", "jehp", 6),
    ("10", "Hindi (Kritika)", "jhkr", 5), ("10", "Hindi (Kshitij)", "jhks", 17), ("10", "Hindi (Vyakaran)", "jhva", 10), ("10", "Sanskrit", "jsab", 10),
    ("10", "Urdu (Gulzar-e-Urdu)", "juge", 10), ("10", "Urdu (Jaan Pehchan)", "jujp", 10), ("10", "Urdu (Nai Awaz)", "june", 10),
    ("10", "Sanskrit (Shemushi)", "jusc", 10), ("10", "Sanskrit (Vyakaran)", "jusr", 10),
    ("11", "Chemistry", "kech", 14), ("11", "Physics", "keph", 15), ("11", "Mathematics", "kemh", 16), ("11", "Geography", "kegy", 10),
    ("11", "History/Heritage Crafts", "kehs", 11), ("11", "Health & Physical Education", "kehp", 6),
    ("12", "Chemistry", "lech", 16), ("12", "Physics", "leph", 15), ("12", "Mathematics", "lemh", 13), ("12", "Geography", "legy", 12), ("12", "History/Heritage Crafts", "lehs", 14),
]


def values_sql() -> str:
    return "VALUES " + ", ".join(f"('{c}', '{s}', '{k}', {n})" for c, s, k, n in CURRICULUM)


def curriculum(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM ({values_sql()}) AS t(class, subject, code, chapters)")
