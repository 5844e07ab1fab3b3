"""Small tables with the awkward cases every operator must define."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "score string, shard string, component_id string, spans string, id string, t string, offset string, label string")
LONG = "the thing was over there and here we are again with more " * 6000
WORDS = {"en": "the and that with from this have are was for not you they were which".split(),
         "de": "der die und das nicht mit sich auf für ist eine dem wird über schön".split()}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "e", "en", "s"]) for _ in range(n))


def documents(spark, n: int = 60):
    """n plain documents of two languages, then awkward rows; extra columns clash with operators' names."""
    rng = random.Random(7)
    rows = [(i, sentence(rng, "en" if i % 2 else "de", 40), "en" if i % 2 else "de", "s") for i in range(n)]
    rows += [(1000, None, "en", "s"), (1001, "", None, None), (1002, " \n\t ", "de", "s"), (1003, "one", None, "s"),
             (1004, LONG, "en", "s"), (1005, rows[5][1], "en", "s"), (1006, "12 34!?", "en", "s"),
             (1007, "twice", "en", "s"), (1007, "twice", "en", "s"), (1008, "same id", "en", "a"), (1008, "other text", "en", "b"),
             (None, "no id", "en", "s")]
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * 8) for r in rows], SCHEMA).repartition(5)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
