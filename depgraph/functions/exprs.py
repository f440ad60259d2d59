"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of an edge by its confidence; anything else weighs OTHER_WEIGHT.
WEIGHTS = {"EXTRACTED": 1.0, "INFERRED": 0.7, "AMBIGUOUS": 0.4}
OTHER_WEIGHT = 0.5
#: The same as whole numbers: cost of a step in a path (1 / weight times 14) and distance (weight times 10), free of rounding.
COSTS, OTHER_COST = {"EXTRACTED": 14, "INFERRED": 20, "AMBIGUOUS": 35}, 28
DISTANCES, OTHER_DISTANCE = {"EXTRACTED": 10, "INFERRED": 7, "AMBIGUOUS": 4}, 5


def by_confidence(values: dict, other, confidence: str = "confidence") -> Column:
    c = F.lit(other)
    for k, v in values.items():
        c = F.when(F.col(confidence) == k, F.lit(v)).otherwise(c)
    return c


def weight(confidence: str = "confidence") -> Column:
    return by_confidence(WEIGHTS, OTHER_WEIGHT, confidence)


def path_cost(confidence: str = "confidence") -> Column:
    return by_confidence(COSTS, OTHER_COST, confidence)


def distance(confidence: str = "confidence") -> Column:
    return by_confidence(DISTANCES, OTHER_DISTANCE, confidence)


def node_id(repo: str, path: str, *members: str) -> Column:
    """repo::path[::Class][::member]; null parts are left out."""
    return F.concat_ws("::", F.col(repo), F.col(path), *(F.col(m) for m in members))


def short_name(name: str = "name") -> Column:
    return F.element_at(F.split(F.col(name), "::"), -1)


#: Latin letters with marks and the plain ones they stand for.
ACCENTED = "áàâäãåāăąéèêëēĕėęěíìîïĩīĭįóòôöõōŏőúùûüũūŭůűųýÿŷçćĉċčñńņňśŝşšžźżďťţřŕŗľĺļģğĝġķĥĵŵ"
PLAIN = "aaaaaaaaaeeeeeeeeeiiiiiiiioooooooouuuuuuuuuuyyycccccnnnnsssszzzdttrrrlllggggkhjw"


def search_tokens(text: Column) -> Column:
    """Lower-case words without accents; everything but letters and digits separates them."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}\p{Co}]+"), lambda x: x != "")


