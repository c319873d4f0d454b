"""Text expressions of the recognition operators."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the recognition engines; others weigh 1. Fixed values.
ENGINE_WEIGHTS = {"paddleocr": 1.5, "easyocr": 1.2, "tesseract": 1.0}
#: Language codes of two engines by short code. Fixed values.
LANGUAGES = {"ru": "rus", "en": "eng", "de": "deu", "fr": "fra", "es": "spa", "it": "ita", "zh": "chi_sim", "ja": "jpn", "ko": "kor"}
SINGLE_LANGUAGE = {"ru": "ru", "en": "en", "de": "german", "fr": "fr", "es": "es", "it": "it", "zh": "ch", "ja": "japan", "ko": "korean"}
#: What str.split() without arguments cuts at, as a Java class.
_BLANK = r"(?U)[\s\x1c-\x1f]+"


def normalized(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), _BLANK, " "))


def blank(text: Column) -> Column:
    return F.coalesce(normalized(text), F.lit("")) == ""


def engine_weight(source: Column) -> Column:
    pairs = [F.lit(x) for kv in ENGINE_WEIGHTS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[source], F.lit(1.0))


def mapped_languages(codes: Column) -> Column:
    """Codes of an array, mapped where known, joined by +."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    table = F.create_map(*pairs)
    return F.array_join(F.transform(codes, lambda c: F.coalesce(F.try_element_at(table, c), c)), "+")


def single_language(codes: Column) -> Column:
    """The first code of an array that the one-language engine knows, in its terms, else en."""
    table = F.create_map(*[F.lit(x) for kv in SINGLE_LANGUAGE.items() for x in kv])
    known = F.filter(F.transform(codes, lambda c: F.try_element_at(table, c)), lambda c: c.isNotNull())
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.lit("en"))


def indel_ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / (lengths), for texts of any length; 1 for two empty ones. The row of the table is
    one integer, and each character of the longer text takes an addition."""
    if a == b:
        return 1.0
    if len(a) < len(b):
        a, b = b, a
    place: dict[str, int] = {}
    for i, c in enumerate(b):
        place[c] = place.get(c, 0) | 1 << i
    full = row = (1 << len(b)) - 1
    for c in a:
        u = row & place.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return 2.0 * (len(b) - row.bit_count()) / (len(a) + len(b))


def mean_similarity(texts: list[str]) -> float:
    """Mean ratio over the pairs (0,1), (0,2), (1,2), ... in this order, summed from the left; 1 for one text."""
    ratios = [indel_ratio(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :]]
    # sum() would carry the rounding errors along, and 0.8 decides.
    return reduce(add, ratios) / len(ratios) if ratios else 1.0


def positional_match(a: Column, b: Column) -> Column:
    """Share of places that hold the same character, over the longer text's length; 1 for two empty texts."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when(longest > 0, F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(same / longest)).otherwise(1.0)


def sheet_name(name: Column) -> Column:
    r"""Characters \ / * ? : [ ] as _, at most 31 characters, Sheet for none."""
    made = F.substring(F.translate(F.coalesce(name, F.lit("")), "\\/*?:[]", "_______"), 1, 31)
    return F.when(made == "", "Sheet").otherwise(made)


def column_width(longest: Column) -> Column:
    return F.least(longest + 2, F.lit(50))
