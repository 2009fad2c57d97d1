"""Text functions as Column expressions: no Python runs on the executors.

White space means what it means to Python's ``str.strip`` and ``str.split``: Unicode space
and the separators 0x1C-0x1F. Word boundaries are look-arounds over letters, digits and ``_``,
since the boundary classes of regex engines differ on combining marks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words dropped from titles, in order of preference; the labels and their
# keywords; the details that enter a retrieval text, in order.
SIZE_WORDS = ("size", "small", "medium", "large", "x-large", "xl", "xxl", "xs", "s", "m", "l")
CATEGORY_KEYWORDS = {
    "women": ("women", "women's", "womens", "woman", "ladies", "lady"),
    "men": ("men", "men's", "mens", "man"),
    "kids": ("girls", "boys", "kids", "children", "child", "toddler", "baby"),
    "shoes": ("shoe", "shoes", "sneaker", "sneakers", "boot", "boots", "sandals", "heels"),
    "accessories": ("bag", "purse", "wallet", "hat", "cap", "belt", "scarf", "sunglasses", "watch", "jewelry"),
    "tops": ("shirt", "shirts", "top", "tops", "tee", "blouse", "sweater", "hoodie", "jacket"),
    "bottoms": ("pants", "jeans", "shorts", "skirt", "leggings", "trousers"),
    "dresses": ("dress", "dresses", "gown"),
}
DETAIL_KEYS = (
    "Department", "Material", "Material Composition", "Fabric Type", "Outer Material", "Sole Material", "Care Instructions",
    "Closure Type", "Fit Type", "Style",
)
TITLE_TOKENS = 12
UNCATEGORIZED = "uncategorized"

_SPACE = r"[\s\x1c-\x1f]+"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), rf"(?U)^{_SPACE}|{_SPACE}$", "")


def blank_to_null(c: Column | str) -> Column:
    """Stripped text, null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def has_text(c: Column | str) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def collapse_spaces(c: Column | str) -> Column:
    return strip(F.regexp_replace(_col(c), rf"(?U){_SPACE}", " "))


def clean_list(c: Column | str) -> Column:
    """Stripped entries, without nulls and blanks; a null list is empty."""
    return F.coalesce(F.filter(F.transform(_col(c), strip), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def normalize_title(c: Column | str) -> Column:
    """Lower case; without parentheses, size words and numbers; the first TITLE_TOKENS ASCII words."""
    t = F.regexp_replace(F.lower(_col(c)), r"\([^)]*\)", " ")
    t = F.regexp_replace(t, f"{_BEFORE}(?:{'|'.join(SIZE_WORDS)}){_AFTER}", " ")
    t = F.regexp_replace(t, rf"{_BEFORE}\p{{Nd}}+(?:\.\p{{Nd}}+)?{_AFTER}", " ")
    words = F.filter(F.split(F.regexp_replace(t, r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.slice(words, 1, TITLE_TOKENS), " ")


def categories(c: Column | str, lexicon: dict[str, tuple[str, ...]] = CATEGORY_KEYWORDS) -> Column:
    """Labels whose keywords stand in the title between spaces, in the lexicon's order."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(" "))

    def any_of(keywords: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for k in keywords:
            found = found | padded.contains(f" {k} ")
        return found

    hits = F.filter(F.array(*[F.when(any_of(k), F.lit(label)) for label, k in lexicon.items()]), lambda x: x.isNotNull())
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(UNCATEGORIZED)))


def retrieval_text(title: Column, features: Column, store: Column, details: list[tuple[str, Column]]) -> Column:
    """Title, ``- feature`` lines, store and the given details, without what is blank, one a line."""
    none = F.array().cast("array<string>")

    def line(prefix: str, c: Column) -> Column:
        return F.when(has_text(c), F.array(F.concat(F.lit(prefix), strip(c)))).otherwise(none)

    parts = [line("", title), F.transform(clean_list(features), lambda f: F.concat(F.lit("- "), f)), line("Store: ", store)]
    return F.array_join(F.concat(*parts, *[line(f"{k}: ", c) for k, c in details]), "\n")


def token_estimate(c: Column | str) -> Column:
    """A third of the characters, rounded up, at least 1: the estimate without a tokenizer."""
    return F.greatest(F.lit(1), F.floor((F.length(_col(c)) + 2) / 3)).cast("bigint")


def first_lines(c: Column | str) -> Column:
    return F.split(_col(c), "\n", -1)


def escape_pipes(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("|"), F.lit("\\|"))


def is_http_url(c: Column | str) -> Column:
    """An http or https URL with a host, no white space."""
    return F.coalesce(_col(c).rlike(r"^(?i:https?)://[^\s/?#]+\S*$"), F.lit(False))
