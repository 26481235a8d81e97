"""Column functions on text and vectors; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it (fixed values).
SPACE_CLASS = r"[\t\n\x0B\f\r\x1C-\x20\x85\xA0  -     　]"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f names it: written out at each place, long
    expressions grow past what Spark compiles."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Unicode words (letters, digits, underscore)."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def token_count(text: Column) -> Column:
    return F.size(word_tokens(text))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def single_spaced(text: Column) -> Column:
    return stripped(F.regexp_replace(text, f"{SPACE_CLASS}+", " "))


def excerpt(text: Column, most: int = 240) -> Column:
    """White space single; cut to most characters, the last three then being dots."""
    t = single_spaced(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most - 3), r" +$", ""), F.lit("...")))


def trigrams(text: Column) -> Column:
    """The set of 3-character runs of a text, lower case, other signs than letters and digits as one _."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    grams = F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))
    return F.when(F.length(t) >= 3, F.array_sort(F.array_distinct(grams))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different sizes, empty ones and ones of no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (size == 0), F.lit(0.0)).otherwise(dot(a, b) / size)


def cosine_to(column: Column, query: list[float], norm: Column | None = None) -> Column:
    """cosine() with one vector: its length is computed once. norm: the stored length of column's vectors."""
    probe, size = F.array(*[F.lit(float(x)) for x in query]), sum(x * x for x in query) ** 0.5
    length = (norm if norm is not None else F.sqrt(dot(column, column))) * F.lit(size)
    return F.when((F.size(column) != len(query)) | (F.size(column) <= 0) | (length == 0), F.lit(0.0)).otherwise(dot(column, probe) / length)


def distance_score(distance: Column) -> Column:
    """Cosine distance as a score: 1 - clamp(d, 0, 2) / 2."""
    return 1 - F.least(F.greatest(distance, F.lit(0.0)), F.lit(2.0)) / 2


def target_path(path: Column, root: str = "") -> Column:
    """A link target as a vault path: without ./, with .md; null for addresses, anchors, artifacts,
    absolute paths and those that leave the vault."""
    p = F.regexp_replace(stripped(path), r"^(\./)+", "")
    bad = p.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://|^#|^artifact:|^evidence:|^/|(^|/)\.\.(/|$)") | (p == "")
    file = F.when(F.lower(p).endswith(".md"), p).otherwise(F.concat(p, F.lit(".md")))
    return F.when(~bad, F.concat(F.lit(root), file) if root else file)


def embedding_text(title: Column, heading: Column, content: Column, prefix: str = "passage: ") -> Column:
    """What is embedded for a chunk: its title, its heading where that is another, the content."""
    head = F.when(heading.isNotNull() & (heading != F.coalesce(title, F.lit(""))), F.concat(F.lit("Heading: "), heading))
    return F.concat(F.lit(prefix), F.concat_ws("\n", F.when(title.isNotNull(), F.concat(F.lit("Title: "), title)), head), F.lit("\n\n"), content)
