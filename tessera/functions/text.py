"""Text functions as Spark columns: tokens, variants, similarity."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed list: words that search ignores.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "the", "to", "with")


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def token_variants(text: Column) -> Column:
    """Tokens without stopwords, each followed by its forms without a final s and ing."""
    kept = F.filter(tokens(text), lambda t: ~t.isin(*STOPWORDS))

    def forms(t: Column) -> Column:
        plain = F.when((F.length(t) > 3) & t.endswith("s"), F.substr(t, F.lit(1), F.length(t) - 1))
        stem = F.when((F.length(t) > 5) & t.endswith("ing"), F.substr(t, F.lit(1), F.length(t) - 3))
        return F.array_distinct(F.array_compact(F.array(t, plain, stem)))

    return F.flatten(F.transform(kept, forms))


def label_key(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Share of the union of two arrays that both have; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


#: Fixed list: words that name no theme.
THEME_STOPWORDS = (
    "the", "and", "with", "for", "from", "that", "this", "into", "over", "under", "between", "through", "about", "after", "before", "looking",
    "images", "image", "first", "last", "reference", "feature", "active", "not", "are", "was", "were", "has", "have", "but", "also", "very", "more",
    "most", "some", "other", "each", "all", "both", "such", "than", "when", "where", "which", "while", "being", "having", "their", "these", "those",
    "what", "will", "can", "may", "its", "various", "multiple", "different", "similar", "visible", "present", "showing", "including", "versus",
)
#: Stop words of term weights where the caller gives no list of its own.
TERM_STOPWORDS = tuple(sorted({*STOPWORDS, *THEME_STOPWORDS}))
#: Characters aside at the ends of a word.
MARKS = ".,;:()\"'-/"


def clean_word(word: Column) -> Column:
    """A word without the marks at its ends; null if it is short or names no theme."""
    bare = F.btrim(F.lower(word), F.lit(MARKS))
    return F.when((F.length(bare) > 2) & ~bare.isin(*THEME_STOPWORDS), bare)


#: Hashes of trigrams that a task remembers.
REMEMBERED = 200_000


def hashed_vector(text: Column, dims: int = 16) -> Column:
    """Counts of the hashed trigrams of a text in ``dims`` cells: the built-in embedder.

    A text under three characters is one trigram, null has none.  The counts of an Arrow batch come of one count.
    """

    @F.arrow_udf("array<double>")
    def vectors(column: pa.Array) -> pa.Array:
        known: dict[str, int] = {}
        cells, ends = [], np.zeros(len(column), np.int64)
        for i, t in enumerate(column.to_pylist()):
            for at in range(max(1, len(t) - 2) if t is not None else 0):
                gram = t[at : at + 3]
                cell = known.get(gram)
                if cell is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    cell = known[gram] = int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % dims
                cells.append(cell)
            ends[i] = len(cells)
        rows = np.repeat(np.arange(len(column)), np.diff(ends, prepend=0))
        counts = np.bincount(rows * dims + np.array(cells, np.int64), minlength=len(column) * dims).astype(np.float64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * dims), pa.array(counts))

    return vectors(text)


def hashed_vector_sql(text: str, dims: int = 16) -> str:
    """The same in DuckDB's SQL."""
    cells = f"list_transform(range(1, greatest(length({text}) - 1, 2)), lambda i: ('0x' || substr(md5(substr({text}, i, 3)), 1, 8))::BIGINT % {dims})"
    return f"list_transform(range(0, {dims}), lambda d: len(list_filter({cells}, lambda c: c = d))::DOUBLE)"


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is null or has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(size > 1e-8, dot(a, b) / size), F.lit(0.0))


def aligned(label: Column, terms: Column) -> Column:
    """Whether one of the first five terms is in a label, or one of its words in a term; an empty label has none."""
    low = F.lower(label)
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    return (F.size(words) > 0) & F.exists(F.slice(terms, 1, 5), lambda t: F.contains(low, F.lower(t)) | F.exists(words, lambda w: F.contains(F.lower(t), w)))
