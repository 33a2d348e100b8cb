"""Text building blocks: token patterns and stop-word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regex; (?U) makes \w and \b Unicode-aware (accented letters are word
# characters, as in Python's default Unicode matching).
DEFAULT_TOKEN = r"(?U)\b\w\w+\b"  # words of 2+ characters (corpus / per-cluster TF-IDF)
MIXED_TOKEN = r"(?U)\b\w+\b"      # words of 1+ characters (mixed-type features)

# Fixed values (must equal the reference's custom French stop-word list, in its
# own order; repeated entries are kept as they appear, the set has 102 words).
FRENCH_CUSTOM = [
    'le', 'de', 'et', 'à', 'un', 'il', 'être', 'et', 'en', 'avoir', 'que', 'pour',
    'dans', 'ce', 'son', 'une', 'sur', 'avec', 'ne', 'se', 'pas', 'tout', 'plus',
    'par', 'grand', 'mais', 'si', 'ou', 'leur', 'bien', 'encore', 'pouvoir', 'aussi',
    'sans', 'autre', 'après', 'très', 'donc', 'aller', 'savoir', 'faire', 'voir',
    'donner', 'prendre', 'venir', 'falloir', 'vouloir', 'dire', 'quelque', 'où',
    'lui', 'nous', 'comme', 'alors', 'même', 'cette', 'votre', 'notre', 'trop',
    'peu', 'avant', 'deux', 'trois', 'toujours', 'jamais', 'souvent', 'peut',
    'peuvent', 'cette', 'ces', 'cela', 'celui', 'celle', 'ceux', 'celles', 'aussi',
    'ainsi', 'alors', 'après', 'avant', 'avec', 'beaucoup', 'bien', 'car', 'chez',
    'comme', 'comment', 'dans', 'depuis', 'dont', 'encore', 'entre', 'jusqu',
    'lors', 'pendant', 'plutôt', 'pour', 'près', 'puis', 'quand', 'que', 'quel',
    'quelle', 'quels', 'quelles', 'qui', 'sans', 'selon', 'sous', 'sur', 'tous',
    'toute', 'toutes', 'tout', 'très', 'vers', 'voici', 'voilà', 'là', 'où',
]

# Extra entries the mixed-type text path adds to the library list.
MIXED_EXTRA = ['', 'nan', 'na', 'manquant']


def stop_words(name: str = "french_custom") -> list[str]:
    """E7: 'french_custom' (default), 'french' (Spark's bundled French list),
    'french_mixed' (Spark's list plus the mixed-path extras), or 'none'."""
    if name == "none":
        return []
    if name == "french_custom":
        return sorted(set(FRENCH_CUSTOM))
    from pyspark.ml.feature import StopWordsRemover
    base = StopWordsRemover.loadDefaultStopWords("french")
    if name == "french":
        return base
    if name == "french_mixed":
        return base + MIXED_EXTRA
    raise ValueError(f"unknown stop-word list {name!r}")


# Splitting on runs of non-word characters and keeping pieces of the minimum
# length gives the same tokens, in order, as finding \b\w{min,}\b matches.
SPLIT = r"(?U)[^\w]+"


def min_length(pattern: str) -> int:
    return 2 if pattern == DEFAULT_TOKEN else 1


def split_tokens(col, pattern: str = DEFAULT_TOKEN) -> Column:
    """Lower-cased tokens (duplicates kept), before stop-word removal."""
    c = F.col(col) if isinstance(col, str) else col
    n = min_length(pattern)
    parts = F.split(F.lower(F.coalesce(c.cast("string"), F.lit(""))), SPLIT)
    return F.filter(parts, lambda t: F.length(t) >= n)


def tokenize(col, pattern: str = DEFAULT_TOKEN, stops: list[str] | None = None) -> Column:
    """Lower-case, extract the tokens, drop stop words (duplicates kept)."""
    toks = split_tokens(col, pattern)
    if stops:
        sw = F.array(*[F.lit(s) for s in sorted(set(stops))])
        toks = F.filter(toks, lambda t: ~F.array_contains(sw, t))
    return toks
