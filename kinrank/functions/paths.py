"""Path features (T1-T7, T9) as Spark column expressions.

Every function takes and returns ``Column`` objects, so a job builds all
features in one projection that Catalyst keeps JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wordlists as W

# A token boundary sits before an upper-case letter that follows a lower-case one.
CAMEL_BOUNDARY = r"(?<=\p{IsLowercase})(?=\p{IsUppercase})"
# Separators for path tokens: slash, backslash, dot, dash and underscore.
TOKEN_SEPARATORS = r"[/\\.\-_]+"


def words(values) -> Column:
    """Array literal of strings (a small, fixed list)."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(c) -> Column:
    """Split on / \\ . - _ and lower->upper case changes; lower-case; no empties."""
    marked = F.regexp_replace(_col(c), CAMEL_BOUNDARY, "_")
    parts = F.split(marked, TOKEN_SEPARATORS)
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.lower(x))


def file_name(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def parent_dir(path) -> Column:
    """Everything before the last slash; '' for a file at the root."""
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)


def dir_parts(path) -> Column:
    """Components of the parent folder (empty array at the root)."""
    d = parent_dir(path)
    return F.filter(F.split(d, "/"), lambda x: x != "")


def name_without_extensions(path) -> Column:
    """Last component with all extensions removed, original case.

    A leading dot belongs to the name: '.eslintrc.json' -> '.eslintrc'.
    """
    return F.regexp_extract(file_name(path), r"^(\.?[^.]*)", 1)


def normalize(path) -> Column:
    """Tokens of the whole path after stripping the extensions of its name."""
    p = _col(path)
    base = name_without_extensions(p)
    d = parent_dir(p)
    return tokenize(F.when(d == "", base).otherwise(F.concat(d, F.lit("/"), base)))


def stem_original(path) -> Column:
    """Name up to its first dot, original case ('' for dot-files)."""
    return F.element_at(F.split(file_name(path), r"\."), 1)


def primary_stem(path) -> Column:
    """T3."""
    return F.lower(stem_original(path))


def basename(path) -> Column:
    """T4: lower-cased name without extensions."""
    return F.lower(name_without_extensions(path))


def extension_tokens(path) -> Column:
    """T5: dot-separated parts after the first one, non-empty, lower-cased."""
    parts = F.split(file_name(path), r"\.")
    return F.transform(F.filter(parts, lambda x, i: (i > 0) & (x != "")), lambda x: F.lower(x))


def without(tokens: Column, stop) -> Column:
    stop_arr = words(stop)
    return F.filter(tokens, lambda x: ~F.array_contains(stop_arr, x))


def domain_tokens(path, type_words=W.TYPE_WORDS, generic_stems=W.GENERIC_STEMS) -> Column:
    """What the file is about.

    Generic stems (index, show, ...) take the parent folder's tokens when that
    leaves anything after dropping role words; otherwise the stem's own tokens
    minus role words.
    """
    p = _col(path)
    stem = stem_original(p)
    parent_name = F.substring_index(parent_dir(p), "/", -1)
    from_parent = without(tokenize(parent_name), type_words)
    from_stem = without(tokenize(stem), type_words)
    is_generic = F.array_contains(words(generic_stems), F.lower(stem))
    return F.when(is_generic & (F.size(from_parent) > 0), from_parent).otherwise(from_stem)


def token_weight(token: Column, noise=W.NOISE_TOKENS, noise_weight=W.NOISE_WEIGHT) -> Column:
    """T7."""
    return F.when(F.array_contains(words(noise), token), F.lit(noise_weight)).otherwise(F.lit(1.0))


def last_extension(path) -> Column:
    """Extension as a file system sees it: after the last dot, unless the only
    dot is a leading one."""
    name = file_name(path)
    return F.when(name.rlike(r"^\.?[^.]*$"), F.lit("")).otherwise(F.substring_index(name, ".", -1))


def language(path) -> Column:
    """Language from the (case-sensitive) last extension."""
    known = F.create_map(*[F.lit(x) for pair in W.LANGUAGE_BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.try_element_at(known, last_extension(path)), F.lit("generic"))
