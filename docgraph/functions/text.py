"""Names, titles, slugs, paths and snippets."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgraph.operators.text import snippet

__all__ = ["relative_path", "slug", "snake_case", "snippet", "subsequence", "title_of"]


def relative_path(a: str, b: str) -> str:
    """The way from file a's folder to file b."""
    return posixpath.relpath(b, posixpath.dirname(a) or ".")


def title_of(file: Column, suffix: str = ".qmd.md") -> Column:
    """A title from a file's name: words with capitals."""
    name = F.element_at(F.split(file, "/"), -1)
    return F.initcap(F.regexp_replace(F.regexp_replace(name, re.escape(suffix) + "$", ""), "[-_]+", " "))


def snake_case(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(c, r"[^\w\s-]", ""), r"[\s-]+", "_")), "^_+|_+$", "")


def slug(c: Column) -> Column:
    """A section's label for ids: no marks nor brackets' content, at most 40 characters, 'section' for none."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[#*`]", ""), ":+$", ""), r"\([^)]*\)", "")
    short = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(plain)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 40)
    return F.when(short == "", "section").otherwise(short)


def subsequence(c: Column, letters: str) -> Column:
    """Whether a text has the letters in that order, whatever the case and what stands between."""
    return F.lower(c).rlike(".*".join(re.escape(x) for x in letters.lower()))
