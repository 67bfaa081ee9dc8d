"""Predicates and labels on file paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories never scanned.
IGNORED_DIRS = [
    "node_modules", ".git", "target", "build", "dist", ".idea", ".vscode", "out", "bin", ".gradle", ".mvn",
    "__pycache__", ".pytest_cache", "venv", ".env",
]

# Language by file suffix.
LANGUAGE_BY_SUFFIX = {
    "java": "java", "kt": "kotlin", "scala": "scala",
    "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyw": "python", "pyi": "python",
    "cs": "csharp", "vb": "vbnet", "fs": "fsharp",
    "go": "go", "rb": "ruby", "rake": "ruby", "php": "php",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "rs": "rust", "swift": "swift",
}

# Language by the end of the file name, tried in this order after the suffixes.
LANGUAGE_BY_NAME = {
    "dockerfile": "dockerfile", "makefile": "makefile", "rakefile": "ruby", "gemfile": "ruby",
    "package.json": "json", "pom.xml": "maven", "build.gradle": "gradle",
}

# Detected languages that are not source code.
NON_SOURCE_LANGUAGES = ["json", "maven", "gradle", "dockerfile", "makefile"]

# Path fragments left out of reviews.
REVIEW_IGNORED = [
    "node_modules/", ".git/", "dist/", "build/", "coverage/", ".aws-sam/", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
]

# Suffixes a review accepts, suffixes of text files, suffixes the impact analysis reads.
REVIEW_SUFFIXES = [
    ".js", ".jsx", ".ts", ".tsx", ".py", ".java", ".cs", ".go", ".json", ".yaml", ".yml", ".md", ".txt", ".sql", ".sh", ".dockerfile",
]
TEXT_SUFFIXES = [
    ".js", ".jsx", ".ts", ".tsx", ".py", ".java", ".cs", ".go", ".json", ".yaml", ".yml", ".xml", ".html", ".css", ".scss",
    ".md", ".txt", ".sql", ".sh", ".dockerfile",
]
IMPACT_SUFFIXES = [".java", ".ts", ".js", ".py", ".go", ".cs", ".cpp", ".c"]

MAX_FILES_PER_PR = 50
MAX_FILE_MB = 10


def detect_language(path: Column) -> Column:
    """Language of a path, null when unknown."""
    low = F.lower(path)
    pairs = [F.lit(v) for pair in LANGUAGE_BY_SUFFIX.items() for v in pair]
    by_suffix = F.when(F.contains(low, F.lit(".")), F.try_element_at(F.create_map(*pairs), F.substring_index(low, ".", -1)))
    by_name = F.lit(None).cast("string")
    for name, language in reversed(LANGUAGE_BY_NAME.items()):
        by_name = F.when(low.endswith(name), language).otherwise(by_name)
    return F.coalesce(by_suffix, by_name)


def is_source(language: Column) -> Column:
    return language.isNotNull() & ~language.isin(NON_SOURCE_LANGUAGES)


def extension(path: Column) -> Column:
    """Text from the last dot on, lower-cased; the whole name when there is no dot."""
    low = F.lower(path)
    return F.when(F.contains(low, F.lit(".")), F.concat(F.lit("."), F.substring_index(low, ".", -1))).otherwise(low)


def is_review_supported(path: Column) -> Column:
    return extension(path).isin(REVIEW_SUFFIXES)


def is_review_ignored(path: Column) -> Column:
    hit = F.lit(False)
    for fragment in REVIEW_IGNORED:
        hit = hit | F.contains(path, F.lit(fragment))
    return hit


def is_reviewable(path: Column) -> Column:
    return is_review_supported(path) & ~is_review_ignored(path)


def is_text_file(path: Column) -> Column:
    return extension(path).isin(TEXT_SUFFIXES)


def is_impact_source(path: Column) -> Column:
    """Case-sensitive suffix test of the impact analysis."""
    return path.rlike("(?:" + "|".join(re.escape(s) for s in IMPACT_SUFFIXES) + ")$")


def class_of_file(path: Column) -> Column:
    """File name with the first ``.java``, then ``.ts``, then ``.js`` taken out."""
    name = F.substring_index(path, "/", -1)
    # Few names have more than one of them, and a search for a text costs far less than a pattern.
    for suffix in (".java", ".ts", ".js"):
        name = F.when(F.contains(name, F.lit(suffix)), F.regexp_replace(name, rf"^(.*?)\{suffix}", "$1")).otherwise(name)
    return name


def glob_to_regex(glob: str) -> str:
    """``**`` crosses folders, ``*`` does not; a pattern without ``/`` is matched against the file name."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(known.get(p, re.escape(p)) for p in parts)
    return f"^{body}$" if "/" in glob else f"(?:^|/){body}$"
