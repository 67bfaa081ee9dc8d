"""Language strategies: what a language must provide to be indexed. Register more with ``register``."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from code_impact.operators import diff, java
from code_impact.operators.modules import ModuleStrategy


class LanguageStrategy(Protocol):
    def extract(self, files: DataFrame) -> DataFrame:
        """Files to one row per class, with the columns of ``java.java_types``."""

    def breaking_changes(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Breaking changes between two results of ``extract``.

        A strategy may also have ``link(types, files)``, which adds edges that need more than one file.
        """


class JavaStrategy:
    def extract(self, files: DataFrame) -> DataFrame:
        return java.java_types(files)

    def breaking_changes(self, old: DataFrame, new: DataFrame) -> DataFrame:
        return diff.breaking_changes(old, new)


STRATEGIES: dict[str, LanguageStrategy] = {"java": JavaStrategy()}

# With JavaScript and TypeScript, which share one strategy and so one pass over the files.
_modules = ModuleStrategy()
EVERY: dict[str, LanguageStrategy] = STRATEGIES | {"typescript": _modules, "javascript": _modules}


def register(language: str, strategy: LanguageStrategy) -> None:
    STRATEGIES[language] = strategy
