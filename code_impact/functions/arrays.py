"""Array expressions that stay inside one row: binding, running sums, token rewriting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def sums_before(values: Column) -> Column:
    """Exclusive running sums of an INT array. Works on blocks of sqrt(n), so the cost is n * sqrt(n), not n * n."""

    def over(arr: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(arr)))).cast("int")

        def with_blocks(blocks: Column) -> Column:
            def with_starts(starts: Column) -> Column:
                return F.flatten(
                    F.transform(
                        blocks,
                        lambda block, b: let(
                            F.get(starts, b),
                            lambda start: F.transform(block, lambda _x, i: start + _total(F.slice(block, 1, i))),
                        ),
                    )
                )

            starts = let(
                F.transform(blocks, _total),
                lambda totals: F.transform(totals, lambda _x, b: _total(F.slice(totals, 1, b))),
            )
            return let(starts, with_starts)

        blocks = let(
            width,
            lambda w: F.transform(F.sequence(F.lit(0), ((F.size(arr) - 1) / w).cast("int")), lambda b: F.slice(arr, b * w + 1, w)),
        )
        return F.when(F.size(arr) == 0, F.array().cast("array<int>")).otherwise(let(blocks, with_blocks))

    return let(values, over)


def rewrite_tokens(text: Column, pattern: str, replace: Callable[[Column], Column]) -> Column:
    """Replace each match of ``pattern`` by an expression over the matched text."""
    gaps = F.split(text, pattern, -1)
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(gaps, tokens, lambda gap, token: F.concat(gap, F.coalesce(replace(token), F.lit(""))))
    return F.array_join(pieces, "")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def each(values: Column) -> Column:
    """Input for a generator over a computed array. A bare column would make the optimizer infer a size filter, push it
    below the projection and so compute the array twice."""
    return F.filter(values, lambda v: v.isNotNull())


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and fields use many times. The one-element generator keeps the optimizer
    from moving those uses below it, where each would evaluate ``value`` again."""
    return df.select("*", F.explode(F.array(value)).alias(name))
