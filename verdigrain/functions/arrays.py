"""Array expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often the expression names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step: Callable[[Column, Column], Column], *, levels: int = 2, block: int = 256) -> Column:
    """Each element folded with all before it by an associative step, which keeps the elements' type.

    A fold that appends to an array copies it each time. So blocks are folded each, then their last
    elements in the same way, and those are brought into the blocks: for up to some millions of elements
    work is about the length times the block.
    """
    last = lambda a: F.element_at(a, -1)
    folded = lambda a: F.aggregate(F.slice(a, F.lit(2), F.size(a)), F.slice(a, 1, 1), lambda got, x: F.concat(got, F.array(step(last(got), x))))

    def of(v: Column) -> Column:
        if levels == 1:
            made = folded(v)
        else:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda i: F.slice(v, i * block + 1, F.lit(block)))
            moved = lambda parts, totals: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: step(F.get(totals, i - 1), x)))))
            made = let(F.transform(blocks, folded), lambda parts: let(running(F.transform(parts, last), step, levels=levels - 1, block=block), lambda totals: moved(parts, totals)))
        return F.when(F.size(v) > 0, made).otherwise(v)

    return let(values, of)


def prefix_sums(values: Column) -> Column:
    """0, then the sum of the first element, of the first two, and so on."""
    return F.concat(F.array(F.lit(0).cast("bigint")), running(F.transform(values, lambda x: x.cast("bigint")), lambda a, b: a + b))


def at(values: Column, index: Column) -> Column:
    """The element at an index from 0."""
    return F.element_at(values, (index + 1).cast("int"))


def compacted(items: list[Column]) -> Column:
    """The items that aren't null, in order."""
    return F.array_compact(F.array(*items))


def first_of(items: list[Column], good: Callable[[Column], Column]) -> Column:
    """The first item that isn't null and is good."""
    return F.coalesce(*[F.when(good(x), x) for x in items])
