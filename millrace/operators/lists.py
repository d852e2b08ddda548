"""Edits of short lists held in a column, and the first element that satisfies a predicate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.values import trim


def added(items: Column, raw: Column) -> Column:
    """Trimmed and upper-cased, at the end; nothing changes for an empty or present one."""
    t = F.upper(trim(raw))
    return F.when((t == "") | F.array_contains(items, t), items).otherwise(F.array_append(items, t))


def already_there(items: Column, raw: Column) -> Column:
    t = F.upper(trim(raw))
    return F.when((t != "") & F.array_contains(items, t), F.concat(t, F.lit(" is already on your list.")))


def removed(items: Column, item: Column) -> Column:
    return F.array_remove(items, item)


def index_of(items: Column, item: Column) -> Column:
    """From 0; -1 if it is not there."""
    return F.array_position(items, item) - 1


def restored(items: Column, index: Column, item: Column) -> Column:
    """Put back at its old index, or at the end of a list that has become shorter."""
    return F.array_insert(items, (F.least(index, F.size(items)) + 1).cast("int"), item)


def toggled(items: Column, item: Column) -> Column:
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, item))


def first_where(items: Column, predicate: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(items, predicate), F.lit(1))
