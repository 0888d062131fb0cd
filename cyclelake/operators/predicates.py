"""Filters, search and paging over the cell table.

The search mini-language is tokenised on the driver (it is a few characters of user input); what it
produces is an ordinary ``Column`` predicate, so the filtering itself runs in Spark and simple comparisons
reach the parquet scan as pushed filters.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import FILTER_COLUMNS, SEARCH_COLUMNS, is_numeric

CELL = "cell_id"
PAGE_SIZE = 50
# Fixed value: the ``column:value`` pair pattern (a leading '-' is accepted in values, quirk Q3).
PAIR_PATTERN = r"(\w+):\s*([\w.%<>=-]+)"


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def filter_equals(df: DataFrame, filters: dict) -> DataFrame:
    """B1: AND of ``column == value``; empty values and unknown columns are ignored."""
    preds = [F.col(c) == F.lit(v) for c, v in filters.items() if v not in (None, "") and c in df.columns]
    return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df


def filter_choices(df: DataFrame, choices: dict) -> DataFrame:
    """B2: widget choices are text, so the column is compared as text (Q2)."""
    preds = [_text(c) == F.lit(str(v)) for c, v in choices.items() if v not in (None, "") and c in df.columns]
    return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df


def text_search_predicate(df: DataFrame, query: str, columns=SEARCH_COLUMNS) -> Column | None:
    """Literal, case-sensitive substring in any of the present search columns."""
    present = [c for c in columns if c in df.columns]
    if not query or not present:
        return None
    return reduce(lambda a, b: a | b, [_text(c).contains(F.lit(query)) for c in present])


def search_cells(df: DataFrame, query: str) -> DataFrame:
    pred = text_search_predicate(df, query)
    return df.filter(pred) if pred is not None else df


@dataclass
class ParsedSearch:
    predicate: Column | None
    notes: list[str] = field(default_factory=list)
    applied: bool = False


def _lower_text(c: str) -> Column:
    return F.lower(_text(c))


def _compare(df: DataFrame, name: str, num: Column, op: str, v: float) -> Column:
    """``num op v``. On an integer column the bound is turned into an integer with the same meaning, so the
    comparison stays on the column itself (no cast to double) and is pushed down to the scan."""
    if isinstance(df.schema[name].dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) \
            and math.isfinite(v):
        if op == ">=":
            return num >= math.ceil(v)
        if op == ">":
            return num > math.floor(v)
        if op == "<=":
            return num <= math.floor(v)
        if op == "<":
            return num < math.ceil(v)
        return (num == int(v)) if v == int(v) else F.lit(False)
    return {">=": num >= v, "<=": num <= v, ">": num > v, "<": num < v, "=": num == v}[op]


def parse_search(df: DataFrame, query: str) -> ParsedSearch:
    """``column:value`` pairs (AND) and free text (regex over every column), case-insensitive.

    * ``col:>=v``, ``col:<=v``, ``col:>v``, ``col:<v``: numeric comparison (a bad number → note, no filter);
    * ``col:=v``: numeric equality, or literal substring when ``v`` is not a number;
    * ``col:v``: literal substring of the column as text;
    * what remains after removing the pairs (by match span): one regex, OR over every column as text.
    Unknown columns give a note and no filter.
    """
    out = ParsedSearch(None)
    if not query:
        return out
    preds: list[Column] = []
    lower_names = {c.lower(): c for c in df.columns}
    for name, value in re.findall(PAIR_PATTERN, query):
        value = value.lower()
        actual = lower_names.get(name.lower())
        if actual is None:
            out.notes.append(f"no column is called {name!r}; the term is left out")
            continue
        # numeric columns are compared as they are, so the predicate reaches the scan as a pushed filter;
        # text columns are read as numbers where they parse (NULL, so no match, where they do not)
        num = F.col(actual) if is_numeric(df, actual) else F.col(actual).try_cast("double")
        if any(op in value for op in (">", "<", "=")):
            op = next(o for o in (">=", "<=", ">", "<", "=") if o in value)
            raw = value.replace(op, "").strip()
            try:
                v = float(raw)
            except ValueError:
                if op == "=":
                    preds.append(_lower_text(actual).contains(F.lit(raw)))
                    out.applied = True
                else:
                    out.notes.append(f"{value!r} holds no number; the term is left out")
                continue
            preds.append(_compare(df, actual, num, op, v))
        else:
            preds.append(_lower_text(actual).contains(F.lit(value)))
        out.applied = True
    rest = re.sub(PAIR_PATTERN, " ", query).strip()
    if rest:
        preds.append(reduce(lambda a, b: a | b, [_text(c).rlike("(?i)" + rest) for c in df.columns]))
        out.applied = True
    if preds:
        # plain AND: a NULL comparison drops the row in a filter and is not counted by count_if, exactly like
        # false, and un-wrapped comparisons can be pushed down to the scan
        out.predicate = reduce(lambda a, b: a & b, preds)
    return out


def apply_search(df: DataFrame, query: str) -> tuple[DataFrame, list[str]]:
    parsed = parse_search(df, query)
    return (df.filter(parsed.predicate) if parsed.predicate is not None else df), parsed.notes


def match_summary(df: DataFrame, query: str) -> DataFrame:
    """One row ``(found, total)`` from a single aggregate."""
    parsed = parse_search(df, query)
    pred = parsed.predicate if parsed.predicate is not None else F.lit(True)
    return df.agg(F.count_if(pred).cast("long").alias("found"), F.count(F.lit(1)).cast("long").alias("total"))


def display_columns(df: DataFrame, chosen: list[str]) -> DataFrame:
    """``cell_id`` first, then the chosen columns without repeats."""
    cols = [CELL] + [c for c in dict.fromkeys(chosen) if c != CELL and c in df.columns]
    return df.select(*cols)


def base_projection(df: DataFrame) -> DataFrame:
    """Drop the derived specific-metric columns."""
    return df.select(*[c for c in df.columns if not c.endswith(("_specific_mAh_g", "_specific_Wh_g"))])


def page(df: DataFrame, number: int, order_by: str = CELL, size: int = PAGE_SIZE) -> DataFrame:
    """page ``number`` (0-based) of ``size`` rows in ``order_by`` order."""
    return df.orderBy(order_by).offset(number * size).limit(size)


def filter_choice_values(df: DataFrame, columns=FILTER_COLUMNS) -> DataFrame:
    """``(column_name, choice)`` = distinct non-null values as text, plus the empty 'no filter' choice.

    One unpivot + distinct (partial aggregation per task); the display order is ``orderBy(column_name, choice)``.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "column_name string, choice string")
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), _text(c).alias("choice")) for c in present])
    values = df.select(F.inline(items)).filter(F.col("choice").isNotNull()).distinct()
    empty = df.sparkSession.createDataFrame([(c, "") for c in present], "column_name string, choice string")
    return values.unionByName(empty).distinct()


def sorted_choices(df: DataFrame, columns=FILTER_COLUMNS) -> DataFrame:
    """``(column_name, place, choice)``, each column's choices in text order from 1.

    The window runs over distinct values of one column, which a choice list shows whole.
    """
    place = F.row_number().over(Window.partitionBy("column_name").orderBy("choice"))
    return filter_choice_values(df, columns).select("column_name", place.alias("place"), "choice")
