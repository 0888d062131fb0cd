"""Skew-safe ordering: positions within a group, halo-chunked windows, exact quantiles.

A per-cell ``Window.partitionBy("cell_id")`` sends every row of a cell to one task; one hot cell holding a
third of the table would then be one task. So groups are split by size (one small job gives the answer whether any
group is over ``HOT_GROUP_ROWS``; nothing about sizes is remembered between calls). Groups up to that size use one
plain window, whose partitions are then bounded; larger groups take these paths, which never put a whole group in
one task:

* :func:`with_positions` (any order) numbers rows within a large group through range partitions.
* :func:`with_block_positions` (integer order) numbers rows within a group (1, 2, ...). Rows are cut into blocks of order values, a
  crowded block further by value and row hash, and windows run inside (group, block, part); a table with one row per
  part supplies the number of the group's rows in earlier parts.
* :func:`with_chunks` cuts each group into chunks of ``chunk_rows`` consecutive positions and copies the
  last ``lookback`` rows of every chunk into the next one ("halo"). A window on ``(group, chunk)`` ordered by
  position then sees every row it needs for ``lag`` and ``rowsBetween(-lookback, 0)`` frames, and each window
  partition holds at most ``chunk_rows + lookback`` rows, however large the group.
* :func:`quantiles` sorts the values of small groups inside one aggregate. For larger groups a mergeable sketch
  brackets each rank, and only the values inside the bracket are counted and ranked, once per distinct value; brackets that are
  large themselves are narrowed, so that the last window is bounded whatever the group's size.

No path loses rows: NULL keys form a group as in a window, NULL order values come first, and rows that tie in order
are ordered by the hash of the whole row, so repeated runs agree and both paths give identical results.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.window import WindowSpec
from pyspark.sql import functions as F

from ..session import checkpoint_dir

POS = "_pos"
GROUP_ROWS = "_group_rows"
CHUNK = "_chunk"
HALO = "_halo"
TIE = "_tie"

#: Rows per window partition in chunked windows. Large enough that the halo copy is negligible,
#: small enough that one window partition always fits a task.
DEFAULT_CHUNK_ROWS = 65536

#: Groups up to this many rows are ordered with a plain window over the group (one shuffle; a window
#: partition is then bounded by this number). Larger ("hot") groups take the skew-safe paths below.
HOT_GROUP_ROWS = 1 << 20

#: Groups up to this many rows have their values gathered for exact quantiles. The aggregate may hold 128 groups
#: at once, so this is lower than the window's bound, which can spill.
GATHER_ROWS = 1 << 14

#: The sketch's rank error is at most rows / SKETCH_ACCURACY; brackets are twice as wide.
SKETCH_ACCURACY = 10000

#: A bracket of more distinct values than this (about) is cut into ``NARROW`` pieces by another sketch, and so on.
BRACKET_VALUES = 1 << 17
NARROW = 256


def hot_group_rows(df: DataFrame, value: int | None = None, default: int = HOT_GROUP_ROWS) -> int:
    """The hot-group threshold: ``value`` if given, else ``spark.cyclelake.hotGroupRows``, else the default.

    Setting the conf to 0 sends every group through the split paths (used to test them on small data).
    """
    if value is not None:
        return int(value)
    return int(df.sparkSession.conf.get("spark.cyclelake.hotGroupRows", str(default)))


def chunk_rows_for(df: DataFrame, value: int | None = None) -> int:
    if value is not None:
        return int(value)
    return int(df.sparkSession.conf.get("spark.cyclelake.chunkRows", str(DEFAULT_CHUNK_ROWS)))


def same_keys(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> list[Column]:
    """Null-safe equality of ``left``'s and ``right``'s columns, for joins that keep NULL groups."""
    return [left[a].eqNullSafe(right[b]) for a, b in pairs.items()]


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest ``keys`` group: a partial aggregate, and one row comes back."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.max("_n")).first()[0] or 0


def group_sizes_have_hot(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> bool:
    """Whether any ``keys`` group is over ``hot_rows``: a partial aggregate, and one row at most comes back."""
    hot_rows = hot_group_rows(df, hot_rows)
    if hot_rows <= 0:
        return True
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return bool(sizes.filter(F.col("_n") > hot_rows).limit(1).collect())


def with_tie(df: DataFrame) -> DataFrame:
    """Add the hash of the whole row, which orders rows that tie."""
    return df.withColumn(TIE, F.xxhash64(*df.columns))


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], pos_col: str = POS,
                   count_col: str | None = GROUP_ROWS, hot_rows: int | None = None,
                   known_hot: bool | None = None) -> DataFrame:
    """Add ``pos_col``: the 1-based position of the row in its group by any sortable ``order``, ties by row hash.

    Groups with at most ``hot_rows`` rows take one exchange and one window over the group. Larger groups, and a table without
    ``keys``, are numbered through range partitions (:func:`_ranged_positions`); the exchange, checkpoint and join of that path
    move only their rows. Both give identical positions. ``known_hot``: whether any group is larger, where known (else a job
    asks). ``count_col`` (optional) receives the group's size.
    """
    keys = list(keys)
    hot_rows = hot_group_rows(df, hot_rows)
    if not keys or hot_rows <= 0:
        return _ranged_positions(df, keys, order, pos_col, count_col, few_groups=not keys)
    if known_hot is None:
        known_hot = group_sizes_have_hot(df, keys, hot_rows)
    if not known_hot:
        return _windowed_positions(df, keys, order, pos_col, count_col)
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    big = big.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    same = same_keys(df, big, {k: f"_hot_{k}" for k in keys})
    small = _windowed_positions(df.join(big, same, "left_anti"), keys, order, pos_col, count_col)
    large = _ranged_positions(df.join(big, same, "left_semi"), keys, order, pos_col, count_col, few_groups=True)
    return small.unionByName(large)


def _windowed_positions(df: DataFrame, keys: list[str], order: Sequence[str | Column], pos_col: str,
                        count_col: str | None) -> DataFrame:
    """:func:`with_positions` of groups of bounded size. The row hash is made behind the exchange, which need not carry it."""
    rows = with_tie(df.repartition(*[F.col(k) for k in keys]))
    placed = Window.partitionBy(*keys).orderBy(*order, TIE)
    counts = {count_col: F.count(F.lit(1)).over(placed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    return rows.withColumns({**(counts if count_col else {}), pos_col: F.row_number().over(placed).cast("long")}).drop(TIE)


def _ranged_positions(df: DataFrame, keys: list[str], order: Sequence[str | Column], pos_col: str,
                      count_col: str | None, few_groups: bool) -> DataFrame:
    """:func:`with_positions` of groups of any size.

    Rows are range-partitioned by keys, order and hash (Spark samples the data, so neither a hot group nor a frequent
    value stays in one task) and numbered inside each partition. Partition counts and rows must come from one
    exchange, as two would sample differently; the rows are therefore checkpointed, lazily, to
    ``spark.checkpoint.dir``. With ``few_groups`` the counts, at most a row per group and partition border, are broadcast.
    """
    checkpoint_dir(df.sparkSession)
    rows = with_tie(df)
    sort = [*[F.col(k) for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order], F.col(TIE)]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumns(
        {"_piece": F.spark_partition_id(), "_line": F.monotonically_increasing_id()}).checkpoint(eager=False)
    counts = ranged.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"), F.min("_line").alias("_first"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(*[F.col(c).alias(f"_p_{c}") for c in (*keys, "_piece")], "_first",
                          F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ahead"),
                          *([F.sum("_n").over(group).alias(count_col)] if count_col else []))
    same = same_keys(ranged, ahead, {c: f"_p_{c}" for c in (*keys, "_piece")})
    out = ranged.join(F.broadcast(ahead) if few_groups else ahead, same)
    out = out.withColumn(pos_col, F.col("_ahead") + F.col("_line") - F.col("_first") + F.lit(1))
    return out.drop("_piece", "_line", TIE, *[c for c in ahead.columns if c != count_col])


def with_block_positions(df: DataFrame, keys: Sequence[str], order_col: str, tiebreak: Sequence[str] = (),
                         pos_col: str = POS, block_width: int = 4096) -> DataFrame:
    """Add ``pos_col``: the 1-based position of the row in its group by (``order_col``, row hash), NULLs first.

    ``order_col`` holds integers. Blocks are ``block_width`` consecutive values; a block with more rows than values
    (repeated numbers) is cut by value and then by the hash, so a window holds about ``block_width`` rows even when
    one value is frequent. (Rows equal in every column hash alike and stay together; with ``tiebreak`` columns, which
    order ties before the hash does, the rows of one value stay together.)
    """
    keys = list(keys)
    block = F.coalesce(F.floor(F.col(order_col) / F.lit(block_width)), F.lit(-(1 << 62)))
    rows = (df if TIE in df.columns else with_tie(df)).withColumn("_block", block)
    held = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_held")).filter(F.col("_held") > block_width)
    held = held.select(*[F.col(c).alias(f"_h_{c}") for c in (*keys, "_block")], "_held")
    rows = rows.join(held, same_keys(rows, held, {c: f"_h_{c}" for c in (*keys, "_block")}), "left")
    parts = F.ceil(F.col("_held") / F.lit(block_width))
    value = F.coalesce(F.col(order_col) - F.col("_block") * F.lit(block_width), F.lit(0))
    spread = F.floor(F.shiftrightunsigned(F.col(TIE).bitwiseXOR(F.lit(-(1 << 63))), 11) / F.lit(float(1 << 53)) * parts)
    spread = F.lit(0) if tiebreak else spread
    rows = rows.withColumn("_part", F.when(F.col("_held").isNull(), F.lit(0)).otherwise(value * parts + spread).cast("long"))
    rows = rows.drop(*held.columns)
    piece = [*keys, "_block", "_part"]
    inside = Window.partitionBy(*piece).orderBy(F.col(order_col), *[F.col(t) for t in tiebreak], F.col(TIE))
    rows = rows.withColumn("_local", F.row_number().over(inside))
    counts = rows.groupBy(*piece).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block", "_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(*[F.col(c).alias(f"_p_{c}") for c in piece],
                          F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ahead"))
    out = rows.join(ahead, same_keys(rows, ahead, {c: f"_p_{c}" for c in piece}))
    out = out.withColumn(pos_col, F.col("_ahead") + F.col("_local"))
    return out.drop("_block", "_part", "_local", *ahead.columns, *([TIE] if TIE not in df.columns else []))


def with_chunks(df: DataFrame, lookback: int, pos_col: str = POS,
                chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Assign ``_chunk`` and copy each chunk's last ``lookback`` rows into the next chunk with ``_halo`` = true.

    Windows must be ``partitionBy(*keys, "_chunk").orderBy(pos_col)``; drop halo rows afterwards with
    ``filter(~F.col("_halo"))`` (see :func:`drop_halo`).
    """
    if lookback >= chunk_rows:
        raise ValueError("lookback must be smaller than chunk_rows")
    home = F.floor((F.col(pos_col) - 1) / chunk_rows)
    in_tail = ((F.col(pos_col) - 1) % chunk_rows) >= (chunk_rows - lookback)
    targets = F.when(in_tail & F.lit(lookback > 0), F.array(home, home + 1)).otherwise(F.array(home))
    return (
        df.withColumn("_home_chunk", home)
        .withColumn(CHUNK, F.explode(targets))
        .withColumn(HALO, F.col(CHUNK) != F.col("_home_chunk"))
        .drop("_home_chunk")
    )


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(CHUNK, HALO)


def chunk_window(keys: Sequence[str], pos_col: str = POS):
    """The window spec that goes with :func:`with_chunks`."""
    return Window.partitionBy(*keys, CHUNK).orderBy(pos_col)


def ordered_columns(df: DataFrame, keys: Sequence[str], order_col: str,
                    build: Callable[[WindowSpec], dict[str, Column]], lookback: int,
                    tiebreak: Sequence[str] = (), hot_rows: int | None = None, chunk_rows: int | None = None,
                    known_hot: bool | None = None) -> DataFrame:
    """Add the columns ``build(window)`` returns, computed over each group's rows in ``order_col`` order.

    ``build`` receives an ordered window spec and may use ``lag`` and row frames reaching ``lookback`` rows
    back. Ties in ``order_col`` follow ``tiebreak``, then the hash of the whole row. Groups with at most ``hot_rows`` rows use
    ``Window.partitionBy(keys)`` directly. Larger groups are split: block positions, then windows over halo chunks
    (:func:`with_block_positions`, :func:`with_chunks`). Both halves give identical values and keep every row.
    Without a hot group (``known_hot`` or one small job) the plain window is used alone, and without the hash where rows that
    tie are equal in every column.
    """
    keys = list(keys)
    hot_rows = hot_group_rows(df, hot_rows)
    chunk_rows = max(chunk_rows_for(df, chunk_rows), lookback + 1)
    untied = Window.partitionBy(*keys).orderBy(F.col(order_col), *[F.col(t) for t in tiebreak])
    plain = Window.partitionBy(*keys).orderBy(F.col(order_col), *[F.col(t) for t in tiebreak], F.col(TIE))
    rows = with_tie(df)
    if known_hot is None:
        known_hot = group_sizes_have_hot(df, keys, hot_rows)
    if not known_hot and set(df.columns) <= {*keys, order_col, *tiebreak}:
        return df.withColumns(build(untied))
    if not known_hot:
        return rows.withColumns(build(plain)).drop(TIE)
    big = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    big = big.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    same = same_keys(rows, big, {k: f"_hot_{k}" for k in keys})
    hot = with_block_positions(rows.join(big, same, "left_semi"), keys, order_col, tiebreak)
    hot = drop_halo(with_chunks(hot, lookback, chunk_rows=chunk_rows).withColumns(build(chunk_window(keys))))
    if hot_rows <= 0:
        return hot.drop(POS, TIE)
    return rows.join(big, same, "left_anti").withColumns(build(plain)).unionByName(hot.drop(POS)).drop(TIE)


def nearest_rank_index(n: Column, q: float) -> Column:
    """1-based index of the nearest-rank quantile q among n sorted values: round((n - 1) * q) + 1."""
    return F.round((n - F.lit(1)).cast("double") * F.lit(float(q))).cast("long") + F.lit(1)


def q_name(q: float) -> str:
    return f"p{round(q * 100):02d}"


def _wanted(n: Column, q: float, method: str) -> tuple[Column, Column, Column]:
    """1-based places of the two values a quantile lies between, and how far it lies towards the second."""
    if method == "nearest":
        place = nearest_rank_index(n, q)
        return place, place, F.lit(0.0)
    if method == "linear":
        h = (n - F.lit(1)).cast("double") * F.lit(float(q))
        return F.floor(h).cast("long") + 1, F.ceil(h).cast("long") + 1, h - F.floor(h)
    raise ValueError(f"unknown quantile method: {method}")


def _gathered_quantiles(df: DataFrame, keys: list[str], wanted: Mapping[str, Sequence[float]], method: str) -> DataFrame:
    """Quantiles of groups of at most ``GATHER_ROWS`` rows: one aggregate sorts each group's values."""
    arrays = [F.sort_array(F.collect_list(F.col(c).cast("double"))).alias(f"_arr_{i}") for i, c in enumerate(wanted)]
    grouped = df.groupBy(*keys).agg(*arrays)
    finals = []
    for i, (c, qs) in enumerate(wanted.items()):
        arr = F.col(f"_arr_{i}")
        n = F.size(arr).cast("long")
        for q in qs:
            low, high, share = _wanted(n, q, method)
            a, b = (F.try_element_at(arr, F.greatest(x, F.lit(1)).cast("int")) + F.lit(0.0) for x in (low, high))
            finals.append(F.when(n > 0, a if method == "nearest" else a + (b - a) * share).alias(f"{c}_{q_name(q)}"))
    return grouped.select(*keys, *finals)


def _narrowed(counts: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """``counts`` (distinct values of brackets, ``_n`` and the number ``_base`` before the row's piece) without the pieces
    that hold neither wanted place.

    A sketch over a bracket's distinct values cuts it into ``NARROW`` pieces; the pieces' counts are summed in their order.
    """
    piece = [*keys, "_col", "_q", "_piece"]
    ends = counts.groupBy(*piece).agg(F.percentile_approx("_x", [i / NARROW for i in range(1, NARROW)], SKETCH_ACCURACY).alias("_ends"))
    ends = ends.select(*[F.col(c).alias(f"_e_{c}") for c in piece], "_ends")
    cut = counts.join(ends, same_keys(counts, ends, {c: f"_e_{c}" for c in piece}))
    cut = cut.withColumn("_inner", F.size(F.filter("_ends", lambda e: e < F.col("_x")))).drop("_ends", *[f"_e_{c}" for c in piece])
    sums = cut.groupBy(*piece, "_inner").agg(F.sum("_n").alias("_sum"), F.first("_base").alias("_start"), F.first("_all").alias("_all"))
    upto = Window.partitionBy(*piece).orderBy("_inner").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_start", F.col("_start") + F.coalesce(F.sum("_sum").over(upto), F.lit(0)))
    holds = lambda place: (F.col("_start") < place) & (F.col("_start") + F.col("_sum") >= place)
    kept = sums.where(holds(low) | holds(high)).select(*[F.col(c).alias(f"_k_{c}") for c in (*piece, "_inner")], "_start")
    out = cut.join(kept, same_keys(cut, kept, {c: f"_k_{c}" for c in (*piece, "_inner")}))
    return out.select(*keys, "_col", "_q", "_x", "_n", "_all", (F.col("_piece") * NARROW + F.col("_inner")).alias("_piece"),
                      F.col("_start").alias("_base"))


def _bracketed_quantiles(df: DataFrame, keys: list[str], wanted: Mapping[str, Sequence[float]], method: str,
                         largest: int) -> DataFrame:
    """Exact quantiles of groups of any size, the largest of ``largest`` rows.

    1. Per group and column, a mergeable sketch gives values below and above each wanted rank, and the count.
    2. One pass counts the values below each bracket, another those inside, per distinct value.
    3. A bracket holds about 4 / ``SKETCH_ACCURACY`` of the group's distinct values (one, if that is frequent). While that may be
       over ``BRACKET_VALUES``, a sketch cuts the bracket and the piece with the rank is kept.
    4. A running count over the values left finds the ranks.
    """
    margin = 2.0 / SKETCH_ACCURACY
    aggs = []
    for i, (c, qs) in enumerate(wanted.items()):
        ends = [min(1.0, max(0.0, q + d)) for q in qs for d in (-margin, margin)]
        x = F.col(c).cast("double")
        aggs += [F.percentile_approx(x, ends, SKETCH_ACCURACY).alias(f"_ends_{i}"), F.count(x).alias(f"_n_{i}")]
    names = [x for i in range(len(wanted)) for x in (f"_ends_{i}", f"_n_{i}")]
    if keys:
        sketch = df.groupBy(*keys).agg(*aggs).select(*[F.col(k).alias(f"_k_{k}") for k in keys], *names)
        rows = df.join(sketch, same_keys(df, sketch, {k: f"_k_{k}" for k in keys}))
    else:
        rows = df.withColumn("_sketch", df.agg(*aggs).select(F.struct(*names)).scalar()).select(*wanted, "_sketch.*")
    places, below, order = [], [], {}
    for i, (c, qs) in enumerate(wanted.items()):
        x = F.col(c).cast("double") + F.lit(0.0)
        for j, q in enumerate(qs):
            order[i, j] = (c, q)
            low, high = F.get(f"_ends_{i}", F.lit(2 * j)), F.get(f"_ends_{i}", F.lit(2 * j + 1))
            # the margin must reach past the neighbouring ranks; a group too small for that is its own bracket
            whole = F.col(f"_n_{i}") * F.lit(margin) < 4
            below.append(F.count_if(~whole & (x < low)).alias(f"_below_{i}_{j}"))
            places.append((x.isNotNull() & (whole | ((x >= low) & (x <= high))), F.struct(
                F.lit(i).alias("_col"), F.lit(j).alias("_q"), x.alias("_x"), F.col(f"_n_{i}").alias("_all"))))
    some = reduce(lambda a, b: a | b, [inside for inside, _ in places])
    near = rows.where(some).select(*keys, F.inline(F.filter(F.array(*[F.when(*p) for p in places]), lambda p: p.isNotNull())))
    counts = near.groupBy(*keys, "_col", "_q", "_x").agg(F.count(F.lit(1)).alias("_n"), F.first("_all").alias("_all"))
    ahead = rows.groupBy(*keys).agg(*below)
    if keys:
        ahead = ahead.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[f"_below_{i}_{j}" for i, j in order])
        counts = counts.join(ahead, same_keys(counts, ahead, {k: f"_b_{k}" for k in keys}))
    else:
        counts = counts.withColumn("_ahead", ahead.select(F.struct("*")).scalar()).select(*counts.columns, "_ahead.*")
    base = F.coalesce(*[F.when((F.col("_col") == i) & (F.col("_q") == j), F.col(f"_below_{i}_{j}")) for i, j in order])
    counts = counts.select(*keys, "_col", "_q", "_x", "_n", "_all", F.lit(0).cast("long").alias("_piece"), base.alias("_base"))

    def place(end: int) -> Column:
        """The wanted place of a row of ``counts``."""
        out = None
        for (i, j), (_, q) in order.items():
            own, value = (F.col("_col") == i) & (F.col("_q") == j), _wanted(F.col("_all"), q, method)[end]
            out = F.when(own, value) if out is None else out.when(own, value)
        return out

    held = largest * 2 * margin
    if held > BRACKET_VALUES:
        checkpoint_dir(df.sparkSession)
        counts = counts.checkpoint(eager=False)  # read several times, and small beside the rows
    while held > BRACKET_VALUES:
        counts, held = _narrowed(counts, keys, place(0), place(1)), held / NARROW
    upto = Window.partitionBy(*keys, "_col", "_q", "_piece").orderBy("_x")
    counts = counts.withColumn("_upto", F.col("_base") + F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    hits, finals = [], []
    for (i, j), (c, q) in order.items():
        low, high, share = _wanted(F.col("_all"), q, method)
        own, name = (F.col("_col") == i) & (F.col("_q") == j), f"{c}_{q_name(q)}"
        for end, at in (("lo", low), ("hi", high)):
            inside = own & (F.col("_upto") >= at) & (F.col("_upto") - F.col("_n") < at)
            hits.append(F.max(F.when(inside, F.col("_x"))).alias(f"_{name}_{end}"))
        hits.append(F.max(F.when(own, share)).alias(f"_{name}_t"))
        a, b, t = (F.col(f"_{name}_{e}") for e in ("lo", "hi", "t"))
        finals.append((a if method == "nearest" else a + (b - a) * t).alias(name))
    found = counts.groupBy(*keys).agg(*hits)
    if not keys:
        return found.select(*finals)
    # groups without any value have no counts; they keep a row of NULLs
    found = found.select(*[F.col(k).alias(f"_f_{k}") for k in keys], *finals)
    groups = df.select(*keys).distinct()
    return groups.join(found, same_keys(groups, found, {k: f"_f_{k}" for k in keys}), "left").select(
        *keys, *[f"{c}_{q_name(q)}" for c, q in order.values()])


def quantiles(df: DataFrame, keys: Sequence[str], value_cols: Sequence[str], qs: Sequence[float] | Mapping[str, Sequence[float]],
              method: str = "nearest", hot_rows: int | None = None, largest: int | None = None) -> DataFrame:
    """One row per group: ``{col}_{pNN}`` = exact quantile of each column over its non-null values.

    ``qs``: the quantiles of all columns, or of each. ``largest``: rows of the largest group, where known (else a job asks).
    ``method="nearest"``: element ``round((n-1)q)`` (0-based) of the sorted values (nearest rank).
    ``method="linear"``: ``x[lo] + (x[hi] - x[lo]) * (h - lo)`` with ``h = (n-1)q`` (NumPy's default).
    Groups of at most ``hot_rows`` (default ``GATHER_ROWS``) rows are sorted inside one aggregate; larger ones, and
    only those, are ranked through brackets. Groups without a non-null value of a column get NULL on either path. Zeros
    are positive.
    """
    keys = list(keys)
    wanted = {c: list(qs[c] if isinstance(qs, Mapping) else qs) for c in value_cols}
    hot_rows = hot_group_rows(df, hot_rows, GATHER_ROWS)
    largest = largest_group(df, keys) if largest is None else largest
    if largest <= hot_rows:
        return _gathered_quantiles(df, keys, wanted, method)
    if not keys or hot_rows <= 0:
        return _bracketed_quantiles(df, keys, wanted, method, largest)
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    big = big.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    same = same_keys(df, big, {k: f"_hot_{k}" for k in keys})
    return _gathered_quantiles(df.join(big, same, "left_anti"), keys, wanted, method).unionByName(
        _bracketed_quantiles(df.join(big, same, "left_semi"), keys, wanted, method, largest))


def nearest_rank_quantiles(df: DataFrame, keys: Sequence[str], value_cols: Sequence[str],
                           qs: Sequence[float], hot_rows: int | None = None) -> DataFrame:
    return quantiles(df, keys, value_cols, qs, "nearest", hot_rows)


def linear_quantiles(df: DataFrame, keys: Sequence[str], value_cols: Sequence[str],
                     qs: Sequence[float], hot_rows: int | None = None) -> DataFrame:
    return quantiles(df, keys, value_cols, qs, "linear", hot_rows)
