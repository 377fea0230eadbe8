"""Row-ordered series operators (W1-W12) that stay balanced under skew.

A window partitioned by ``city`` alone puts a whole city in one task; with one
city holding a third of the rows that task becomes the job.  Two building
blocks avoid it:

* ``with_row_index`` numbers the rows of each series.  Rows are numbered inside
  (key, time bucket) partitions, and bucket offsets come from a per-bucket count
  table whose size is keys x buckets (it grows with the time span, not with
  the row count).
* ``halo_window`` evaluates bounded-frame windows (lag, lead, short rolling
  frames) over chunks of ``chunk`` consecutive rows.  Each chunk also receives
  the few rows before/after it that the frame can reach (its halo), so the
  result is exact while every window partition holds at most
  ``chunk + back + fwd`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.util import attach, join_null_safe

DEFAULT_CHUNK = 50_000

# Published lag offsets and the source -> prefix naming of lag columns.
LAG_OFFSETS = [1, 3, 6, 12, 24]
LAG_PREFIX = {"aqi": "aqi", "pm2_5": "pm25", "temperature": "temp"}


def with_row_index(df: DataFrame, by: Sequence[str] = ("city",), order: Sequence[str] | str = ("timestamp",),
                   bucket: str | Sequence[str] | Column | None = ("hour", "day"), index: str = "rn",
                   total: str | None = None) -> DataFrame:
    """Add ``index`` = 1-based position of each row in its ``by`` series ordered by ``order``.

    ``order`` must be unique inside a series (add a tie-breaker otherwise).
    ``bucket`` lists ``date_trunc`` units from fine to coarse (default hour, day):
    rows are numbered inside (key, hour); the offset of each hour inside its day
    and of each day inside the series come from count tables, whose windows hold
    at most 24 hours or one series' days.  So no window task holds more than one
    (key, hour) of rows, whatever the density of the data.  A single unit or an
    explicit bucket expression gives one level; ``None`` one partition per series.
    ``total`` optionally names a column holding the series length.
    """
    by, order = list(by), [order] if isinstance(order, str) else list(order)
    if not by and bucket is not None:  # one global series: a constant key for the offset joins
        out = with_row_index(df.withColumn("__all", F.lit(0)), ["__all"], order, bucket, index, total)
        return out.drop("__all")
    if bucket is None:
        w = Window.partitionBy(*by).orderBy(*order)
        out = df.withColumn(index, F.row_number().over(w))
        if total:
            out = out.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*by)))
        return out
    if isinstance(bucket, Column):
        levels = [bucket]
    elif isinstance(bucket, str):
        levels = [F.date_trunc(bucket, F.col(order[0]))]
    else:
        levels = [F.date_trunc(u, F.col(order[0])) for u in bucket]
    names = [f"__b{k}" for k in range(len(levels))]
    d = df.withColumns(dict(zip(names, levels)))
    d = d.withColumn("__lr", F.row_number().over(Window.partitionBy(*by, names[0]).orderBy(*order)))
    # counts of the finest buckets (one row per (key, bucket), carrying the coarser bucket ids),
    # straight from the input: a map-side combined count, no window in this branch
    cnt = df.withColumns(dict(zip(names, levels))).groupBy(*by, *names).agg(F.count(F.lit(1)).alias("__c"))
    # offset of each bucket inside its parent bucket, level by level; the last level's
    # parent is the whole series
    offs = cnt.withColumn("__off", F.lit(0).cast("long"))
    tables = []
    for k in range(len(names)):
        parent = names[k + 1:k + 2]
        lvl = offs.groupBy(*by, *names[k:]).agg(F.sum("__c").alias("__c")) if k else cnt.select(*by, *names, "__c")
        w = Window.partitionBy(*by, *parent).orderBy(names[k]).rowsBetween(Window.unboundedPreceding, -1)
        lvl = lvl.withColumn(f"__o{k}", F.coalesce(F.sum("__c").over(w), F.lit(0)))
        tables.append(lvl.select(*by, *names[k:], f"__o{k}", *(["__c"] if k == len(names) - 1 else [])))
        offs = lvl
    # fold the per-level offsets into one table keyed by the finest bucket
    acc = tables[0]
    for k in range(1, len(tables)):
        acc = join_null_safe_cols(acc, tables[k].drop("__c") if k < len(tables) - 1 else tables[k], by + names[k:])
    off = sum((F.col(f"__o{k}") for k in range(1, len(names))), F.col("__o0"))
    acc = acc.select(*by, names[0], off.alias("__off"))
    out = join_null_safe_cols(d, acc, by + [names[0]]).withColumn(index, F.col("__off") + F.col("__lr"))
    if total:
        tot = cnt.groupBy(*by).agg(F.sum("__c").alias(total))
        out = attach(out, tot, by, measure=False)
    return out.drop("__lr", "__off", *names)


def join_null_safe_cols(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner equi-join where NULL keys match (series keys may be null)."""
    return join_null_safe(left, right, on, "inner")


def halo_window(df: DataFrame, by: Sequence[str], index: str,
                compute: Callable[[Window], dict[str, Column]],
                back: int = 0, fwd: int = 0, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Evaluate bounded-frame window columns over chunks of ``chunk`` rows plus halos.

    ``compute(w)`` returns ``{name: expr over w}`` where ``w`` is partitioned by
    (by, chunk) and ordered by ``index``; frames may reach at most ``back`` rows
    behind and ``fwd`` rows ahead.
    """
    by = list(by)
    i0 = F.col(index) - 1
    ch = F.floor(i0 / F.lit(chunk)).cast("long")
    pos = F.pmod(i0, F.lit(chunk))
    copies = [F.struct(ch.alias("c"), F.lit(False).alias("h"))]
    # a row is copied into every later chunk whose first row is at most ``back`` rows
    # ahead of it, and into every earlier chunk whose last row is at most ``fwd`` behind
    for k in range(1, -(-back // chunk) + 1 if back else 1):
        copies.append(F.when(pos >= k * chunk - back, F.struct((ch + k).alias("c"), F.lit(True).alias("h"))))
    for k in range(1, -(-fwd // chunk) + 1 if fwd else 1):
        copies.append(F.when(pos < fwd - (k - 1) * chunk, F.struct((ch - k).alias("c"), F.lit(True).alias("h"))))
    if len(copies) == 1:
        d = df.withColumn("__ch", ch).withColumn("__halo", F.lit(False))
    else:
        d = (df.withColumn("__cp", F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull())))
               .withColumn("__ch", F.col("__cp.c")).withColumn("__halo", F.col("__cp.h")).drop("__cp"))
    w = Window.partitionBy(*by, "__ch").orderBy(index)
    d = d.withColumns(compute(w))
    return d.filter(~F.col("__halo")).drop("__ch", "__halo")


def series_shift(df: DataFrame, by: Sequence[str] = ("city",), order: str = "timestamp",
                 compute: Callable[[Window], dict[str, Column]] | None = None, back: int = 0, fwd: int = 0,
                 chunk: int = DEFAULT_CHUNK, bucket: str | Sequence[str] | Column | None = ("hour", "day"),
                 keep_index: bool = False, total: str | None = None) -> DataFrame:
    """Index a series, then evaluate bounded frames over it (index + halo_window)."""
    d = with_row_index(df, by, order, bucket=bucket, index="__rn", total=total)
    d = halo_window(d, by, "__rn", compute, back=back, fwd=fwd, chunk=chunk)
    return d.withColumnRenamed("__rn", "rn") if keep_index else d.drop("__rn")


# --- W1 / W2 ---------------------------------------------------------------------------------------------

def lags(df: DataFrame, cols: dict[str, str] | Sequence[str] = None, offsets: Sequence[int] = LAG_OFFSETS,
         by=("city",), order="timestamp", **kw) -> DataFrame:
    """K-row lags; column ``{prefix}_lag_{k}h`` always exists (null where no row)."""
    cols = LAG_PREFIX if cols is None else cols
    names = cols if isinstance(cols, dict) else {c: c for c in cols}
    back = max(offsets)

    def compute(w):
        return {f"{p}_lag_{k}h": F.lag(c, k).over(w) for k in offsets for c, p in names.items()}
    return series_shift(df, by, order, compute, back=back, **kw)


def target_ahead(df: DataFrame, col: str = "aqi", ahead: int = 24, by=("city",), order="timestamp",
                 drop_null: bool = True, **kw) -> DataFrame:
    """Value ``ahead`` rows later as ``{col}_target_{ahead}h``; rows without it dropped."""
    name = f"{col}_target_{ahead}h"
    out = series_shift(df, by, order, lambda w: {name: F.lead(col, ahead).over(w)}, fwd=ahead, **kw)
    return out.filter(F.col(name).isNotNull()) if drop_null else out


def multi_horizon_targets(df: DataFrame, col: str = "aqi", horizons: Sequence[int] = (24, 48, 72),
                          by=("city",), order="timestamp", **kw) -> DataFrame:
    """Several lead targets in one pass (nulls kept)."""
    return series_shift(df, by, order,
                        lambda w: {f"{col}_target_{h}h": F.lead(col, h).over(w) for h in horizons},
                        fwd=max(horizons), **kw)


# --- W3 / W4 / W5 ------------------------------------------------------------------------------------------

def change_and_rolling(df: DataFrame, col: str = "aqi", by=("city",), order="timestamp", **kw) -> DataFrame:
    """W3 + W4: ``aqi_change_rate`` (first difference, null -> 0) and ``aqi_ma_3h``
    (3-row trailing mean of non-null values, else the current value)."""
    def compute(w):
        return {
            f"{col}_change_rate": F.coalesce(F.col(col) - F.lag(col, 1).over(w), F.lit(0.0)),
            f"{col}_ma_3h": F.coalesce(F.avg(col).over(w.rowsBetween(-2, 0)), F.col(col)),
        }
    return series_shift(df, by, order, compute, back=2, **kw)


def rolling_stats(df: DataFrame, col: str = "aqi", windows: Sequence[int] = (3, 6, 12, 24),
                  by=("city",), order="timestamp", **kw) -> DataFrame:
    """Trailing mean / sample std / min / max over the last n rows (partial frames at the start).

    Mean and variance are written out over explicit lags in a fixed summation
    order (two-pass variance), so the value does not depend on how an engine
    evaluates moving frames.
    """
    top = max(windows)

    def compute(w):
        out = {f"__l{j}": F.lag(col, j).over(w) for j in range(1, top)}
        for n in windows:
            f = w.rowsBetween(-(n - 1), 0)
            out[f"{col}_roll_min_{n}"] = F.min(col).over(f)
            out[f"{col}_roll_max_{n}"] = F.max(col).over(f)
        return out
    d = series_shift(df, by, order, compute, back=top - 1, **kw)
    vals = [F.col(col)] + [F.col(f"__l{j}") for j in range(1, top)]
    stats = {}
    for n in windows:
        v = vals[:n]
        cnt = sum((x.isNotNull().cast("int") for x in v[1:]), v[0].isNotNull().cast("int"))
        tot = F.lit(0.0)
        for x in v:
            tot = tot + F.coalesce(x, F.lit(0.0))
        stats[f"__cnt{n}"] = cnt
        stats[f"{col}_roll_mean_{n}"] = F.try_divide(tot, cnt.cast("double"))
    d = d.withColumns(stats)
    sds = {}
    for n in windows:
        mean, cnt = F.col(f"{col}_roll_mean_{n}"), F.col(f"__cnt{n}")
        ss = F.lit(0.0)
        for x in vals[:n]:
            ss = ss + F.coalesce((x - mean) * (x - mean), F.lit(0.0))
        sds[f"{col}_roll_std_{n}"] = F.when(cnt > 1, F.sqrt(ss / (cnt - 1).cast("double")))
    d = d.withColumns(sds)
    return d.drop(*[f"__l{j}" for j in range(1, top)], *[f"__cnt{n}" for n in windows])


# --- W6 -----------------------------------------------------------------------------------------------------

def dedupe_keep_last(df: DataFrame, key: Sequence[str], ordinal: str) -> DataFrame:
    """One row per key, the one with the largest ``ordinal`` (arrival order).

    An aggregate, not a window: ``max_by`` combines map-side, so a key with
    millions of copies shrinks to one row per task before the shuffle.
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    agg = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("__last"))
    return agg.select(*key, *[F.col(f"__last.{c}").alias(c) for c in rest])


# --- W7 / W9 / W12 ------------------------------------------------------------------------------------------

def recent_trend(df: DataFrame, col: str = "aqi", n: int = 24, by=("city",), order="timestamp") -> DataFrame:
    """Mean of the last ``n`` rows minus mean of the first ``n`` of the last ``2n`` rows (nulls left out).

    Only a series' last 2n rows matter.  Each task keeps that many of its own rows per series before the
    shuffle (``order`` is unique in a series), so what moves is bounded by series times tasks, not by the rows.
    """
    by = list(by)
    newest = Window.partitionBy(*by).orderBy(F.col(order).desc())
    tail = df.select(*by, order, col).withColumn("__back", F.row_number().over(newest)).where(F.col("__back") <= 2 * n)
    held = tail.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("__back").alias("b"), F.col(col).cast("double").alias("v"))), asc=False).alias("__tail"))

    def mean(rows: Column) -> Column:  # rows are oldest first; at most n of them
        some = F.filter(F.transform(rows, lambda r: r["v"]), lambda v: v.isNotNull())
        return F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, v: a + v), F.size(some).cast("double"))
    last = F.filter("__tail", lambda r: r["b"] <= n)
    return held.select(*by, (mean(last) - mean(F.slice("__tail", 1, n))).alias("recent_trend"))


def chronological_split(df: DataFrame, test_fraction: float = 0.2, by=("city",), order="timestamp",
                        bucket=("hour", "day"), flag: str = "is_test") -> DataFrame:
    """The last ceil(f * n) rows of each series are test rows (no shuffling)."""
    d = with_row_index(df, by, order, bucket=bucket, index="__rn", total="__n")
    n_test = F.ceil(F.col("__n") * F.lit(test_fraction))
    return d.withColumn(flag, F.col("__rn") > F.col("__n") - n_test).drop("__rn", "__n")


def future_point(df: DataFrame, by=("city",), ts: str = "timestamp", hours: int = 24) -> DataFrame:
    """Last timestamp + ``hours`` per series."""
    return df.groupBy(*by).agg((F.max(ts) + F.expr(f"INTERVAL {int(hours)} HOURS")).alias("forecast_ts"))


# --- W5 (time-based frames) ---------------------------------------------------------------------------------


def _whole_hours(df: DataFrame, ts: str) -> Column:
    """Whole hours since a fixed time, by elapsed time whatever the session time zone."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        since = F.col(ts) - F.expr("TIMESTAMP_NTZ'0001-01-01 00:00:00'")
        return F.extract(F.lit("DAY"), since).cast("long") * 24 + F.extract(F.lit("HOUR"), since)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.floor((micros - F.pmod(micros, F.lit(3_600_000_000))) / 3_600_000_000).cast("long")


def time_rolling_stats(df: DataFrame, col: str = "aqi", hours: Sequence[int] = (3, 24), by=("city",),
                       ts: str = "timestamp", chunk: str = "day", scale: int | None = None) -> DataFrame:
    """W5, hour-based form: count / mean / sample std / min / max over ``RANGE BETWEEN
    INTERVAL h HOURS PRECEDING AND CURRENT ROW``.

    Time is cut into blocks of h hours.  A frame is the rows of its own block up to the row and the last rows of
    the block before, so both parts are running aggregates, one forwards and one backwards: each row is
    touched a fixed number of times, however many rows a frame holds, where a sliding frame aggregates all its rows
    for every row.  Each row is copied into the next block, shifted by h hours, so that one window task
    holds two blocks of one key.  ``chunk`` changes nothing: a block is as long as the frame.  Nothing is
    subtracted, so far values and NaN stay inside their frames.  With ``scale`` (e.g. 100 for values with
    two decimals) sums run on exact integers and mean / variance are one division each, independent of
    summation order.  Rows without a time are a frame of their own.
    """
    by, names = list(by), []
    v = F.round(F.col(col) * int(scale)).cast("long") if scale else F.col(col)
    mean_type = df.select(F.avg(col).alias("m")).schema["m"].dataType
    d = df
    for h in hours:
        hours_before = F.expr(f"INTERVAL {int(h)} HOURS")
        block = F.floor(_whole_hours(df, ts) / int(h)).cast("long")
        copies = [F.struct(block.alias("b"), F.col(ts).alias("t"), F.lit(False).alias("old")),
                  F.when(F.col(ts).isNotNull(), F.struct((block + 1).alias("b"), (F.col(ts) + hours_before).alias("t"), F.lit(True).alias("old")))]
        d = d.withColumn("__cp", F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull())))
        d = d.withColumns({"__b": F.col("__cp.b"), "__t": F.col("__cp.t"), "__old": F.col("__cp.old")}).drop("__cp")
        part = Window.partitionBy(*by, "__b")
        out = {}
        for name, order, mine in (("f", F.col("__t"), ~F.col("__old")), ("p", F.col("__t").desc(), F.col("__old"))):
            w = part.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
            x, n = F.when(mine, v), F.when(mine, F.col(col))
            out |= {f"__{name}n": F.count(x).over(w), f"__{name}s": F.coalesce(F.sum(x).over(w), F.lit(0)),
                    f"__{name}l": F.min(n).over(w), f"__{name}h": F.max(n).over(w)}
            if scale:
                out[f"__{name}q"] = F.coalesce(F.sum(x * x).over(w), F.lit(0))
            else:
                out[f"__{name}v"] = F.var_pop(x).over(w)
        d = d.withColumns(out).filter(~F.col("__old"))
        n, total = F.col("__fn") + F.col("__pn"), F.col("__fs") + F.col("__ps")
        if scale:
            mean = F.try_divide(total.cast("double"), n.cast("double") * float(scale))
            num = (n * (F.col("__fq") + F.col("__pq")) - total * total).cast("double")
            var = num / (n * (n - 1)).cast("double") / float(scale * scale)
        else:
            mean = F.when(n > 0, total / n).cast(mean_type)
            halves = [(F.col(f"__{x}n").cast("double"), F.col(f"__{x}s").cast("double"), F.coalesce(F.col(f"__{x}v"), F.lit(0.0))) for x in "fp"]
            apart = F.when((F.col("__fn") > 0) & (F.col("__pn") > 0), F.col("__fs").cast("double") / F.col("__fn") - F.col("__ps").cast("double") / F.col("__pn")).otherwise(0.0)
            squares = halves[0][0] * halves[0][2] + halves[1][0] * halves[1][2] + apart * apart * halves[0][0] * halves[1][0] / n
            var = squares / (n - 1)
        own = {f"{col}_troll_n_{h}h": n, f"{col}_troll_min_{h}h": F.least("__fl", "__pl"), f"{col}_troll_max_{h}h": F.greatest("__fh", "__ph"),
               f"{col}_troll_mean_{h}h": mean, f"{col}_troll_std_{h}h": F.when(n > 1, F.sqrt(var))}
        names.append(list(own))
        d = d.withColumns(own).drop("__b", "__t", "__old", *out)
    # scaled: all counts and extremes come before all means and deviations
    order = [x for own in names for x in own[:3]] + [x for own in names for x in own[3:]] if scale else [x for own in names for x in own]
    return d.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`") for c in order])
