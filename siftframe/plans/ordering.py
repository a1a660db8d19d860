"""Global row positions and forward fill without a single-partition window.

A window with no ``partitionBy`` moves every row into one task. Instead the
ordering key is cut into ``order_buckets`` ranges at boundaries taken from a
bounded sample of composite keys (so a timestamp shared by a third of the
rows is still split by its tiebreak column). Rows are counted per range; the
small count table gives each range its starting offset, and a window
partitioned by range numbers the rows inside it.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftframe.functions.exprs import q
from siftframe.settings import DEFAULT, Settings

_DAY_MICROS = 86_400_000_000
_LEAST_LONG = -(1 << 63)


def order_value(name: str, dt: T.DataType) -> Column:
    """An order-preserving long/double/string image of a column.

    Literals of these types round-trip exactly through the driver, unlike
    timestamps whose Python form depends on time zones.
    """
    c = q(name)
    if isinstance(dt, T.TimestampNTZType):
        # wall-clock fields only: no session time zone is involved
        return (F.unix_date(F.to_date(c)).cast("long") * _DAY_MICROS
                + (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000
                + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long"))
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(dt, T.BooleanType):
        return c.cast("int")
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return c.cast("double")
    return c.cast("string")


def _key(df: DataFrame, order_cols: list[str]) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.struct(*[order_value(c, types[c]).alias(f"k{j}") for j, c in enumerate(order_cols)])


def bucket_count(n: int, settings: Settings) -> int:
    """Buckets so that each holds about ``order_bucket_rows`` rows (capped)."""
    return max(1, min(settings.order_buckets, -(-n // settings.order_bucket_rows)))


def _boundaries(df: DataFrame, order_cols: list[str], n: int, settings: Settings) -> list[tuple]:
    """Up to ``bucket_count - 1`` composite split keys in order, chosen on the cluster.

    A key that holds a whole tile of the sample stands in the list more than once.

    About ``order_sample_per_bucket`` keys per wanted bucket are sampled;
    one window over that bounded sample (at most ``order_buckets`` x
    ``order_sample_per_bucket`` x 1.5 rows, whatever the table size) cuts it
    into equal tiles, and only the tile maxima -- one row per bucket -- reach
    the driver. The sample only places split points; every row is still
    processed.
    """
    want = bucket_count(n, settings)
    if n <= 0 or want <= 1:
        return []
    per = settings.order_sample_per_bucket
    frac = min(1.0, 1.5 * want * per / n)
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [f"k{j}" for j in range(len(order_cols))]
    sample = (df.select(*[order_value(c, types[c]).alias(k) for k, c in zip(names, order_cols)])
              .sample(False, frac, seed=20240101))
    ordered = Window.orderBy(*names)
    everything = Window.partitionBy()
    tiles = F.least(F.lit(want), F.greatest(F.lit(1), F.floor(F.col("_m") / F.lit(per)))).cast("long")
    picks = (sample
             .select("*", F.row_number().over(ordered).alias("_r"), F.count(F.lit(1)).over(everything).alias("_m"))
             .select("*", F.floor((F.col("_r") - 1) * tiles / F.col("_m")).alias("_t"), tiles.alias("_tiles"))
             .where(F.col("_t") < F.col("_tiles") - 1)
             .groupBy("_t").agg(F.max(F.struct(*names)).alias("m"))
             .orderBy("_t").collect())   # at most ``order_buckets`` rows
    return [tuple(r["m"]) for r in picks]


def _distinct(bounds: list[tuple]) -> list[tuple]:
    """Ordered keys without repeats (NaN repeats itself, too)."""
    return list({tuple("NaN" if v != v else v for v in b): b for b in bounds}.values())


def _before(value: float | int | None) -> float | int | None:
    """The next smaller long or double in Spark's order, NULL (the smallest) for the least one."""
    if isinstance(value, float):
        return math.inf if value != value else None if value == -math.inf else math.nextafter(value, -math.inf)
    return None if value is None or value == _LEAST_LONG else value - 1


def _le(keys: list[Column], lits: list[Column]) -> Column:
    """Lexicographic ``keys <= lits`` on plain columns (no struct per row); NULL is the smallest value."""
    key, lit = keys[0], lits[0]
    less = lit.isNotNull() & F.coalesce(key < lit, F.lit(True))
    same = key.eqNullSafe(lit)
    return less | (same if len(keys) == 1 else same & _le(keys[1:], lits[1:]))


def _bucket(df: DataFrame, order_cols: list[str], bounds: list[tuple]) -> Column:
    """Bucket id by a balanced tree over the precomputed ``_ok<j>`` key columns."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if not bounds:
        return F.lit(0)
    key_types = [df.select(order_value(c, types[c]).alias("x")).schema[0].dataType for c in order_cols]
    keys = [F.col(f"_ok{j}") for j in range(len(order_cols))]

    def lits(b):
        return [F.lit(v).cast(t) for v, t in zip(b, key_types)]

    if len(bounds) > _TREE_MAX:
        return _bucket_search(keys, bounds, key_types)

    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_le(keys, lits(bounds[mid])), build(lo, mid)).otherwise(build(mid + 1, hi))

    return build(0, len(bounds))


_TREE_MAX = 63  # larger CASE trees outgrow generated-method limits


def _bounds_literal(bounds: list[tuple], key_types: list[T.DataType]) -> Column:
    """The boundary list as ONE string literal decoded by ``from_json``.

    A literal ``array(named_struct(...), ...)`` is one expression node per
    field, and analysing tens of thousands of them takes minutes; a single
    string is one node, and the decode is constant-folded before any task
    runs. JSON keeps doubles exact (shortest round-trip text) and NaN/inf
    as tokens Spark's JSON reader accepts.
    """
    names = [f"k{j}" for j in range(len(key_types))]
    rows = []
    for b in bounds:
        rows.append({k: (None if v is None else float(v) if isinstance(t, T.DoubleType) else
                         str(v) if isinstance(t, T.StringType) else int(v))
                     for k, v, t in zip(names, b, key_types)})
    schema = T.ArrayType(T.StructType([T.StructField(k, t) for k, t in zip(names, key_types)]))
    return F.from_json(F.lit(json.dumps(rows, allow_nan=True)), schema)


def _bucket_search(keys: list[Column], bounds: list[tuple], key_types: list[T.DataType]) -> Column:
    """Binary search over a constant boundary array: expression size does not
    grow with the number of buckets; log2(buckets) steps per row."""
    arr = _bounds_literal(bounds, key_types)
    n = len(bounds)
    steps = max(1, n.bit_length())

    def step(acc, _):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        b = F.element_at(arr, mid + 1)
        le = _le(keys, [b[f"k{j}"] for j in range(len(keys))])
        return F.when(lo >= hi, acc).otherwise(
            F.when(le, F.struct(lo.alias("lo"), mid.alias("hi")))
            .otherwise(F.struct((mid + 1).alias("lo"), hi.alias("hi"))))

    init = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step, lambda acc: acc["lo"])


def bucketed(df: DataFrame, order_cols: list[str], settings: Settings = DEFAULT,
             n: int | None = None, bucket_col: str = "_bkt") -> DataFrame:
    n = df.count() if n is None else n
    return _in_buckets(df, order_cols, _distinct(_boundaries(df, order_cols, n, settings)), bucket_col)


def bucketed_points(df: DataFrame, order_cols: list[str], settings: Settings = DEFAULT,
                    n: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` with its range bucket ``_bkt``, and whether some key holds more than a bucket.

    If one does, each split key is a bucket of its own: odd buckets (points)
    hold the rows of exactly one key, even ones (ranges) what lies between
    two. The last of ``order_cols`` must be a long or double without NULLs,
    so that the range in front of a point ends at the next smaller key.
    """
    n = df.count() if n is None else n
    found = _boundaries(df, order_cols, n, settings)
    bounds = _distinct(found)
    hot = len(bounds) < len(found)
    if hot:
        bounds = [k for b in bounds for k in ((*b[:-1], _before(b[-1])), b)]
    return _in_buckets(df, order_cols, bounds, "_bkt"), hot


def _in_buckets(df: DataFrame, order_cols: list[str], bounds: list[tuple], bucket_col: str) -> DataFrame:
    if not bounds:
        return df.withColumn(bucket_col, F.lit(0))
    # key images are their own projection, so the search reads plain columns
    types = {f.name: f.dataType for f in df.schema.fields}
    keyed = df.select("*", *[order_value(c, types[c]).alias(f"_ok{j}") for j, c in enumerate(order_cols)])
    # non-nullable id: a later join on it cannot infer (and copy) a NOT NULL test
    return (keyed.withColumn(bucket_col, F.coalesce(_bucket(df, order_cols, bounds), F.lit(0)))
            .drop(*[f"_ok{j}" for j in range(len(order_cols))]))


def with_position(df: DataFrame, order_cols: list[str], partition_cols: list[str] = (),
                  settings: Settings = DEFAULT, pos_col: str = "_pos",
                  n: int | None = None, step: int = 1) -> DataFrame:
    """Add the 0-based position of each row in (partition, order_cols) order.

    ``order_cols`` must be non-null and together unique for a deterministic
    numbering (pass a tiebreak column last). With ``step``, only buckets
    that hold a multiple of it are kept, so the others are never sorted.
    """
    parts = [q(c) for c in partition_cols]
    b = bucketed(df, order_cols, settings, n)
    counts = b.groupBy(*parts, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    w_off = Window.partitionBy(*parts).orderBy("_bkt")
    offsets = counts.withColumn("_off", F.sum("_cnt").over(w_off) - F.col("_cnt"))
    if step > 1:
        offsets = offsets.where(F.pmod(-F.col("_off"), F.lit(step)) < F.col("_cnt"))
    offsets = offsets.drop("_cnt")
    if not partition_cols:
        # at most ``order_buckets`` rows: a proven bound for the broadcast
        offsets = F.broadcast(offsets)
    keys = list(partition_cols) + ["_bkt"]
    w = Window.partitionBy(*parts, "_bkt").orderBy(*[q(c) for c in order_cols])
    pos = F.col("_off") + F.row_number().over(w) - 1
    return b.join(offsets, keys).withColumn(pos_col, pos.cast("long")).drop("_bkt", "_off")


def numbered(df: DataFrame, order_cols: list[str], keep: list[str], n: int,
             settings: Settings = DEFAULT, step: int = 1) -> DataFrame:
    """``keep`` of the rows in the order of ``order_cols``, with ``_pos`` (0-based) and ``_c``: the row stands for
    ``_c`` equal rows from that position on.

    ``order_cols`` must hold all that tells rows apart, a double without NULLs
    last. Rows of a key that outgrows a range are a bucket of their own, which
    its count and one value describe: they are never shuffled or sorted. The
    others are shuffled once, by range. With ``step``, only rows of ranges that
    hold a multiple of it are shuffled at all.
    """
    b, hot = bucketed_points(df, order_cols, settings, n)
    values = [F.min(q(c)).alias(f"_v{i}") for i, c in enumerate(keep)] if hot else []
    offsets = (b.groupBy("_bkt").agg(F.count(F.lit(1)).alias("_cnt"), *values)
               .withColumn("_off", F.sum("_cnt").over(Window.orderBy("_bkt")) - F.col("_cnt")))
    if step > 1:
        offsets = offsets.where(F.pmod(-F.col("_off"), F.lit(step)) < F.col("_cnt"))
    ranges = offsets.where("_bkt % 2 = 0") if hot else offsets
    w = Window.partitionBy("_bkt").orderBy(*[q(c) for c in order_cols])
    # at most 2 x ``order_buckets`` rows: a proven bound for the broadcast
    rows = b.join(F.broadcast(ranges.select("_bkt", "_off")), "_bkt").select(
        *[q(c) for c in keep], (F.col("_off") + F.row_number().over(w) - 1).alias("_pos"), F.lit(1).cast("long").alias("_c"))
    if not hot:
        return rows
    return rows.unionAll(offsets.where("_bkt % 2 = 1").select(
        *[F.col(f"_v{i}").alias(c) for i, c in enumerate(keep)], F.col("_off").alias("_pos"), F.col("_cnt").alias("_c")))


def forward_fill(df: DataFrame, cols: list[str], order_cols: list[str],
                 partition_cols: list[str] = (), settings: Settings = DEFAULT) -> DataFrame:
    """Replace each gap with the last earlier non-missing value; leading gaps stay.

    Inside each range bucket a running ``last(ignorenulls)`` fills gaps; a
    gap at the start of a bucket takes the last value of the nearest earlier
    bucket that has one, found on the small per-bucket table.

    Rows tied on ``order_cols`` are ordered by a hash of the whole row, so a
    hot order value (say a third of all rows on one timestamp) is split over
    many buckets and the fill among ties is deterministic. Exact copies share
    the hash. They receive the same fill, whatever their order, so copies of a
    row that outgrow a bucket are set apart and take it straight from the
    per-bucket table: they meet in no window (and without ``partition_cols``
    they are not shuffled).
    """
    if not cols:
        return df
    parts = [q(c) for c in partition_cols]
    hashable = [q(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    src = df.withColumn("_ff_tb", F.xxhash64(*hashable))
    order_cols = list(order_cols) + ["_ff_tb"]
    b, hot = bucketed_points(src, order_cols, settings)
    types = {f.name: f.dataType for f in src.schema.fields}
    okey = F.struct(*[order_value(c, types[c]).alias(f"k{j}") for j, c in enumerate(order_cols)])
    lasts = b.groupBy(*parts, "_bkt").agg(*[
        F.max_by(q(c), F.when(q(c).isNotNull(), okey)).alias(f"_last{i}") for i, c in enumerate(cols)])
    w_prev = Window.partitionBy(*parts).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(*parts, "_bkt", *[
        F.last(f"_last{i}", ignorenulls=True).over(w_prev).alias(f"_carry{i}") for i in range(len(cols))])
    w_run = (Window.partitionBy(*parts, "_bkt").orderBy(*[q(c) for c in order_cols])
             .rowsBetween(Window.unboundedPreceding, 0))

    def filled(rows: DataFrame, carry: DataFrame, running: bool) -> DataFrame:
        if partition_cols:
            # a NULL is a partition of its own, as in the window
            keys = [*partition_cols, "_bkt"]
            named = carry.select(*[q(k).alias(f"_p{i}") for i, k in enumerate(keys)], *[f"_carry{i}" for i in range(len(cols))])
            joined = rows.join(named, [q(k).eqNullSafe(F.col(f"_p{i}")) for i, k in enumerate(keys)])
        else:
            joined = rows.join(F.broadcast(carry), "_bkt")  # at most 2 x ``order_buckets`` rows

        def value(c: str) -> Column:
            earlier = [F.last(q(c), ignorenulls=True).over(w_run)] if running else [q(c)]
            return F.coalesce(*earlier, F.col(f"_carry{cols.index(c)}")).alias(c)

        return joined.select(*[value(f.name) if f.name in cols else q(f.name) for f in df.schema.fields])

    if not hot:
        return filled(b, carry, True)
    return filled(b.where("_bkt % 2 = 0"), carry, True).unionAll(filled(b.where("_bkt % 2 = 1"), carry, False))
