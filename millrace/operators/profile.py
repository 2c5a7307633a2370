"""Column-level data quality profile by load, and the columns that changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.scratch import write_cut

#: Quantiles of each load whose medians over the loads bound the bins of a column.
CUTS = [0.002, 0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 0.998]
#: Text values are told apart by this many hash buckets, so no column makes unbounded groups.
VALUE_BUCKETS = 256
#: Divergence (Jensen-Shannon, bits) that is a clear change, beyond what chance explains.
CLEAR = 0.012
#: A rate is changed beyond CLEAR_RATE and so many standard errors, the larger of chance and the loads' spread, from the median load.
CLEAR_RATE, ERRORS = 0.005, 6.0
#: Change of the logs of distinct values and of their ratio to values that is clear.
CLEAR_DISTINCT = 0.25
#: A column is nearly unique if its loads usually have at least this share of distinct values; then the ratio alone tells.
NEARLY_UNIQUE = 0.9
#: A mask is rare in its column below this share of the bulk.
RARE = 0.005
#: Texts beyond so many characters are masked before they are counted.
LONG_TEXT = 64
REAL, WHOLE = (T.DoubleType, T.FloatType, T.DecimalType), (T.IntegerType, T.LongType, T.ShortType, T.ByteType)
VALUE, NULL, NAN = 0, 1, 2
#: Masks of numbers: sign and number of decimals, or 9E9 for very large and very small ones.
NUMBER_MASKS = [sign + body for sign in ("", "-") for body in ("9.", "9.9", "9.99", "9.999", "9.9999", "9E9")]


def text_mask(x: Column) -> Column:
    """Character classes of a text: Latin a/A and other letters w in runs, digits one by one.

    Leading zeros are o, other digits 9 (five or more in a row as 99999); all else stays.
    """
    for pattern, to in (
        ("[a-z]+", "a"),
        ("[A-Z]+", "A"),
        (r"[\p{L}\p{M}&&[^aA]]+", "w"),
        ("(?<![0-9])0(?=[0-9])", "o"),
        ("[0-9]", "9"),
        ("9{5,}", "99999"),
    ):
        x = F.regexp_replace(x, pattern, to)
    return x


def number_mask(x: Column) -> Column:
    """Place in NUMBER_MASKS: sign and number of decimals (0 to 3, or 4 for more) of a number, or its very large or small size."""
    size = F.abs(x)
    body = F.when((size >= 1e7) | ((size > 0) & (size < 1e-3)), 5)
    for k in range(4):
        scaled = size * F.lit(10.0**k)
        body = body.when(F.abs(scaled - F.rint(scaled)) <= F.lit(1e-9) * (scaled + 1), k)
    return body.otherwise(4) + F.when(x < 0, 6).otherwise(0)


def _mask_name(number: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in NUMBER_MASKS]), number)


def _columns(df: DataFrame, load: str, skip: tuple[str, ...]) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name != load and f.name not in skip]


def _real(f: T.StructField) -> bool:
    return isinstance(f.dataType, REAL)


def _as_number(f: T.StructField) -> Column | None:
    """A real column as double without NaN, whole numbers, flags, dates and times as long; None for texts."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(f.dataType, T.DecimalType):
        return c.cast("double")
    if isinstance(f.dataType, WHOLE):
        return c.cast("long")
    if isinstance(f.dataType, T.BooleanType):
        return c.cast("int").cast("long")
    if isinstance(f.dataType, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    return None


def _as_text(f: T.StructField, number: Column) -> Column:
    """A whole value as the text of its own type."""
    if isinstance(f.dataType, T.BooleanType):
        number = number.cast("boolean")
    elif isinstance(f.dataType, T.DateType):
        number = F.date_from_unix_date(number.cast("int"))
    elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        number = F.timestamp_micros(number)
    return number.cast("string")


def _summaries(df: DataFrame, load: str, fields: list[T.StructField]) -> DataFrame:
    """One row a load: quantiles of number-like columns (q), extremes and estimated distinct values of real ones, extremes of texts."""
    wanted = []
    for i, f in enumerate(fields):
        number = _as_number(f)
        if number is not None:
            wanted.append(F.percentile_approx(number.cast("double"), CUTS, 2000).alias(f"q{i}"))
        if number is None or _real(f):
            shown = F.col(f"`{f.name}`").cast("string") if number is None else number
            wanted += [F.min(shown).alias(f"low{i}"), F.max(shown).alias(f"high{i}")]
        if _real(f):
            wanted.append(F.approx_count_distinct(number, 0.02).alias(f"kinds{i}"))
    return df.groupBy(F.col(load).alias("load")).agg(F.count(F.lit(1)).alias("rows"), *wanted)


def _edges(summaries: DataFrame, fields: list[T.StructField]) -> dict[int, list[float]]:
    """Bin edges of number-like columns: medians over the loads of the loads' quantiles.

    To the driver: len(CUTS) numbers a column.
    """
    numbers = [i for i, f in enumerate(fields) if _as_number(f) is not None]
    if not numbers:
        return {}
    mid = summaries.agg(*[F.array(*[F.median(F.col(f"q{i}")[k]) for k in range(len(CUTS))]).alias(f"q{i}") for i in numbers]).first()
    return {i: sorted({x for x in (mid[f"q{i}"] or []) if x is not None}) for i in numbers}


def _bin(number: Column, edges: list[float]) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + (number > F.lit(e)).cast("int")
    return out


def value_counts(df: DataFrame, load: str, fields: list[T.StructField], edges: dict[int, list[float]]) -> DataFrame:
    """(load, c, state, bin, mask, whole, text, hash, n): the values of every column, counted before the shuffle.

    Column number c has real values by bin and mask number, whole ones and texts by the value
    itself, so that masks of texts are formed once a distinct value. Texts beyond LONG_TEXT
    characters hardly repeat: they are counted by mask (text) and hash.
    """
    rows = None
    for i, f in enumerate(fields):
        c, number = F.col(f"`{f.name}`"), _as_number(f)
        state = F.when(c.isNull(), NULL)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            state = state.when(F.isnan(c), NAN)
        real = number if number is not None and _real(f) else None
        text = c.cast("string")
        long = F.length(text) > LONG_TEXT
        cells = {
            "bin": (F.when(real.isNotNull(), _bin(real, edges[i])) if real is not None else F.lit(None)).cast("int"),
            "mask": (F.when(real.isNotNull(), number_mask(real)) if real is not None else F.lit(None)).cast("int"),
            "whole": (number if number is not None and real is None else F.lit(None)).cast("long"),
            "text": (F.when(long, text_mask(text)).otherwise(text) if number is None else F.lit(None)).cast("string"),
            "hash": (F.when(long, F.xxhash64(text)) if number is None else F.lit(None)).cast("long"),
        }
        # a scan of one column each: together they read no more, and code for all columns at once would be too long to compile
        part = df.select(F.col(load).alias("load"), F.lit(i).alias("c"), state.otherwise(VALUE).alias("state"), *[v.alias(k) for k, v in cells.items()])
        rows = part if rows is None else rows.unionAll(part)
    return rows.groupBy("load", "c", "state", "bin", "mask", "whole", "text", "hash").agg(F.count(F.lit(1)).alias("n"))


def _by_column(column: Column, choices: dict[int, Column], kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for i, c in choices.items():
        out = F.when(column == i, c.cast(kind)).otherwise(out)
    return out


def token_counts(values: DataFrame, fields: list[T.StructField], edges: dict[int, list[float]]) -> DataFrame:
    """(load, c, aspect, token, n): presence, masks and values of every column, from its distinct values."""
    c, whole = F.col("c"), F.col("whole")
    numbers = {i: _as_number(f) for i, f in enumerate(fields)}
    bounds = {i: F.array(*[F.lit(e) for e in edges[i]]) for i, f in enumerate(fields) if numbers[i] is not None and not _real(f)}
    bins = F.size(F.filter(_by_column(c, bounds, "array<double>"), lambda e: e < whole))
    bucket = F.pmod(F.coalesce("hash", F.xxhash64("text")), F.lit(VALUE_BUCKETS))
    value = F.when(F.col("text").isNotNull(), bucket).when(whole.isNotNull(), bins).otherwise(F.col("bin"))
    masked = c.isin([i for i, f in enumerate(fields) if isinstance(f.dataType, WHOLE)])
    mask = F.when(F.col("hash").isNotNull(), F.col("text")).when(F.col("text").isNotNull(), text_mask(F.col("text")))
    mask = mask.when(whole.isNotNull() & masked, _mask_name(number_mask(whole.cast("double")))).otherwise(_mask_name(F.col("mask")))
    aspects = {"presence": F.col("state").cast("string"), "values": value.cast("string"), "masks": mask}
    parts = [F.struct(F.lit(a).alias("aspect"), t.alias("token")) for a, t in aspects.items()]
    rows = values.select("load", "c", "n", F.inline(F.array(*parts))).filter("token IS NOT NULL")
    return rows.groupBy("load", "c", "aspect", "token").agg(F.sum("n").alias("n"))


def shares(counts: DataFrame) -> DataFrame:
    """(load, c, aspect, token, n, total, p, q, k): the share of a token in its load (p) and in the bulk of the loads (q).

    The bulk's share is the median of the loads' shares (0 where a load lacks the token),
    scaled to sum 1; loads that are themselves odd hardly move it. k tokens have a share in
    the bulk. Sums by column are grouped and joined, so a column with a token for every row is never in one task.
    """
    each = ["c", "aspect"]
    totals = counts.groupBy("load", *each).agg(F.sum("n").alias("total"))
    own = counts.join(totals, ["load", *each]).withColumn("p", F.col("n") / F.col("total"))
    loads = totals.groupBy(*each).agg(F.count(F.lit(1)).alias("loads"))
    bulk = own.groupBy(*each, "token").agg(F.sort_array(F.collect_list("p")).alias("ps")).join(loads, each)
    at = F.ceil(F.col("loads") / 2) - (F.col("loads") - F.size("ps"))
    bulk = bulk.select(*each, "token", F.when(at > 0, F.get("ps", at.cast("int") - 1)).otherwise(0.0).alias("median"))
    whole = bulk.groupBy(*each).agg(F.sum("median").alias("whole"), F.count_if(F.col("median") > 0).alias("k"))
    bulk = bulk.join(whole, each).withColumn("q", F.when(F.col("whole") > 0, F.col("median") / F.col("whole")).otherwise(0.0))
    return own.join(bulk.select(*each, "token", "q", "k"), [*each, "token"])


def divergences(counts: DataFrame) -> DataFrame:
    """(load, c, aspect, n, k, divergence, rare): each load against the bulk of the loads.

    rare: share of the load's values whose token is rare in the bulk.
    """
    m = (F.col("p") + F.col("q")) / 2
    part = F.col("p") * F.log2(F.col("p") / m) + F.when(F.col("q") > 0, F.col("q") * F.log2(F.col("q") / m)).otherwise(0.0)
    return shares(counts).groupBy("load", "c", "aspect").agg(
        F.max("total").alias("n"),
        F.max("k").alias("k"),
        (0.5 * F.sum(part) + 0.5 * (1 - F.sum("q"))).alias("divergence"),
        F.sum(F.when(F.col("q") < RARE, F.col("p")).otherwise(0.0)).alias("rare"),
    )


def _chance(n: Column, k: Column) -> Column:
    """Divergence that chance alone gives a load of n values over k tokens, with a wide margin."""
    return (k + 6 * F.sqrt(2.0 * k)) / (8 * n * F.lit(0.6931471805599453))


def _departs(x: Column, chance: Column, floor: float) -> Column:
    """Whether x is clearly off the median load of its column: chance is its standard error by chance alone."""
    each = Window.partitionBy("column_name")
    spread = 1.4826 * F.median(F.abs(x)).over(each)
    return F.abs(x) > floor + ERRORS * F.greatest(chance, spread)


def column_profile(df: DataFrame, load: str = "load_no", skip: tuple[str, ...] = ("received_at",)) -> DataFrame:
    """Profile of every column of every load, and whether it departs from the bulk of the loads.

    Aspects: presence (null, NaN, value), masks (character classes of texts, sign and
    decimals of numbers), values (bins of numbers, dates and flags; hash buckets of texts)
    and distinct values. A load's column is changed if the divergence of an aspect from the
    bulk exceeds CLEAR plus the chance of so many values; if its rate of nulls, NaN, rare
    masks or values that are rare in the bulk (for numbers and dates those beyond its range)
    departs from the other loads' rates; or if its distinct values do, both by themselves and
    by their ratio to the values, so that the size of a load is no change. Rows with a null load number belong to no load
    and are left out; columns that are null throughout have only their presence; an empty
    table has no rows. Any column names and any number of columns will do, but one at least (ValueError).
    Returns (load_no, column_name, n_rows, null_rate, nan_rate, n_distinct, min_value,
    max_value, top_mask, rare_mask_rate, mask_divergence, value_divergence,
    presence_divergence, changed).
    """
    fields = _columns(df, load, skip)
    if not fields:
        raise ValueError("no column to profile")
    summaries, values, counts = _counted(df, load, fields)
    div = divergences(counts).withColumn("over", F.col("divergence") > F.lit(CLEAR) + _chance(F.col("n"), F.col("k")))
    pick = lambda aspect, c: F.max(F.when(F.col("aspect") == aspect, F.col(c)))
    judged = div.groupBy("load", "c").agg(
        pick("masks", "divergence").alias("mask_divergence"),
        pick("masks", "rare").alias("rare_mask_rate"),
        pick("values", "divergence").alias("value_divergence"),
        pick("values", "rare").alias("rare_value_rate"),
        pick("presence", "divergence").alias("presence_divergence"),
        F.max("over").alias("over"),
    )
    state = values.groupBy("load", "c").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("state") == NULL, F.col("n")).otherwise(0)).alias("nulls"),
        F.sum(F.when(F.col("state") == NAN, F.col("n")).otherwise(0)).alias("nans"),
        F.count_if(F.col("state") == VALUE).alias("exact"),
        F.min("whole").alias("low"),
        F.max("whole").alias("high"),
    )
    masks = counts.filter("aspect = 'masks'").groupBy("load", "c").agg(F.max_by("token", F.struct("n", "token")).alias("top_mask"))
    ends = [
        F.struct(
            F.lit(i).alias("c"),
            F.lit(f.name).alias("column_name"),
            (F.col(f"kinds{i}") if _real(f) else F.lit(None).cast("long")).alias("estimate"),
            *[(F.col(f"{end}{i}").cast("string") if _real(f) or _as_number(f) is None else F.lit(None).cast("string")).alias(f"{end}_text") for end in ("low", "high")],
        )
        for i, f in enumerate(fields)
    ]
    out = summaries.select("load", F.inline(F.array(*ends))).join(state, ["load", "c"]).join(masks, ["load", "c"], "left").join(judged, ["load", "c"], "left")
    whole = {i: f for i, f in enumerate(fields) if _as_number(f) is not None and not _real(f)}
    extreme = lambda end: F.coalesce(f"{end}_text", _by_column(F.col("c"), {i: _as_text(f, F.col(end)) for i, f in whole.items()}, "string"))
    out = out.withColumns({"n_distinct": F.coalesce("estimate", "exact"), "min_value": extreme("low"), "max_value": extreme("high")})
    values = F.col("n_rows") - F.col("nulls") - F.col("nans")
    out = out.withColumn("unique", F.when(values > 0, F.log(F.col("n_distinct") / values)))
    each = Window.partitionBy("column_name")
    rates = {"nulls": (F.col("nulls") / F.col("n_rows"), F.col("n_rows")), "nans": (F.col("nans") / F.col("n_rows"), F.col("n_rows"))}
    rates |= {x: (F.col(x), F.when(values > 0, values)) for x in ("rare_mask_rate", "rare_value_rate")}
    shift = [(F.median(x).over(each), x, n) for x, n in rates.values()]
    off = [(x - m).alias(f"off{k}") for k, (m, x, _) in enumerate(shift)]
    chance = [F.sqrt(F.greatest(m * (1 - m), 1 / n) / n).alias(f"chance{k}") for k, (m, _, n) in enumerate(shift)]
    count = F.when(values > 0, F.log("n_distinct"))
    usual = F.median("unique").over(each).alias("usual")
    out = out.select("*", usual, (F.col("unique") - F.median("unique").over(each)).alias("ratio"), (count - F.median(count).over(each)).alias("kinds"), *off, *chance)
    # the sketch's error (2 %) and a load of few values are no change
    clear = (values >= 30) & (F.abs("ratio") > CLEAR_DISTINCT)
    error = F.lit(0.02) + 1 / F.sqrt(F.greatest(values, F.lit(1)))
    both = (F.abs("kinds") > CLEAR_DISTINCT) & (F.signum("ratio") == F.signum("kinds"))
    both &= _departs(F.col("ratio"), error, CLEAR_DISTINCT) | _departs(F.col("kinds"), error, CLEAR_DISTINCT)
    odd = F.coalesce(clear & ((F.col("usual") > F.log(F.lit(NEARLY_UNIQUE))) | both), F.lit(False))
    for k in range(len(shift)):
        odd = odd | F.coalesce(_departs(F.col(f"off{k}"), F.col(f"chance{k}"), CLEAR_RATE), F.lit(False))
    return out.select(
        F.col("load").alias(load),
        "column_name",
        "n_rows",
        (F.col("nulls") / F.col("n_rows")).alias("null_rate"),
        (F.col("nans") / F.col("n_rows")).alias("nan_rate"),
        "n_distinct",
        "min_value",
        "max_value",
        "top_mask",
        "rare_mask_rate",
        "mask_divergence",
        "value_divergence",
        "presence_divergence",
        (F.coalesce("over", F.lit(False)) | odd).alias("changed"),
    )


def _counted(df: DataFrame, load: str, fields: list[T.StructField]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summaries of the loads, value counts, token counts); written once, small, and read by many steps."""
    known = df.filter(F.col(load).isNotNull())
    summaries = write_cut(_summaries(known, load, fields), "summaries").df
    edges = _edges(summaries, fields)
    values = write_cut(value_counts(known, load, fields, edges), "values").df
    return summaries, values, write_cut(token_counts(values, fields, edges), "profile").df


def rare_masks(df: DataFrame, load: str = "load_no", skip: tuple[str, ...] = ("received_at",)) -> DataFrame:
    """Pattern violations: (load_no, column_name, mask, n, share, usual_share), a row for each mask of a load that is rare in its column.

    Rare is a mask that makes up less than RARE of the bulk of the loads; nulls and NaN have none.
    Nulls, other columns and empty tables as in column_profile.
    """
    fields = _columns(df, load, skip)
    found = shares(_counted(df, load, fields)[2].filter("aspect = 'masks'")).filter(F.col("q") < RARE)
    name = F.get(F.array(*[F.lit(f.name) for f in fields]), F.col("c"))
    return found.select(F.col("load").alias(load), name.alias("column_name"), F.col("token").alias("mask"), "n", F.col("p").alias("share"), F.col("q").alias("usual_share"))


def changed_columns(df: DataFrame, load: str = "load_no", skip: tuple[str, ...] = ("received_at",)) -> DataFrame:
    """(load_no, column_name) of the columns that changed; see column_profile."""
    return column_profile(df, load, skip).filter("changed").select(load, "column_name")
