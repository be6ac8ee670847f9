"""Validation, normalisation and quarantine of raw transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.exprs import plain_number
from ..sources.session import cut

ALIASES = {"sender_id": "sender", "receiver_id": "receiver", "transaction_id": "tx_id"}
REQUIRED = ("sender_id", "receiver_id", "amount", "timestamp")
NUMBER_KIND = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?(Z|[+-]\d{2}:\d{2})?)?)?$"
# any other ISO form: basic and week dates, any separator, hours alone, compact times and offsets
OTHER_ISO = (r"^(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(-\d)?|\d{4}W\d{2}\d?)"
             r"(\D(\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?|\d{4}(\d{2}([.,]\d+)?)?)(Z|[+-]\d{2}(:?\d{2})?)?)?$")
AMOUNT = r"(?i)^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$|^[+-]?(inf|infinity|nan)$"


class TransferValidationError(ValueError):
    """Raised in strict mode when a batch is empty or holds an invalid row."""


def resolve_aliases(raw: DataFrame) -> DataFrame:
    """Main names for aliased columns. An alias counts only where the main key is absent."""
    for main, alias in ALIASES.items():
        if main not in raw.columns and alias in raw.columns:
            raw = raw.withColumnRenamed(alias, main)
        elif main in raw.columns and alias in raw.columns:
            raw = raw.withColumn(main, F.coalesce(F.col(main), F.col(alias).cast(raw.schema[main].dataType))).drop(alias)
    for name in (*REQUIRED, "transaction_id", *fixed.CONTEXT_FIELDS):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    return raw


def _week_day(text: Column) -> Column:
    """Date of ``2024-W01-1`` or ``2024W011``, Monday where no day is named; null for weeks and days that do not exist."""
    form = r"^(\d{4})-?W(\d{2})(?:-?(\d))?"
    year, week = (F.regexp_extract(text, form, i).try_cast("int") for i in (1, 2))
    day = F.coalesce(F.regexp_extract(text, form, 3).try_cast("int"), F.lit(1))
    start = F.when(year > 0, F.make_date(year, F.lit(1), F.lit(4)))  # always in the first week
    found = F.date_add(F.date_sub(start, F.weekday(start)), ((week - 1) * 7 + day - 1).cast("int"))
    return F.when((week >= 1) & day.between(1, 7) & (F.weekofyear(found) == week), found)


def _other_iso(text: Column) -> Column:
    """Text of any further ISO form, written in full."""
    full = F.translate(text, ",", ".")
    week = F.concat(F.date_format(_week_day(full), "yyyy-MM-dd"), F.regexp_replace(full, r"^\d{4}-?W\d{2}(-?\d)?", ""))
    full = F.when(full.rlike(r"^\d{4}-?W"), week).otherwise(F.regexp_replace(full, r"^(\d{4})(\d{2})(\d{2})(?=\D|$)", "$1-$2-$3"))
    for pattern, written in (
        (r"^(\d{4}-\d{2}-\d{2})\D", "$1T"), (r"^(.{10}T\d{2})(\d{2})(\d{2})", "$1:$2:$3"), (r"^(.{10}T\d{2})(\d{2})(?=\D|$)", "$1:$2"),
        (r"^(.{10}T\d{2})(?=[Z+-]|$)", "$1:00"), (r"^(.{10}T\d{2}:\d{2})(?=[Z+-]|$)", "$1:00"), (r"([+-]\d{2})(\d{2})$", "$1:$2"), (r"(T.*[+-]\d{2})$", "$1:00"), (r"(\.\d{6})\d+", "$1"),
    ):
        full = F.regexp_replace(full, pattern, written)
    return full


def parse_time(raw: DataFrame, name: str = "timestamp") -> Column:
    """UTC timestamp from ISO-8601 text (naive means UTC; basic, week and shortened forms included), epoch seconds >= 0
    given as a number, or null. A quoted number is no time."""
    kind = raw.schema[name].dataType
    col = F.col(name)
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("timestamp")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return col.cast("timestamp")
    if isinstance(kind, T.NumericType):
        seconds = col.cast("double")
        return F.when(~F.isnan(seconds) & (seconds >= 0) & (seconds < 253402300800.0),
                      F.timestamp_micros((seconds * 1e6).cast("bigint")))
    if isinstance(kind, T.VariantType):
        number = F.try_variant_get(col, "$", "double")
        seconds = F.when(F.schema_of_variant(col).rlike(NUMBER_KIND) & (number >= 0) & (number < 253402300800.0), number)
        text = F.when(F.schema_of_variant(col) == "STRING", F.trim(F.try_variant_get(col, "$", "string")))
    else:
        seconds, text = F.lit(None).cast("double"), F.trim(col.cast("string"))
    return (
        F.when(seconds.isNotNull(), F.timestamp_micros((seconds * 1e6).cast("bigint")))
        .when(text.rlike(ISO), F.try_to_timestamp(F.translate(text, ",", ".")))
        .when(text.rlike(OTHER_ISO), F.try_to_timestamp(_other_iso(text)))
    )


def _amount_text(text: Column) -> tuple[Column, Column]:
    """Numbers as people write them; suffixes and hexadecimal forms that a cast would take are no amounts."""
    plain = F.trim(text)
    value = F.when(plain.rlike(AMOUNT), F.regexp_replace(plain, "_", "").try_cast("double"))
    bad = F.concat(F.lit("Invalid amount format: cannot parse '"), text, F.lit("' as numeric"))
    return value, F.when(value.isNull(), bad)


def _amount(raw: DataFrame) -> tuple[Column, Column]:
    """(amount as double or null, reason for a wrong type or null)."""
    kind = raw.schema["amount"].dataType
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("double"), F.lit("Invalid amount type: bool")
    if isinstance(kind, T.NumericType):
        return F.col("amount").cast("double"), F.lit(None).cast("string")
    if isinstance(kind, T.StringType):
        return _amount_text(F.col("amount"))
    if isinstance(kind, T.VariantType):
        given = F.col("amount")
        found = F.schema_of_variant(given)
        value, bad = _amount_text(F.try_variant_get(given, "$", "string"))
        number = F.when(found.rlike(NUMBER_KIND), F.try_variant_get(given, "$", "double"))
        wrong = F.when(found == "BOOLEAN", F.lit("Invalid amount type: bool")).when(
            ~found.rlike(NUMBER_KIND) & (found != "STRING"), F.concat(F.lit("Invalid amount type: "), F.lower(found)))
        return F.coalesce(number, F.when(found == "STRING", value)), F.coalesce(wrong, F.when(found == "STRING", bad))
    return F.lit(None).cast("double"), F.lit(f"Invalid amount type: {kind.simpleString()}")


def _context(name: str) -> Column:
    text = F.trim(F.col(name).cast("string"))
    clean = F.substring(F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ ]]", ""), 1, fixed.CONTEXT_WIDTH)
    return F.when((text != "") & (F.lower(text) != "nan"), clean)


def check(raw: DataFrame, max_amount: float = fixed.MAX_AMOUNT) -> DataFrame:
    """Every raw row with its clean columns and ``error`` (null when valid).

    The first failing check names the reason. Duplicate ids are judged last, among rows that passed
    every other check: the lowest ``row_index`` keeps the id.
    """
    raw = resolve_aliases(raw)
    original = [c for c in raw.columns if c != "row_index"]
    if "row_index" not in raw.columns:
        raw = cut(raw.withColumn("row_index", F.monotonically_increasing_id()))  # numbered once, whatever reads it
    # Parsed once, in a projection of its own; the checks below only compare its columns.
    value, bad_type = _amount(raw)
    raw = raw.select(
        "*", F.to_json(F.struct(*original)).alias("__raw"), F.trim(F.col("sender_id").cast("string")).alias("__sender"),
        F.trim(F.col("receiver_id").cast("string")).alias("__receiver"), value.alias("__amount"), bad_type.alias("__bad"), parse_time(raw).alias("__when"))
    sender, receiver, amount, when = (F.col(c) for c in ("__sender", "__receiver", "__amount", "__when"))
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])

    def text(prefix: str, col: Column, suffix: str) -> Column:
        return F.concat(F.lit(prefix), col, F.lit(suffix))

    error = (
        F.when(missing != "", F.concat(F.lit("Missing required fields: "), missing))
        .when(sender == "", F.lit("Invalid sender_id: must be non-empty string or integer identifier"))
        .when(receiver == "", F.lit("Invalid receiver_id: must be non-empty string or integer identifier"))
        .when(sender == receiver, text("Self-transfer detected: sender_id equals receiver_id (", sender, ")"))
        .when(F.col("__bad").isNotNull(), F.col("__bad"))
        .when(F.isnan(amount), F.lit("Invalid amount: NaN is strictly prohibited"))
        .when(F.abs(amount) == float("inf"), F.lit("Invalid amount: infinite value detected"))
        .when(amount < 0, text("Invalid amount: negative value (", plain_number(amount), ") is not permitted"))
        .when(amount == 0, F.lit("Invalid amount: zero-value transactions are invalid"))
        .when(amount > max_amount, text("Extreme amount: ", plain_number(amount),
                                        f" exceeds maximum allowed limit ({max_amount})"))
        .when(when.isNull(), text("Invalid timestamp: '", F.coalesce(F.col("timestamp").cast("string"), F.lit("")),
                                  "' cannot be parsed as a valid ISO-8601 or epoch date"))
    )
    given = F.nullif(F.trim(F.col("transaction_id").cast("string")), F.lit(""))
    ok = F.col("reason").isNull()
    tagged = raw.withColumn("reason", error).select(
        "row_index",
        F.col("__raw").alias("raw"),
        "reason",
        given.alias("given_id"),
        F.when(ok, sender).alias("sender_id"),
        F.when(ok, receiver).alias("receiver_id"),
        F.when(ok, F.round(amount, 4).cast("decimal(18,4)")).alias("amount"),
        F.when(ok, when).alias("ts"),
        *[_context(c).alias(c) for c in fixed.CONTEXT_FIELDS],
    )
    # Aggregate per id (combined map-side) instead of a window, so one id repeated on a third of all
    # rows is one partial row per task. Only ids seen twice are joined back.
    repeated = (
        tagged.where("reason IS NULL AND given_id IS NOT NULL").groupBy("given_id")
        .agg(F.min("row_index").alias("first_row"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    late = F.col("reason").isNull() & (F.col("row_index") > F.col("first_row"))
    made = F.concat(F.lit("TX_"), F.hex(F.xxhash64("sender_id", "receiver_id", "amount", "ts", "row_index")))
    # rows without an id get a key of their own that matches nothing, so they do not meet in one task
    own = F.coalesce("given_id", F.concat(F.lit("\u0000"), F.col("row_index").cast("string")))
    out = tagged.join(repeated.withColumnRenamed("given_id", "seen_id"), own == F.col("seen_id"), "left").withColumn(
        "error",
        F.coalesce(F.col("reason"), F.when(late, text("Duplicate transaction_id detected: '", F.col("given_id"), "'"))),
    )
    micros = F.date_format("ts", "SSSSSS")
    return out.select(
        "row_index", "raw", "error",
        F.coalesce("given_id", made).alias("transaction_id"),
        "sender_id", "receiver_id", "amount",
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
                 F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")),
                 F.lit("+00:00")).alias("timestamp"),
        F.floor(F.unix_micros("ts") / 1_000_000).cast("bigint").alias("t"),
        *fixed.CONTEXT_FIELDS,
    )


def valid(checked: DataFrame) -> DataFrame:
    return checked.where("error IS NULL").drop("error", "raw")


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.where("error IS NOT NULL").select("row_index", "error", "raw")


def summary(checked: DataFrame) -> DataFrame:
    """One row: processed, valid and invalid counts, and whether the whole batch is valid."""
    good = F.count_if(F.col("error").isNull())
    bad = F.count_if(F.col("error").isNotNull())
    return checked.agg(
        F.count("*").alias("total_processed"), good.alias("valid_count"), bad.alias("invalid_count"),
        ((bad == 0) & (good > 0)).alias("is_valid"),
    )


def validate(raw: DataFrame, strict: bool = False, max_amount: float = fixed.MAX_AMOUNT) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine). Strict mode runs the checks now and raises on the first bad row."""
    checked = check(raw, max_amount)
    if strict:
        if checked.isEmpty():
            raise TransferValidationError("Empty dataset: transactions DataFrame contains 0 rows")
        first = quarantine(checked).orderBy("row_index").select("row_index", "error").first()
        if first:
            raise TransferValidationError(f"Row {first.row_index}: {first.error}")
    return valid(checked), quarantine(checked)
