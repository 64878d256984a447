"""Row-local operators: no shuffle, one pass, usable on batch and stream alike."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smeltry.functions import columns as C
from smeltry.functions.ladders import Ladder, bucket

# --- fixed values -----------------------------------------------------------
EVENT_TYPES = (
    "page_view", "product_view", "add_to_cart", "remove_from_cart", "add_to_wishlist",
    "search", "filter_apply", "sort_apply", "checkout_start", "purchase_complete",
    "user_login", "user_logout",
)
MARKETPLACES = ("Amazon", "eBay", "Shopify", "Etsy", "Walmart")
# ----------------------------------------------------------------------------


def require_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(columns))


def positive_amount(df: DataFrame, column: str = "amount", below: float | None = None) -> DataFrame:
    keep = F.col(column) > 0
    if below is not None:
        keep = keep & (F.col(column) < below)
    return df.filter(keep)


def business_rules(
    df: DataFrame, source: str, until: datetime | str | None = None,
    since: datetime | str = "2024-01-01 00:00:00",
) -> DataFrame:
    """Source-specific plausibility filter.

    ``until`` bounds event time from above; pass the run time of the job.
    """
    if source == "user_events":
        keep = [F.col("event_time") >= F.lit(since).cast("timestamp")]
        if until is not None:
            keep.append(F.col("event_time") <= F.lit(until).cast("timestamp"))
        needed = ["event_time", "customer_id", "event_type"]
    elif source == "marketplace_sales":
        keep = [F.col("amount") > 0, F.col("amount") < 10000]
        needed = ["transaction_id", "amount", "transaction_time"]
    elif source == "customer_data":
        keep = [F.col("email").rlike(C.EMAIL)]
        needed = ["customer_id", "email"]
    else:
        return df
    return df.filter(C.all_of([F.col(c).isNotNull() for c in needed] + keep))


def standardize_timestamps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.col(c).try_cast("timestamp") for c in present})


def add_audit_columns(
    df: DataFrame, processed_time: datetime | None = None,
    data_source: str = "bronze_layer", version: str = "1.0",
) -> DataFrame:
    stamp = F.lit(processed_time) if processed_time is not None else F.current_timestamp()
    return df.withColumns(
        {
            "processed_time": stamp.cast("timestamp"),
            "data_source": F.lit(data_source),
            "pipeline_version": F.lit(version),
        }
    )


def clean_strings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: C.blank_to_null(c) for c in present})


def to_usd(
    df: DataFrame, amount_columns: Sequence[str], currency_column: str = "currency",
    rates: Mapping[str, float] = C.USD_RATES,
) -> DataFrame:
    """Convert amounts in place and keep the input as ``{column}_original``."""
    if currency_column not in df.columns:
        return df
    new = {}
    for c in amount_columns:
        if c in df.columns:
            new[f"{c}_original"] = F.col(c)
            new[c] = C.usd(F.col(c), F.col(currency_column), rates)
    return df.withColumns(new) if new else df


def date_parts(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.withColumns(
        {
            f"{column}_year": F.year(c),
            f"{column}_month": F.month(c),
            f"{column}_day": F.dayofmonth(c),
            f"{column}_quarter": F.quarter(c),
            f"{column}_dayofweek": F.dayofweek(c),
            f"{column}_weekofyear": F.weekofyear(c),
        }
    )


def hash_key(df: DataFrame, columns: Sequence[str], out: str = "hash_key") -> DataFrame:
    return df.withColumn(out, C.sha256_key(columns))


def surrogate_key_hash(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn(out, C.hash_surrogate(column))


def lift_map(df: DataFrame, map_col: str, fields: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Lift map entries into columns; ``fields`` maps key -> (type, default)."""
    return df.withColumns(
        {key: C.from_map(map_col, key, dtype, default) for key, (dtype, default) in fields.items()}
    )


def label(df: DataFrame, column: str, ladder: Ladder, out: str) -> DataFrame:
    return df.withColumn(out, bucket(F.col(column), ladder))


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace NULLs by defaults cast to each column's own type, so none is skipped."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns(
        {
            c: F.coalesce(F.col(c), F.lit(v).cast(types[c]))
            for c, v in defaults.items()
            if c in types
        }
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast every declared column that is present; leave the others alone.

    Meant for all-text input; values that do not parse become NULL.
    """
    want = {f.name: f.dataType for f in schema.fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[C.lenient_cast(c, want[c], have[c]) if c in want else F.col(c) for c in df.columns]
    )


def select_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the declared columns, in order and type; absent ones become NULL."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            C.lenient_cast(f.name, f.dataType, have[f.name])
            if f.name in have
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def constant_scd_columns(df: DataFrame, day: date | str, stamp: datetime | None = None) -> DataFrame:
    """History columns of an initial load: open from ``day``, current."""
    now = (F.lit(stamp) if stamp is not None else F.current_timestamp()).cast("timestamp")
    return df.withColumns(
        {
            "effective_start_date": C.day_lit(day),
            "effective_end_date": F.lit(C.OPEN_END),
            "is_current": F.lit(True),
            "created_time": now,
            "updated_time": now,
        }
    )


def _missing(columns: Sequence[str]):
    """First missing required column as a reason, or NULL."""
    return F.coalesce(
        *[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in columns]
    )


def validate_event(df: DataFrame, event_types: Sequence[str] = EVENT_TYPES) -> DataFrame:
    reason = F.coalesce(
        _missing(["event_id", "customer_id", "event_type", "event_time"]),
        F.when(~F.col("event_type").isin(list(event_types)), F.lit("invalid event_type")),
    )
    return df.withColumns({"reject_reason": reason, "is_valid": reason.isNull()})


def validate_sale(df: DataFrame, marketplaces: Sequence[str] = MARKETPLACES) -> DataFrame:
    """An unknown marketplace is only flagged: the sale stays valid."""
    reason = F.coalesce(
        _missing(["transaction_id", "marketplace_name", "product_id", "amount"]),
        F.when(F.col("amount").try_cast("double").isNull(), F.lit("invalid amount")),
        F.when(F.col("amount").try_cast("double") <= 0, F.lit("invalid amount")),
    )
    return df.withColumns(
        {
            "reject_reason": reason,
            "is_valid": reason.isNull(),
            "unknown_marketplace": F.col("marketplace_name").isNotNull()
            & ~F.col("marketplace_name").isin(list(marketplaces)),
        }
    )


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantine) halves of a validated frame."""
    clean = df.filter("is_valid").drop("is_valid", "reject_reason")
    return clean, df.filter("NOT is_valid").drop("is_valid")


def with_delay(
    df: DataFrame, event_ts: str, ingest_ts: str, ladder: Ladder, late_after_hours: float = 1.0,
) -> DataFrame:
    """Arrival delay, its label, and whether it counts as delayed.

    An unreadable time gives 0 hours, the ladder's ``unknown`` label, not delayed.
    """
    hours = C.hours_between(
        F.col(event_ts).try_cast("timestamp"), F.col(ingest_ts).try_cast("timestamp")
    )
    return (
        df.withColumn("_delay", hours)
        .withColumns(
            {
                "delay_hours": F.coalesce(F.col("_delay"), F.lit(0.0)),
                "delay_category": bucket(F.col("_delay"), ladder),
                "is_delayed": F.coalesce(F.col("_delay") > late_after_hours, F.lit(False)),
            }
        )
        .drop("_delay")
    )
