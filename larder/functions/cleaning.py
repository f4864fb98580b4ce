"""Column expressions that turn raw text into typed values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder import config

# A plain decimal number; Spark's cast alone would also take Java suffixes such as "12d".
_NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"
_DAY_FIRST = r"^\s*([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\s*$"
_ISO = r"^\s*([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})(?:T.*)?\s*$"


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number_or_null(c) -> Column:
    """Text to double; anything that is not a plain number is null."""
    return F.regexp_extract(as_column(c).cast("string"), _NUMBER, 1).try_cast("double")


def number_or_zero(c) -> Column:
    """Text to double; null and bad text count as 0."""
    return F.coalesce(number_or_null(c), F.lit(0.0))


def comma_number(c) -> Column:
    """Text with thousands commas to double; null and bad text count as 0."""
    return number_or_zero(F.replace(as_column(c).cast("string"), F.lit(","), F.lit("")))


def strict_number(c) -> Column:
    """Keep digits, dot and minus (drops currency signs and commas); bad text is null."""
    return number_or_null(F.regexp_replace(as_column(c).cast("string"), r"[^0-9.\-]", ""))


def _day_first_text(c) -> Column:
    """``d/M/yyyy`` text as ``yyyy-M-d``, anything else as empty text."""
    whole = F.regexp_extract(as_column(c), _DAY_FIRST, 0)
    return F.regexp_replace(whole, _DAY_FIRST, "$3-$2-$1")


def day_first(c) -> Column:
    """``d/M/yyyy`` text to a date, otherwise null."""
    return _day_first_text(c).try_cast("date")


def iso_day(c) -> Column:
    """The date part before ``T`` of an ISO text, otherwise null."""
    return F.regexp_extract(as_column(c), _ISO, 1).try_cast("date")


def any_day(c) -> Column:
    """Day-first or ISO text to a date: two stated formats instead of guessing from the data.

    At most one of the two texts is not empty, so one cast serves both. Casting is far cheaper
    than a date formatter, which throws for every text it cannot read.
    """
    iso = F.regexp_extract(as_column(c), _ISO, 1)
    return F.concat(_day_first_text(c), iso).try_cast("date")


def channel_name(c) -> Column:
    return F.coalesce(F.trim(as_column(c)), F.lit("Unknown"))


def item_id(sku="sku", channel="channel") -> Column:
    """SKU and channel joined by an underscore; null without a SKU, an unnamed channel is Unknown."""
    return F.concat(as_column(sku), F.lit("_"), F.coalesce(as_column(channel), F.lit("Unknown")))


def sku_of(item="item_id") -> Column:
    """Text before the last underscore of an item id; the whole id if it has none."""
    return F.regexp_replace(as_column(item), r"_[^_]*$", "")


def channel_of(item="item_id") -> Column:
    """Text after the last underscore of an item id; Unknown if it has none."""
    item = as_column(item)
    return F.when(item.contains("_"), F.regexp_extract(item, r"_([^_]*)$", 1)).otherwise(
        F.when(item.isNotNull(), "Unknown"))


def sku_category(sku="sku") -> Column:
    """Leading capital letters of a SKU, null if there are none."""
    return F.nullif(F.regexp_extract(as_column(sku), r"^([A-Z]+)", 1), F.lit(""))


def sellable_sku(sku="sku") -> Column:
    """False for service and gift prefixes and for bundles (``+`` in the SKU)."""
    c = as_column(sku)
    return ~c.rlike(f"^({'|'.join(config.EXCLUDED_SKU_PREFIXES)})") & ~c.contains("+")


def genuine_order(email="email", name="name", tags="tags") -> Column:
    """False for test, replacement, warranty and ``rr`` orders; null fields drop the row, as in SQL."""
    keep = ~F.lower(as_column(email)).contains("test") & ~F.lower(as_column(name)).contains("test")
    for word in ("replacement", "warranty", "rr"):
        keep = keep & ~F.lower(as_column(tags)).contains(word)
    return keep


def wallet_price(tags="tags", total="total_price") -> Column:
    """Order total plus the wallet amount named in a comma-separated tag, when both tags are set."""
    tags, total = as_column(tags), as_column(total)
    amount_tag = F.get(
        F.filter(F.split(tags, ","), lambda t: t.contains("app_wallet_used_amount")), F.lit(0))
    amount = number_or_null(F.replace(amount_tag, F.lit("app_wallet_used_amount_"), F.lit("")))
    paid = tags.contains("app_wallet_used") & tags.contains("COD + Wallet")
    return F.when(paid, amount + total).otherwise(total)


def lookup(mapping: dict, key, default) -> Column:
    """Constant dictionary lookup with a default."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), as_column(key)), F.lit(default))


def feedback_score(c) -> Column:
    return lookup(config.FEEDBACK_SCORES, c, 0.0)


def warehouse_of(channel="channel") -> Column:
    return lookup(config.WAREHOUSE_BY_CHANNEL, channel, config.DEFAULT_WAREHOUSE)


def units(c) -> Column:
    """Forecast to whole units: clip at 0, round half to even."""
    return F.bround(F.greatest(as_column(c), F.lit(0.0)), 0).cast("int")
