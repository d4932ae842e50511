"""Display formatting as native Column expressions.

Everything here is a JVM-side expression (whole-stage codegen), applied to
whole DataFrames; no Python UDFs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's for identical output) ---------
CURRENCY_SIGN = "₹"
DATETIME_FORMAT = "dd MMM yyyy, hh:mm a"        # Python "%d %b %Y, %I:%M %p"
TIME_FORMAT = "hh:mm a"                          # "%I:%M %p"
CHART_LABEL_FORMAT = "dd MMM hh:mm a"            # "%d %b %I:%M %p"
TEXT_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"    # "%Y-%m-%d %H:%M:%S"
DISPLAY_ZONE = "Asia/Kolkata"
STORAGE_ZONE = "UTC"
DEFAULT_IMAGE = "https://res.cloudinary.com/demo/image/upload/v1633427556/default_image.jpg"
MAP_LINK_PREFIX = "https://www.google.com/maps?q="
ORDER_STATUS_BADGE = {
    "pending": "warning",
    "confirmed": "info",
    "processing": "primary",
    "shipped": "purple",
    "delivered": "success",
    "cancelled": "danger",
    "refunded": "secondary",
}
PAYMENT_STATUS_BADGE = {
    "pending": "warning",
    "completed": "success",
    "failed": "danger",
    "refunded": "secondary",
    "processing": "info",
}
STATUS_COLOR = {
    "pending": "#ffc107",
    "confirmed": "#17a2b8",
    "processing": "#007bff",
    "shipped": "#6f42c1",
    "delivered": "#28a745",
    "cancelled": "#dc3545",
}
DEFAULT_BADGE = "secondary"
DEFAULT_COLOR = "#6c757d"
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# -----------------------------------------------------------------------------

_TOKEN = re.compile(r"yyyy|MMM|MM|dd|HH|hh|mm|ss|a|.", re.S)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def currency(col: str | Column) -> Column:
    """``₹1,234.50``; NULL or text that is not a number gives ``₹0.00``."""
    amount = F.coalesce(_c(col).try_cast("double"), F.lit(0.0))
    return F.concat(F.lit(CURRENCY_SIGN), F.format_number(amount, 2))


def format_ntz(col: str | Column, pattern: str) -> Column:
    """A ``timestamp_ntz`` as text in a date pattern (``yyyy MM MMM dd HH hh mm
    ss a``; other characters are literal).  NULL stays NULL.

    ``date_format`` casts NTZ values through the session time zone, which
    moves wall times inside a daylight-saving gap by an hour; here the text
    is composed from the value's own zone-free parts instead (beyond the years
    1 to 9999, from its zone-free string form).
    """
    ts = _c(col).cast("timestamp_ntz")
    tokens = _TOKEN.findall(pattern)
    # years of four digits: from the parts of the value, none of which makes its whole text first
    parts, text = _parts(ts), _text_parts(ts.cast("string"))
    plain, other = (F.concat(*[of.get(tok, F.lit(tok)) for tok in tokens]) for of in (parts, text))
    return F.when(F.year(ts).between(1, 9999), plain).when(ts.isNotNull(), other)


def _two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def _parts(ts: Column) -> dict[str, Column]:
    hour = F.hour(ts)
    return {
        "yyyy": F.lpad(F.year(ts).cast("string"), 4, "0"),
        "MM": _two(F.month(ts)),
        "MMM": F.element_at(F.array(*[F.lit(m) for m in MONTH_ABBR]), F.month(ts)),
        "dd": _two(F.dayofmonth(ts)),
        "HH": _two(hour),
        "hh": _two((hour + 11) % 12 + 1),
        "mm": _two(F.minute(ts)),
        "ss": _two(F.second(ts)),
        "a": F.when(hour < 12, F.lit("AM")).otherwise(F.lit("PM")),
    }


def _text_parts(s: Column) -> dict[str, Column]:
    """The same of the text ``yyyy-MM-dd HH:mm:ss[.f]``."""
    hour = F.substring(s, 12, 2).cast("int")
    return {
        "yyyy": F.substring(s, 1, 4),
        "MM": F.substring(s, 6, 2),
        "MMM": F.element_at(F.array(*[F.lit(m) for m in MONTH_ABBR]), F.substring(s, 6, 2).cast("int")),
        "dd": F.substring(s, 9, 2),
        "HH": F.substring(s, 12, 2),
        "hh": F.lpad(((hour + 11) % 12 + 1).cast("string"), 2, "0"),
        "mm": F.substring(s, 15, 2),
        "ss": F.substring(s, 18, 2),
        "a": F.when(hour < 12, F.lit("AM")).otherwise(F.lit("PM")),
    }


def to_display_zone(col: str | Column) -> Column:
    """A naive timestamp taken as UTC, shown in IST (NULL stays NULL)."""
    return F.convert_timezone(F.lit(STORAGE_ZONE), F.lit(DISPLAY_ZONE), _c(col).cast("timestamp_ntz"))


def datetime_text(col: str | Column, fmt: str = DATETIME_FORMAT, convert: bool = False) -> Column:
    """Formatted timestamp, empty string for NULL.

    ``convert=False`` is the live behaviour (no zone change); ``True`` converts
    UTC to IST first, as the richer layer does.
    """
    ts = to_display_zone(col) if convert else _c(col)
    return F.coalesce(format_ntz(ts, fmt), F.lit(""))


def datetime_text_from_string(col: str | Column, fmt: str = DATETIME_FORMAT) -> Column:
    """Text input; text that does not parse is returned unchanged."""
    s = _c(col)
    shape = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"  # what strptime(TEXT_TIMESTAMP_FORMAT) takes
    parsed = F.when(s.rlike(shape), s.try_cast("timestamp_ntz"))
    return F.coalesce(format_ntz(parsed, fmt), s, F.lit(""))


def datetime_text_or_na(col: str | Column, fmt: str = DATETIME_FORMAT) -> Column:
    """Browser formatting with 'N/A' for missing values."""
    return F.coalesce(format_ntz(to_display_zone(col), fmt), F.lit("N/A"))


def browser_datetime_text(col: str | Column, fmt: str = DATETIME_FORMAT) -> Column:
    """X6 for text input (``formatDateTime``): 'N/A' when missing or empty,
    the text itself when it is not a date, else the IST rendering."""
    s = _c(col)
    shape = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?$"
    parsed = F.when(s.rlike(shape), F.regexp_replace(s, "T", " ").try_cast("timestamp_ntz"))
    shown = F.coalesce(format_ntz(to_display_zone(parsed), fmt), s)
    return F.when(s.isNull() | (s == ""), F.lit("N/A")).otherwise(shown)


def truncate(col: str | Column, n: int) -> Column:
    """First ``n`` characters plus '...' when longer, else unchanged."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def signature_mask(col: str | Column, n: int = 30) -> Column:
    """First 30 characters and '...' always; NULL stays NULL."""
    c = _c(col)
    return F.when(c.isNotNull(), F.concat(F.substring(c, 1, n), F.lit("...")))


def title_case(col: str | Column) -> Column:
    """Python ``str.title``: a letter is raised after any non-letter.

    ``initcap`` only splits on spaces, so split after every non-letter and
    ``initcap`` each piece.
    """
    pieces = F.split(_c(col), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(pieces, lambda p: F.initcap(p)), "")


def map_link(lat: str | Column, lon: str | Column) -> Column:
    """Maps URL when both coordinates are present and non-zero."""
    la, lo = _c(lat), _c(lon)
    ok = la.isNotNull() & lo.isNotNull() & (la != 0) & (lo != 0)
    return F.when(ok, F.concat(F.lit(MAP_LINK_PREFIX), la.cast("string"), F.lit(","), lo.cast("string")))


def image_url(col: str | Column) -> Column:
    """The URL when it starts with 'http', else the default image."""
    c = _c(col)
    return F.when(c.startswith("http"), c).otherwise(F.lit(DEFAULT_IMAGE))


def location_text(city: str | Column, state: str | Column) -> Column:
    """X18: 'city, state' or 'N/A' when there is no city."""
    ci, st = _c(city), _c(state)
    return F.when(ci.isNull() | (ci == ""), F.lit("N/A")).otherwise(
        F.when(st.isNull() | (st == ""), ci).otherwise(F.concat_ws(", ", ci, st)))


def active_text(col: str | Column) -> Column:
    """X19: 'Active' / 'Inactive'; NULL counts as inactive."""
    return F.when(_c(col), F.lit("Active")).otherwise(F.lit("Inactive"))


def address_block(*cols: str | Column) -> Column:
    """Non-empty address lines joined by newlines."""
    return F.concat_ws("\n", *[F.nullif(_c(c), F.lit("")) for c in cols])


def two_decimals(col: str | Column) -> Column:
    """``toFixed(2)`` without grouping commas."""
    return F.call_function("format_number", _c(col).cast("double"), F.lit("0.00"))


def or_default(col: str | Column, default: str) -> Column:
    """X22: 'N/A', 'Never', 'No orders', 'pending' for missing values."""
    return F.coalesce(_c(col).cast("string"), F.lit(default))


def _lookup(mapping: dict[str, str], key: Column, default: str) -> Column:
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.create_map(*pairs)[F.lower(key)], F.lit(default))


def status_badge(col: str | Column) -> Column:
    """M1: order status to badge class, case-folded; 'secondary' otherwise."""
    return _lookup(ORDER_STATUS_BADGE, _c(col), DEFAULT_BADGE)


def payment_badge(col: str | Column) -> Column:
    """M2: payment status to badge class."""
    return _lookup(PAYMENT_STATUS_BADGE, _c(col), DEFAULT_BADGE)


def status_color(col: str | Column) -> Column:
    """M3: status label to chart colour."""
    return _lookup(STATUS_COLOR, _c(col), DEFAULT_COLOR)


def to_json_record(*cols: str | Column) -> Column:
    """A nested record as JSON text: ISO timestamps with microseconds,
    numeric decimals, null fields written out."""
    return F.to_json(F.struct(*[_c(c) for c in cols]),
                     {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"})
