"""Table schemas, value domains, defaults and compare lists.

Stored ledgers are Parquet snapshots with the fixed schemas below. Money is
DECIMAL(12,2) (DECIMAL(14,2) for pending investments); the audit columns hold
the UTC wall clock as TIMESTAMP_NTZ, like the naive UTC datetimes of the
service we mirror.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the original service's values for results to
# match; they are stated here plainly and in natural order.
# ---------------------------------------------------------------------------

# Status domain: raw text is upper-cased and looked up by enum *name*;
# the stored value is the enum value.
STATUS_VALUES = {"PAID": "Paid", "PENDING": "Pending", "OVERDUE": "Overdue", "CANCELLED": "Cancelled"}

# Expense type domain: looked up by name, case-sensitive.
EXPENSE_TYPES = ("CAPEX", "OPEX", "COGS")

# Category names whose expenses are flagged recurring (period "monthly").
RECURRING_CATEGORIES = (
    "Alquiler",
    "Utilidades",
    "Gastos Personal",
    "Sueldos",
    "Internet, Agua y Electricidad",
    "Electricidad Nave",
)
RECURRENCE_PERIOD = "monthly"

# Income tax rate applied to a positive EBIT.
TAX_RATE = "0.15"

# Money compare tolerance used by change detection.
MONEY_TOLERANCE = "0.001"

# Defaults when a column is missing from the export altogether.
DEFAULT_PARTY = "Unknown"
DEFAULT_CURRENCY = "THB"
DEFAULT_LOCATION = "Unknown"
DEFAULT_CATEGORY = "Uncategorized"
AUTO_DOC_PREFIX = "AUTO-"

# Report labels.
YEARLY_LABEL = "Total"
ALL_LOCATIONS = "All"
REPORT_FORMATS = ("yearly", "monthly")
MAX_MONTH_DIFFERENCE = 12

# Pending-investment defaults.
PENDING_DEFAULTS = {"currency": "THB", "committed_amount": "0", "priority": "Medium", "status": "Planned"}

# Fields compared by change detection (row_id is the match key).
INCOME_COMPARE = ("doc_date", "customer", "currency", "amount", "vat", "grand_total", "status", "location")
EXPENSE_COMPARE = (
    "doc_date", "overdue_date", "supplier", "currency", "amount", "vat", "grand_total",
    "status", "type", "location", "category_key",
)
MONEY_FIELDS = ("amount", "vat", "grand_total")

# Separator between a parent name and a child name in a category key.
CATEGORY_KEY_SEP = "\u001f"

# ---------------------------------------------------------------------------
# Spark types
# ---------------------------------------------------------------------------

MONEY = T.DecimalType(12, 2)
MONEY_PARSE = T.DecimalType(38, 2)
MONEY_BEYOND = "1E20"  # stands for a number too wide to parse
MONEY_WIDE = T.DecimalType(14, 2)

INCOME_SCHEMA = T.StructType([
    T.StructField("row_id", T.StringType()),
    T.StructField("doc_no", T.StringType(), False),
    T.StructField("doc_date", T.DateType(), False),
    T.StructField("customer", T.StringType(), False),
    T.StructField("currency", T.StringType(), False),
    T.StructField("amount", MONEY, False),
    T.StructField("vat", MONEY),
    T.StructField("grand_total", MONEY, False),
    T.StructField("status", T.StringType(), False),
    T.StructField("location", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("created_by", T.StringType()),
    T.StructField("notes", T.StringType()),
])

EXPENSE_SCHEMA = T.StructType([
    T.StructField("row_id", T.StringType()),
    T.StructField("doc_no", T.StringType(), False),
    T.StructField("doc_date", T.DateType(), False),
    T.StructField("overdue_date", T.DateType()),
    T.StructField("supplier", T.StringType(), False),
    T.StructField("currency", T.StringType(), False),
    T.StructField("amount", MONEY, False),
    T.StructField("vat", MONEY),
    T.StructField("grand_total", MONEY, False),
    T.StructField("status", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("location", T.StringType(), False),
    T.StructField("category_key", T.StringType(), False),
    T.StructField("subcategory_free", T.StringType()),
    T.StructField("is_recurring", T.BooleanType(), False),
    T.StructField("recurrence_period", T.StringType()),
    T.StructField("forecasted_until", T.DateType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("created_by", T.StringType()),
    T.StructField("notes", T.StringType()),
])

CATEGORY_SCHEMA = T.StructType([
    T.StructField("category_key", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("parent_key", T.StringType()),
])

PENDING_SCHEMA = T.StructType([
    T.StructField("ref_code", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("detailed_notes", T.StringType()),
    T.StructField("currency", T.StringType(), False),
    T.StructField("estimated_cost", MONEY_WIDE, False),
    T.StructField("committed_amount", MONEY_WIDE),
    T.StructField("funding_source", T.StringType()),
    T.StructField("target_start_date", T.DateType()),
    T.StructField("expected_completion_date", T.DateType()),
    T.StructField("priority", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("location", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("created_by", T.StringType()),
])

#: Text of a row that the reader could not take apart, and the reason it is refused for.
CORRUPT = "_corrupt_record"
MALFORMED = "malformed_row"

INCOME_RAW_COLUMNS = (
    "row_id", "doc_no", "doc_date", "customer", "currency", "amount", "vat", "grand_total",
    "status", "location",
)
EXPENSE_RAW_COLUMNS = (
    "row_id", "doc_no", "doc_date", "overdue_date", "supplier", "currency", "amount", "vat",
    "grand_total", "status", "type", "location", "category", "subcategory",
)


def column_names(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields]
