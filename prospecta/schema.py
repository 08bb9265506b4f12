"""Event table schema and the rule that missing text is the empty string."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_FIELDS = (
    "event_id", "accession_number", "cik", "form", "date", "accepted_at", "etf_name", "class_name", "series_name",
    "series_id", "class_id", "ticker", "ticker_at_filing", "ticker_source", "vehicle", "identity_scope", "filer", "link",
    "effectiveness_basis", "designated_effective_date", "effectiveness_label",
)
#: Column order of the event store and of its CSV.
EVENT_FIELDS = (*TEXT_FIELDS[:19], "effectiveness_days", *TEXT_FIELDS[19:])
EVENT_SCHEMA = T.StructType([T.StructField(x, T.IntegerType() if x == "effectiveness_days" else T.StringType()) for x in EVENT_FIELDS])
STORED_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField("ingested_at", T.StringType()), T.StructField("parser_version", T.IntegerType())])
LEDGER_SCHEMA = "accession_number string, cik string, form string, filing_date string, parser_version int, event_count long, ingested_at string"
REGISTRY_SCHEMA = "series_id string, cik string, first_filing_date string, lookup_source string, resolved_at string"
RUN_SCHEMA = (
    "run_id long, mode string, started_at string, completed_at string, start_bound string, end_bound string, ciks_attempted int, "
    "ciks_failed int, filings_processed int, events_added int, error_summary string"
)
NOT_LISTED = "Not Listed"


def as_events(df: DataFrame) -> DataFrame:
    """All event fields: absent or null text is empty, days that are no number are null."""
    def field(name: str):
        if name == "effectiveness_days":
            return (F.expr("try_cast(effectiveness_days AS int)") if name in df.columns else F.lit(None).cast("int")).alias(name)
        return (F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")).alias(name)

    rest = [c for c in df.columns if c not in EVENT_FIELDS]
    return df.select(*map(field, EVENT_FIELDS), *rest)
