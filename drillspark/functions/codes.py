"""Texts for coded values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col

# Display texts per code.
PAYMENT_TYPES = {1: "Kreditkarte", 2: "Bargeld", 3: "Keine Zahlung", 4: "Streit", 5: "Unbekannt", 6: "Storniert"}
PAYMENT_TYPES_SHORT = {1: "Kreditkarte", 2: "Bargeld", 3: "Keine Zahlung", 4: "Streit"}
WEEKDAYS = {1: "So", 2: "Mo", 3: "Di", 4: "Mi", 5: "Do", 6: "Fr", 7: "Sa"}
SEVERITIES = {"info": "Info", "warning": "Warning", "error": "Error", "critical": "Critical"}
HTTP_STATUS = {
    200: "200 OK",
    201: "201 Created",
    301: "301 Redirect",
    400: "400 Bad Request",
    404: "404 Not Found",
    500: "500 Internal Error",
    502: "502 Bad Gateway",
    503: "503 Unavailable",
}
CLUSTER_STATUS = {1: "GREEN", 2: "YELLOW", 3: "RED"}
UP_STATUS = {1: "UP", 0: "DOWN"}


def label_codes(code: Column | str, mapping: dict, default: Column | None = None) -> Column:
    """Text of a code; codes outside the mapping get ``default`` (null if there is none)."""
    c = as_col(code)
    cases = None
    for key, text in mapping.items():
        cases = F.when(c == key, text) if cases is None else cases.when(c == key, text)
    return cases if default is None else cases.otherwise(default)


def payment_label(code: Column | str) -> Column:
    c = as_col(code)
    return label_codes(c, PAYMENT_TYPES, F.concat(F.lit("Typ "), c.cast("string")))


def weekday_label(code: Column | str) -> Column:
    c = as_col(code)
    return label_codes(c, WEEKDAYS, c.cast("string"))


def http_label(code: Column | str) -> Column:
    c = as_col(code)
    return label_codes(c, HTTP_STATUS, c.cast("string"))


def severity_label(code: Column | str) -> Column:
    c = as_col(code)
    return label_codes(c, SEVERITIES, c)


def status_text(code: Column | str, mapping: dict = CLUSTER_STATUS) -> Column:
    return label_codes(code, mapping)
