"""Names, hosts and suffixes of labelled metrics. Labels are a MAP<STRING, STRING>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col

# Labels that never enter the metric name, and suffixes of quantiles.
STANDARD_LABELS = ["job", "instance"]
IGNORED_LABELS = ["base_url", "cluster_id", "core", "fstype", "__name__"]
HISTOGRAM_LABELS = ["quantile", "le"]
QUANTILE_SUFFIX = {
    "0.5": "_p50",
    "0.75": "_p75",
    "0.9": "_p90",
    "0.95": "_p95",
    "0.99": "_p99",
    "0.999": "_p999",
    "1": "_p100",
}


def label(labels: Column | str, name: str) -> Column:
    """Value of a label; a missing label is the empty text."""
    return F.coalesce(F.element_at(as_col(labels), F.lit(name)), F.lit(""))


def host_of(instance: Column | str) -> Column:
    """``node1.nodes.example:9100`` -> ``node1``; without a dot the text before the colon."""
    c = F.coalesce(as_col(instance), F.lit(""))
    return F.when(F.contains(c, F.lit(".")), F.substring_index(c, ".", 1)).otherwise(F.substring_index(c, ":", 1))


def strip_job(name: Column | str, job: Column | str) -> Column:
    """Metric name without a leading ``<job>_``."""
    n, j = as_col(name), as_col(job)
    leads = (j != "") & F.startswith(n, F.concat(j, F.lit("_")))
    return F.when(leads, n.substr(F.length(j) + 2, F.length(n))).otherwise(n)


def name_parts(name: Column | str) -> Column:
    return F.split(as_col(name), "_", -1)


def name_prefixes(name: Column | str) -> Column:
    """All prefixes of a name cut at ``_``, shortest first."""
    parts = name_parts(name)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "_"))


def label_suffix(labels: Column | str) -> Column:
    """Remaining labels as ``key_value`` in key order; ``/`` and blanks become ``_``; empty without labels."""
    skipped = [*STANDARD_LABELS, *IGNORED_LABELS, *HISTOGRAM_LABELS]
    kept = F.map_filter(as_col(labels), lambda k, v: ~k.isin(skipped))
    entries = F.array_sort(F.map_entries(kept))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("_"), F.translate(e["value"], "/ ", "__"))), "_"
    )


def quantile_suffix(quantile: Column | str) -> Column:
    """``0.99`` -> ``_p99``; unknown quantiles keep their digits; empty without a quantile."""
    q = as_col(quantile)
    text = F.concat(F.lit("_p"), F.replace(q, F.lit("."), F.lit("")))
    for known, suffix in QUANTILE_SUFFIX.items():
        text = F.when(q == known, suffix).otherwise(text)
    return F.coalesce(text, F.lit(""))
