"""Column functions: built-in expressions only, evaluated in the JVM."""

from factorloom.functions.columns import (
    bare_chrom,
    chrom_sort_key,
    direction_label,
    dot,
    interval_name,
    is_primary_interval,
    p_one_tailed,
    parse_interval,
    relu,
    safe_ratio,
    significance_class,
    significance_labels,
    significant,
    strict_bool,
)

__all__ = [
    "bare_chrom",
    "chrom_sort_key",
    "direction_label",
    "dot",
    "interval_name",
    "is_primary_interval",
    "p_one_tailed",
    "parse_interval",
    "relu",
    "safe_ratio",
    "significance_class",
    "significance_labels",
    "significant",
    "strict_bool",
]
