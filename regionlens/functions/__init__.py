"""Native column expressions (no Python UDFs)."""

from regionlens.functions.scalar import (  # noqa: F401
    clamp,
    clean_text,
    format_round,
    hash_unit,
    is_missing_text,
    log10_1p,
    log10_positive,
    logistic,
    pad_key,
    parse_header_date,
    rate,
    ratio,
    round_half_even,
    round_to,
    strip_number_text,
    threshold_label,
    to_number,
)
