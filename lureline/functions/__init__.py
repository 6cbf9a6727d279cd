from lureline.functions.expressions import (  # noqa: F401
    clamp,
    html_to_text,
    keyed_uniform,
    keyed_bernoulli,
    lookup,
    na_to_null,
    normalize_label,
    safe_rate,
    sanitize_name,
    sigmoid,
    signal_flag,
    join_text,
)
