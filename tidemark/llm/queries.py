"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op03_substring, op04_decontaminate, op10_licenses
from .op01_secrets import op1_secret_scan
from .op02_pii import op2_pii
from .op05_quality import op5_line_quality
from .op06_html import op6_html_text
from .op07_token_ids import op7_token_ids
from .op08_simhash import op8_simhash
from .op09_packing import op9_best_fit_packing
from .op11_language import op11_language
from .op12_periodic_runs import op12_periodic_runs
from .op13_spelling import op13_spelling_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_pii,
        op03_substring.op3_substring_dedup,
        op04_decontaminate.op4_decontaminate,
        op5_line_quality,
        op6_html_text,
        op7_token_ids,
        op8_simhash,
        op9_best_fit_packing,
        op10_licenses.op10_license_scan,
        op11_language,
        op12_periodic_runs,
        op13_spelling_variants,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": op03_substring.ORACLE_SQL,
    "op4_decontaminate": op04_decontaminate.ORACLE_SQL,
    "op10_license_scan": op10_licenses.oracle(),
}
