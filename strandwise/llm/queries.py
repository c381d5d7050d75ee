"""Registry of this subpackage's queries."""

from __future__ import annotations

from strandwise.llm import decontaminate, exact_dedup, html_templates, packing, pii, quality, secret_scan, simhash, toxicity, url_filter

QUERIES = {
    "op1_html_templates": html_templates.query,
    "op2_quality": quality.query,
    "op3_secret_scan": secret_scan.query,
    "op4_url_filter": url_filter.query,
    "op5_decontaminate": decontaminate.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_packing": packing.query,
    "op8_simhash": simhash.query,
    "op9_toxicity": toxicity.query,
    "op10_pii": pii.query,
}

ORACLES = {
    "op4_url_filter": url_filter.oracle(),
    "op6_exact_dedup": exact_dedup.ORACLE,
}
