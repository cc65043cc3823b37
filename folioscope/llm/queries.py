"""The queries of this subpackage by name; those whose result SQL can't express have tests in tests/llm instead."""

from __future__ import annotations

from folioscope.llm import abuse, encode, mixture, pairs, scannoise, sharedspans
from folioscope.sources.tables import table

QUERIES = {
    "p2_found": lambda spark, d: pairs.found(table(spark, d, "prompt_pairs")),
    "p4_found": lambda spark, d: scannoise.found(table(spark, d, "ocr_pages")),
    "p4_repaired": lambda spark, d: scannoise.repaired(table(spark, d, "ocr_pages")),
    "p5_found": lambda spark, d: sharedspans.found(table(spark, d, "ocr_pages")),
    "p5_shared": lambda spark, d: sharedspans.shared_amounts(table(spark, d, "ocr_pages")),
    "p7_ids": lambda spark, d: encode.ids(table(spark, d, "documents")),
    "p8_mix": lambda spark, d: mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")),
    "p8_shares": lambda spark, d: mixture.shares(table(spark, d, "documents"), table(spark, d, "mix_targets")),
    "p9_found": lambda spark, d: abuse.found(table(spark, d, "documents"), table(spark, d, "review_labels")),
    "p9_scores": lambda spark, d: abuse.scored(table(spark, d, "documents"), table(spark, d, "review_labels")),
    "p9_rates": lambda spark, d: abuse.rates(table(spark, d, "documents"), table(spark, d, "review_labels")),
}
ORACLES: dict[str, str] = {}
