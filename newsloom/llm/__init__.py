"""Training-data operators: PII, quality, WARC, token counts, toxicity, chat,
language, decontamination, packing and near-duplicates.

Nothing else in the library imports this subpackage."""
