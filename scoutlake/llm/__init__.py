"""Training-data operators: fingerprints, token counts, near-duplicate detection, packing, classifiers,
tokenisation, chat formatting and HTML extraction, each a job over Spark DataFrames.

Nothing else in the library imports this subpackage."""
