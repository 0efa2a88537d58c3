"""Training-data operators: sharding, near-duplicates, exact and approximate
nearest neighbours, language ID, chat formatting, mixing, toxicity, packing and
language-model scoring.  Nothing outside this package imports it except the
guarded registration in ``__spark_entry__``."""
