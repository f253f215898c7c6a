"""Training-data operators: deduplication, tokenization, extraction, decontamination and quality scoring on Spark."""
