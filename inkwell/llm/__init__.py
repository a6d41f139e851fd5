"""Training-data operators: dedup, decontamination, scoring, mixing. Nothing outside this folder imports it."""
