"""Training-data operators: tokens, duplicates, secrets, language, mixing, decontamination."""
