"""Training-data operators: joins on n-grams, decontamination, quality, chat, language, scoring, secrets, BPE, PII, HTML."""
