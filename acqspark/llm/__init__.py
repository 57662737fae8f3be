"""Training-data operators: language id, archive conversion, token counts,
quality rules, token-id files, near-duplicate removal, BPE with a compiled
lexicon, line deduplication, curve sharding, benchmark decontamination,
conversation prefix trie, toxicity and hard-negative mining.

Nothing else in the library imports this subpackage."""
