"""Training-data operators: decontamination, chat formatting, licence scans,
line dedup, token counts, language ID, quality rules, SentencePiece, sharding
and the n-gram Jaccard join.  Nothing outside this subpackage imports it."""
