"""Training-data operators: rules, tokens, classifier, mixing, dedup, packing, HTML, joins, search, URL filters."""
