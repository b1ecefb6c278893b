"""DataFrame operators: alignments, variants, graphs, statistics, curation and reports."""
