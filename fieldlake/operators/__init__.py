"""DataFrame operators: positions, headers, duplicates, reviews, offsets, totals."""
