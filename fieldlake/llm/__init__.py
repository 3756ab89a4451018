"""Training-data operators: ten operators over documents, vectors and pages, and their queries."""
