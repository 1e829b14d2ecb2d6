"""Operators for language-model training data: documents in, decisions per document out."""
