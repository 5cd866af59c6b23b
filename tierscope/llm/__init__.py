"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries`` binds the operators
to the documents/benchmark/pages/conversations/embeddings tables.
"""
