"""Relational operators: collection, index, retrieval, keywords, dense, re-ranking, evaluation, answers."""
