"""Readers and writers of corpora, questions, judgements and results."""
