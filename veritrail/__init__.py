"""Audits of retrieval-augmented question answering as DataFrame transformations."""
