"""Registered queries and their SQL."""

from lodestrata.plans import architecture, chat, chunking, code, corpus, graph, localisation, search  # noqa: F401
