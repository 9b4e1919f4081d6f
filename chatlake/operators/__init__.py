"""Operators: analytics, text labelling, knowledge base, state jobs, limits."""
