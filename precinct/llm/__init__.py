"""Operators for building training corpora out of documents, web pages and conversations.

Nothing outside this folder imports it. Each module is one operator; ``queries`` applies
them to the test tables.
"""
