"""Training-data operators for text corpora, vectors and URLs.

Each module holds one operator with its own general interface; ``queries``
derives the registered queries from them.  Nothing outside this subpackage
imports it.
"""
