"""Operators for training-data pipelines.

Nothing outside this folder imports it: the folder can be removed and the rest
of the library still works.  One module per operator; ``queries`` holds the
thin registered queries, ``text`` the byte-level helpers that several share.
"""
