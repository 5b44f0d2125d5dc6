"""Operators for preparing training text.

Nothing else in the library imports this subpackage. Every operator takes a
DataFrame with a ``doc_id`` and a ``text`` column (others are ignored, so names
that clash with an operator's own do no harm) and treats a null text as empty.
"""
