"""Operators for preparing large text corpora.

Nothing else in the package imports this subpackage.  Input rules shared by all operators:
a row whose identifier is null is left out (no result could name it), a null text counts as
empty, columns other than those an operator names are ignored whatever they are called, and an
empty table gives an empty result with the same columns.
"""
