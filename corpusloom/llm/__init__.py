"""Operators for large training corpora. Nothing else in corpusloom imports this subpackage."""
