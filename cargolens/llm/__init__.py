"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; delete it and the rest works."""
