"""Operators for building language-model training sets, and their registered queries."""
