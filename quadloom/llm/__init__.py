"""Operators that prepare training text: nothing else in quadloom imports this subpackage."""
