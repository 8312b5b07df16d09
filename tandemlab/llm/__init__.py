"""Operators for training and evaluation text. Nothing outside this subpackage imports it."""
