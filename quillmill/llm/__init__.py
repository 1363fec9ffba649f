"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries; each operator keeps a general interface in its own module.
"""
