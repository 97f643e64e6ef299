"""Operators of a training-data pipeline and their queries; nothing else in the library imports this package."""
