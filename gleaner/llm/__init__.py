"""Operators of a training-data pipeline over text and sampling; nothing outside this folder imports it."""
