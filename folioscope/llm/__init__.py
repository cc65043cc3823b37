"""Operators for text destined for language models. Nothing else in folioscope imports this subpackage."""
