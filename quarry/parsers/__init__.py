"""Parsers of filing envelopes, XML forms and HTML."""
