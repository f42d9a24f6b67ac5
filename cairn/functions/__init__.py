"""Scalar functions, filter codecs and configuration parsers."""
