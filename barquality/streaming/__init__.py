"""Bars from streams, beyond what a batch engine offers."""
