"""Readers, writers, sample generators and the bindings of the bundled tables."""
