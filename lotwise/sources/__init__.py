"""Readers, row mappers and sinks."""
