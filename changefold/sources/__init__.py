"""Readers and decoders that produce change envelopes."""
