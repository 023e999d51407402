"""Readers, decoders, encoders and writers."""
