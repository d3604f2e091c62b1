"""Scans (SRC-*) and writers (SNK-*) with explicit schemas; nothing is inferred."""
