"""Readers and writers of records, bundles, primitives and exports."""
