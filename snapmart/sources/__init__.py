"""Readers, partitioned writers, audits and model artefacts."""
