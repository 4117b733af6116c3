"""Detectors over streams of relations."""
