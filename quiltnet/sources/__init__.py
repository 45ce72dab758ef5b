"""Readers and writers for delimited, annotation and ontology files, and the table model."""
