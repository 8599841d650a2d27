"""Readers and writers of sequence files and saved assemblies."""
