"""Readers and writers of sequence files, matrices and profile text files."""
