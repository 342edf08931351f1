"""Readers and writers: FASTA (batch and stream) and Newick text."""
