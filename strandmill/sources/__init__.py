"""Readers and writers of reads, k-mers, edges and clusters."""
