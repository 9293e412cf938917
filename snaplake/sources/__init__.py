"""Readers: work trees, file lists, packs, remote catalogues."""
