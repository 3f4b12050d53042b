"""Incremental haplotype counts over a stream of calls."""
