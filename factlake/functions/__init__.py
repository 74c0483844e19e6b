"""Paging and cursors, labels and keys: what answers share."""
