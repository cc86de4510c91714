"""Incremental forms of the audits: the stream checkpoint is the set of finished work."""
