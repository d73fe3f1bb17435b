"""Readers and writers: annotated corpora, request logs, server-sent events, reports."""
