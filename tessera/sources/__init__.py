"""Readers and writers of artifacts, catalogs, feedback logs, training sets and stores."""
