"""Readers and writers of catalogs, candidates, labels, tasks, sidecar files and reports."""
