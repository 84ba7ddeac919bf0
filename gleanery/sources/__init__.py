"""Readers and writers of annotation, list, log and report files."""
