"""Readers and writers: JSON splits, driver tables, TREC runs, thesaurus."""
