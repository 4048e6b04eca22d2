"""Readers and writers: corpora, named splits, saved vocabularies, training logs."""
