"""Readers and writers; every one plans a distributed job over a set of paths."""
