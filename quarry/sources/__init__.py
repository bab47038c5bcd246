"""Readers and writers of graphs, knowledge bases, question sets and run outputs."""
