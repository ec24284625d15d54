"""Operators over the relations objects, edges, refs, chunks and vectors."""
