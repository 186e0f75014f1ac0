"""Reusable table operators: additive facts, ranking, gates."""
