"""Chains of operators: typed actions, replayable plans, suggestions, rule packs, audit."""
