"""Marts, graph, reports and dashboard roll-ups built from the operators."""
