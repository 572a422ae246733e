"""Pipelines that combine the operators."""
