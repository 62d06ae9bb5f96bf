"""Whole jobs built from the operators: experiments, searches and explanations."""
