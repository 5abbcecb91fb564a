"""Training-data operators: cleaning, matching, sampling and scoring of text tables."""
