"""The stock rule fed by a stream of sale lines."""
