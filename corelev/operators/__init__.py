"""DataFrame operators: moments, scores, samplers, probit fits, posteriors, distances, summaries."""
