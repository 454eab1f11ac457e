"""End-to-end jobs (detect, score, review) and the registered queries."""
