"""Training-data operators: ten scalable DataFrame-to-DataFrame stages and their queries."""
