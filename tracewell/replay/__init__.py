"""Training, audited replay and counterfactual branches of a small NumPy decoder, one branch a Spark task."""
