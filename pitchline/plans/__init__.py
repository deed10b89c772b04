"""End-to-end plans: fitting scores, model registry, training, prediction, evaluation."""
