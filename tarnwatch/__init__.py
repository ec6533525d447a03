"""Package-risk analytics on Spark: findings, scores and roll-ups computed set-at-a-time."""
