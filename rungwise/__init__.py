"""Spark-native vector-search analytics: budget-graded k-NN, labels, policies, objectives and ledgers."""
