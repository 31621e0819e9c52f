"""Spark-native accounts-payable reconciliation and exception analytics."""
