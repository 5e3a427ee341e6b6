"""Scam and phishing risk scoring over Spark DataFrames."""
