"""packspark.operators"""
