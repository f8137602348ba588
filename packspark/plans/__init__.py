"""packspark.plans"""
