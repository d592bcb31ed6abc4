"""rookery.operators"""
