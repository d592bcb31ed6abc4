"""rookery.streaming"""
