"""rookery.sources"""
