"""rookery.functions"""
